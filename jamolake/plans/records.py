"""Queries of segment records: sessions cut into segments, lookups, splits and small projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import filters, joins, report, segments, splits
from ._registry import registry
from .base import SENT, sentences, sql_split, table
from .names import _ASCII, latin

QUERIES, ORACLES, query = registry()

# Turns of conversations stand for sessions. Regions are as many as sentences, one more or one less
# by turn; some sessions lack a signal or a transcript, or could not be read.
_SESSIONS = f"""s AS (SELECT conv_id * 1000 + turn AS session, CASE WHEN (conv_id + turn) % 13 = 0 THEN '' ELSE text END AS transcript, (conv_id + turn) % 17 = 0 AS read_error, CASE WHEN (conv_id + turn) % 11 <> 0 THEN 'x.wav' END AS wav,
  {sql_split("CASE WHEN (conv_id + turn) % 13 = 0 THEN '' ELSE text END")} AS sentences, {sql_split('text')} AS all_s, (conv_id + turn) AS k FROM conversations),
r AS (SELECT *, list_transform(range(greatest(0, len(all_s) + CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END)), lambda i: {{'start': i * 30.0, 'duration': (k * 7 + i * 5) % 23}}) AS regions FROM s),
g AS (SELECT *, len(regions) AS n, len(sentences) AS m, CASE WHEN read_error THEN 'read_error' WHEN transcript = '' THEN 'no_transcript' WHEN wav IS NULL THEN 'no_wav' WHEN len(sentences) = 0 THEN 'no_sentences' WHEN len(regions) = 0 THEN 'no_regions' WHEN abs(len(regions) - len(sentences)) / greatest(len(sentences), 1) > 0.1 THEN 'count_mismatch' ELSE 'passed' END AS reason FROM r),
p AS (SELECT session, n, m, i - 1 AS idx, regions[i].start AS start, regions[i].duration AS duration, sentences[i] AS sentence FROM (SELECT *, unnest(range(1, least(n, m) + 1)) AS i FROM g WHERE reason = 'passed') q)"""


def segmented(spark, sf):
    c = table(spark, sf, "conversations").withColumn("k", F.col("conv_id") + F.col("turn"))
    n = F.greatest(F.lit(0), F.size(t.split_transcript(F.col("text"))) + F.when(F.col("k") % 5 == 0, 1).when(F.col("k") % 5 == 1, -1).otherwise(0))
    region = lambda i: F.struct((i * 30.0).alias("start"), (i * 30.0 + (F.col("k") * 7 + i * 5) % 23).alias("end"), ((F.col("k") * 7 + i * 5) % 23).cast("double").alias("duration"))
    regions = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), region)
    s = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("session"), F.when(F.col("k") % 13 == 0, "").otherwise(F.col("text")).alias("transcript"), (F.col("k") % 17 == 0).alias("read_error"), F.when(F.col("k") % 11 != 0, "x.wav").alias("wav"), regions.alias("regions"))
    return segments.segment_sessions(s)


@query("seg_segments", rf"WITH {_SESSIONS} SELECT session, n AS n_regions, m AS n_sentences, idx AS index, start::DOUBLE AS start, duration::DOUBLE AS duration, sentence FROM p WHERE duration BETWEEN 0.5 AND 20")
def seg_segments(spark, sf):
    s = segments.session_segments(segmented(spark, sf), "session").drop("end")
    return s.withColumns({c: F.col(c).cast("long") for c in ("n_regions", "n_sentences", "index")})


@query("seg_reasons", rf"""WITH {_SESSIONS}, a AS (SELECT reason, 1 AS n FROM g UNION ALL SELECT 'mismatch_n' || n || '_m' || m, 1 FROM g WHERE reason = 'count_mismatch' UNION ALL SELECT 'bad_duration', 1 FROM p WHERE duration NOT BETWEEN 0.5 AND 20)
SELECT reason, sum(n)::BIGINT AS n FROM a GROUP BY reason""")
def seg_reasons(spark, sf):
    return segments.session_reasons(segmented(spark, sf))


@query("flt_worth_scoring", "SELECT event_id FROM events WHERE value * 1000 >= 4800 AND event_type <> ''")
def flt_worth_scoring(spark, sf):
    return table(spark, sf, "events").where(filters.worth_scoring(F.col("value") * 1000, F.col("event_type"))).select("event_id")


@query("flt_labelled_between", r"SELECT p_partkey FROM part WHERE p_size > 1 AND p_size < 20 AND trim(p_name) <> '' AND trim(p_type) <> ''")
def flt_labelled_between(spark, sf):
    return table(spark, sf, "part").where(filters.duration_between(F.col("p_size").cast("double"), 1.0, 20.0) & filters.filled(F.col("p_name"), F.col("p_type"))).select("p_partkey")


@query("prj_default_fill", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.a.b'), '') AS nested FROM events")
def prj_default_fill(spark, sf):
    p = F.from_json("props", "k string, a struct<b: string>")
    return table(spark, sf, "events").select("event_id", t.or_empty(p["k"]).alias("k"), t.or_empty(p["a"]["b"]).alias("nested"))


@query("prj_in_folder", "SELECT page_id, replace(replace(url, '/en/', '/source/'), 'http', 'file') AS path FROM pages")
def prj_in_folder(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.in_folder(F.col("url"), {"/en/": "/source/", "http": "file"}).alias("path"))


@query("prj_label", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(trim(p_name)) ELSE trim(p_type) END AS label FROM part")
def prj_label(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.label_of(F.col("p_name"), F.col("p_type"), F.col("p_partkey") % 2 == 0, F.upper).alias("label"))


@query("prj_error_row", "SELECT o_orderkey, o_orderpriority AS target_text, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE 100.0::DOUBLE / (o_orderkey % 7) END AS score, CASE WHEN o_orderkey % 7 = 0 THEN 'no divisor' END AS error FROM orders")
def prj_error_row(spark, sf):
    n = F.col("o_orderkey") % 7
    return table(spark, sf, "orders").select("o_orderkey", report.error_row(F.col("o_orderpriority"), F.try_divide(F.lit(100.0), n), F.when(n == 0, "no divisor")).alias("r")).select("o_orderkey", "r.*")


@query("fn_nearly_matches", f"{_ASCII}, m AS (SELECT utt, x, y, list_sum(list_transform(range(1, least(length(x), length(y)) + 1), lambda i: (substr(x, i, 1) = substr(y, i, 1))::INT)) / greatest(length(x), length(y)) AS r FROM q) SELECT utt, r AS rate, r > 0.5 AND length(x) > 3 AND length(y) > 3 AS nearly FROM m")
def fn_nearly_matches(spark, sf):
    return latin(spark, sf).select("utt", t.match_rate(F.col("x"), F.col("y")).alias("rate"), t.nearly_matches(F.col("x"), F.col("y")).alias("nearly"))


@query("jon_by_place", """WITH c AS (SELECT conv_id, role, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS place FROM conversations)
SELECT a.conv_id, a.place::BIGINT AS place, a.n AS n_prediction, b.n AS n_reference FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.place = b.place AND a.role = 'user' AND b.role = 'assistant'""")
def jon_by_place(spark, sf):
    side = lambda role, name: table(spark, sf, "conversations").where(F.col("role") == role).select("conv_id", "turn", F.length("text").cast("long").alias(name))
    return joins.pair_by_place(side("user", "n_prediction"), side("assistant", "n_reference"), "conv_id", "turn").withColumn("place", F.col("place").cast("long"))


@query("jon_first_match", "SELECT p.page_id, url FROM pages p WHERE page_id IN (SELECT doc_id FROM labels) ORDER BY url, page_id LIMIT 1")
def jon_first_match(spark, sf):
    pages, labels = table(spark, sf, "pages").select("page_id", "url"), table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"))
    return joins.first_match(pages, labels, "page_id", "url", "page_id")


_FOLD = r"regexp_replace(s, '[^\x00-\x7F]', '?', 'g')"


@query("jon_chunks", rf"""WITH {SENT}, f AS (SELECT conv_id, utt, role, turn, pos, substr({_FOLD}, 1, 30) AS s FROM sent),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY utt) AS k FROM f WHERE role = 'user') q WHERE k <= 10),
p AS (SELECT c.conv_id, c.utt AS left_id, f.utt AS other, 1 - levenshtein(c.s, f.s)::DOUBLE / greatest(length(c.s), length(f.s)) AS score FROM c JOIN f ON c.conv_id = f.conv_id AND f.role = 'assistant'),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, other) AS k FROM p WHERE score > 0.15)
SELECT conv_id, left_id, other, round_even(score, 6) AS score FROM r WHERE k = 1""")
def jon_chunks(spark, sf):
    from pyspark.sql import Window as W

    s = sentences(spark, sf).withColumn("s", F.regexp_replace("s", r"[^\x00-\x7F]", "?"))
    chunks = s.where("role = 'user'").select("conv_id", F.col("utt").alias("left_id"), (F.row_number().over(W.partitionBy("conv_id").orderBy("utt")) - 1).alias("place"), F.col("s").alias("chunk"))
    score = 1 - F.levenshtein("chunk", "sentence") / F.greatest(F.length("chunk"), F.length("sentence"))
    got = joins.match_chunks(chunks, s.where("role = 'assistant'").select("conv_id", F.col("utt").alias("other"), F.col("s").alias("sentence")), "conv_id", score, accept=0.15)
    return got.withColumn("score", F.bround("score", 6))


@query("jon_two_producers", "WITH x AS (SELECT o_custkey AS c, min(o_orderpriority) AS x FROM orders GROUP BY 1), y AS (SELECT c_custkey AS c, c_mktsegment AS y FROM customer) SELECT c, x, y FROM x JOIN y USING (c)")
def jon_two_producers(spark, sf):
    x = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.min("o_orderpriority").alias("x"))
    return joins.paired(x, table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), F.col("c_mktsegment").alias("y")), "c")


_AUDIO = "SELECT CASE doc_id % 4 WHEN 0 THEN 'id' || doc_id WHEN 1 THEN 'doc' || doc_id || '.wav' WHEN 2 THEN 'source/' || doc_id || '.flac' ELSE 'other' || doc_id END AS k, doc_id AS v FROM labels"


@query("jon_audio_fallback", f"""WITH a AS ({_AUDIO}) SELECT doc_id, coalesce(a1.v, a2.v, a3.v, a4.v, a5.v) AS v FROM documents d LEFT JOIN a a1 ON a1.k = 'id' || doc_id LEFT JOIN a a2 ON a2.k = 'doc' || doc_id || '.wav'
LEFT JOIN a a3 ON a3.k = 'source/' || doc_id || '.wav' LEFT JOIN a a4 ON a4.k = 'source/' || doc_id || '.flac' LEFT JOIN a a5 ON a5.k = 'source/' || doc_id || '.mp3'""")
def jon_audio_fallback(spark, sf):
    i = F.col("doc_id")
    s = i.cast("string")
    kinds = F.when(i % 4 == 0, F.concat(F.lit("id"), s)).when(i % 4 == 1, F.concat(F.lit("doc"), s, F.lit(".wav"))).when(i % 4 == 2, F.concat(F.lit("source/"), s, F.lit(".flac"))).otherwise(F.concat(F.lit("other"), s))
    audio = table(spark, sf, "labels").select(kinds.alias("k"), i.alias("v"))
    stem = t.in_folder(F.concat(F.lit("labels/"), s), {"labels": "source"})
    keys = [F.concat(F.lit("id"), s), F.concat(F.lit("doc"), s, F.lit(".wav")), *[F.concat(stem, F.lit(e)) for e in (".wav", ".flac", ".mp3")]]
    return joins.fallback_join(table(spark, sf, "documents").select("doc_id"), audio, keys, "k", "v")


@query("ord_positional_split", "SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY c_name, c_custkey) <= floor((SELECT count(*) FROM customer) * 0.9) THEN 'train' ELSE 'eval' END AS split FROM customer")
def ord_positional_split(spark, sf):
    return splits.positional_split(table(spark, sf, "customer").select("c_name", "c_custkey"), "c_name", "c_custkey").select("c_custkey", "split")


@query("ord_split_limits", """WITH c AS (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY c_custkey) AS k FROM c)
SELECT c_custkey, split FROM r WHERE split = 'test' OR split = 'train' AND k <= 50 OR split = 'validation' AND k <= 20""")
def ord_split_limits(spark, sf):
    n = F.col("c_nationkey") % 3
    c = table(spark, sf, "customer").select("c_custkey", F.when(n == 0, "train").when(n == 1, "validation").otherwise("test").alias("split"))
    return splits.limited(c, {"train": 50, "validation": 20, "test": 0}, "c_custkey")


@query("set_letter_inventory", "SELECT n, c FROM (SELECT nation.n_name AS n, string_split(n_name, '') || string_split(r_name, '') AS l FROM nation JOIN region ON n_regionkey = r_regionkey) q, unnest(list_distinct(l)) AS u(c)")
def set_letter_inventory(spark, sf):
    from ..functions.hangul import chars

    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("n"), F.explode(F.array_union(chars(F.col("n_name")), chars(F.col("r_name")))).alias("c"))


@query("snk_markdown_table", r"SELECT '## Regions' || chr(10) || '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS report FROM region")
def snk_markdown_table(spark, sf):
    return report.markdown_table(table(spark, sf, "region").select("r_regionkey", "r_name"), "Regions", ["r_regionkey"])


@query("snk_console_lines", "SELECT p - 1 AS place, l AS line FROM (SELECT [rpad('n', 28, ' ') || ' ' || count(*), rpad('largest', 28, ' ') || ' ' || max(r_name)] AS ls FROM region) q, unnest(ls) WITH ORDINALITY AS u(l, p)")
def snk_console_lines(spark, sf):
    m = table(spark, sf, "region").agg(F.count("*").alias("n"), F.max("r_name").alias("largest"))
    return report.console_lines(m).withColumn("place", F.col("place").cast("long"))
