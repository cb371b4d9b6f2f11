"""Queries of filters, joins, groups, windows, splits and segmentation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank, split_transcript
from ..operators import filters, joins, segments, selection, splits
from ..streaming.sessions import session_regions, tumbling_chunks
from ..streaming.speakers import speaker_profiles
from ._registry import registry
from .base import SENT, sentences, sql_split, table

QUERIES, ORACLES, query = registry()


@query("flt_duration_incl", "SELECT event_id, user_id, value FROM events WHERE coalesce(value, 0) BETWEEN 0.5 AND 25")
def flt_duration_incl(spark, sf):
    return table(spark, sf, "events").where(filters.duration_within(F.col("value"))).select("event_id", "user_id", "value")


@query("flt_duration_excl", "SELECT event_id, user_id, value FROM events WHERE coalesce(value, 0) > 1 AND coalesce(value, 0) < 10")
def flt_duration_excl(spark, sf):
    return table(spark, sf, "events").where(filters.duration_between(F.col("value"))).select("event_id", "user_id", "value")


@query("agg_duration_reasons", "SELECT event_type, CASE WHEN coalesce(value, 0) < 0.5 THEN 'short' WHEN coalesce(value, 0) > 25 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n FROM events GROUP BY ALL")
def agg_duration_reasons(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", filters.duration_reason(F.col("value")).alias("reason")).agg(F.count("*").alias("n"))


@query("flt_filled", r"SELECT conv_id, turn FROM conversations WHERE regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') <> '' AND length(role) >= 2")
def flt_filled(spark, sf):
    return table(spark, sf, "conversations").where(filters.filled(F.col("text")) & filters.usable_label(F.col("role"))).select("conv_id", "turn")


_GATE = f"{SENT}, n AS (SELECT conv_id, count_if(role = 'user')::BIGINT AS n, count_if(role = 'assistant')::BIGINT AS m FROM sent GROUP BY conv_id)"


@query("flt_quality_gate", f"WITH {_GATE} SELECT conv_id, n, m FROM n WHERE abs(n - m) / greatest(m, 1) <= 0.5")
def flt_quality_gate(spark, sf):
    n = sentences(spark, sf).groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n"), F.count_if(F.col("role") == "assistant").alias("m"))
    return n.where(segments.count_gate(F.col("n"), F.col("m"), 0.5))


@query("jon_hash_inner", "SELECT source, quality, toxic, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def jon_hash_inner(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("source", "quality", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("jon_anti_reject", "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def jon_anti_reject(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@query("jon_semi", "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jon_semi(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("jon_zip", f"""WITH {SENT}, o AS (SELECT conv_id, role, s, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, pos) - 1 AS pos FROM sent)
SELECT u.conv_id, u.pos, u.s AS region, a.s AS sentence FROM o u JOIN o a ON u.conv_id = a.conv_id AND u.pos = a.pos WHERE u.role = 'user' AND a.role = 'assistant'""")
def jon_zip(spark, sf):
    o = sentences(spark, sf).withColumn("pos", F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn", "pos")).cast("long") - 1)
    side = lambda role, name: o.where(F.col("role") == role).select("conv_id", "pos", F.col("s").alias(name))
    return segments.zip_join(side("user", "region"), side("assistant", "sentence"), "conv_id")


@query("jon_fallback", "SELECT d.doc_id, coalesce(a.quality, b.quality, c.quality) AS quality FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN labels b ON b.doc_id = d.doc_id + 1 LEFT JOIN labels c ON c.doc_id = d.doc_id + 2")
def jon_fallback(spark, sf):
    keys = [F.col("doc_id"), F.col("doc_id") + 1, F.col("doc_id") + 2]
    return joins.fallback_join(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), keys, "doc_id", "quality")


@query("jon_latest_by_key", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) q WHERE k = 1")
def jon_latest_by_key(spark, sf):
    return joins.latest_by_key(table(spark, sf, "events"), "user_id", "event_type", "event_id")


@query("jon_nation_revenue", "SELECT n_name, count(DISTINCT o_orderkey) AS n_orders, round_even(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def jon_nation_revenue(spark, sf):
    l, o, c, n = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation"))
    # lines are summed per order before they meet the customers
    per_order = l.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    j = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.bround(F.sum("r"), 2).alias("revenue"))


@query("agg_reject_reasons", rf"""WITH c AS (SELECT d.doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') = '' AS no_text, l.doc_id IS NULL AS no_wav, len({sql_split("coalesce(text, '')")}) AS n, quality
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT CASE WHEN no_text THEN 'no_transcript' WHEN no_wav THEN 'no_wav' WHEN n = 0 THEN 'no_sentences' WHEN quality = 0 THEN 'count_mismatch' ELSE 'passed' END AS reason, count(*) AS n FROM c GROUP BY 1""")
def agg_reject_reasons(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("wav"))
    d = table(spark, sf, "documents").select("doc_id", "text").join(l, "doc_id", "left")
    checks = {"no_transcript": is_blank(F.col("text")), "no_wav": F.col("wav").isNull(), "no_sentences": F.size(split_transcript(F.coalesce("text", F.lit("")))) == 0, "count_mismatch": F.col("quality") == 0}
    return segments.reason_counts(d.select(segments.reject_reason(checks).alias("reason")))


@query("agg_mismatch_keys", f"WITH {_GATE} SELECT 'mismatch_n' || n || '_m' || m AS k, count(*) AS n_sessions FROM n WHERE n <> m GROUP BY 1")
def agg_mismatch_keys(spark, sf):
    n = sentences(spark, sf).groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n"), F.count_if(F.col("role") == "assistant").alias("m"))
    return n.where("n <> m").groupBy(F.format_string("mismatch_n%d_m%d", "n", "m").alias("k")).agg(F.count("*").alias("n_sessions"))


@query("agg_duration_stats", "SELECT event_type, round_even(avg(value), 6) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type")
def agg_duration_stats(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value")
    return selection.with_medians(e.groupBy("event_type").agg(F.bround(F.avg("value"), 6).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi")), e, "value", "median", "event_type")


@query("agg_per_session", f"WITH {SENT} SELECT count(*) AS n_segments, count(DISTINCT conv_id) AS n_sessions, round_even(count(*)::DOUBLE / greatest(count(DISTINCT conv_id), 1), 4) AS per_session FROM sent")
def agg_per_session(spark, sf):
    per = sentences(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_segments"), F.count("*").alias("n_sessions"), F.bround(F.coalesce(F.sum("n"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1)), 4).alias("per_session"))


@query("agg_training_estimates", "WITH n AS (SELECT count(*) AS n FROM events) SELECT n // 16 AS steps, greatest(500, n // 16 // 2) AS eval_steps, round_even((n // 32) * 5 * 89 / 3600.0::DOUBLE, 4) AS hours, round_even(n / 12.0::DOUBLE / 60, 4) AS minutes FROM n")
def agg_training_estimates(spark, sf):
    n = table(spark, sf, "events").agg(F.count("*").alias("n"))
    steps = F.floor(F.col("n") / 16)
    return n.select(steps.alias("steps"), F.greatest(F.lit(500).cast("long"), F.floor(steps / 2)).alias("eval_steps"), F.bround(F.floor(F.col("n") / 32) * 5 * 89 / F.lit(3600.0), 4).alias("hours"), F.bround(F.col("n") / 12 / 60, 4).alias("minutes"))


@query("agg_speaker_retention", "WITH s AS (SELECT count(DISTINCT user_id) AS b, count(DISTINCT CASE WHEN value >= 0.5 THEN user_id END) AS a FROM events) SELECT b AS n_before, a AS n_after, round_even(a::DOUBLE / b, 4) AS retained FROM s")
def agg_speaker_retention(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id").agg(F.max((F.col("value") >= 0.5).cast("int")).alias("kept"))
    return per.agg(F.count("*").alias("n_before"), F.sum("kept").alias("n_after"), F.bround(F.sum("kept") / F.count("*"), 4).alias("retained"))


@query("win_linking_lookback", """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events""")
def win_linking_lookback(spark, sf):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    return table(spark, sf, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("before"))


@query("win_adjacent_pairs", "SELECT event_type AS first, nxt AS second, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) q WHERE nxt IS NOT NULL GROUP BY ALL")
def win_adjacent_pairs(spark, sf):
    nxt = F.lead("event_type").over(W.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf, "events").select(F.col("event_type").alias("first"), nxt.alias("second")).where("second IS NOT NULL").groupBy("first", "second").agg(F.count("*").alias("n"))


@query("ord_topk_speakers", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, min(event_id) LIMIT 5")
def ord_topk_speakers(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first")).orderBy(F.desc("n"), "first").limit(5).select("user_id", "n")


_PLACED = "p AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id || '-42'), user_id) AS place, count(*) OVER () AS total FROM (SELECT DISTINCT user_id FROM events) q)"


@query("ord_speaker_split", f"WITH {_PLACED} SELECT CASE WHEN place <= floor(total * 0.8) THEN 'train' WHEN place <= floor(total * 0.8) + floor(total * 0.1) THEN 'validation' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT user_id) AS n_speakers FROM events JOIN p USING (user_id) GROUP BY 1")
def ord_speaker_split(spark, sf):
    return splits.speaker_split(table(spark, sf, "events"), "user_id").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_speakers"))


@query("ord_speaker_sample", f"WITH {_PLACED} SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM p WHERE place <= greatest(1, floor(total * 0.3)))")
def ord_speaker_sample(spark, sf):
    return splits.speaker_sample(table(spark, sf, "events"), "user_id", 0.3).select("event_id", "user_id")


@query("ord_seeded_sample", "SELECT event_id FROM events ORDER BY md5(event_id || '-42'), event_id LIMIT 200")
def ord_seeded_sample(spark, sf):
    return splits.seeded_sample(table(spark, sf, "events"), "event_id", 200).select("event_id")


@query("ord_first_n_split", "SELECT split, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY md5(item_id || '-42'), item_id) <= 10 THEN 'validation' ELSE 'train' END AS split FROM benchmark) q GROUP BY split")
def ord_first_n_split(spark, sf):
    return splits.first_n_split(table(spark, sf, "benchmark"), "item_id", 10).groupBy("split").agg(F.count("*").alias("n"))


@query("set_union_splits", "SELECT 'user' AS side, doc_id AS id FROM documents UNION ALL SELECT 'page', page_id FROM pages UNION ALL SELECT 'item', item_id FROM benchmark")
def set_union_splits(spark, sf):
    part = lambda t, k, s: table(spark, sf, t).select(F.lit(s).alias("side"), F.col(k).alias("id"))
    return part("documents", "doc_id", "user").unionByName(part("pages", "page_id", "page"), allowMissingColumns=True).unionByName(part("benchmark", "item_id", "item"), allowMissingColumns=True)


@query("set_disjoint_splits", "SELECT 0::BIGINT AS n_shared")
def set_disjoint_splits(spark, sf):
    s = splits.speaker_split(table(spark, sf, "events"), "user_id").select("user_id", "split").distinct()
    return s.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_shared"))


_SECONDS = "epoch(ts)"
_REGIONS = f"""g AS (SELECT user_id, {_SECONDS} AS t, CASE WHEN {_SECONDS} - lag({_SECONDS}) OVER (PARTITION BY user_id ORDER BY ts) >= 10800 THEN 1 ELSE 0 END AS new FROM events),
i AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS region FROM g),
r AS (SELECT user_id, region, min(t) AS lo, max(t) AS hi, count(*) AS n_points FROM i GROUP BY ALL)"""


def points(spark, sf):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf, "events").select("user_id", t.alias("t"))


@query("arr_regions_gap", f"WITH {_REGIONS} SELECT user_id, region, n_points, round_even(hi - lo, 3) AS duration FROM r WHERE hi - lo >= 0.3")
def arr_regions_gap(spark, sf):
    r = segments.merge_regions(points(spark, sf), "user_id", "t", 10800, 0.3)
    return r.select("user_id", F.col("region").cast("long").alias("region"), "n_points", F.bround("duration", 3).alias("duration"))


@query("arr_equal_division", f"""WITH {_REGIONS}, s AS (SELECT user_id, min(lo) AS lo, max(hi) AS hi, 1 + user_id % 5 AS n FROM r GROUP BY user_id)
SELECT user_id, i AS part, round_even((hi - lo) / n * i, 2) AS offset_s FROM s, generate_series(0, 4) AS g(i) WHERE i < n AND (hi - lo) / n >= 0.3""")
def arr_equal_division(spark, sf):
    r = segments.merge_regions(points(spark, sf), "user_id", "t", 10800)
    d = segments.equal_division(r, "user_id", 1 + F.col("user_id") % 5)
    first = r.groupBy("user_id").agg(F.min("start").alias("lo"))
    return d.join(first, "user_id").select("user_id", F.col("part").cast("long").alias("part"), F.bround(F.col("start") - F.col("lo"), 2).alias("offset_s"))


@query("stream_session_regions", f"WITH {_REGIONS} SELECT user_id, n_points AS n_events FROM r")
def stream_session_regions(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return session_regions(e, gap="3 hours").select("user_id", "n_events")


@query("stream_tumbling_chunks", "SELECT event_type, n_events, count(*) AS n_chunks FROM (SELECT event_type, floor(epoch(ts) / 3600) AS w, count(*) AS n_events FROM events GROUP BY ALL) q GROUP BY ALL")
def stream_tumbling_chunks(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling_chunks(e, "1 hour").groupBy("event_type", "n_events").agg(F.count("*").alias("n_chunks"))


@query("agg_order_statistics", """SELECT event_type, user_id % 3 AS k, count(value) AS n, round_even(quantile_cont(value, 0.0), 6) AS p0, round_even(quantile_cont(value, 0.1), 6) AS p10, round_even(quantile_cont(value, 0.25), 6) AS p25, round_even(quantile_cont(value, 0.5), 6) AS p50,
  round_even(quantile_cont(value, 0.75), 6) AS p75, round_even(quantile_cont(value, 0.99), 6) AS p99, round_even(quantile_cont(value, 1.0), 6) AS p100 FROM events GROUP BY ALL""")
def agg_order_statistics(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("user_id") % 3).alias("k"), "value")
    q = selection.order_statistics(e, "value", [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0], "event_type", "k")
    return q.select("event_type", "k", "n", *[F.bround(f"q{i}", 6).alias(f"p{p}") for i, p in enumerate((0, 10, 25, 50, 75, 99, 100))])


@query("agg_speaker_stretches", """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id AS speaker_id, count(*) AS n_utterances, count_if(event_id % 2 = 0)::BIGINT AS n_raw, sum(event_id % 5)::BIGINT AS edits, sum(event_id % 3)::BIGINT AS rule_hits, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY user_id, k""")
def agg_speaker_stretches(spark, sf):
    """V4: profiles of stretches of a speaker's utterances that are no more than twelve hours apart."""
    e = table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("speaker_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 2 == 0).alias("is_raw"), (F.col("event_id") % 5).alias("edits"), (F.col("event_id") % 3).alias("rule_hits"))
    return speaker_profiles(rows, "12 hours").select("speaker_id", "n_utterances", "n_raw", "edits", "rule_hits", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))
