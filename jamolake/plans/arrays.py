"""Queries of signals, frames and label arrays; embeddings stand for signals and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as x
from ..functions import hangul as h
from ._registry import registry
from .base import UTT, sql_jamo, table, utterances

QUERIES, ORACLES, query = registry()


@query("arr_rms", "SELECT vec_id, round_even(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / len(embedding)), 9) AS rms FROM embeddings")
def arr_rms(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.bround(x.rms(F.col("embedding")), 9).alias("rms"))


_K = "0.1 / sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / len(embedding))"


@query("arr_rms_normalise", f"""WITH k AS (SELECT vec_id, embedding, {_K} AS k FROM embeddings)
SELECT vec_id, o - 1 AS pos, round_even(greatest(-1, least(1, v::DOUBLE * k)), 9) AS v FROM k, unnest(embedding) WITH ORDINALITY AS u(v, o)""")
def arr_rms_normalise(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(x.normalise(F.col("embedding"))).alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.bround("v", 9).alias("v"))


@query("arr_pcm16", "SELECT vec_id, o - 1 AS pos, trunc(v::DOUBLE * 32767)::INTEGER AS v FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(v, o)")
def arr_pcm16(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(x.pcm16(F.col("embedding"))).alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("int").alias("v"))


@query("arr_encoder_length", "WITH a AS (SELECT l_orderkey, l_linenumber, (l_quantity * 1000)::BIGINT AS n FROM lineitem), s1 AS (SELECT *, (n - 1) // 5 + 1 AS a FROM a), s2 AS (SELECT *, (a - 1) // 2 + 1 AS b FROM s1), s3 AS (SELECT *, (b - 1) // 2 + 1 AS c FROM s2), s4 AS (SELECT *, (c - 1) // 2 + 1 AS d FROM s3), s5 AS (SELECT *, (d - 1) // 2 + 1 AS e FROM s4), s6 AS (SELECT *, (e - 1) // 2 + 1 AS f FROM s5) SELECT n, (f - 1) // 2 + 1 AS frames, count(*) AS n_rows FROM s6 GROUP BY ALL")
def arr_encoder_length(spark, sf):
    n = (F.col("l_quantity") * 1000).cast("long")
    return table(spark, sf, "lineitem").groupBy(n.alias("n"), x.encoder_length(n).alias("frames")).agg(F.count("*").alias("n_rows"))


# 16 frames of 4 classes each
_FRAMES = "list_transform(generate_series(0, 15), lambda f: list_slice(embedding, f * 4 + 1, f * 4 + 4))"


@query("arr_ctc_greedy", f"""WITH b AS (SELECT vec_id, list_transform({_FRAMES}, lambda f: list_position(f, list_max(f)) - 1) AS best FROM embeddings)
SELECT vec_id, array_to_string(list_filter(best, lambda v, i: v <> 0 AND (i = 1 OR v <> best[i - 1])), ' ') AS labels FROM b""")
def arr_ctc_greedy(spark, sf):
    frames = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda f: F.slice(F.col("embedding"), f * 4 + 1, 4))
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(F.transform(x.greedy_decode(frames), lambda v: v.cast("string")), " ").alias("labels"))


_TOKENS = "map {" + ", ".join(f"'{c}': {i}" for c, i in h.VOCABULARY.items() if len(c) == 1) + "}"
_LABELS = f"""WITH {UTT}, e AS (SELECT utt, conv_id, list_transform(string_split({sql_jamo('cx')}, ''), lambda c: coalesce({_TOKENS}[c], {h.UNKNOWN})) AS l FROM utt),
w AS (SELECT utt, l, max(len(l)) OVER (PARTITION BY conv_id) AS m, min(l[1] = 5) OVER (PARTITION BY conv_id) AS same FROM e),
d AS (SELECT utt, list_concat(l, list_transform(range(m - len(l)), lambda i: {{pad}})) AS l, same FROM w) SELECT utt, array_to_string(CASE WHEN same THEN l[2:] ELSE l END, ' ') AS labels FROM d"""


def _padded(spark, sf):
    l = utterances(spark, sf).select("utt", "conv_id", h.encode(h.jamo_string(F.col("x"))).alias("labels"))
    return x.pad_batches(l, "labels", "conv_id", start=5)


def _shown(labels):
    return F.array_join(F.transform(labels, lambda v: v.cast("string")), " ")


@query("arr_pad_mask", _LABELS.replace("{pad}", "-100"))
def arr_pad_mask(spark, sf):
    return _padded(spark, sf).select("utt", _shown(F.col("labels")).alias("labels"))


@query("arr_unmask", _LABELS.replace("{pad}", "0"))
def arr_unmask(spark, sf):
    return _padded(spark, sf).select("utt", _shown(x.unmask(F.col("labels"))).alias("labels"))


@query("arr_chunk30", """WITH n AS (SELECT p_partkey, (p_retailprice * 2000)::BIGINT AS n FROM part)
SELECT p_partkey, i AS chunk, i * 480000 AS start FROM n, generate_series(0, 19) AS g(i) WHERE i < ceil(n / 480000.0) AND n - i * 480000 >= 16000""")
def arr_chunk30(spark, sf):
    n = (F.col("p_retailprice") * 2000).cast("long")
    return table(spark, sf, "part").select("p_partkey", F.posexplode(x.chunk_offsets(n)).alias("chunk", "start")).withColumn("chunk", F.col("chunk").cast("long"))


@query("arr_label_cap", f"WITH {UTT}, j AS (SELECT utt, {sql_jamo('cx')} AS jamo, 1 + utt % 7 AS sec FROM utt) SELECT utt, substr(jamo, 1, (sec * 20)::INTEGER) AS label FROM j")
def arr_label_cap(spark, sf):
    j = utterances(spark, sf).select("utt", h.jamo_string(F.col("x")).alias("jamo"), (1 + F.col("utt") % 7).alias("sec"))
    return j.select("utt", x.label_cap(F.col("jamo"), F.col("sec")).alias("label"))


@query("arr_quiet", "SELECT label, count(*) AS n, count_if(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / len(embedding)) < 0.125)::BIGINT AS n_quiet FROM embeddings GROUP BY label")
def arr_quiet(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(x.is_quiet(F.col("embedding"), 0.125)).alias("n_quiet"))


@query("arr_clip_or_silence", "SELECT vec_id, 48::BIGINT AS n_clipped, 8000::BIGINT AS n_silence FROM embeddings")
def arr_clip_or_silence(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.size(x.clip_seconds(F.col("embedding"), 0.003)).cast("long").alias("n_clipped"), F.size(x.or_silence(F.lit(None).cast("array<float>"), 0.5)).cast("long").alias("n_silence"))
