"""Queries that write files of a given table's rows into the shared folder and read them back, and those of
providers that run in workers. Embeddings stand for recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals
from ..operators import providers, segments
from ..sources import files, sinks
from ..sources.scratch import new_folder
from ._registry import registry
from .base import SENT, sentences, table
from .records import _SESSIONS, segmented

QUERIES, ORACLES, query = registry()

# Recordings of 8 to 64 samples.
_RECORDINGS = "rec AS (SELECT vec_id, embedding[1 : 8 + vec_id % 57] AS signal FROM embeddings)"
_FLOAT = "(signal[i]::DOUBLE)"


def _recordings(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.expr("slice(embedding, 1, cast(8 + vec_id % 57 as int))").alias("signal"))


def _written(spark, sf, rate=16_000):
    folder = new_folder(spark, "wav")
    rows = _recordings(spark, sf).select(F.concat(F.lit("r"), "vec_id").alias("stem"), F.lit(0).alias("index"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), "signal")
    return folder, sinks.write_segments(rows, folder, rate)


def _id():
    return F.regexp_extract("stem", r"r(\d+)_seg", 1).cast("long").alias("vec_id")


@query("src_wav_samples", f"WITH {_RECORDINGS} SELECT vec_id, i - 1 AS pos, round_even(least(1, greatest(-1, {_FLOAT})) * 32767, 0)::BIGINT AS sample FROM rec, unnest(range(1, len(signal) + 1)) AS u(i)")
def src_wav_samples(spark, sf):
    """SNK2, SRC5, SRC8: segments written as files, decoded from them."""
    folder, _ = _written(spark, sf)
    return files.read_audio(spark, folder).select(_id(), F.posexplode("signal").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("v").cast("double") * 32768).cast("long").alias("sample"))


@query("src_wav_durations", f"WITH {_RECORDINGS} SELECT vec_id, 16000::BIGINT AS rate, len(signal)::BIGINT AS n_samples, len(signal) / 16000 AS duration FROM rec WHERE len(signal) BETWEEN 16 AND 48")
def src_wav_durations(spark, sf):
    """SRC5, FLT1: headers alone, bounded by duration while they are read."""
    folder, found = _written(spark, sf)
    d = spark.read.format("wav").schema("stem string, rate int, n_samples long, duration double").option("minDuration", 0.001).option("maxDuration", 0.003).load(folder)
    return d.select(_id(), F.col("rate").cast("long").alias("rate"), "n_samples", "duration")


@query("src_audio_join", f"WITH {_RECORDINGS} SELECT doc_id, len(signal)::BIGINT AS n_samples FROM labels JOIN rec ON vec_id = doc_id")
def src_audio_join(spark, sf):
    """SRC5, FLT4, JON1: rows whose recording is there, by the stem of its file."""
    folder, found = _written(spark, sf)
    index = files.audio_index(spark, folder).select("stem", "path").join(found.select("stem", "n_samples"), "stem")
    return table(spark, sf, "labels").select("doc_id", F.format_string("r%d_seg0000", "doc_id").alias("stem")).join(index, "stem").select("doc_id", "n_samples")


# Sentences as segment records in three splits; the stored text has lines that are no records.
_SPLITS = "CASE conv_id % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END"


@query("src_jsonl_splits", rf"""WITH {SENT}, r AS (SELECT {_SPLITS} AS split, utt, s, length(s) / 10 AS duration FROM sent)
SELECT split, count(*) AS n, count(DISTINCT utt) AS n_paths, sum(length(s))::BIGINT AS letters, count_if(duration > 1 AND duration < 10)::BIGINT AS n_fit FROM r GROUP BY split""")
def src_jsonl_splits(spark, sf):
    """SNK1, SRC1, FLT2: records written as JSON lines by split, read back as the segment schema."""
    folder = new_folder(spark, "splits")
    s = sentences(spark, sf)
    split = F.when(F.col("conv_id") % 10 == 0, "validation").when(F.col("conv_id") % 10 == 1, "test").otherwise("train")
    sinks.write_splits(s.select(split.alias("split"), F.col("utt").cast("string").alias("wav_path"), F.col("s").alias("transcript"), F.col("s").alias("label"), (F.length("s") / 10).alias("duration"), F.col("conv_id").cast("string").alias("speaker_id")), folder)
    fit = (F.col("duration") > 1) & (F.col("duration") < 10)
    return files.read_splits(spark, folder).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("wav_path").alias("n_paths"), F.sum(F.length("transcript")).alias("letters"), F.count_if(fit).alias("n_fit"))


@query("src_signal_cache", f"WITH {_RECORDINGS} SELECT vec_id, len(signal)::BIGINT AS n_samples, round_even(list_sum(list_transform(signal, lambda v: v::DOUBLE)), 6) AS total FROM rec WHERE vec_id % 7 <> 0")
def src_signal_cache(spark, sf):
    """SNK3, SRC10: the cache of decoded signals, without those that could not be decoded."""
    folder = new_folder(spark, "cache")
    sinks.write_signals(_recordings(spark, sf).select(F.col("vec_id").cast("string").alias("stem"), F.when(F.col("vec_id") % 7 != 0, F.col("signal")).alias("signal")), folder)
    return files.read_signals(spark, folder).select(F.col("stem").cast("long").alias("vec_id"), F.size("signal").cast("long").alias("n_samples"), F.bround(F.aggregate("signal", F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("total"))


@query("seg_counters", rf"""WITH {_SESSIONS}, a AS (SELECT reason, 1 AS n FROM g UNION ALL SELECT 'total', 1 FROM g UNION ALL SELECT CASE WHEN duration BETWEEN 0.5 AND 20 THEN 'segments' ELSE 'bad_duration' END, 1 FROM p)
SELECT x.reason, count(a.n) AS n FROM (VALUES ('total'), ('segments'), ('bad_duration'), ('passed'), {', '.join(f"('{r}')" for r in segments.REASONS)}) x(reason) LEFT JOIN a ON a.reason = x.reason GROUP BY x.reason""")
def seg_counters(spark, sf):
    """AGG11: why sessions were left out, counted while the others' segments are written."""
    rows, watch = segments.observed(segmented(spark, sf))
    segments.session_segments(rows, "session").write.parquet(new_folder(spark, "segments"))
    return segments.counters(spark, watch)


def _threes():
    def run(texts):
        if any(len(x) % 7 == 0 for x in texts):
            raise ValueError("sevenfold")
        return [x.replace("e", "3") for x in texts]

    return run


def _fours():
    def run(texts):
        if any(len(x) % 3 == 0 for x in texts):
            raise ValueError("threefold")
        return [x.replace("a", "4") for x in texts]

    return run


@query("fn_provider_fallback", rf"""WITH {SENT} SELECT utt, CASE WHEN length(s) % 7 <> 0 THEN replace(s, 'e', '3') WHEN length(s) % 3 <> 0 THEN replace(s, 'a', '4') END AS label, CASE WHEN length(s) % 7 <> 0 THEN 1 WHEN length(s) % 3 <> 0 THEN 2 ELSE 0 END::BIGINT AS provider,
  CASE WHEN length(s) % 21 = 0 THEN 'ValueError: threefold' END AS error FROM sent""")
def fn_provider_fallback(spark, sf):
    """FN13, PRJ13: a provider that fails on some texts, a second one that fails on some of these."""
    return providers.provide(sentences(spark, sf).select("utt", "s"), "s", _threes, _fours).select("utt", "label", F.coalesce("provider", F.lit(0)).cast("long").alias("provider"), "error")


@query("arr_resample", f"""WITH c AS (SELECT vec_id, embedding AS x, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 8 END AS up, CASE WHEN vec_id % 2 = 0 THEN 3 ELSE 5 END AS down FROM embeddings),
r AS (SELECT DISTINCT up, greatest(up, down) AS m FROM c),
k AS (SELECT up, m, unnest(range(-{signals.ZEROS} * m, {signals.ZEROS} * m + 1)) AS k FROM r),
g AS (SELECT up, m, k, CASE WHEN k = 0 THEN 1 ELSE sin(pi() * k / m) / (pi() * k / m) END * list_sum(list_transform(range(0, 33), lambda j: pow({signals.BETA} * {signals.BETA} / 4 * (1 - (k / ({signals.ZEROS} * m)) * (k / ({signals.ZEROS} * m))), j) / pow(factorial(j::INT)::DOUBLE, 2))) AS g FROM k),
h AS (SELECT up, k, g * up / sum(g) OVER (PARTITION BY up) AS h FROM g),
o AS (SELECT vec_id, x, up, down, unnest(range(0, (64 * up + down - 1) // down)) AS pos FROM c),
n AS (SELECT vec_id, x, up, down, pos, unnest(range(0, 64)) AS n FROM o)
SELECT vec_id, pos, round_even(sum(x[n + 1]::DOUBLE * h), 6) + 0.0 AS v FROM n JOIN h ON h.up = n.up AND h.k = pos * down - n.n * n.up GROUP BY vec_id, pos""")
def arr_resample(spark, sf):
    """ARR6: signals at 48 and at 10 kHz brought to 16 kHz."""
    e = table(spark, sf, "embeddings")
    rate = F.when(F.col("vec_id") % 2 == 0, 48_000).otherwise(10_000)
    return e.select("vec_id", F.posexplode(signals.resample(F.col("embedding"), rate, double=True)).alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), (F.bround("v", 6) + 0.0).alias("v"))


# Frames of 16 samples, 8 apart; 9 frequencies, 5 triangles.
_MEL = r"""e AS (SELECT i, CASE WHEN q < 15 THEN q * 200 / 3 ELSE 1000 * exp((q - 15) * ln(6.4) / 27) END AS hz FROM (SELECT i, i * (15 + 27 * ln(8.0) / ln(6.4)) / 6 AS q FROM range(0, 7) t(i)) z),
bank AS (SELECT a.i AS mel, k, greatest(0, least((k * 1000 - a.hz) / (b.hz - a.hz), (c.hz - k * 1000) / (c.hz - b.hz))) * 2 / (c.hz - a.hz) AS w FROM e a JOIN e b ON b.i = a.i + 1 JOIN e c ON c.i = a.i + 2, range(0, 9) t(k)),
cut AS (SELECT vec_id, f AS frame, j, embedding[1 + CASE WHEN f * 8 + j - 8 < 0 THEN 8 - f * 8 - j WHEN f * 8 + j - 8 > 63 THEN 126 - (f * 8 + j - 8) ELSE f * 8 + j - 8 END]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS v FROM embeddings, range(0, 8) t(f), range(0, 16) s(j)),
dft AS (SELECT vec_id, frame, k, pow(sum(v * cos(2 * pi() * j * k / 16)), 2) + pow(sum(v * sin(2 * pi() * j * k / 16)), 2) AS p FROM cut, range(0, 9) t(k) GROUP BY ALL),
logs AS (SELECT vec_id, mel, frame, log10(greatest(1e-10, sum(p * w))) AS v FROM dft JOIN bank USING (k) GROUP BY ALL)"""


@query("arr_log_mel", f"WITH {_MEL} SELECT vec_id, mel, frame, round_even((greatest(v, max(v) OVER (PARTITION BY vec_id) - 8) + 4) / 4, 4) + 0.0 AS v FROM logs")
def arr_log_mel(spark, sf):
    """ARR14: log-mel features of each signal."""
    m = table(spark, sf, "embeddings").select("vec_id", F.posexplode(signals.log_mel(F.col("embedding"), None, n_fft=16, hop=8, n_mels=5, double=True)).alias("mel", "frames"))
    return m.select("vec_id", F.col("mel").cast("long").alias("mel"), F.posexplode("frames").alias("frame", "v")).select("vec_id", "mel", F.col("frame").cast("long").alias("frame"), (F.bround("v", 4) + 0.0).alias("v"))


@query("arr_unit_variance", """WITH m AS (SELECT vec_id, embedding AS x, list_avg(list_transform(embedding, lambda v: v::DOUBLE)) AS m FROM embeddings), s AS (SELECT *, list_avg(list_transform(x, lambda v: pow(v::DOUBLE - m, 2))) AS s FROM m)
SELECT vec_id, o - 1 AS pos, round_even((v::DOUBLE - m) / sqrt(s + 1e-7), 6) AS v FROM s, unnest(x) WITH ORDINALITY AS u(v, o)""")
def arr_unit_variance(spark, sf):
    """ARR14: signals of mean 0 and variance 1."""
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(signals.unit_variance(F.col("embedding"))).alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.bround("v", 6).alias("v"))


@query("arr_trim_silence", """WITH f AS (SELECT vec_id, f, list_sum(list_transform(embedding[greatest(1, f * 4 - 3) : least(64, f * 4 + 4)], lambda v: v::DOUBLE * v::DOUBLE)) AS p FROM embeddings, range(0, 17) t(f)),
l AS (SELECT vec_id, f, p > max(p) OVER (PARTITION BY vec_id) / 2 AS loud FROM f), s AS (SELECT vec_id, min(f) * 4 AS a, least(64, (max(f) + 1) * 4) AS b FROM l WHERE loud GROUP BY vec_id),
k AS (SELECT vec_id, CASE WHEN b - a < 20 THEN 0 ELSE a END AS a, CASE WHEN b - a < 20 THEN 64 ELSE b END AS b FROM s)
SELECT vec_id, b - a AS n, round_even(list_sum(list_transform(embedding[a + 1 : b], lambda v: v::DOUBLE)), 6) AS total FROM k JOIN embeddings USING (vec_id)""")
def arr_trim_silence(spark, sf):
    """ARR3: frames of 8 samples, 4 apart, within 3.01 dB (half the power) of the loudest."""
    import math

    cut = table(spark, sf, "embeddings").select("vec_id", signals.trim_silence(F.col("embedding"), 10 * math.log10(2), 8, 4, 20).alias("x"))
    return cut.select("vec_id", F.size("x").cast("long").alias("n"), F.bround(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("total"))
