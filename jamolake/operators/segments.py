"""Segmentation: speech regions, the pairing of regions with sentences, and why sessions are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank, split_transcript


def merge_regions(points: DataFrame, key: str, at: str, gap: float, least: float = 0.0, bucket: float | None = None) -> DataFrame:
    """Islands of points less than gap seconds apart: (key, start, end, duration, n_points, region). at is a
    number of seconds; points without one are left out. Regions of a key are numbered in order of time;
    those shorter than least are dropped then.

    Islands are found inside time buckets of a key (64 gaps long, or bucket seconds), so a key with most of
    the points is in many tasks. Only the first and the last island of a bucket can go on outside it; these
    few are stitched in order of time."""
    width = F.lit(float(bucket or 64 * gap))
    given = points.where(F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.floor(F.col(at) / width).alias("_bucket"))
    inside = W.partitionBy("_key", "_bucket")
    ordered = inside.orderBy("_at")
    fresh = lambda start, before: F.coalesce((start - before >= gap).cast("long"), F.lit(1))
    marked = given.withColumn("_new", fresh(F.col("_at"), F.lag("_at").over(ordered))).withColumn("_island", F.sum("_new").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    islands = marked.groupBy("_key", "_bucket", "_island").agg(F.min("_at").alias("start"), F.max("_at").alias("end"), F.count("*").alias("n_points")).withColumn("_last", F.max("_island").over(inside))

    edge = (F.col("_island") == 1) | (F.col("_island") == F.col("_last"))
    along = W.partitionBy("_key").orderBy("start", "end")
    edges = islands.where(edge).withColumn("_new", fresh(F.col("start"), F.lag("end").over(along))).withColumn("_run", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    stitched = edges.groupBy("_key", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_points").alias("n_points")).drop("_run")
    regions = islands.where(~edge).select("_key", "start", "end", "n_points").unionByName(stitched).withColumn("_bucket", F.floor(F.col("start") / width))

    before = regions.groupBy(F.col("_key").alias("_k"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = regions.withColumn("_place", F.row_number().over(inside.orderBy("start"))).join(before, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b")))
    numbered = placed.select(F.col("_key").alias(key), (F.col("_before") + F.col("_place") - 1).alias("region"), "start", "end", "n_points", (F.col("end") - F.col("start")).alias("duration"))
    return numbered.where(F.col("duration") >= least)


def equal_division(regions: DataFrame, key: str, parts: Column, least: float = 0.3) -> DataFrame:
    """The span from the first start to the last end in equal parts; parts below least are dropped."""
    span = regions.groupBy(key).agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.max(parts).cast("int").alias("n")).where("n > 0").withColumn("step", (F.col("hi") - F.col("lo")) / F.col("n"))
    each = span.where(F.col("step") >= least).select(key, "lo", "step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    return each.select(key, "part", (F.col("lo") + F.col("part") * F.col("step")).alias("start"), (F.col("lo") + (F.col("part") + 1) * F.col("step")).alias("end"))


def zip_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides with the same place (pos, from 0) of a key, as far as the shorter goes."""
    return left.join(right, [key, "pos"])


def count_gate(n: Column, m: Column, tolerance: float = 0.10) -> Column:
    """Whether regions and sentences agree in number."""
    return F.abs(n - m) / F.greatest(m, F.lit(1)) <= tolerance


#: Why a session is rejected, in the order in which the checks are made.
REASONS = ["read_error", "no_transcript", "no_wav", "no_sentences", "load_error", "vad_error", "no_regions", "no_segments", "count_mismatch", "no_pairs"]


def reject_reason(checks: dict[str, Column]) -> Column:
    """The first check that is true, or 'passed'."""
    out = F.lit("passed")
    for name in reversed(REASONS):
        if name in checks:
            out = F.when(F.coalesce(checks[name], F.lit(False)), name).otherwise(out)
    return out


def reason_counts(sessions: DataFrame, reason: str = "reason") -> DataFrame:
    return sessions.groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), reason)


def segment_sessions(sessions: DataFrame, tolerance: float = 0.10, low: float = 0.5, high: float = 20.0) -> DataFrame:
    """Sessions (any columns, with read_error, transcript, wav and regions: array<struct<start, end,
    duration>>) with sentences, n_regions, n_sentences, reason and pairs: the regions and sentences
    of a session that passes, as far as the shorter goes, each with its index and whether its
    duration is within bounds. The cascade looks at one check after another, in the order of REASONS;
    those of load_error, vad_error, no_segments and no_pairs are boolean columns that a session may have."""
    r, s = F.size(F.coalesce("regions", F.array())), F.size("sentences")
    d = sessions.withColumn("sentences", F.coalesce(split_transcript(F.col("transcript")), F.array().cast("array<string>")))
    d = d.withColumn("n_regions", r).withColumn("n_sentences", s)
    reason = reject_reason({"read_error": F.col("read_error"), "no_transcript": is_blank(F.col("transcript")), "no_wav": F.col("wav").isNull(), "no_sentences": s == 0, "no_regions": r == 0, "count_mismatch": ~count_gate(r, s, tolerance)} | {c: F.col(c) for c in ("load_error", "vad_error", "no_segments", "no_pairs") if c in sessions.columns})
    zipped = F.transform(F.arrays_zip("regions", "sentences"), lambda p, i: F.struct(i.alias("index"), p["regions"]["start"].alias("start"), p["regions"]["end"].alias("end"), p["regions"]["duration"].alias("duration"), p["sentences"].alias("sentence"), p["regions"]["duration"].between(low, high).alias("fits")))
    pairs = F.slice(zipped, 1, F.least(r, s))
    return d.withColumn("reason", reason).withColumn("pairs", F.when(F.col("reason") == "passed", pairs).otherwise(F.slice(zipped, 1, 0)))


def session_segments(segmented: DataFrame, *keys: str) -> DataFrame:
    """One row a segment of fitting duration: the keys, n_regions, n_sentences, index (as counted
    before others were left out), start, end, duration, sentence."""
    return segmented.select(*keys, "n_regions", "n_sentences", F.inline("pairs")).where("fits").drop("fits")


def session_reasons(segmented: DataFrame) -> DataFrame:
    """(reason, n): sessions by reason, those that do not agree also by their numbers, and segments of
    unfit duration."""
    mismatch = F.when(F.col("reason") == "count_mismatch", F.format_string("mismatch_n%d_m%d", "n_regions", "n_sentences"))
    whole = segmented.select(F.explode(F.array_compact(F.array("reason", mismatch))).alias("reason"), F.lit(1).alias("n"))
    unfit = segmented.select(F.lit("bad_duration").alias("reason"), F.size(F.filter("pairs", lambda p: ~p["fits"])).alias("n")).where("n > 0")
    return whole.unionByName(unfit).groupBy("reason").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "reason")


def observed(segmented: DataFrame, name: str = "sessions") -> tuple[DataFrame, Observation]:
    """segmented with counters that fill while it is written or counted: sessions in all, each reason's and
    `passed`, and segments of unfit and fitting duration. They come with the rows of the one job, without
    another read; get() of the observation waits for that job."""
    watch = Observation(name)
    pairs = lambda fits: F.coalesce(F.sum(F.size(F.filter("pairs", lambda p: p["fits"] == fits))), F.lit(0)).cast("long")
    counts = [F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in [*REASONS, "passed"]]
    return segmented.observe(watch, F.count(F.lit(1)).alias("total"), *counts, pairs(False).alias("bad_duration"), pairs(True).alias("segments")), watch


def counters(spark: SparkSession, watch: Observation) -> DataFrame:
    """(reason, n) of a finished job's counters."""
    return spark.createDataFrame(sorted(watch.get.items()), "reason string, n long")
