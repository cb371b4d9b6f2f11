"""Signals, frames and label arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signals import SAMPLE_RATE

STRIDES = [5, 2, 2, 2, 2, 2, 2]
PAD_LABEL = -100


def rms(signal: Column) -> Column:
    total = F.aggregate(signal, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return F.when(F.size(signal) > 0, F.sqrt(total / F.size(signal)))


def normalise(signal: Column, level: float = 0.1) -> Column:
    """Scaled to that level (unless silent) and clipped to [-1, 1]."""
    r = rms(signal)
    k = F.when(r > 1e-6, F.lit(level) / r).otherwise(1.0)
    return F.transform(signal, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double") * k)))


def pcm16(signal: Column) -> Column:
    return F.transform(signal, lambda v: (v.cast("double") * 32767).cast("int").cast("smallint"))


def is_quiet(signal: Column, level: float = 0.01) -> Column:
    return rms(signal) < level


def clip_seconds(signal: Column, seconds: float, rate: int = SAMPLE_RATE) -> Column:
    return F.slice(signal, 1, int(seconds * rate))


def or_silence(signal: Column, seconds: float = 1.0, rate: int = SAMPLE_RATE) -> Column:
    return F.coalesce(signal, F.array_repeat(F.lit(0.0).cast("float"), int(seconds * rate)))


def label_cap(label: Column, seconds: Column, per_second: int = 20) -> Column:
    return F.substring(label, F.lit(1), (seconds * per_second).cast("int"))


def encoder_length(n: Column) -> Column:
    """Frames that a signal of n samples leaves after all strides."""
    for s in STRIDES:
        n = F.floor((n - 1) / s) + 1
    return n.cast("long")


def greedy_decode(frames: Column, blank: int = 0) -> Column:
    """Best class of each frame, repeats merged, blanks removed."""
    best = F.transform(frames, lambda f: (F.array_position(f, F.array_max(f)) - 1).cast("int"))
    return merge_repeats(best, blank)


def merge_repeats(best: Column, blank: int = 0) -> Column:
    beside = F.arrays_zip(best.alias("v"), F.concat(F.array(F.lit(None).cast("int")), best).alias("before"))
    kept = F.filter(beside, lambda x: x["v"].isNotNull() & (x["v"] != blank) & ~x["v"].eqNullSafe(x["before"]))
    return F.transform(kept, lambda x: x["v"])


def pad_batches(rows: DataFrame, labels: str, batch: str, start: int | None = None) -> DataFrame:
    """rows with labels padded to the longest of their batch; where every row of a batch begins with
    the start label, it is taken off. Batches are summed up and joined back, so no task needs one
    whole."""
    first = F.coalesce(F.try_element_at(F.col(labels), F.lit(1)) == start, F.lit(False)) if start is not None else F.lit(False)
    per = rows.groupBy(batch).agg(F.max(F.size(labels)).alias("_longest"), F.bool_and(first).alias("_same"))
    out = rows.join(per, batch).withColumn(labels, F.concat(labels, F.array_repeat(F.lit(PAD_LABEL), F.col("_longest") - F.size(labels))))
    return out.withColumn(labels, F.when(F.col("_same"), F.slice(labels, 2, F.greatest(F.lit(0), F.col("_longest") - 1))).otherwise(F.col(labels))).drop("_longest", "_same")


def unmask(labels: Column, pad: int = 0) -> Column:
    return F.transform(labels, lambda v: F.when(v == PAD_LABEL, pad).otherwise(v))


def chunk_offsets(length: Column, chunk: int = 30 * SAMPLE_RATE, most: int = 20, least: int = SAMPLE_RATE) -> Column:
    """First samples of up to `most` chunks; a rest shorter than least is left out."""
    n = F.least(F.lit(most), F.ceil(length / chunk))
    return F.filter(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: i * chunk), lambda s: length - s >= least)
