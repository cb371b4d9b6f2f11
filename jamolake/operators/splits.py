"""Samples and splits that repeat: order comes from a hash of the key and a seed.

Shuffles with a particular generator are replaced by hash order; shares and group rules hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int) -> Column:
    """A hexadecimal text to order by, the same in any engine."""
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows in hash order; all for n <= 0."""
    return rows if n <= 0 else rows.orderBy(hash_order(F.col(key), seed), key).limit(n)


def ranked_keys(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """(key, place from 1, total): one row a distinct key. Keys are placed within 256 ranges of
    their hash, after the keys of the ranges before, so no task sorts them all."""
    keys = rows.where(F.col(key).isNotNull()).select(key).distinct().withColumn("h", hash_order(F.col(key), seed)).withColumn("g", F.substring("h", 1, 2))
    sizes = keys.groupBy("g").agg(F.count("*").alias("m"))  # 256 rows at most
    before = sizes.select("g", (F.sum("m").over(W.orderBy("g")) - F.col("m")).alias("first"), F.sum("m").over(W.partitionBy()).alias("total"))
    return keys.join(F.broadcast(before), "g").select(key, (F.col("first") + F.row_number().over(W.partitionBy("g").orderBy("h", key))).alias("place"), "total")


def speaker_split(rows: DataFrame, key: str, train: float = 0.8, validation: float = 0.1, seed: int = 42) -> DataFrame:
    """rows with split: whole speakers go to train, validation or test; shares are rounded down and
    test gets the rest. A table has one row a speaker, so Spark broadcasts it only while small."""
    n_train, n_val = F.floor(F.col("total") * train), F.floor(F.col("total") * validation)
    which = F.when(F.col("place") <= n_train, "train").when(F.col("place") <= n_train + n_val, "validation").otherwise("test")
    return rows.join(ranked_keys(rows, key, seed).select(key, which.alias("split")), key)


def speaker_sample(rows: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """All rows of a share of the speakers, one at least."""
    chosen = ranked_keys(rows, key, seed).where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("total") * ratio))).select(key)
    return rows.join(chosen, key, "left_semi")


def first_n_split(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n keys in hash order are for validation, the rest for training."""
    return rows.join(ranked_keys(rows, key, seed), key).withColumn("split", F.when(F.col("place") <= n, "validation").otherwise("train")).drop("place", "total")


def placed_rows(rows: DataFrame, *order: str, ranges: int = 256, sample: int = 20_000) -> DataFrame:
    """rows with place (from 1, in that order) and total. Rows are placed within ranges of the first
    column after those of the ranges before, so no task sorts them all; the ranges' ends come from
    a sample and decide nothing but the work."""
    n = rows.count()
    some = sorted(r[0] for r in rows.select(order[0]).where(F.col(order[0]).isNotNull()).sample(min(1.0, sample / max(n, 1)), 7).collect())
    ends = sorted({some[i * len(some) // ranges] for i in range(1, ranges)}) if some else []
    # the number of ends that are not greater; null keys come first
    g = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col(order[0]))) if ends else F.lit(0)
    g = F.coalesce(g, F.lit(0)) if ends else g
    dealt = rows.withColumn("_g", F.when(F.col(order[0]).isNull(), -1).otherwise(g))
    sizes = dealt.groupBy("_g").agg(F.count("*").alias("_m"))  # at most ranges + 1 rows
    before = sizes.select("_g", (F.sum("_m").over(W.orderBy("_g")) - F.col("_m")).alias("_first"))
    within = F.row_number().over(W.partitionBy("_g").orderBy(*order))
    return dealt.withColumn("place", within).join(F.broadcast(before), "_g").withColumn("place", F.col("place") + F.col("_first")).withColumn("total", F.lit(n)).drop("_g", "_first")


def positional_split(rows: DataFrame, *order: str, train: float = 0.9) -> DataFrame:
    """The first rows in that order are for training, as many as the share rounded down, the rest for
    evaluation."""
    return placed_rows(rows, *order).withColumn("split", F.when(F.col("place") <= F.floor(F.col("total") * train), "train").otherwise("eval")).drop("place", "total")


def limited(rows: DataFrame, limits: dict[str, int], *order: str) -> DataFrame:
    """Of each split the first rows in that order, as many as its limit; all where there is none (0)."""
    out = [rows.where(F.col("split") == s) if n <= 0 else rows.where(F.col("split") == s).orderBy(*order).limit(n) for s, n in limits.items()]
    return reduce(DataFrame.unionByName, out)
