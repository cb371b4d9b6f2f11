"""Exact order statistics of continuous values, without a group's values in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that the values are cut into; a rank's range, with about that part of the different values, is sorted.
RANGES = 64


def order_statistics(rows: DataFrame, value: str, quantiles: list[float], *by: str, ranges: int = RANGES) -> DataFrame:
    """(by, n, q0, q1, ...): exact quantiles with linear interpolation between the two ranks next to each. Nulls
    are left out, groups without a value have no row; nan counts as the greatest value.

    Equal values of a group are counted first. Cut points at even ranks of the different values (approximate
    ones will do: they decide no result) part them into ranges, whose counts, added up in order, tell in
    which range each wanted rank lies; only the values in these ranges are put in order, each range on
    its own."""
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    cuts = counts.agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("_cuts"))
    one_row = counts.crossJoin(F.broadcast(cuts))  # of cut points, the same for all
    ranged = one_row.withColumn("_r", F.size(F.filter("_cuts", lambda s: s <= F.col("_v")))).drop("_cuts")

    per = ranged.groupBy(*names, "_r").agg(F.sum("_c").alias("_in"))
    along = W.partitionBy(*names)
    per = per.withColumn("_upto", F.sum("_in").over(along.orderBy("_r"))).withColumn("_n", F.sum("_in").over(along)).withColumn("_below", F.col("_upto") - F.col("_in"))
    place = [(F.col("_n") - 1) * F.lit(float(q)) for q in quantiles]
    ranks = F.array(*[F.struct(F.lit(2 * i + j).alias("w"), (f(p)).cast("long").alias("rank")) for i, p in enumerate(place) for j, f in enumerate((F.floor, F.ceil))])
    wanted = per.withColumn("_x", F.filter(ranks, lambda x: (x["rank"] >= F.col("_below")) & (x["rank"] < F.col("_upto")))).where(F.size("_x") > 0).select(*names, "_r", "_below", "_n", "_x")

    wanted = wanted.select(*[F.col(k).alias(f"{k}_") for k in names], F.col("_r").alias("_r_"), "_below", "_n", "_x")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in names], F.col("_r") == F.col("_r_"))
    near = ranged.join(wanted, same).select(*names, "_r", "_v", "_c", "_below", "_n", "_x")
    within = W.partitionBy(*names, "_r").orderBy("_v")
    reached = near.withColumn("_to", F.sum("_c").over(within) + F.col("_below"))
    hits = reached.withColumn("_x", F.filter("_x", lambda x: (x["rank"] < F.col("_to")) & (x["rank"] >= F.col("_to") - F.col("_c")))).where(F.size("_x") > 0).select(*names, "_n", "_v", F.explode("_x").alias("_x"))
    at = lambda w: F.max(F.when(F.col("_x.w") == w, F.col("_v")))
    found = hits.groupBy(*names, "_n").agg(*[at(w).alias(f"_w{w}") for w in range(2 * len(quantiles))])

    def between(i: int) -> Column:
        low, high, p = F.col(f"_w{2 * i}"), F.col(f"_w{2 * i + 1}"), place[i]
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return found.select(*[F.col(k).alias(c) for k, c in zip(names, by)], F.col("_n").alias("n"), *[between(i).alias(f"q{i}") for i in range(len(quantiles))])


def with_medians(summary: DataFrame, rows: DataFrame, value: str, name: str, *by: str) -> DataFrame:
    """A summary of rows by those columns (one row each) with the median of a value under a name; null where there
    is no value."""
    middle = order_statistics(rows, value, [0.5], *by).select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(by)], F.col("q0").alias(name))
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate(by)], F.lit(True))
    return summary.join(middle, on, "left").drop(*[f"_m{i}" for i in range(len(by))])
