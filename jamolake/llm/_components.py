"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import Scratch, partitions


def _with_least(edges: DataFrame, least: Column, salts: int) -> DataFrame:
    """edges (u, v) with m, the smallest `least` of u's edges. A vertex may have a third of all edges,
    so they are dealt over salts before they meet m: no task sees more of a vertex than one salt's
    edges, or one row for each salt."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    parts = dealt.groupBy("u", "salt").agg(least.alias("m")).withColumn("m", F.min("m").over(W.partitionBy("u")))
    return dealt.join(parts, ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """Edges (a, b) of numbers to (v, root): root is the least number that v is connected to.
    Only vertices with an edge to another vertex are returned. Each round joins and groups edges,
    a hub's in parts, and stores them; the driver sees two numbers a round."""
    salts = partitions(edges.sparkSession)
    now = scratch.store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = sign(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, F.least(F.min("v"), F.min("u")), salts).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large, F.min("v"), salts).select(F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).where("u <> v").distinct()
        new = scratch.store(small)
        scratch.drop(now)
        now, before, was = new, was, sign(new)
        if was == before:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(now.select(F.col("v"), F.col("v").alias("root")).distinct())
    raise RuntimeError("components did not settle")
