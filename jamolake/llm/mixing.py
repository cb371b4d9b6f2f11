"""Mixing sources to target token weights by entropy balancing. [native]

Among all document rates between 0 and a cap, the ones nearest to uniform in relative entropy
that meet each source's token target are exponentially tilted: rate = min(cap, exp(l * x)),
with x a document's size over its source's mean size. The multipliers l solve a convex dual,
found by guarded Newton steps over sums that Spark takes in parallel; rates are then rounded
into whole copies.

Documents of one source and size have the same rate, so all sums run over the histogram of
(source, size): what one source holds there is bounded by the sizes that occur, not by rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import WORD, Scratch, table

NEWTON_STEPS, MAX_ROUNDS, TOLERANCE = 12, 6, 1e-9
#: Documents of one source and size are dealt to this many groups before copies are handed out.
DEALT = 256
REPAIRS = 4


def source_targets(sizes: DataFrame, weights: list[float], total: float, cap: float) -> DataFrame:
    """(source, source_size) to (k, source, source_size, target): sources by code point, null last,
    weigh as the repeating list says and share total times all sizes; a target stops at cap times
    its source's size and the excess is shared by weight among the rest. One row per source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("k", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int"))).withColumn("limit", F.col("source_size") * float(cap))
    # sources in the order in which a rising common share reaches their limits
    order = W.orderBy(F.col("limit") / F.col("w"), "k")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    share = (F.sum("source_size").over(W.partitionBy()) * float(total) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after)
    stepped = ranked.withColumn("share", share).withColumn("free", F.col("share") * F.col("w") < F.col("limit"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("w"), "k", "share"))).over(W.partitionBy())
    return stepped.withColumn("level", level["share"]).select("k", "source", "source_size", F.coalesce(F.least(F.col("level") * F.col("w"), F.col("limit")), F.col("limit")).alias("target"))


def _tilts(cells: DataFrame, cap: float, scratch: Scratch) -> DataFrame:
    """(k, size, n, source_size, target) to (k, tilt, scale)."""
    top = F.log(F.lit(float(cap)))
    state = cells.groupBy("k").agg(F.first("source_size").cast("double").alias("have"), F.first("target").alias("target"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"), F.min("size").alias("least"))
    ratio = F.least(F.col("target") / F.col("have"), F.lit(float(cap)))
    x_min = F.col("least") / F.col("scale")
    lo, hi = F.least(F.lit(0.0), F.log(ratio) / x_min), top / x_min
    state = state.select("k", "target", "scale", lo.alias("lo"), hi.alias("hi"), F.when(ratio >= cap, hi).otherwise(F.least(hi, F.log(ratio) * 0.5)).alias("tilt"), F.lit(1.0).alias("gap"))
    x = F.col("size") / F.col("scale")
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * x, top)))
    mass = F.col("size") * F.col("n")
    exact = lambda c: F.sum(c.cast("decimal(28,9)")).cast("double")  # noqa: E731  the same in whatever order rows come
    for _ in range(MAX_ROUNDS):
        for _ in range(NEWTON_STEPS):
            sums = cells.select("k", "size", "n").join(state, "k").groupBy("k", "target", "scale", "lo", "hi", "tilt").agg(exact(mass * rate).alias("got"), exact(F.when(F.col("tilt") * x < top, mass * rate * x).otherwise(0.0)).alias("slope"))
            over = F.col("got") > F.col("target")
            step = F.when(F.col("slope") > 0, F.col("tilt") - (F.col("got") - F.col("target")) / F.col("slope"))
            lo, hi = F.when(over, F.col("lo")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("hi"))
            gap = F.abs(F.col("got") / F.col("target") - 1)
            state = sums.select("k", "target", "scale", lo.alias("lo"), hi.alias("hi"), gap.alias("gap"), step.alias("step"), F.col("tilt").alias("was")).select("k", "target", "scale", "lo", "hi", "gap", F.when(F.col("gap") <= TOLERANCE, F.col("was")).when((F.col("step") >= F.col("lo")) & (F.col("step") <= F.col("hi")), F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2).alias("tilt"))
        state = scratch.store(state)
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select("k", "tilt", "scale")


def _handed_out(n: Column, share: Column, before: Column) -> Column:
    """Of n documents with that many expected extra copies before them, how many get one."""
    return F.floor(before + n * share + 0.5) - F.floor(before + 0.5)


def mix(docs: DataFrame, weights: list[float], total: float = 1.5, cap: float = 2.0, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", row_id: str | None = None) -> DataFrame:
    """(id, size, source_size, target, copies, taken, rid) for every row of docs.

    size is the number of words of `text` unless given. copies is a whole number up to cap (a
    whole number); taken = copies * size. Null sources are one source, the last; null texts have
    size 0 and rate 1. Rows that repeat are mixed one by one. Sources without words have target
    0. An empty table gives no rows. The same rows give the same mix again, however they are
    stored or split: ids and texts decide, and rows that are equal in both take each other's
    place. All sources meet in one task, one row each. rid is a row's number, that of the column
    row_id if docs has been stored with one.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long") if size is None else size
    by = F.xxhash64(F.col(id_col), *[F.col(c) for c in ("text",) if c in docs.columns])
    sized = scratch.store(docs.select((F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("rid"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), by.alias("by")))
    counts = scratch.store(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = scratch.store(source_targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, total, cap))
    cells = scratch.store(counts.join(targets, counts["source"].eqNullSafe(targets["source"])).select("k", "size", "n", "source_size", "target"))
    tilts = _tilts(cells.where("size > 0"), cap, scratch)

    # whole copies for each (source, size): the whole part of the rate for all of them, one more for some
    rate = F.coalesce(F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.log(F.lit(float(cap)))))), F.lit(1.0))
    down = W.partitionBy("k").orderBy(F.desc("size"))
    earlier = down.rowsBetween(W.unboundedPreceding, -1)
    c = cells.join(tilts, "k", "left").withColumn("rate", rate).withColumn("base", F.least(F.floor("rate"), F.lit(int(cap) - 1))).withColumn("share", F.col("rate") - F.col("base"))
    c = c.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("share")).over(earlier), F.lit(0.0))).withColumn("extra", _handed_out(F.col("n"), F.col("share"), F.col("before")))
    # what rounding leaves over or short is repaired with ever smaller documents
    for _ in range(REPAIRS):
        c = c.withColumn("off", F.col("target") - F.sum((F.col("base") * F.col("n") + F.col("extra")) * F.col("size")).over(W.partitionBy("k")))
        free = F.when(F.col("off") >= F.col("size"), F.col("n") - F.col("extra")).when(-F.col("off") >= F.col("size"), F.col("extra")).otherwise(0)
        c = c.withColumn("free", F.when(F.col("size") > 0, free).otherwise(0)).withColumn("used", F.coalesce(F.sum(F.col("free") * F.col("size")).over(earlier), F.lit(0)))
        moved = F.least(F.col("free"), F.greatest(F.lit(0), F.floor((F.abs("off") - F.col("used")) / F.greatest("size", F.lit(1)))))
        c = c.withColumn("extra", F.col("extra") + F.signum("off").cast("long") * F.coalesce(moved, F.lit(0)).cast("long"))
    planned = scratch.store(c.select("k", "size", "source_size", "target", "base", "n", "extra"))

    # which documents get the extra copy: even shares of the dealt groups, then hash order within
    dealt = sized.join(targets.select("k", "source"), sized["source"].eqNullSafe(targets["source"])).select("id", "rid", "by", "k", "size", F.pmod("by", F.lit(DEALT)).alias("g"))
    groups = dealt.groupBy("k", "size", "g").agg(F.count("*").alias("m")).join(planned, ["k", "size"])
    prior = F.coalesce(F.sum("m").over(W.partitionBy("k", "size").orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # of the first `prior` documents floor(prior * extra / n) are chosen, so the whole cell gets exactly `extra`
    upto = lambda p: F.floor(p * F.col("extra") / F.col("n"))
    groups = groups.withColumn("prior", prior).select("k", "size", "g", "source_size", "target", "base", (F.when(F.col("prior") + F.col("m") == F.col("n"), F.col("extra")).otherwise(upto(F.col("prior") + F.col("m"))) - upto(F.col("prior"))).alias("chosen"))
    place = F.row_number().over(W.partitionBy("k", "size", "g").orderBy(F.xxhash64("by", F.lit("copies")), "id", "rid"))
    return (
        dealt.join(groups, ["k", "size", "g"])
        .withColumn("copies", (F.col("base") + F.when(place <= F.col("chosen"), 1).otherwise(0)).cast("long"))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "rid")
    )


def op1_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), [3.0, 1.0, 2.0]).drop("rid")
