"""Packing documents into token-budget batches inside optimal length buckets.

Bucket boundaries minimise padding over the whole corpus: dynamic programming over the global
histogram of lengths. Inside a bucket every document is padded to the boundary, so a batch
holds budget // boundary of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import WORD, Scratch, table, with_row_id

BUCKETS, BUDGET = 16, 65_536
#: Documents of a bucket are dealt to shards of about this many, which are numbered apart.
SHARD_ROWS = 200_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (ascending, the last is the longest) with the least padding: sum over documents
    of boundary - length. lengths are the distinct candidates in order, counts the documents at
    each, totals their true tokens. Ties take the later split.

    With c and t the running counts and totals, closing a bucket at length x that was opened
    after place i costs best[i] + t[i] - c[i] * x and what depends on x alone. These are lines in
    x of falling slope, asked at rising x, so their lower envelope gives each round in one pass.
    Whole numbers keep it exact."""
    n = len(lengths)
    if n == 0:
        return []
    x = [int(v) for v in lengths]
    c, t = ([0, *np.cumsum(np.asarray(v, dtype=np.int64)).tolist()] for v in (counts, totals))
    best: list[int | None] = [0, *[None] * n]
    back = []
    for _ in range(min(buckets, n)):
        new: list[int | None] = [None] * (n + 1)
        arg, lines, at = [0] * (n + 1), [], 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                line = (-c[j - 1], best[j - 1] + t[j - 1], j - 1)
                while len(lines) > 1 and (line[1] - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - line[0]):
                    lines.pop()
                lines.append(line)
            if not lines:
                continue
            at = min(at, len(lines) - 1)
            value = lines[at][0] * x[j - 1] + lines[at][1]
            while at + 1 < len(lines) and (other := lines[at + 1][0] * x[j - 1] + lines[at + 1][1]) <= value:
                at, value = at + 1, other
            new[j], arg[j] = value + x[j - 1] * c[j] - t[j], lines[at][2]
        back.append(arg)
        best = new
    # the last round has min(buckets, n) buckets exactly, and more buckets never pad more
    out, j = [], n
    for arg in reversed(back):
        out.append(x[j - 1])
        j = arg[j]
    return sorted(out)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, bucket, boundary, batch_size, batch, slot, padding, over_budget) per row.

    bucket counts from 0 in order of length; batch counts from 0 inside a bucket and slot inside
    a batch; a batch has at most max(1, budget // boundary) documents, and all but a bucket's
    last are full. Documents longer than the budget stand alone (over_budget). Null and empty
    texts have 0 tokens and go with the shortest. Repeated rows each get a slot; an empty table
    gives no rows; columns other than the id and text are not read. n_tokens is the number of words
    of `text` unless a length is given.

    The histogram of lengths reaches the driver. Of m tokens in all it has at most sqrt(2 * m)
    entries, as that many distinct lengths sum up to m: a million for 5e11 tokens.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    length = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) if length is None else length
    sized = scratch.store(with_row_id(docs.select(F.col(id_col).alias("id"), length.cast("long").alias("n_tokens"))))
    length = F.greatest("n_tokens", F.lit(1)).alias("length")
    bins = sized.groupBy(length).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("total")).toPandas().sort_values("length")
    bounds = optimal_boundaries(bins.length.to_numpy(), bins.n.to_numpy(), bins.total.to_numpy(), buckets) or [1]
    upto = np.concatenate([[0], np.cumsum(bins.n.to_numpy())])[np.searchsorted(bins.length.to_numpy(), [0, *bounds], "right")]
    rows = np.diff(upto).tolist()
    shards = [max(1, -(-r // SHARD_ROWS)) for r in rows]
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]).cast("array<long>"), F.col("bucket") + 1)
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<long>"), lambda b: b < F.col("n_tokens")))
    placed = sized.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("id", "rid"), pick(shards)).cast("int"))
    firsts = placed.groupBy("bucket", "shard").agg(F.count("*").alias("m")).withColumn("first", F.coalesce(F.sum("m").over(W.partitionBy("bucket").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(W.partitionBy("bucket", "shard").orderBy("n_tokens", "id", "rid")) - 1
    ranked = placed.withColumn("place", within).join(F.broadcast(firsts.select("bucket", "shard", "first")) if sum(shards) <= 100_000 else firsts.select("bucket", "shard", "first"), ["bucket", "shard"]).withColumn("place", F.col("place") + F.col("first"))
    out = ranked.withColumn("boundary", pick(bounds)).withColumn("batch_size", pick([max(1, budget // b) for b in bounds]))
    return out.select(
        F.col("id").alias(id_col), "n_tokens", "bucket", "boundary", "batch_size",
        F.floor(F.col("place") / F.col("batch_size")).cast("long").alias("batch"), (F.col("place") % F.col("batch_size")).cast("int").alias("slot"),
        (F.col("boundary") - F.col("n_tokens")).alias("padding"), (F.col("n_tokens") > budget).alias("over_budget"),
    )


def op3_pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
