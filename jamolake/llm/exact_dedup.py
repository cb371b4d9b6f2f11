"""Exact duplicate texts by deterministic block naming. [native]

Texts are cut into blocks of fixed size; equal blocks get equal integer names by sorting the
distinct ones; adjacent names are paired and the distinct pairs named in turn, until each text
has one name. Two texts have the same (number of blocks, last name) only if they are equal, so
the identity is free of collisions.

Blocks travel by a 64-bit fingerprint. Before fingerprints are sorted into names, one
aggregation shows that each stands for a single content (its least content equals its greatest).
Should that ever fail, the contents themselves are sorted instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import Scratch, table

BLOCK_BYTES = 4096
#: Names are handed out in this many independent sorts; distinct keys are dealt evenly by hash.
NAME_BUCKETS = 4096


def _names(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """An integer for each distinct key: its place in the sorted keys of its bucket, times the
    number of buckets, plus the bucket."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(NAME_BUCKETS))
    place = F.row_number().over(W.partitionBy("bucket").orderBy(*keys)).cast("long")
    return distinct.withColumn("bucket", bucket).select(*keys, ((place - 1) * NAME_BUCKETS + F.col("bucket")).alias("name"))


def block_identity(texts: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(rid, text, more) to (rid, n_blocks, name, more): (n_blocks, name) are equal exactly for equal
    texts. Null counts as empty. Row numbers and whatever more there is are read once, with the
    blocks, and more goes with a text's first block alone."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.length("data") / block_bytes)).cast("int")
    part = lambda i: F.substring(F.col("data"), i * block_bytes + 1, F.lit(block_bytes))
    cut = texts.select("rid", "more", data.alias("data")).withColumn("n_blocks", n_blocks)
    blocks = cut.select("rid", "more", "n_blocks", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("i"), "data").select("rid", F.when(F.col("i") == 0, F.col("more")).alias("more"), "n_blocks", "i", part(F.col("i")).alias("block")).withColumn("fp", fingerprint(F.col("block")))
    per_print = blocks.groupBy("fp").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    prints = scratch.store(per_print.select("fp", (F.col("lo") == F.col("hi")).alias("single")))
    keys = ["fp"] if prints.where(~F.col("single")).limit(1).count() == 0 else ["fp", "block"]
    if keys == ["fp"]:
        level = prints.select("fp")
        occ = blocks.select("rid", "more", "n_blocks", "i", "fp")
    else:
        level = blocks.select(*keys).distinct()
        occ = blocks.select("rid", "more", "n_blocks", "i", *keys)
    named = scratch.store(occ.join(_names(level, keys), keys).select("rid", "more", "n_blocks", "i", "name"))
    done, left = named.where("n_blocks = 1").select("rid", "n_blocks", "name", "more"), named.where("n_blocks > 1").withColumn("n_left", F.col("n_blocks"))
    most = named.agg(F.max("n_blocks")).first()[0] or 1
    while most > 1:
        odd = F.col("i") % 2 == 1
        pairs = left.groupBy("rid", "n_blocks", (F.col("i") / 2).cast("int").alias("i"), ((F.col("n_left") + 1) / 2).cast("int").alias("n_left")).agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("b"), F.max("more").alias("more"))
        left = scratch.store(pairs.join(_names(pairs.select("a", "b").distinct(), ["a", "b"]), ["a", "b"]).select("rid", "more", "n_blocks", "i", "n_left", "name"))
        done = done.unionByName(left.where("n_left = 1").select("rid", "n_blocks", "name", "more"))
        left = left.where("n_left > 1")
        most = (most + 1) // 2
    return done


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, fingerprint: Callable[[Column], Column] = F.xxhash64, row_id: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, rid.

    Of equal texts the row with the largest doc_id stays (null ids are the smallest; among rows
    that repeat a doc_id, one stays). Null text counts as empty, and empty texts are equal to
    each other. Empty tables give no rows; other columns of docs are not read. rid is a row's
    number, that of the column row_id if docs has been stored with one.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    more = F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")).alias("more")
    rows = docs.select((F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("rid"), "text", more)
    tagged = scratch.store(block_identity(rows, scratch, block_bytes, fingerprint).select("n_blocks", "name", "rid", "more.*"))
    # stored, so that a hot text's rows can be split over tasks when they meet their group's row
    groups = scratch.store(tagged.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")))
    return tagged.join(groups, ["n_blocks", "name"]).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256", "rid")


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).drop("rid")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
  sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""
