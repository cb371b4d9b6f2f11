"""A corpus pipeline: toxic texts, exact copies and near copies go, sources are mixed, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the
last return the columns of documents; between stages the table is written as Parquet and read
again. Rows are told apart by numbers that are stored with them once a stage. All stages keep
columns that they don't know, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jamolake.llm._common import Scratch, free_name, table
from jamolake.llm.exact_dedup import exact_dedup
from jamolake.llm.jaccard_join import jaccard_groups
from jamolake.llm.mixing import mix
from jamolake.llm.packing import pack
from jamolake.llm.toxicity import fit, fold_of, keep_clean

#: Sources by code point, null last, weigh this, repeating, and share this many times all words.
WEIGHTS, TOTAL = [3.0, 1.0, 2.0], 1.5
NEAR_WORDS, NEAR_PER_CENT = 5, 80


def _numbered(spark: SparkSession, docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs stored once with a row number, and the name of its column, which docs doesn't have."""
    rid = free_name(docs, "_rid")
    return Scratch(spark, name).numbered(docs, rid), rid


def _without(docs: DataFrame, rid: str, gone: DataFrame) -> DataFrame:
    return docs.join(gone.select(F.col("rid").alias(rid)), rid, "left_anti").drop(rid)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score, by a lexicon learned from `labels`, is below the threshold. Labels
    of a third of the ids are never learned from, so that they can tell how well it works. Null
    and empty texts match nothing; repeated rows are judged alike."""
    labels = table(spark, sf_dir, "labels")
    return keep_clean(docs, fit(docs, labels.where(fold_of(F.col("doc_id"), 3) != 1)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; null texts are empty texts, null ids the
    smallest, and of rows that repeat one stays. An empty table stays empty."""
    rows, rid = _numbered(spark, docs, "copies")
    return _without(rows, rid, exact_dedup(rows, row_id=rid).where(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) the row with the least doc_id
    (null ids the largest, one of repeated rows). Texts without words are in no group and stay."""
    rows, rid = _numbered(spark, docs, "near-copies")
    scratch = Scratch(spark, "near-copies")
    groups = scratch.store(jaccard_groups(rows, NEAR_WORDS, NEAR_PER_CENT, row_id=rid))
    keep = scratch.store(groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("keep")))
    return _without(rows, rid, groups.join(keep, "root").where("rid <> keep"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: rows of null texts have no words and stay once."""
    rows, rid = _numbered(spark, docs, "mix")
    times, copy = free_name(docs, "_copies"), free_name(docs, "_copy")
    copies = mix(rows, WEIGHTS, TOTAL, row_id=rid).where("copies > 0").select(F.col("rid").alias(rid), F.col("copies").alias(times))
    return rows.join(copies, rid).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop(rid, times, copy)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of each row; see pack()."""
    return pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_batches)]

#: SQL expresses neither the lexicon, the near copies nor the mix; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.store(stage(spark, docs, sf_dir))
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
