"""Joins of recordings, labels and results."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alignment import near_pairs


def fallback_join(left: DataFrame, right: DataFrame, keys: list[Column], right_key: str, value: str) -> DataFrame:
    """left with the right side's value under the first of several keys that is there. The right
    side has one row a key."""
    out = left
    for i, k in enumerate(keys):
        side = right.select(F.col(right_key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        out = out.withColumn(f"_q{i}", k).join(side, F.col(f"_q{i}") == F.col(f"_k{i}"), "left").drop(f"_q{i}", f"_k{i}")
    hit = F.coalesce(*[F.col(f"_v{i}") for i in range(len(keys))])
    return reduce(lambda d, i: d.drop(f"_v{i}"), range(len(keys)), out.withColumn(value, hit))


def latest_by_key(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row a key: the value that comes last."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def best_match(left: DataFrame, right: DataFrame, key: str, order: str, score: Column, accept: float = 0.5, bound: Column | None = None) -> DataFrame:
    """For each left row (left_id) the right row of the same key with the highest score above accept,
    the first by order on ties. The sides meet inside a key only, each left row keeps one partner
    while the pairs are made, and pairs whose bound (no less than the score, and cheap) is not
    above accept are left out before they are scored."""
    pairs = left.join(right, key)
    scored = (pairs if bound is None else pairs.where(bound > accept)).withColumn("score", score).where(F.col("score") > accept)
    return scored.groupBy(key, "left_id").agg(F.max_by(F.struct("score", order), F.struct("score", -F.col(order))).alias("best")).select(key, "left_id", "best.*")


#: Letters of a piece of texts; a text counts for some more, as comparing it has a price of its own.
PIECE_LETTERS, TEXT_LETTERS = 8_000_000, 64
#: Tasks of such a join at most.
MOST_TILES = 20_000


def _best_in_tile(accept: float, names: list[str]):
    """Of a piece of texts on the left (side 0) and one on the right the best partner of each left text."""

    def best(rows: pa.Table) -> pa.Table:
        is_left = pc.equal(rows["_side"], 0)
        left, right = rows.filter(is_left), rows.filter(pc.invert(is_left))
        # texts of one length stand together
        left = left.take(pc.sort_indices(pc.utf8_length(left["_text"])))
        places, partners, scores = (np.zeros(0, dtype) for dtype in (np.int64, np.int64, np.float64))
        if left.num_rows and right.num_rows:
            rank = np.empty(right.num_rows, dtype=np.int64)
            rank[pc.sort_indices(right["_id"]).to_numpy()] = np.arange(right.num_rows)
            for found in near_pairs(left["_text"].to_pylist(), right["_text"].to_pylist(), accept):
                i, j, s = (np.concatenate(x) for x in zip((places, partners, scores), found))
                at = np.lexsort((rank[j], -s, i))
                at = at[np.r_[True, i[at][1:] != i[at][:-1]]] if len(at) else at
                places, partners, scores = i[at], j[at], s[at]
        mine, theirs = left.take(pa.array(places)), right.take(pa.array(partners))
        return pa.table([mine["_key"], mine["_text"], pa.array(scores), theirs["_id"]], names=names)

    return best


def similar_match(left: DataFrame, right: DataFrame, key: str, order: str, accept: float = 0.85) -> DataFrame:
    """best_match() of texts s (left_id, s) and t (order, t) by 1 - distance / longer length. No pair is ever a
    row: texts of like lengths meet piece by piece, and a task compares a piece with a piece (near_pairs()).

    A side's texts of a key are laid out by length and cut into pieces of some megabytes, however many rows a key or a
    length has; a piece meets those of the other side whose lengths accept allows. Each distinct text of a key
    is matched once. Memory does not grow with the input; the work does with the pairs of texts of like lengths that
    share a run of letters. accept is between 0 and 1, order is unique in a key; rows with a null key or text and
    empty texts match nothing."""
    tidy = lambda df, text, number: df.where(F.col(key).isNotNull() & (F.col(text) != "")).groupBy(F.col(key).alias("_key"), F.col(text).alias("_text")).agg(F.min(number).alias("_id"))

    def pieces(texts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(texts with the number of their piece, the pieces' lengths)"""
        # a row a key and length
        w = W.partitionBy("_key").orderBy("_n")
        sizes = texts.groupBy("_key", "_n").agg((F.count("*") * (F.col("_n") + TEXT_LETTERS)).alias("_w")).withColumn("_before", F.sum("_w").over(w) - F.col("_w"))
        place = F.col("_before") + F.col("_w") * F.pmod(F.xxhash64("_text"), F.lit(2**30)) / 2**30
        cut = lambda c: F.floor(c / PIECE_LETTERS).cast("long")
        spans = sizes.select("_key", "_n", F.explode(F.sequence(cut(F.col("_before")), cut(F.col("_before") + F.col("_w")))).alias(name))
        return texts.join(sizes, ["_key", "_n"]).select("_key", cut(place).alias(name), "_text", "_id"), spans.groupBy("_key", name).agg(F.min("_n").alias(name + "_lo"), F.max("_n").alias(name + "_hi"))

    id_type = dict(right.dtypes)[order]
    sized = lambda df: df.withColumn("_n", F.length("_text"))
    lefts, left_pieces = pieces(sized(tidy(left, "s", "left_id").withColumn("_id", F.lit(None).cast(id_type))), "_i")
    rights, right_pieces = pieces(sized(tidy(right, "t", order)), "_j")
    # a row a tile
    like = (F.col("_j_hi") >= accept * F.col("_i_lo") - 1e-6) & (F.col("_i_hi") >= accept * F.col("_j_lo") - 1e-6)
    plan = left_pieces.join(right_pieces, "_key").where(like).select("_key", "_i", "_j")
    tiles = plan.count() or 1
    tile = ["_key", "_i", "_j"]
    a = lefts.join(plan, ["_key", "_i"]).select(*tile, F.lit(0).alias("_side"), "_text", "_id")
    b = rights.join(plan, ["_key", "_j"]).select(*tile, F.lit(1).alias("_side"), "_text", "_id")
    # as many tasks as tiles: small ones are much work too
    dealt = a.unionByName(b).repartition(max(left.sparkSession.sparkContext.defaultParallelism, min(2 * tiles, MOST_TILES)), *tile)
    schema = T.StructType([T.StructField(key, left.schema[key].dataType), T.StructField("s", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField(order, right.schema[order].dataType)])
    found = dealt.groupBy(*tile).applyInArrow(_best_in_tile(accept, schema.names), schema)
    best = found.groupBy(key, "s").agg(F.max_by(F.struct("score", order), F.struct("score", -F.col(order))).alias("best"))
    return left.select(key, "left_id", "s").join(best, [key, "s"]).select(key, "left_id", "best.*")


def match_chunks(chunks: DataFrame, sentences: DataFrame, key: str, score: Column, first: int = 10, width: int = 30, accept: float = 0.5) -> DataFrame:
    """best_match() of the first chunks (left_id, place, chunk; empty ones skipped) of each key with its
    sentences (other, sentence), both cut to a width. The limits are those of the report it is for."""
    left = chunks.where((F.col("place") < first) & (F.col("chunk") != "")).select(key, "left_id", F.substring("chunk", 1, width).alias("chunk"))
    right = sentences.select(key, "other", F.substring("sentence", 1, width).alias("sentence"))
    n, m = F.length("chunk"), F.length("sentence")
    return best_match(left, right, key, "other", score, accept, 2 * F.least(n, m) / (n + m))


def paired(x: DataFrame, y: DataFrame, key: str) -> DataFrame:
    """The outputs of two producers for the same input on one row."""
    return x.join(y, key)


def pair_by_place(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """The n-th row of a key on the left with the n-th on the right, as far as the shorter goes."""
    w = W.partitionBy(key).orderBy(order)
    placed = lambda df: df.withColumn("place", F.row_number().over(w)).drop(order)
    return placed(left).join(placed(right), [key, "place"])


def first_match(left: DataFrame, right: DataFrame, key: str, *order: str) -> DataFrame:
    """The first left row in that order whose key is on the right too."""
    return left.join(right.select(key), key, "left_semi").orderBy(*order).limit(1)
