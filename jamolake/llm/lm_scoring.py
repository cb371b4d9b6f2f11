"""Language-model scores by deleted interpolation.

A token's probability mixes maximum-likelihood estimates of orders 2, 1 and 0: the bigram, the
unigram, and one over the vocabulary and an unknown word. The weights depend on how often the
context was seen (buckets of powers of two) and are learned by expectation-maximisation on a
held-out part of the training texts, against counts of the other part. The final model uses the
counts of all training texts with these weights.

Counts are exact and cover all training texts. The expectation steps see all held-out tokens,
summed by context bucket and by fine steps of the two estimates, which bounds what reaches the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._blocks import answer, ask, pack, parts_for, store_blocks, to_parts, together, unpack, with_answers
from ._common import Scratch, mix, table, tokenize, word_keys

HELD_OUT_SHARE = 8
BUCKETS, GRID, ITERATIONS = 24, 48, 200
FLOOR = 1e-6
BIGRAM = 1 << 40
_END, _START, _CONTEXT = np.uint64(1), np.uint64(2), np.uint64(0x5851F42D4C957F2D)


class _Tokens:
    """Tokens of a block: words and one end for each text, and the context of each token."""

    def __init__(self, rows: pa.Table):
        bounds, ids, words = tokenize(rows.column("text"), lower=True)
        n = len(bounds) - 1
        lens = np.diff(bounds)
        self.bounds = bounds + np.arange(n + 1)
        ends, starts = self.bounds[1:] - 1, self.bounds[:-1]
        keys = np.empty(self.bounds[-1], dtype=np.uint64)
        inside = np.ones(len(keys), dtype=bool)
        inside[ends] = False
        keys[inside] = word_keys(words)[ids]
        keys[ends] = _END
        before = np.empty_like(keys)
        before[1:] = keys[:-1]
        before[starts] = _START
        self.keys, self.before = keys, before
        self.text = np.repeat(np.arange(n), lens + 1)
        self.role = np.array(rows.column("role").to_pylist(), dtype=np.int64)  # 0 counted, 1 held-out part of training, 2 not in training
        # contexts that are not tokens (starts) are counted with the tokens, under a key of their own
        self.uni, uni_at = np.unique(np.concatenate([mix(keys, np.full_like(keys, _CONTEXT)), mix(before[starts], np.full(n, _CONTEXT))]), return_inverse=True)
        self.uni_at = uni_at[: len(keys)]
        self.before_at = np.empty(len(keys), dtype=np.int64)
        self.before_at[1:] = self.uni_at[:-1]
        self.before_at[starts] = uni_at[len(keys) :]
        self.bi, self.bi_at = np.unique(mix(before, keys), return_inverse=True)

    def counts(self):
        """For each unigram and bigram of the block: (fitted, held-out) occurrences."""
        role = self.role[self.text]
        by = lambda at, n, r: np.bincount(at[role == r], minlength=n).astype(np.uint32)
        start = np.uint64(mix(np.array([_START]), np.array([_CONTEXT]))[0])
        at = np.searchsorted(self.uni, start)
        uni = [by(self.uni_at, len(self.uni), r) for r in (0, 1)]
        for r in (0, 1):
            if len(self.role):
                uni[r][at] += np.uint32((self.role == r).sum())
        return uni, [by(self.bi_at, len(self.bi), r) for r in (0, 1)]


def _reply(part, keys, more):
    """Total counts back to each block; from unigram parts also the number of distinct tokens."""
    u, inverse, ends = together(keys)
    sums = [np.bincount(inverse, weights=np.concatenate([m[i] for m in more]), minlength=len(u)).astype(np.int64) for i in (0, 1)]
    starts = np.concatenate([[0], ends[:-1]])
    back = [pack(*(s[inverse[a:b]] for s in sums)) for a, b in zip(starts, ends)]
    if part >= BIGRAM:
        return back, []
    start = mix(np.array([_START]), np.array([_CONTEXT]))[0]
    real = u != start
    return back, [(-1, pack(np.array([(sums[0][real] > 0).sum(), ((sums[0] + sums[1])[real] > 0).sum()])))]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of distinct tokens that the unigram parts found."""
    for b in batches:
        found = [unpack(p.as_py())[0] for p in b.column("payload")]
        yield pa.RecordBatch.from_arrays([pa.array([int(f[i]) for f in found], pa.int64()) for i in (0, 1)], ["v_fit", "v"])


def _looked_up(t: _Tokens, got: list[tuple[int, bytes]]):
    """Counts of context, token and bigram at each token: arrays (fitted, held-out) of each."""
    def column(kind, i, n):
        found = [unpack(p)[i] for part, p in got if (part >= BIGRAM) == kind]
        out = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        assert len(out) == n, "answers do not fit the block"
        return out

    uni = [column(False, i, len(t.uni)) for i in (0, 1)]
    bi = [column(True, i, len(t.bi)) for i in (0, 1)]
    return [u[t.before_at] for u in uni], [u[t.uni_at] for u in uni], [b[t.bi_at] for b in bi]


def bucket(context_count: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then one for each power of two."""
    return np.minimum(np.where(context_count > 0, 1 + np.log2(np.maximum(context_count, 1)).astype(np.int64), 0), BUCKETS - 1)


def _grid(f: np.ndarray) -> np.ndarray:
    """0 for 0, else a step of the logarithm."""
    return np.where(f > 0, 1 + np.clip((-np.log10(np.maximum(f, 1e-12)) * 6).astype(np.int64), 0, GRID - 2), 0)


def learn_weights(b: np.ndarray, f2: np.ndarray, f1: np.ndarray, n: np.ndarray, f0: float, iterations: int = ITERATIONS) -> np.ndarray:
    """EM for the weights (bucket, order 2 / 1 / 0) that make n held-out tokens with these
    estimates likeliest. Buckets without held-out tokens keep the weights of the whole."""
    f = np.column_stack([f2, f1, np.full(len(b), f0)])

    def em(rows, w):
        for _ in range(iterations):
            p = f[rows] * w
            p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
            new = (p * n[rows, None]).sum(axis=0)
            new = np.maximum(new / new.sum(), FLOOR)
            new /= new.sum()
            if np.abs(new - w).max() < 1e-9:
                return new
            w = new
        return w

    whole = em(np.arange(len(b)), np.array([0.3, 0.6, 0.1])) if n.sum() > 0 else np.array([0.3, 0.6, 0.1])
    out = np.tile(whole, (BUCKETS, 1))
    for k in np.unique(b):
        rows = np.flatnonzero(b == k)
        if n[rows].sum() > 0:
            out[k] = em(rows, whole)
    out[0] = [0.0, *(out[0, 1:] / out[0, 1:].sum())]  # an unseen context has no bigrams
    return out


def score(docs: DataFrame, training: Column, held_out_share: int = HELD_OUT_SHARE, block_bytes: int | None = None) -> DataFrame:
    """(doc_id, in_training, n_tokens, n_known, train_tokens, base_score, score) for every row.

    A-Z is lowered; tokens are words and one end. training (a Boolean column; null is no) says
    which rows are learned from; of these, one in held_out_share by a hash of doc_id fits the
    weights, with a model of the rest. score is the log10 probability of the text's tokens, base_score
    that of unigrams with one added. Null and empty texts are one end token. Repeated rows count
    each time. Without training rows every token has probability 1. Columns other than doc_id
    and text (and what training reads) are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lm-scoring")
    kind = dict(docs.dtypes)["doc_id"]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(held_out_share)) == 0
    role = F.when(~F.coalesce(training, F.lit(False)), 2).when(F.coalesce(part, F.lit(False)), 1).otherwise(0)
    blocks = store_blocks(docs.select("doc_id", "text", role.cast("long").alias("role")), scratch, *([block_bytes] if block_bytes else []))
    words = (blocks.agg(F.sum("n_bytes")).first()[0] or 0) / 6
    uni_parts, bi_parts = parts_for(words / 8), parts_for(words)

    def keys(block, rows):
        t = _Tokens(rows)
        uni, bi = t.counts()
        return to_parts(block, uni_parts, 0, t.uni, *uni) + to_parts(block, bi_parts, BIGRAM, t.bi, *bi)

    answers = scratch.store(answer(ask(blocks, keys), _reply))
    sizes = answers.where("block < 0").select("payload").mapInArrow(_sizes, "v_fit long, v long")
    v_fit, v = sizes.agg(F.coalesce(F.sum("v_fit"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def held_out(_, rows, got):
        t = _Tokens(rows)
        (c1, _d1), (c2, _d2), (c12, _d12) = _looked_up(t, got)
        role = t.role[t.text]
        n_fit, n_held = int((role == 0).sum()), int((role == 1).sum())
        at = role == 1
        c1, c2, c12 = c1[at], c2[at], c12[at]
        f2 = np.where(c1 > 0, c12 / np.maximum(c1, 1), 0.0)
        cell = (bucket(c1) * GRID + _grid(f2)) * 4096 + np.minimum(c2, 63) + np.where(c2 > 63, (np.log2(np.maximum(c2, 64)) * 16).astype(np.int64), 0)
        u, inverse = np.unique(cell, return_inverse=True)
        total = lambda w: np.bincount(inverse, weights=w, minlength=len(u)).astype(np.float64)
        extra = pa.table({"cell": pa.array([-1, -2], pa.int64()), "n": pa.array([float(n_fit), float(n_held)]), "f2": [0.0, 0.0], "c2": [0.0, 0.0]})
        return pa.concat_tables([pa.table({"cell": pa.array(u, pa.int64()), "n": total(np.ones(len(inverse))), "f2": total(f2), "c2": total(c2.astype(float))}), extra])

    cells = with_answers(blocks, answers, held_out, "cell long, n double, f2 double, c2 double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "f2", "c2")])
    got = cells.orderBy("cell").toPandas()  # at most BUCKETS * GRID * about 500 cells
    n_fit = float(got.n[got.cell == -1].sum())
    n_train = n_fit + float(got.n[got.cell == -2].sum())
    got = got[got.cell >= 0]
    n = got.n.to_numpy()
    weights = learn_weights(got.cell.to_numpy() // 4096 // GRID, got.f2.to_numpy() / n, got.c2.to_numpy() / n / max(n_fit, 1.0), n, 1.0 / (v_fit + 1))

    def scored(_, rows, got):
        t = _Tokens(rows)
        (c1, c2, c12) = (a + b for a, b in _looked_up(t, got))
        w = weights[bucket(c1)]
        p = w[:, 0] * np.where(c1 > 0, c12 / np.maximum(c1, 1), 0.0) + w[:, 1] * (c2 / max(n_train, 1.0)) + w[:, 2] / (v + 1)
        total = lambda x: np.add.reduceat(x, t.bounds[:-1]) if len(t.bounds) > 1 else np.zeros(0)
        known = total((c2 > 0).astype(np.int64))
        base = total(np.log10((c2 + 1.0) / (n_train + v + 1)))
        mixed = total(np.log10(p)) if n_train else np.zeros(len(known))
        return pa.Table.from_arrays([rows.column("doc_id"), pa.array(t.role < 2), pa.array(np.diff(t.bounds)), pa.array(known), pa.array(np.full(len(known), int(n_train))), pa.array(base), pa.array(mixed)], ["doc_id", "in_training", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_answers(blocks, answers, scored, f"doc_id {kind}, in_training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_score(spark, sf_dir):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
