"""Removal of repeated passages by level-wise doubling.

Windows of half the asked length are looked at first, everywhere. Only where both halves of a
longer window (they overlap if the length is odd) are themselves repeated is that window looked
at on the next level, until the asked length is reached or no candidate survives. A window is
named by the pair of its halves' names.

Earlier levels only choose candidates, so they use short hashes; the last level tells windows
apart by 96 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import PACKED, answer, ask, pack, packed_batch, parts_for, store_blocks, to_parts, together, unpack, with_answers
from ._common import Scratch, mix, room, table, tokenize, windows, word_keys

WINDOW, LEAST_LEVEL = 35, 16
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def levels(window: int, least: int = LEAST_LEVEL) -> list[int]:
    """Lengths that double up to the window: the halves, rounded up, that are not below least."""
    out = [window]
    while (half := (out[0] + 1) // 2) >= least and half < out[0]:
        out.insert(0, half)
    return out


class _Text:
    """The words of a block and the names of their windows."""

    def __init__(self, rows: pa.Table):
        self.bounds, self.ids, self.words = tokenize(rows.column("text"), lower=False)
        self.keys = word_keys(self.words)[self.ids]
        self.room = room(self.bounds)

    def names(self, width: int) -> np.ndarray:
        return windows(self.keys, width)


def _short(names: np.ndarray, bits: int) -> np.ndarray:
    return names >> np.uint64(64 - bits) << np.uint64(64 - bits)


def _told_apart(text: _Text, where: np.ndarray, width: int, last: bool, bits: int):
    """(sorted distinct keys, more of each, number of each place in `where`, places with each).
    On the last level the key is 64 bits and goes with 32 more."""
    names = text.names(width)[where]
    if not last:
        u, inverse, n = np.unique(_short(names, bits), return_inverse=True, return_counts=True)
        return u, [], inverse, n
    second = (windows(mix(text.keys, np.full_like(text.keys, _SECOND)), width)[where] >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((second, names))
    a, b = names[order], second[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    inverse = np.empty(len(a), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return a[new], [b[new]], inverse, np.bincount(inverse, minlength=int(new.sum()))


def _candidates(text: _Text, widths: list[int], got: list[tuple[int, bytes]], level: int, bits: int) -> np.ndarray:
    """Places whose window on that level both fits and has repeated halves, given the answers of
    the earlier levels (their parts are numbered level << 40 onwards)."""
    where = np.flatnonzero(text.room >= widths[0])
    for i in range(level):
        repeated = _repeated(text, widths, got, i, where, bits)
        flags = np.zeros(len(text.keys) + 1, dtype=bool)
        flags[where[repeated]] = True
        ahead = widths[i + 1] - widths[i]
        where = np.flatnonzero(text.room >= widths[i + 1])
        where = where[flags[where] & flags[where + ahead]]
    return where


def _repeated(text: _Text, widths: list[int], got: list[tuple[int, bytes]], level: int, where: np.ndarray, bits: int) -> np.ndarray:
    last = level == len(widths) - 1
    u, _, inverse, _ = _told_apart(text, where, widths[level], last, bits)
    flags = [np.unpackbits(bits_, count=int(n[0])) for part, p in got if part >> 40 == level for n, bits_ in [unpack(p)]]
    flags = np.concatenate(flags).astype(bool) if flags else np.zeros(0, dtype=bool)
    assert len(flags) == len(u), "answers do not fit the block"
    return flags[inverse] if len(u) else np.zeros(0, dtype=bool)


def _reply(part, keys, more):
    u, inverse, ends = together(keys)
    if len(more[0]) > 1:  # the last level: 32 more bits tell windows apart
        second = np.concatenate([m[0] for m in more])
        order = np.lexsort((second, inverse))
        new = np.concatenate([[True], (inverse[order][1:] != inverse[order][:-1]) | (second[order][1:] != second[order][:-1])])
        fine = np.empty(len(order), dtype=np.int64)
        fine[order] = np.cumsum(new) - 1
        inverse = fine
    several = np.concatenate([m[-1] for m in more]).astype(np.int64)
    repeated = np.bincount(inverse, weights=1 + several)[inverse] > 1
    starts = np.concatenate([[0], ends[:-1]])
    return [pack(np.array([b - a]), np.packbits(repeated[a:b])) for a, b in zip(starts, ends)], [(-1, pack(np.array([repeated.sum()])))]


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of repeated windows that the parts found."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(unpack(p.as_py())[0][0]) for p in b.column("payload")], pa.int64())], ["n"])


def covered_words(text: _Text, widths: list[int], got: list[tuple[int, bytes]], bits: int) -> np.ndarray:
    """Whether a repeated window of the asked length covers each word."""
    last = len(widths) - 1
    where = _candidates(text, widths, got, last, bits)
    starts = where[_repeated(text, widths, got, last, where, bits)]
    change = np.zeros(len(text.keys) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + widths[-1], -1)
    return np.cumsum(change)[:-1] > 0


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False, least_level: int = LEAST_LEVEL, block_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, and kept_text if asked) for every row of docs.

    A word goes if some window of that many words that covers it also starts anywhere else, in
    the same text or another, as the input stands. Null and empty texts have no words and an
    empty kept text. Repeated rows are different places, so they remove each other. Texts
    shorter than the window lose nothing; an empty table gives no rows; columns other than
    doc_id and text are not read. Texts are taken whole.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    kind = dict(docs.dtypes)["doc_id"]
    blocks = store_blocks(docs.select("doc_id", "text"), scratch, *([block_bytes] if block_bytes else []))
    words = (blocks.agg(F.sum("n_bytes")).first()[0] or 0) / 6
    widths, parts = levels(window, least_level), parts_for(words)
    bits = min(64, max(16, int(np.ceil(np.log2(words + 2))) + 5))

    answers = None
    for level, width in enumerate(widths):
        last = level == len(widths) - 1

        def keys(block, text, got, level=level, width=width, last=last):
            where = _candidates(text, widths, got, level, bits)
            u, more, _, n = _told_apart(text, where, width, last, bits)
            return to_parts(block, parts, level << 40, u, *more, (n > 1).astype(np.uint8))

        if level == 0:
            asked = ask(blocks, lambda block, rows, keys=keys: keys(block, _Text(rows), []))
        else:
            asked = with_answers(blocks, answers, lambda block, rows, got, keys=keys: pa.Table.from_batches([packed_batch(keys(block, _Text(rows), got) if rows is not None else [])]), PACKED)
        found = scratch.store(answer(asked, _reply))
        answers = found if answers is None else answers.unionByName(found)
        if ended := not found.where("block < 0").select("payload").mapInArrow(_survivors, "n long").agg(F.sum("n")).first()[0]:
            break  # nothing repeats at this length, so nothing does at the next

    fields = [("doc_id", None), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())][: 5 if with_text else 4]

    def finish(block, rows, got):
        text = _Text(rows)
        gone = np.zeros(len(text.keys), dtype=bool) if ended else covered_words(text, widths, got, bits)
        lost = np.concatenate([[0], np.cumsum(gone)])
        words, kept_ids = text.words.to_pylist(), text.ids
        out = []
        for a, b in zip(text.bounds[:-1], text.bounds[1:]):
            n = int(lost[b] - lost[a])
            ids = kept_ids[a:b] if not n else kept_ids[a:b][~gone[a:b]]
            kept = " ".join([words[i] for i in ids])
            out.append((int(b - a), n, hashlib.sha256(kept.encode()).hexdigest(), kept))
        cols = list(zip(*out))
        return pa.Table.from_arrays([rows.column("doc_id"), *(pa.array(c, t) for c, (_, t) in zip(cols, fields[1:]))], [f for f, _ in fields])

    return with_answers(blocks, answers, finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op6_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))
