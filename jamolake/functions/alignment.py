"""Alignment of letter sequences, error rates and sequence matching.

Distances of short texts are the built-in levenshtein(). Long ones, and the path itself where it is
wanted, come from Arrow UDFs that work on many pairs at once: built-in functions give no path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .phonology import LINKING

ALIGNMENT = T.ArrayType(T.StructType().add("position", T.IntegerType()).add("expected", T.StringType()).add("actual", T.StringType()).add("status", T.StringType()))
OPCODES = T.ArrayType(T.StructType().add("type", T.StringType()).add("ref", T.StringType()).add("hyp", T.StringType()))


DIAGNOSIS = T.StructType().add("correct", T.IntegerType()).add("substitution", T.IntegerType()).add("insertion", T.IntegerType()).add("deletion", T.IntegerType()).add("linking", T.IntegerType()).add("subs", T.ArrayType(T.StructType().add("exp", T.StringType()).add("act", T.StringType())))

#: Words of each of the four tables that are filled side by side. A long pair stands alone, and its table
#: is never there as a whole.
CELLS = 2_000_000
#: Pairs whose distances are found together, and letters of a text from which on a pair stands alone.
GROUP, LONG = 2048, 2048
STATUS = ["correct", "substitution", "insertion", "deletion"]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


_SILENT, _LINKING = _codes("ㅇ")[0], _codes("".join(LINKING))


def _side_by_side(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, lengths of a, lengths of b): the letters of all pairs, filled up with ones that match nothing."""
    n, m = (np.array([len(p[s]) for p in pairs]) for s in (0, 1))
    a, b = np.full((len(pairs), n.max(initial=0)), 2**32 - 1, dtype=np.uint32), np.full((len(pairs), m.max(initial=0)), 2**32 - 2, dtype=np.uint32)
    for r, (e, x) in enumerate(pairs):
        a[r, : len(e)] = e
        b[r, : len(x)] = x
    return a, b, n, m


def _next_row(last: np.ndarray, letter: np.ndarray, b: np.ndarray, ramp: np.ndarray) -> np.ndarray:
    """The next row of a table of unit costs, of one pair or (along the first axis) of many."""
    row = last + last.dtype.type(1)
    np.minimum(row[..., 1:], last[..., :-1] + (b != letter), out=row[..., 1:])
    # insertions spread to the right as a running minimum
    row -= ramp
    np.minimum.accumulate(row, axis=-1, out=row)
    row += ramp
    return row


def _columns(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Column by column the tables of unit costs of all pairs, as signs of steps, 64 rows a word: words (word,
    pair) of rows whose cost is above or below that of the column before, and of the row above. One
    round of word operations moves all pairs on; what leaves a word at the top enters the next."""
    k, words = len(a), max(1, -(-a.shape[1] // 64))
    letters = np.unique(a)

    def code(x):
        at = np.searchsorted(letters, x)
        return np.where(letters[np.minimum(at, len(letters) - 1)] == x, at, len(letters)) if len(letters) else np.zeros(x.shape, np.int64)

    a_at, b_at, rows, one, top = code(a), code(b).T.copy(), np.arange(k), np.uint64(1), np.uint64(63)
    equal = np.zeros((len(letters) + 1, words, k), dtype=np.uint64)
    for i in range(a.shape[1]):
        equal[a_at[:, i], i >> 6, rows] |= one << np.uint64(i & 63)
    equal[len(letters)] = 0
    up, down = np.full((words, k), ~np.uint64(0)), np.zeros((words, k), dtype=np.uint64)
    for at in b_at:
        same = equal[at, :, rows].T
        rises, falls, ups, downs = (np.empty((words, k), dtype=np.uint64) for _ in range(4))
        rise, fall = one, np.uint64(0)
        for w in range(words):
            p, q, e = up[w], down[w], same[w]
            side = e | q
            e = e | fall
            across = (((e & p) + p) ^ p) | e
            rises[w] = plus = q | ~(across | p)
            falls[w] = minus = p & across
            plus_in, minus_in = (plus << one) | rise, (minus << one) | fall
            ups[w], downs[w] = minus_in | ~(side | plus_in), plus_in & side
            rise, fall = plus >> top, minus >> top
        up, down = ups, downs
        yield rises, falls, up, down


def _distances_together(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """Edit distances by bit-parallel dynamic programming."""
    a, b, n, m = _side_by_side(pairs)
    rows, word, bit = np.arange(len(pairs)), np.maximum(n - 1, 0) >> 6, (np.maximum(n - 1, 0) & 63).astype(np.uint64)
    score, one = n.astype(np.int64), np.uint64(1)
    for j, (rises, falls, _, _) in enumerate(_columns(a, b)):
        change = ((rises[word, rows] >> bit) & one).astype(np.int64) - ((falls[word, rows] >> bit) & one).astype(np.int64)
        score += np.where(j < m, change, 0)
    return np.where(n == 0, m, score).tolist()


def _distance_long(a: np.ndarray, b: np.ndarray) -> int:
    """The same for one long pair, with a whole column in one of Python's long integers."""
    if not len(a):
        return len(b)
    equal: dict[int, int] = {}
    for letter in np.unique(a).tolist():
        equal[letter] = int.from_bytes(np.packbits(a == letter, bitorder="little").tobytes(), "little")
    mask, top = (1 << len(a)) - 1, len(a) - 1
    up, down, score = mask, 0, len(a)
    for letter in b.tolist():
        e = equal.get(letter, 0)
        side = e | down
        across = (((e & up) + up) ^ up) | e
        plus, minus = down | ~(across | up), up & across
        score += (plus >> top & 1) - (minus >> top & 1)
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(side | plus)) & mask, plus & side & mask
    return score


def distances(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """Edit distances of pairs, short ones of like size together."""
    out: list = [None] * len(pairs)
    short = [r for r, (e, x) in enumerate(pairs) if len(e) <= LONG and len(x) <= LONG]
    order = sorted(short, key=lambda r: (-(-len(pairs[r][0]) // 64), len(pairs[r][1])))
    for at in range(0, len(order), GROUP):
        some = order[at : at + GROUP]
        for r, d in zip(some, _distances_together([pairs[r] for r in some])):
            out[r] = d
    return [_distance_long(*pairs[r]) if d is None else d for r, d in enumerate(out)]


def _steps_together(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Unit-cost alignments as places in STATUS; read from the end, a match goes before a
    substitution, that before an insertion, and a deletion comes last. All pairs' tables are
    filled and read in step; they hold the signs of steps, from which the costs around a cell follow."""
    a, b, n, m = _side_by_side(pairs)
    k, words = len(pairs), max(1, -(-a.shape[1] // 64))
    rises, falls, ups, downs = (np.empty((max(1, b.shape[1]), words, k), dtype=np.uint64) for _ in range(4))
    for j, column in enumerate(_columns(a, b)):
        rises[j], falls[j], ups[j], downs[j] = column
    rows, one = np.arange(k), np.uint64(1)
    bits = lambda table, j, i: ((table[j, i >> 6, rows] >> (i & 63).astype(np.uint64)) & one).astype(bool)
    steps, i, j = [], n.copy(), m.copy()
    while (live := (i > 0) | (j > 0)).any():
        up, left = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        both = (i > 0) & (j > 0)
        same = both & (a[rows, up] == b[rows, left]) if a.size and b.size else both
        # the diagonal is cheaper by one where just one of the steps down (here) and right (a row above) costs one
        above = np.maximum(i - 2, 0)
        right, back = (i < 2) | bits(rises, left, above), (i >= 2) & bits(falls, left, above)
        rise, fall = bits(ups, left, up), bits(downs, left, up)
        swap = both & ((rise & ~right & ~back) | (right & ~rise & ~fall))
        add = (j > 0) & ((i == 0) | bits(rises, left, up))
        what = np.where(same, 0, np.where(swap, 1, np.where(add, 2, 3))).astype(np.int8)
        steps.append(np.where(live, what, np.int8(-1)))
        i, j = i - (live & (what != 2)), j - (live & (what != 3))
    table = np.array(steps).T if steps else np.zeros((k, 0), dtype=np.int8)
    return [line[line >= 0][::-1] for line in table]


def _steps_long(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same steps of one long pair. Every so many rows of its table are kept, and the rows between two of
    them are made again, from the last pair of kept rows to the first, while the path is read: memory
    grows with len(b) * sqrt(len(a))."""
    every = max(1, math.isqrt(len(a)))
    ramp = np.arange(len(b) + 1, dtype=np.int32)
    kept, last = [ramp], ramp
    for i in range(len(a)):
        last = _next_row(last, a[i], b, ramp)
        if (i + 1) % every == 0:
            kept.append(last)
    i, j, steps = len(a), len(b), bytearray()
    while i > 0:
        base = (i - 1) // every * every
        rows = [kept[base // every]]
        for r in range(base, i):
            rows.append(_next_row(rows[-1], a[r], b, ramp))
        cost = np.stack(rows).astype(np.uint8)
        del rows
        while i > base:
            here, line = i - base, (int(cost[i - base, j]) - 1) & 255
            kind = 0 if j and a[i - 1] == b[j - 1] else 1 if j and cost[here - 1, j - 1] == line else 2 if j and cost[here, j - 1] == line else 3
            steps.append(kind)
            i, j = i - (kind != 2), j - (kind != 3)
    steps += b"\2" * j
    return np.frombuffer(bytes(steps), np.int8)[::-1]


def steps(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Alignments of pairs, short ones of like size together, in order."""
    order = sorted(range(len(pairs)), key=lambda r: (-(-len(pairs[r][0]) // 64), len(pairs[r][1])))
    out: list = [None] * len(pairs)
    at = 0
    while at < len(order):
        words = lambda r: max(1, -(-len(pairs[r][0]) // 64))
        to, wide, long = at, 0, 0
        while to < len(order) and to - at < GROUP:
            r = order[to]
            wide, long = max(wide, words(r)), max(long, len(pairs[r][1]))
            if to > at and (to - at + 1) * wide * (long + 1) > CELLS:
                break
            to += 1
        some = [pairs[r] for r in order[at:to]]
        longest = max(max(len(e), len(x)) for e, x in some)
        # numpy earns nothing on a few long pairs
        got = [_steps_long(*p) for p in some] if longest > LONG or len(some) < longest >> 6 else _steps_together(some)
        for r, g in zip(order[at:to], got):
            out[r] = g
        at = to
    return out


#: Classes in which letters are counted, and how many of them are compared for all pairs; letters of a run, and
#: classes in which runs are counted; pairs of texts that are told apart further at once.
LETTERS, FIRST_LOOK, RUN, RUNS, SURVIVORS = 32, 20, 4, 1024, 20_000
#: Pairs in whose time a step through names is made, and pairs that share pieces held at once.
STEP, MOST_MET = 2000, 1 << 20


def _counts(texts: list[np.ndarray], q: int, size: int, kind: type) -> np.ndarray:
    """How often each class of runs of q letters is in each text. Counts are capped where sums would not fit; capped
    ones differ by no more than whole ones."""
    most = min(np.iinfo(kind).max, 30_000 // size)
    lengths, out, at = np.array([len(t) for t in texts]), np.zeros((len(texts), size), dtype=kind), 0
    ends = np.cumsum(lengths)
    while at < len(texts):
        # so many letters together, one text at least
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SURVIVORS * 10, "right")))
        flat, row = np.concatenate(texts[at:to]).astype(np.uint64), np.repeat(np.arange(to - at), lengths[at:to])
        runs, inside = flat[: max(0, len(flat) - q + 1)], row[: max(0, len(flat) - q + 1)] == row[q - 1 :]
        for k in range(1, q):
            runs = runs * np.uint64(0x9E3779B97F4A7C15) + flat[k : len(flat) - q + 1 + k]
        kinds = (runs if q == 1 else runs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40))[inside] % np.uint64(size)
        found = np.bincount(row[: len(inside)][inside] * size + kinds.astype(np.int64), minlength=(to - at) * size)
        out[at:to] = np.minimum(found, most).reshape(-1, size)
        at = to
    return out


class _Side:
    """Texts in order of length, with what is compared of them."""

    def __init__(self, texts: list[str]):
        self.order = np.argsort([len(t) for t in texts], kind="stable")
        self.codes = [_codes(texts[r]) for r in self.order.tolist()]
        self.n = np.array([len(t) for t in self.codes], dtype=np.int64)
        self.letters, self.runs = _counts(self.codes, 1, LETTERS, np.int16), _counts(self.codes, RUN, RUNS, np.uint8)
        self.starts = np.cumsum(self.n) - self.n
        flat = np.concatenate([*self.codes, np.zeros(0, np.uint32)]).astype(np.uint64) + np.uint64(1)
        self.sums = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum(flat * _powers(_BASE, int(self.n.max(initial=0)))[np.arange(len(flat)) - np.repeat(self.starts, self.n)], out=self.sums[1:])

    def named(self, rows: slice, place: int, size: int, back: np.uint64) -> np.ndarray:
        """Names of the pieces of that many letters at a place of texts; equal pieces have equal names."""
        at = self.starts[rows] + place
        return (self.sums[at + size] - self.sums[at]) * back


_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to n modulo 2 ** 64."""
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base % 2**64, dtype=np.uint64)])


def _pieces(length: int, edits: int) -> list[tuple[int, int, int]]:
    """(place, letters, number from 1) of the pieces of a text of that length, one more than edits."""
    cuts = [length * k // (edits + 1) for k in range(edits + 2)]
    return [(x, y - x, k + 1) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]


def near_pairs(left: list[str], right: list[str], accept: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs (places on the left, on the right, scores) with 1 - distance / longer length above accept, in
    batches; no text is empty.

    The longer text of a pair is cut into one piece more than edits are allowed. Then for some k piece k is in the
    other text unchanged, with k - 1 edits before it, so it has moved by less than k letters, and the rest of the
    edits behind it (the first k pieces with less than k edits end with such a one). Texts meet where they share a
    piece like that, found by its name; where there are fewer pairs than that would take steps, all pairs meet.
    Pairs are then compared by counts of letters, and of runs: d edits change at most d letters, and RUN times d runs, of
    either text. What these bounds leave is aligned."""
    a, b = _Side(left), _Side(right)
    varied = np.argsort(-b.letters.var(axis=0), kind="stable") if len(b.n) else np.arange(LETTERS)
    for side in (a, b):
        side.letters = np.ascontiguousarray(side.letters[:, varied])
        side.columns = np.ascontiguousarray(side.letters[:, :FIRST_LOOK].T)
    back = _powers(pow(_BASE, -1, 2**64), int(max(a.n.max(initial=0), b.n.max(initial=0))))
    # of texts of one length the right one counts as the longer
    for long, short, swap in ((b, a, True), (a, b, False)):
        held, n = [], 0
        for ones, many in _alike(long, short, accept, 0 if swap else 1, back):
            held.append(np.stack([ones, many]))
            n += len(ones)
            if n >= SURVIVORS:
                yield from _scored(long, short, np.concatenate(held, axis=1), accept, swap)
                held, n = [], 0
        if held:
            yield from _scored(long, short, np.concatenate(held, axis=1), accept, swap)


def _scored(long: _Side, short: _Side, pairs: np.ndarray, accept: float, swap: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for at in range(0, pairs.shape[1], SURVIVORS):
        i, j = pairs[:, at : at + SURVIVORS]
        here, there = long.runs[i], short.runs[j]
        differ = (np.maximum(here, there) - np.minimum(here, there)).sum(axis=1, dtype=np.int64)
        like = differ + np.maximum(long.n[i], RUN - 1) - np.maximum(short.n[j], RUN - 1) <= 2 * RUN * _most(long.n[i], accept)
        i, j = i[like], j[like]
        score = 1 - np.array(distances([(long.codes[x], short.codes[y]) for x, y in zip(i.tolist(), j.tolist())]), dtype=np.float64) / long.n[i]
        good = score > accept
        i, j = long.order[i[good]], short.order[j[good]]
        yield (j, i, score[good]) if swap else (i, j, score[good])


def _most(longer, accept: float):
    """The most edits of a pair above accept."""
    return np.ceil((1 - accept) * longer + 1e-9).astype(np.int64) - 1


def _alike(long: _Side, short: _Side, accept: float, less: int, back: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places in long, places in short), each once, that their letters allow, with the text in short by that
    much shorter at least."""
    for length in np.unique(long.n):
        edits = int(_most(length, accept))
        first, end = np.searchsorted(long.n, [length, length + 1]).tolist()
        lo, hi = np.searchsorted(short.n, [length - edits, length - less + 1]).tolist()
        if lo >= hi:
            continue
        # a step for each piece and how far it may have moved
        steps = [(*piece, by) for piece in _pieces(int(length), edits) for by in range(max(1 - piece[2], piece[2] - 1 - 2 * edits), piece[2])] if (edits + 1) ** 2 // 2 * STEP < (end - first) * (hi - lo) else None
        if steps is None:
            yield from _all_alike(long, short, range(first, end), lo, hi, edits)
            continue
        names = {place: _sorted_names(long.named(slice(first, end), place, size, back[place])) for place, size, k in _pieces(int(length), edits)}
        todo = [(x, min(hi, x + MOST_MET)) for x in range(lo, hi, MOST_MET)]
        while todo:
            x, y = todo.pop()
            met = _met(long, short, first, end, x, y, int(length), edits, steps, names, back)
            if met is None:  # too many at once
                todo += [(x, (x + y) // 2), ((x + y) // 2, y)]
            elif len(met):
                yield met // len(short.n), met % len(short.n)


def _sorted_names(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct names, where each begins, how often it is there, places in order of names)."""
    order = np.argsort(names, kind="stable")
    distinct, begin, times = np.unique(names[order], return_index=True, return_counts=True)
    return distinct, begin, times, order


def _met(long: _Side, short: _Side, first: int, end: int, x: int, y: int, length: int, edits: int, steps: list, names: dict, back: np.ndarray) -> np.ndarray | None:
    """Pairs as numbers (place in long times texts in short, and place in short) of long[first:end] and short[x:y] that
    share a piece and that their letters allow; None if they are too many and there is more than one text in short."""
    found, held = [np.zeros(0, dtype=np.int64)], 0
    for place, size, k, by in steps:
        # the edits behind the piece are no fewer than what lengths there differ by
        after = edits + 1 - k
        lowest, highest = max(length - after + by, place + by + size), length + after + by
        if place + by < 0 or lowest > highest:
            continue
        lo, hi = (x + np.searchsorted(short.n[x:y], [lowest, highest + 1])).tolist()
        if lo >= hi:
            continue
        distinct, begin, times, order = names[place]
        mine = short.named(slice(lo, hi), place + by, size, back[place + by])
        at = np.minimum(np.searchsorted(distinct, mine), len(distinct) - 1)
        j = np.flatnonzero(distinct[at] == mine)
        at = at[j]
        n = times[at]
        total = int(n.sum())
        if total > MOST_MET and y - x > 1:
            return None
        i = order[np.repeat(begin[at], n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)] + first
        j = np.repeat(j + lo, n)
        for some in range(0, total, SURVIVORS):
            p, q = i[some : some + SURVIVORS], j[some : some + SURVIVORS]
            like = np.abs(long.letters[p] - short.letters[q]).sum(axis=1, dtype=np.int32) <= 2 * edits - (length - short.n[q])
            found.append(p[like] * len(short.n) + q[like])
            held += len(found[-1])
        if held > MOST_MET:
            found = [np.unique(np.concatenate(found))]
            held = len(found[0])
            if held > MOST_MET // 2 and y - x > 1:
                return None
    return np.unique(np.concatenate(found))


def _all_alike(long: _Side, short: _Side, rows: range, lo: int, hi: int, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of those rows in long and all of short[lo:hi] that their letters allow."""
    total, step = (np.empty(hi - lo, dtype=np.int16) for _ in range(2))
    for i in rows:
        # what letters may differ by: twice the most edits, less the difference in length
        room = np.minimum(2 * edits - (long.n[i] - short.n[lo:hi]), 32_000).astype(np.int16)
        np.abs(np.subtract(short.columns[0, lo:hi], long.letters[i, 0], out=total), out=total)
        for k in range(1, FIRST_LOOK):
            total += np.abs(np.subtract(short.columns[k, lo:hi], long.letters[i, k], out=step), out=step)
        kept = np.flatnonzero(total <= room)
        kept = kept[total[kept] + np.abs(short.letters[lo + kept, FIRST_LOOK:] - long.letters[i, FIRST_LOOK:]).sum(axis=1, dtype=np.int16) <= room[kept]]
        for at in range(0, len(kept), SURVIVORS):
            some = kept[at : at + SURVIVORS] + lo
            yield np.full(len(some), i), some


def align_all(pairs: list[tuple[str, str]]) -> list[list[dict]]:
    """The steps of each pair with their letters."""
    out = []
    for (e, x), kinds in zip(pairs, steps([(_codes(e), _codes(x)) for e, x in pairs])):
        e_at, x_at, path = 0, 0, []
        for kind in kinds.tolist():
            expected, actual = (e[e_at] if kind != 2 else None), (x[x_at] if kind != 3 else None)
            e_at, x_at = e_at + (kind != 2), x_at + (kind != 3)
            path.append({"position": len(path), "expected": expected, "actual": actual, "status": STATUS[kind]})
        out.append(path)
    return out


@F.pandas_udf(ALIGNMENT)
def align(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """Alignment of two letter strings; null if either is."""
    pairs = list(zip(expected, actual))
    given = [r for r, (e, a) in enumerate(pairs) if e is not None and a is not None]
    out = pd.Series([None] * len(pairs), dtype=object)
    for r, path in zip(given, align_all([pairs[r] for r in given])):
        out[r] = path
    return out


@F.arrow_udf(DIAGNOSIS)
def diagnose(expected: pa.Array, actual: pa.Array) -> pa.Array:
    """What the alignment of two letter strings shows: the number of steps of each kind, of lost silent
    initials right after a consonant, and the substitutions in order. Nulls count as empty."""
    pairs = [(_codes(e or ""), _codes(a or "")) for e, a in zip(expected.to_pylist(), actual.to_pylist())]
    numbers, ends, exp, act = [], [0], [_codes("")], [_codes("")]
    for (e, x), kinds in zip(pairs, steps(pairs)):
        # steps but insertions are the expected letters, steps but deletions the actual ones
        of_e, of_x = kinds[kinds != 2], kinds[kinds != 3]
        linked = (of_e[1:] == 3) & (e[1:] == _SILENT) & np.isin(e[:-1], _LINKING)
        numbers.append((*np.bincount(kinds, minlength=4), linked.sum()))
        exp.append(e[of_e == 1])
        act.append(x[of_x == 1])
        ends.append(ends[-1] + len(exp[-1]))
    letters = lambda parts: pa.array(list(np.concatenate(parts).tobytes().decode("utf-32-le")), pa.string())
    subs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([letters(exp), letters(act)], ["exp", "act"]))
    columns = np.array(numbers, dtype=np.int32).reshape(-1, 5).T
    return pa.StructArray.from_arrays([*(pa.array(c) for c in columns), subs], ["correct", "substitution", "insertion", "deletion", "linking", "subs"])


def _common_together(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Steps along a longest common subsequence, 0 equal, 1 insert, 2 delete. All pairs' tables are filled and
    read in step."""
    a, b, i, j = _side_by_side(pairs)
    rows, best = np.arange(len(pairs)), np.zeros((a.shape[1] + 1, len(pairs), b.shape[1] + 1), dtype=np.int32)
    for at in range(a.shape[1]):
        row, last = best[at + 1], best[at]
        row[:, 1:] = np.where(b == a[:, at, None], np.maximum(last[:, 1:], last[:, :-1] + 1), last[:, 1:])
        np.maximum.accumulate(row, axis=1, out=row)
    steps = []
    while (live := (i > 0) | (j > 0)).any():
        up, left = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        both = (i > 0) & (j > 0)
        same = both & (a[rows, up] == b[rows, left]) if a.size and b.size else both
        add = (j > 0) & ((i == 0) | (best[i, rows, left] >= best[up, rows, j]))
        what = np.where(same, 0, np.where(add, 1, 2)).astype(np.int8)
        steps.append(np.where(live, what, np.int8(-1)))
        i, j = i - (live & (what != 1)), j - (live & (what != 2))
    table = np.array(steps).T if steps else np.zeros((len(pairs), 0), dtype=np.int8)
    return [line[line >= 0][::-1] for line in table]


@F.pandas_udf(OPCODES)
def align_common(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Letters in common, inserted and deleted along a longest common subsequence, white space left
    out; read from the end, a match goes first and an insertion before a deletion on ties."""
    texts = [None if r is None or h is None else ("".join(r.split()), "".join(h.split())) for r, h in zip(reference, hypothesis)]
    pairs = [t and (_codes(t[0]), _codes(t[1])) for t in texts]
    order = sorted((r for r, p in enumerate(pairs) if p), key=lambda r: (len(pairs[r][0]), len(pairs[r][1])))
    out: list = [None] * len(pairs)
    at = 0
    while at < len(order):
        to, wide = at, 0
        while to < len(order) and to - at < GROUP:
            wide = max(wide, len(pairs[order[to]][1]) + 1)
            if to > at and (to - at + 1) * wide * (len(pairs[order[to]][0]) + 1) > CELLS:
                break
            to += 1
        for r, kinds in zip(order[at:to], _common_together([pairs[r] for r in order[at:to]])):
            (ref, hyp), i, j, out[r] = texts[r], 0, 0, []
            for kind in kinds.tolist():
                out[r].append({"type": ("equal", "insert", "delete")[kind], "ref": ref[i] if kind != 1 else "", "hyp": hyp[j] if kind != 2 else ""})
                i, j = i + (kind != 1), j + (kind != 2)
        at = to
    return pd.Series(out, dtype=object)


def _longest_runs(windows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of each window, two pieces of letters, (start in a, start in b, length) of the longest run in common, on
    ties the first in a and of these the first in b. Letter by letter of a, the runs that end there at
    each letter of b grow by one, in all windows at once; of a window no more than one row is held."""
    a, b, _, _ = _side_by_side(windows)
    run, best = np.zeros((len(windows), b.shape[1] + 1), dtype=np.int32), np.zeros((3, len(windows)), dtype=np.int64)
    for i in range(a.shape[1]):
        # a copy of the row before is shifted, and cut to 0 where letters differ
        run[:, 1:] = (run[:, :-1] + 1) * (b == a[:, i, None])
        top = run.max(axis=1)
        longer = np.flatnonzero(top > best[2])
        if len(longer):
            size = top[longer]
            best[:, longer] = i + 1 - size, run[longer].argmax(axis=1) - size, size
    return best.T


def _popular(b: np.ndarray) -> np.ndarray:
    """The letters of a text of 200 and more that make up over a hundredth of it (and one more)."""
    letters, times = np.unique(b, return_counts=True)
    return letters[times > len(b) // 100 + 1] if len(b) >= 200 else letters[:0]


def common_blocks(pairs: list[tuple[np.ndarray, np.ndarray]], popular: bool = False) -> list[list[tuple[int, int, int]]]:
    """Of each pair the blocks (start in a, start in b, length) in common: the longest run, then the same left and
    right of it. With popular, a run starts from no popular letter of b, but grows over them.
    All windows of a level, of all pairs, are searched together, those of like size side by side."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in pairs]
    rare = [np.where(np.isin(b, _popular(b)), np.uint32(2**32 - 2), b) if popular else b for _, b in pairs]
    level = [(r, 0, len(a), 0, len(b)) for r, (a, b) in enumerate(pairs) if len(a) and len(b)]
    while level:
        level.sort(key=lambda w: (w[2] - w[1], w[4] - w[3]))
        below, at = [], 0
        while at < len(level):
            to, wide = at, 0
            while to < len(level) and to - at < GROUP:
                wide = max(wide, level[to][4] - level[to][3])
                if to > at and (to - at + 1) * wide > CELLS // 8:
                    break
                to += 1
            some = level[at:to]
            runs = _longest_runs([(pairs[r][0][i:i2], rare[r][j:j2]) for r, i, i2, j, j2 in some])
            for (r, a_lo, a_hi, b_lo, b_hi), (i, j, k) in zip(some, runs.tolist()):
                i, j = a_lo + i, b_lo + j
                if popular:
                    a, b = pairs[r]
                    while i > a_lo and j > b_lo and a[i - 1] == b[j - 1]:
                        i, j, k = i - 1, j - 1, k + 1
                    while i + k < a_hi and j + k < b_hi and a[i + k] == b[j + k]:
                        k += 1
                if k:
                    found[r].append((i, j, k))
                    below += [w for w in ((r, a_lo, i, b_lo, j), (r, i + k, a_hi, j + k, b_hi)) if w[1] < w[2] and w[3] < w[4]]
            at = to
        level = below
    return [sorted(blocks) for blocks in found]


def _operations(reference: str, hypothesis: str, blocks: list[tuple[int, int, int]]) -> list[dict]:
    """The blocks in common, those that meet as one, and what lies between them."""
    out, i, j = [], 0, 0
    for a, b, k in [*blocks, (len(reference), len(hypothesis), 0)]:
        if i < a or j < b:
            kind = "replace" if i < a and j < b else "delete" if i < a else "insert"
            out.append({"type": kind, "ref": reference[i:a], "hyp": hypothesis[j:b]})
        if k and out and out[-1]["type"] == "equal":
            out[-1] = {"type": "equal", "ref": out[-1]["ref"] + reference[a : a + k], "hyp": out[-1]["hyp"] + hypothesis[b : b + k]}
        elif k:
            out.append({"type": "equal", "ref": reference[a : a + k], "hyp": hypothesis[b : b + k]})
        i, j = a + k, b + k
    return out


@F.arrow_udf(OPCODES)
def opcodes(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """Blocks that are equal, replaced, deleted or inserted, by longest common runs; null if either text is."""
    texts = [(r, h) if r is not None and h is not None else None for r, h in zip(reference.to_pylist(), hypothesis.to_pylist())]
    given = [t for t in texts if t]
    blocks = iter(common_blocks([(_codes(r), _codes(h)) for r, h in given]))
    kind = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("hyp", pa.string())]))
    return pa.array([_operations(*t, next(blocks)) if t else None for t in texts], kind)


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """2 * matches / total length, by longest common runs that start from no popular letter; 1 for two empty
    texts, null if either is."""
    pairs = [(_codes(x), _codes(y)) if x is not None and y is not None else None for x, y in zip(a.to_pylist(), b.to_pylist())]
    blocks = iter(common_blocks([p for p in pairs if p], popular=True))
    total = [len(p[0]) + len(p[1]) if p else 0 for p in pairs]
    return pa.array([(2.0 * sum(k for _, _, k in next(blocks)) / n if n else float(next(blocks) == [])) if p else None for p, n in zip(pairs, total)], pa.float64())


@F.arrow_udf(T.IntegerType())
def edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Unit-cost edit distance, null if either text is. For texts of some hundreds of letters and more, where
    bit-parallel columns of many pairs at once take a small part of the time of the built-in levenshtein()."""
    pairs = list(zip(a.to_pylist(), b.to_pylist()))
    given = [r for r, (x, y) in enumerate(pairs) if x is not None and y is not None]
    out: list = [None] * len(pairs)
    for r, d in zip(given, distances([(_codes(pairs[r][0]), _codes(pairs[r][1])) for r in given])):
        out[r] = d
    return pa.array(out, pa.int32())


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " ", "")


def alignment_score(alignment: Column) -> Column:
    """Correct steps over all steps; 0 for an empty alignment."""
    good = F.size(F.filter(alignment, lambda s: s["status"] == "correct"))
    return F.when(F.size(alignment) > 0, good / F.size(alignment)).otherwise(0.0)


def alignment_errors(alignment: Column) -> Column:
    return F.filter(alignment, lambda s: s["status"] != "correct")


def cer_alignment(alignment: Column) -> Column:
    """Variant A: one less the alignment score."""
    return 1 - alignment_score(alignment)


def cer_plain(reference: Column, hypothesis: Column) -> Column:
    """Variant B: edits over reference characters, spaces counted; null for an empty reference."""
    return edit_distance(reference, hypothesis) / F.nullif(F.length(reference), F.lit(0))


def cer_library(reference: Column, hypothesis: Column) -> Column:
    """Variant B as a corpus is scored: an empty hypothesis counts as one space, and a row that cannot
    be scored as 1."""
    return F.coalesce(cer_plain(reference, F.when(hypothesis == "", " ").otherwise(hypothesis)), F.lit(1.0))


def cer_any_space(reference: Column, hypothesis: Column) -> Column:
    """Without any white space, over at least one character."""
    r, h = F.regexp_replace(reference, r"\s", ""), F.regexp_replace(hypothesis, r"\s", "")
    return F.levenshtein(r, h) / F.greatest(F.length(r), F.lit(1))


def cer_squeezed(reference: Column, hypothesis: Column) -> Column:
    """Variant C: without spaces, over at least one character."""
    r, h = without_spaces(reference), without_spaces(hypothesis)
    return edit_distance(r, h) / F.greatest(F.length(r), F.lit(1))


def cer_scorer(reference: Column, hypothesis: Column) -> Column:
    """Variant D: without spaces, 0 for an empty reference, in per cent with one digit."""
    r, h = without_spaces(reference), without_spaces(hypothesis)
    return F.when(F.length(r) > 0, F.bround(100 * edit_distance(r, h) / F.length(r), 1)).otherwise(0.0)
