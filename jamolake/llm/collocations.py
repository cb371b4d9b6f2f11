"""Collocations: phrases that occur more often than their parts let expect.

Rabin-Karp fingerprints: with w the 64-bit names of words and P the prefix sums of w_i * B^i modulo
2^64 (B odd), the n-gram from place i has the fingerprint (P[i + n] - P[i]) * B^-i, so numpy makes
those of all n-grams of a batch at once. Tasks add up equal ones, and the shuffle adds up what tasks
found, 16 bytes a fingerprint. Lengths go one after the other: an n-gram
can be frequent only if both (n-1)-grams in it are. What is known to be frequent reaches the tasks as
a bitmap of fixed size, which can err only towards keeping too much.

A last pass keeps a pointer to an occurrence for each fingerprint that passes all bitmaps, compares
every other occurrence with the words the pointer names, and counts phrases by text (the pointer goes
along), so that fingerprints decide nothing in the end; only frequent phrases, and the few that share
a bit with one, are ever made into strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, Scratch, by_bytes, mix, table

LEAST, LONGEST, TOP = 30, 4, 2000
#: Bits of a bitmap of frequent fingerprints (8 MB). More make it sharper, none change a result.
FILTER_BITS = 1 << 26
#: Text bytes that a task cuts into words at once, and sums that it holds before it passes them on.
STEP_BYTES, HELD = 8 << 20, 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CLASS = np.zeros(256, dtype=np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]


class Words:
    """Words of some texts, one after the other: text (its number), piece (rises with every piece),
    ids into `distinct`, and the 64-bit name of each."""

    def __init__(self, texts: pa.Array):
        texts = pa.concat_arrays([texts.cast(pa.large_string())]).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        kind = _CLASS[data]
        word = kind == 0
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        firsts = ends[:-1][ends[:-1] < len(data)]
        before[firsts] = False
        starts = np.flatnonzero(word & ~before)
        after = np.ones_like(word)
        after[:-1] = ~word[1:]
        after[firsts[firsts > 0] - 1] = True
        stops = np.flatnonzero(word & after) + 1
        offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
        flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_FOLD[data[word]])).dictionary_encode()
        self.distinct = flat.dictionary
        self.ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = np.searchsorted(ends, starts, "right") - 1
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), starts) + self.text
        name = xxhash.xxh3_64_intdigest
        self.names = np.fromiter((name(w) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))


def fingerprints(names: np.ndarray, n: int) -> np.ndarray:
    """Of the n-gram at every place where one ends inside; by prefix polynomials modulo 2^64."""
    m = len(names)
    if m < n:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, _BASE)]), dtype=np.uint64)
        undo = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - n, _INVERSE)]), dtype=np.uint64)
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(names * powers, dtype=np.uint64)])
        return (prefix[n:] - prefix[: m - n + 1]) * undo


class Grams:
    """The n-grams of some texts that lie inside pieces, with their fingerprints by language."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.words = Words(texts)
        codes = langs.dictionary_encode()
        self.langs = codes.dictionary.to_pylist()
        lang_of = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = lang_of[self.words.text] if len(lang_of) else np.zeros(0, np.int64)
        self.salts = np.array([xxhash.xxh3_64_intdigest(s) for s in self.langs], dtype=np.uint64)

    def level(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the n-grams, their fingerprints)."""
        w = self.words
        prints = fingerprints(w.names[w.ids], n)
        at = np.flatnonzero(w.piece[: len(prints)] == w.piece[n - 1 :]) if len(prints) else np.zeros(0, np.int64)
        return at, mix(prints[at], self.salts[self.lang[at]] + np.uint64(n)) if len(at) else prints[:0]

    def passing(self, n: int, bitmaps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams both of whose (n-1)-grams pass the last bitmap (all if n is 1)."""
        at, prints = self.level(n)
        if n > 1 and len(at):
            low_at, low = self.level(n - 1)
            ok = np.zeros(len(self.words.ids) + 1, dtype=bool)
            ok[low_at] = _passes(bitmaps[n - 2], low)
            keep = ok[at] & ok[at + 1]
            at, prints = at[keep], prints[keep]
        return at, prints


def _passes(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    cell = prints & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1


def _summed(prints: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate(prints), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate(sums)).astype(np.int64)


def _counted(docs: DataFrame, n: int, bitmaps) -> DataFrame:
    """(print, a): fingerprints of n-grams and how often tasks have met them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, sums, held = [], [], 0
        send = lambda: pa.RecordBatch.from_arrays([pa.array(prints[0].view(np.int64)), pa.array(sums[0])], ["print", "a"])
        for b in batches:
            for piece in by_bytes(b, "text", STEP_BYTES):
                _, found = Grams(piece.column("text"), piece.column("lang")).passing(n, bitmaps.value if bitmaps else [])
                keys, counts = np.unique(found, return_counts=True)
                prints.append(keys)
                sums.append(counts.astype(np.int64))
                held += len(keys)
                if held > HELD:
                    one = _summed(prints, sums)
                    prints, sums, held = [one[0]], [one[1]], len(one[0])
                    if held > HELD // 2:
                        yield send()
                        prints, sums, held = [], [], 0
        if prints:
            one = _summed(prints, sums)
            prints, sums = [one[0]], [one[1]]
            yield send()

    return docs.select("text", "lang").mapInArrow(run, "print long, a long").groupBy("print").agg(F.sum("a").alias("a"))


def _bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """One bit for each fingerprint; at most bits / 64 rows reach the driver."""
    cell = F.col("print").bitwiseAND(F.lit(bits - 1))
    rows = frequent.select(F.shiftrightunsigned(cell, 6).alias("at"), F.expr(f"shiftleft(1L, cast(print & 63L as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bit").to_numpy().view(np.uint64)
    return out


def _spelled(docs: DataFrame, longest: int, bitmaps) -> DataFrame:
    """(lang, n_words, phrase, a, id, word): for each task, text of the n-grams that pass all bitmaps, and
    where one occurs; n_words = 0 holds the number of words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in by_bytes(b, "text", STEP_BYTES):
                yield from _texts(piece, longest, bitmaps.value)

    return docs.select("text", "lang", "id").mapInArrow(run, "lang string, n_words int, phrase string, a long, id long, word long")


def _texts(piece: pa.RecordBatch, longest: int, bitmaps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    g = Grams(piece.column("text"), piece.column("lang"))
    w, ids = g.words, piece.column("id")
    first = np.searchsorted(w.text, w.text)  # place of the first word of each word's text
    cols = [pa.array(g.langs, pa.string()), pa.array([0] * len(g.langs), pa.int32()), pa.array([""] * len(g.langs)), pa.array(np.bincount(g.lang, minlength=len(g.langs)).astype(np.int64))]
    names = ["lang", "n_words", "phrase", "a", "id", "word"]
    yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(g.langs), pa.int64()), pa.nulls(len(g.langs), pa.int64())], names)
    for n in range(1, longest + 1):
        at, prints = g.passing(n, bitmaps)
        keep = _passes(bitmaps[n - 1], prints) if len(at) else np.zeros(0, bool)
        at, prints = at[keep], prints[keep]
        if not len(at):
            continue
        # every occurrence is compared with the one its fingerprint points to; a collision makes a group of its own
        _, pointer, group = np.unique(prints, return_index=True, return_inverse=True)
        same = g.lang[at] == g.lang[at[pointer[group]]]
        for k in range(n):
            same &= w.ids[at + k] == w.ids[at[pointer[group]] + k]
        places, counts = at[pointer], np.bincount(group[same], minlength=len(pointer)).astype(np.int64)
        if not same.all():
            places, counts = np.concatenate([places, at[~same]]), np.concatenate([counts, np.ones(int((~same).sum()), dtype=np.int64)])
        parts = [w.distinct.take(pa.array(w.ids[places + k])) for k in range(n)]
        phrase = parts[0] if n == 1 else pa.compute.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        lang = pa.array(g.langs, pa.string()).take(pa.array(g.lang[places]))
        yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(places), n, np.int32)), phrase.cast(pa.string()), pa.array(counts), ids.take(pa.array(w.text[places])), pa.array(places - first[places])], names)


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, n_words, phrase, a, id, word) of docs (id, text, lang): phrases of up to `longest` words with
    at least `least` occurrences, and an occurrence (least id, number of its first word in that text); the row
    with n_words = 0 has a language's number of words."""
    sc, bitmaps = docs.sparkSession.sparkContext, []
    for n in range(1, longest + 1):
        shared = sc.broadcast(bitmaps) if bitmaps else None
        counted = scratch.store(_counted(docs, n, shared).where(F.col("a") >= least))
        bitmaps.append(_bitmap(counted, filter_bits))
        scratch.drop(counted)
    texts = _spelled(docs, longest, sc.broadcast(bitmaps)).groupBy("lang", "n_words", "phrase").agg(F.sum("a").alias("a"), F.min("id").alias("id"), F.min_by("word", "id").alias("word"))
    return scratch.store(texts.where((F.col("n_words") == 0) | (F.col("a") >= least)))


def _part(phrase: str, first: Column, n: Column) -> Column:
    """n words of a phrase from its first-th (from 1)."""
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorbed: int = 80, text: str = "text", lang: str = "lang", id_col: str = "doc_id", filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, example): each language's first `top` phrases.

    Texts are lower-cased (A-Z) and split into pieces at .,;:!? and line ends, pieces into words at spaces
    and tabs. Phrases of 2 to `longest` words with a >= `least` occurrences are scored by their weakest cut: the
    least floor(2000000 * a / (l + r)) of the counts of both sides, the earliest cut of equal ones. A phrase
    that lies inside a longer one with at least `absorbed` percent of its occurrences is left out. Null texts
    have no words, a null language is `und`; repeated rows count each; an empty table gives no rows.
    example is a place where the phrase occurs: the least id of a row that has it (null if all such ids are)
    and the number of its first word there (of rows with equal ids, in any of them). Ties are in order of a,
    then of the phrase's bytes. docs is read once for each length and once more, and nothing of it is stored."""
    scratch = Scratch(docs.sparkSession, "collocations")
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(id_col).cast("long").alias("id"))
    found = frequent_phrases(rows, scratch, least, longest, filter_bits)
    counts = found.where("n_words > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    totals = found.where("n_words = 0").select("lang", F.col("a").alias("n"))
    candidates = found.where("n_words > 1").select("lang", "phrase", "n_words", "a", "id", "word")

    cut = candidates.select("lang", "phrase", "n_words", "a", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cut = cut.select("*", _part("phrase", F.lit(1), F.col("k")).alias("left"), _part("phrase", F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"))
    cut = cut.join(counts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("cast(a as decimal(19,0)) * 2000000BD div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    weakest = cut.select("lang", "phrase", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.min("cut").alias("cut"))

    places = F.expr("flatten(transform(sequence(2, n_words - 1), m -> transform(sequence(1, n_words - m + 1), i -> struct(i, m))))")
    inner = candidates.where("n_words > 2").select("lang", "phrase", F.col("a").alias("longer"), F.explode(places).alias("x"))
    inner = inner.select("lang", _part("phrase", F.col("x.i"), F.col("x.m")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))

    kept = candidates.join(inner, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR cast(longer as decimal(19,0)) * 100BD < cast(a as decimal(19,0)) * {int(absorbed)}BD"))
    scored = kept.join(weakest, ["lang", "phrase"]).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), "id", "word")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.struct("id", "word").alias("example"))


def op13_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents")).drop("example")


ORACLE = r"""WITH pieces AS (SELECT doc_id, coalesce(lang, 'und') AS lang, o AS piece, p FROM documents, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) WITH ORDINALITY AS u(p, o)),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, unnest(w) AS a, unnest(w[2:] || [NULL]) AS b, unnest(w[3:] || [NULL, NULL]) AS c, unnest(w[4:] || [NULL, NULL, NULL]) AS d FROM words WHERE len(w) > 0),
grams AS (SELECT lang, 1 AS m, a AS phrase FROM places WHERE a IS NOT NULL UNION ALL SELECT lang, 2, a || ' ' || b FROM places WHERE b IS NOT NULL UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM places WHERE c IS NOT NULL
  UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d FROM places WHERE d IS NOT NULL),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
parts AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 :], ' ') AS rp FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1) c, unnest(range(1, m)) AS t(k)),
cuts AS (SELECT p.lang, p.phrase, p.a, k, l.a AS l, r.a AS r, (2000000 * p.a::HUGEINT // (l.a + r.a))::BIGINT AS score
  FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.lp JOIN f r ON r.lang = p.lang AND r.phrase = p.rp),
weakest AS (SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i : i + q - 1], ' ') AS phrase, max(a) AS longer FROM f, unnest(range(2, m)) AS s(q), unnest(range(1, m - q + 2)) AS t(i) WHERE m > 2 GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE C) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
