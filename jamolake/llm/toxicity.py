"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first (compatibility forms, case, look-alike letters, digits and signs that
stand for letters, invisible characters), so that disguised words match the plain entry. The
weights of the entries that match, less those inside an exception phrase, are summed, divided
by the length of the text and turned into a score between 0 and 1.

The lexicon is learned from labelled texts: words and word beginnings that toxic texts hold far
more often than others (a likelihood-ratio test at a level that allows for how many were tried).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table

#: Labelled rows that the lexicon is fitted on: a sample in hash order of the ids, so its size is
#: bounded whatever the input. Documents are scored without any bound.
FIT_ROWS = 20_000
#: Labelled texts whose folded word pairs have this Jaccard similarity, in per cent, count once.
COPY_PER_CENT = 80
STEMS = (4, 5, 6, 7, 8, 9)
LEAST_ODDS, MARGIN = 8.0, 10.0
SMOOTH_WORDS = 20
THRESHOLD = 0.7

# Letters of other scripts, digits and signs that pass for Latin letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "|": "i",
}
INVISIBLE = "­​‌‍⁠﻿"
PUNCTUATION = "!\"#%&'()*+,-./:;<=>?[\\]^_`{}~" + "¡¿«»‐‑‒–—―‘’‚“”„•…‹›·"

# 1 may stand for i or l, so both letters fold to one
_FOLD = str.maketrans(LOOK_ALIKES | {"l": "i", "ӏ": "i", "ℓ": "i"})
_SPACES = str.maketrans(dict.fromkeys(PUNCTUATION, " ") | dict.fromkeys(INVISIBLE))
# a number stands alone between spaces or punctuation: a digit beside a letter or sign may pass for a letter
_NUMBER = re.compile(r"(?<!\S)\d+(?!\S)")


def fold(text: str | None) -> str:
    """The folded words, each between single spaces: ' word word '; ' ' for none."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    words = _NUMBER.sub(" ", text.lower().translate(_SPACES)).translate(_FOLD).split()
    return f" {' '.join(words)} " if words else " "


@dataclass
class Lexicon:
    """entries and exceptions as matched: ' word ' for a word, ' stem' for a word beginning."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    offset: float = -2.0

    @classmethod
    def of(cls, words: dict[str, float], exceptions: tuple[str, ...] = (), slope: float = 1.0, offset: float = -2.0) -> Lexicon:
        """From plain words (a trailing * makes a word beginning) and plain phrases."""
        entries = {}
        for w, weight in words.items():
            f = fold(w.rstrip("*"))
            entries[f.rstrip() if w.endswith("*") else f] = weight
        return cls(entries, [fold(x) for x in exceptions], slope, offset)

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for e, w in self.entries.items():
            a.add_word(e, (len(e), w))
        for e in self.exceptions:
            a.add_word(e, (len(e), None))
        if not len(a):
            return None
        a.make_automaton()
        return a

    def probability(self, weight: float, n_words: int) -> float:
        x = math.log1p(1000.0 * weight / (n_words + SMOOTH_WORDS))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * x + self.offset))))


def matched(automaton: ahocorasick.Automaton | None, folded: str) -> tuple[float, int]:
    """Sum of the weights of the longest entry at each word, outside exception phrases; matches."""
    if automaton is None:
        return 0.0, 0
    best: dict[int, tuple[int, float]] = {}
    spans = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            spans.append((start, end))
        elif start not in best or size > best[start][0]:
            best[start] = (size, weight)
    if spans:
        best = {s: v for s, v in best.items() if not any(a <= s and s + v[0] - 2 <= b for a, b in spans)}
    return sum(w for _, w in best.values()), len(best)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch: in how many toxic and other texts each word is."""
    for b in batches:
        toxic, other = Counter(), Counter()
        for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            (toxic if label else other).update(set(fold(text).split()))
        words = list(toxic.keys() | other.keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([other[w] for w in words], pa.int64())], ["word", "t", "o"])


def _phrases(entries: dict[str, float]):
    """Word pairs around matches, with the number of toxic and other texts that hold them."""
    automaton = Lexicon(entries).automaton()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, other = Counter(), Counter()
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                folded, pairs = fold(text), set()
                for end, (size, _) in automaton.iter(folded) if automaton else ():
                    start = end - size + 1
                    stop = folded.find(" ", start + 1)
                    after = folded.find(" ", stop + 1)
                    before = folded.rfind(" ", 0, start)
                    if after > 0:
                        pairs.add(folded[start : after + 1])
                    if before >= 0:
                        pairs.add(folded[before : stop + 1])
                (toxic if label else other).update(pairs)
            words = list(toxic.keys() | other.keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([other[w] for w in words], pa.int64())], ["word", "t", "o"])

    return run


def _weighed(automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                folded = fold(text)
                out.append((*matched(automaton, folded), folded.count(" ") - 1))
            rest = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "text"]
            names = [n for n in b.schema.names if n != "text"]
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], [*names, "weight", "matches", "n_words"])

    return run


def _sign(text):
    """Least hash of the word pairs of a text."""
    words = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.array_min(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.xxhash64(a, b)))


def _uncopied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (toxic, sign) those that are no near copies of one kept before with the
    same: an equal sign only says where to look."""
    key, kept = None, []
    for b in batches:
        keep = []
        for mine, text in zip(zip(b.column("toxic").to_pylist(), b.column("sign").to_pylist()), b.column("text").to_pylist()):
            if mine != key:
                key, kept = mine, []
            words = fold(text).split()
            pairs = set(zip(words, words[1:])) or {tuple(words)}
            n = len(pairs)
            # sets of too different sizes cannot be near copies
            sized = (k for k in kept if 100 * min(n, len(k)) >= COPY_PER_CENT * max(n, len(k)))
            keep.append(not any((100 + COPY_PER_CENT) * len(pairs & k) >= COPY_PER_CENT * (n + len(k)) for k in sized))
            if keep[-1]:
                kept.append(pairs)
        yield b.select(["text", "toxic"]).filter(pa.array(keep, pa.bool_()))


def _chosen(counts: DataFrame, n_toxic: int, n_other: int) -> DataFrame:
    """Of (word, t, o) the features that toxic texts hold significantly more often, with weights."""
    rate_t, rate_o = (F.col("t") + 0.5) / (n_toxic + 1), (F.col("o") + 0.5) / (n_other + 1)
    both = F.col("t") + F.col("o")
    share = n_toxic / max(1, n_toxic + n_other)
    g2 = 2 * (F.col("t") * F.log(F.greatest(F.col("t"), F.lit(1e-9)) / (both * share)) + F.when(F.col("o") > 0, F.col("o") * F.log(F.col("o") / (both * (1 - share)))).otherwise(0.0))
    n = max(2, counts.count())
    return counts.withColumn("weight", F.log(rate_t / rate_o)).where((F.col("weight") >= math.log(LEAST_ODDS)) & (g2 >= 2 * math.log(n) + MARGIN))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a lightly regularised logistic fit, by Newton steps."""
    w, design = np.zeros(2), np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.01 * w
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 0.01 * np.eye(2), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """Learns entries, weights, exception phrases and the score's curve from labels (doc_id,
    toxic), at most fit_rows of them. Rows with null labels or ids are left out; where an id is
    labelled twice, toxic wins. Of texts with one label and the same least word pair by hash, those
    that share COPY_PER_CENT of their word pairs with one kept before, in order of doc_id and
    text, are copies and left out; a text that only has the same least word pair stays. Every word
    and beginning that passes the test is an entry, and every pair with a match that is far more
    frequent in other texts an exception, so the words of the sample bound their number. Without
    examples of both classes the lexicon is empty and every score is the share of toxic labels,
    at most 0.5."""
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # at most fit_rows pairs of numbers are broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    # copies and most near copies of a text share its sign, and count once as evidence if they are proven
    signed = sample.withColumn("sign", _sign(F.col("text"))).repartition("toxic", "sign").sortWithinPartitions("toxic", "sign", "doc_id", "text")
    sample = signed.select("text", "toxic", "sign").mapInArrow(_uncopied, "text string, toxic long").persist()
    try:
        n = {bool(r[0]): r[1] for r in sample.groupBy("toxic").agg(F.count("*")).collect()}
        if not n.get(True) or not n.get(False):
            share = (n.get(True, 0) + 0.5) / (sum(n.values()) + 2)
            return Lexicon(offset=math.log(share / (1 - share)) if n.get(True) is None else 0.0)
        schema = "word string, t long, o long"
        words = sample.mapInArrow(_features, schema).groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
        whole = words.select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("word"), "t", "o")
        # a beginning counts each text once for each of its words there, so it is capped at the class
        stems = words.select(F.explode(F.array(*[F.when(F.length("word") > k, F.concat(F.lit(" "), F.substring("word", 1, k))) for k in STEMS])).alias("word"), "t", "o").where("word IS NOT NULL").groupBy("word").agg(F.least(F.sum("t"), F.lit(n[True])).alias("t"), F.least(F.sum("o"), F.lit(n[False])).alias("o"), F.count(F.when(F.col("t") > 0, 1)).alias("words")).where("words >= 3").drop("words")
        kept = _chosen(whole.unionByName(stems), n[True], n[False]).orderBy("word").collect()
        entries = {r["word"]: r["weight"] for r in kept}
        # a longer beginning, or a word, that says hardly more than a beginning that stands already adds nothing
        entries = {e: w for e, w in entries.items() if not any(len(e.rstrip()) > k + 1 and w <= entries.get(e.rstrip()[: k + 1], -math.inf) + 0.5 for k in STEMS)}
        phrases = sample.mapInArrow(_phrases(entries), schema).groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).where((F.col("o") >= 3) & (F.col("o") * n[True] > F.col("t") * n[False] * 2)).orderBy("word")
        lexicon = Lexicon(entries, [r["word"] for r in phrases.collect()])
        # fit_rows pairs of a number and a label at most
        scored = sample.mapInArrow(_weighed(lexicon.automaton()), "toxic long, weight double, matches long, n_words long")
        points = scored.select("toxic", F.log1p(1000.0 * F.col("weight") / (F.col("n_words") + SMOOTH_WORDS)).alias("x")).collect()
        lexicon.slope, lexicon.offset = _logistic(np.array([p["x"] for p in points]), np.array([float(p["toxic"] > 0) for p in points]))
        return lexicon
    finally:
        sample.unpersist()


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, weight, matches, n_words for every row. Null and empty texts
    match nothing; repeated rows are scored one by one; columns other than doc_id and text are
    not read; an empty table gives no rows. Texts are scored whole, however long."""
    kind = dict(docs.dtypes)["doc_id"]
    weighed = docs.select("doc_id", "text").mapInArrow(_weighed(lexicon.automaton()), f"doc_id {kind}, weight double, matches long, n_words long")
    z = lexicon.slope * F.log1p(1000.0 * F.col("weight") / (F.col("n_words") + SMOOTH_WORDS)) + lexicon.offset
    p = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))
    return weighed.withColumn("score", p).select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "weight", "matches", "n_words")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    automaton = lexicon.automaton()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = []
            for text in b.column("text").to_pylist():
                folded = fold(text)
                clean.append(lexicon.probability(matched(automaton, folded)[0], folded.count(" ") - 1) < threshold)
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold_of(doc_id, n: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def op4_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    lexicon = fit(docs, labels.where(~held_out))
    return score(docs, lexicon).withColumn("held_out", held_out)
