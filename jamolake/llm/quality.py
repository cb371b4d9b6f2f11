"""Quality rules: plain counts, and how well public tokenisers fit a text.

A text that a tokeniser was made for gives few tokens a character, hardly any byte tokens and a
mixture of tokens that is neither uniform nor stuck. Each word is tokenised on its own, so a task
encodes the distinct words of a few megabytes once: characters per token by a byte-level vocabulary,
the share of byte-fallback pieces and the entropy of pieces by one with byte fallback.

What is usual differs by language and by length, so the bands are learned: for each language (or
script, where the language is unknown) and half doubling of the number of pieces, quartiles over all
different texts that pass the plain rules. Counts of equal measures are taken before, so that copies
of one text move nothing and no group of rows meets in a task. Bands are open on the side of a better
fit: more characters a token, fewer byte pieces and a richer mixture are no faults.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import Scratch, by_bytes, mix, room, table, tokenize, windows

VOCABULARIES, BYTE_LEVEL, PIECES = "/opt/tokenizers", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
# Fixed value: how the byte-level vocabulary splits text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that a vocabulary file may have, as it goes to every task.
MOST_VOCABULARY = 64 << 20
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Text bytes tokenised at once, and steps a unit in which quartiles are found.
STEP_BYTES, STEPS = 8 << 20, 256
#: A band ends this many quartile distances beyond the quartile, and at least the floor beyond it (a
#: share of the median where the measure has a unit of its own).
REACH, FLOORS = 2.5, {"chars_per_token": 0.08, "fallback_share": 0.05, "evenness": 0.03}
#: Different texts that a language needs in a doubling of length before its band is used.
LEAST_TEXTS = 30
SCRIPTS = ["Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai"]
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_pieces", "n_fallback"]
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[*b"#*$%&|<>"]] = 1


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file's bytes, read on the driver alone."""
    if (size := os.path.getsize(path)) > MOST_VOCABULARY:
        raise ValueError(f"{path} has {size} bytes; at most {MOST_VOCABULARY} are sent to tasks")
    return Path(path).read_bytes()


class Vocabularies:
    """Both tokenisers, opened in a task."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, byte_level.splitlines())}
        self.byte_level = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: byte-level tokens, pieces; and all pieces in a row. The byte-level vocabulary takes
        the words in one text, a space before each, as no token reaches over a space; its tokens' sizes
        tell whose they are."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(self.sizes[self.byte_level.encode_ordinary(" " + " ".join(words))])
        word_ends = np.cumsum([len(w.encode()) + 1 for w in words])
        tokens = np.bincount(np.searchsorted(word_ends, ends), minlength=len(words))
        pieces = self.pieces.encode(words, num_threads=1)
        return tokens, np.array([len(p) for p in pieces], dtype=np.int64), np.fromiter((i for p in pieces for i in p), np.int64)


def _by_text(texts: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(texts, weights, minlength=n)


def repeated_words(bounds: np.ndarray, ids: np.ndarray, text: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Whether each word lies in a window whose words come twice or more in its text. Windows meet by a
    64-bit name and are compared word by word; should two different ones ever share a name, whole windows
    are sorted instead."""
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(room(bounds) >= width)
    if len(at):
        key = mix(windows(ids.astype(np.uint64), width)[at], text[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        a, b = at[order[same]], at[order[same + 1]]
        agree = text[a] == text[b]
        for k in range(width):
            agree &= ids[a + k] == ids[b + k]
        if agree.all():
            found = np.unique(np.concatenate([a, b]))
        else:
            _, inverse, counts = np.unique(np.stack([text[at], *(ids[at + k] for k in range(width))], axis=1), axis=0, return_inverse=True, return_counts=True)
            found = at[counts[inverse.ravel()] > 1]
        covered[found] += 1
        np.subtract.at(covered, found + width, 1)
    return np.cumsum(covered[:-1]) > 0


def _entropy(text: np.ndarray, pieces: np.ndarray, n: int, size: int) -> np.ndarray:
    """Bits a piece, of the pieces of each text."""
    keys, counts = np.unique(text * size + pieces, return_counts=True)
    totals = np.maximum(_by_text(text, n), 1)
    return np.maximum(np.log2(totals) - _by_text(keys // size, n, counts * np.log2(counts)) / totals, 0.0)


def _measured(texts: pa.Array, v: Vocabularies) -> dict[str, np.ndarray]:
    n = len(texts)
    texts = pa.concat_arrays([texts.cast(pa.large_string())]).fill_null("")
    bounds, ids, words = tokenize(texts, lower=False)
    text = np.repeat(np.arange(n), np.diff(bounds))
    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten().dictionary_encode()
    line, line_text = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    filled = pc.match_substring_regex(flat.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[line]
    line, line_text = line[filled], line_text[filled]
    ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]])])[ends - ends[0]]
    tokens, lengths, pieces = v.encode(words.to_pylist())
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else lengths
    fallback = _by_text(np.repeat(np.arange(len(lengths)), lengths), len(lengths), v.is_byte[pieces].astype(float))
    each = lengths[ids]
    places = np.repeat(starts[ids] - np.concatenate([[0], np.cumsum(each)[:-1]]).astype(np.int64), each) + np.arange(each.sum()) if len(ids) else ids
    out = {
        "n_words": np.diff(bounds), "word_chars": _by_text(text, n, pc.utf8_length(words).to_numpy(zero_copy_only=False)[ids]), "n_symbols": np.diff(symbols),
        "n_dup_lines": _by_text(line_text, n) - _by_text(np.unique(line_text * max(1, len(flat.dictionary)) + line) // max(1, len(flat.dictionary)), n),
        "n_repeat_words": _by_text(text, n, repeated_words(bounds, ids, text)), "n_tokens": _by_text(text, n, tokens[ids]), "n_pieces": _by_text(text, n, each), "n_fallback": _by_text(text, n, fallback[ids]),
    }
    out = {k: x.astype(np.int64) for k, x in out.items()}
    return out | {"token_entropy": _entropy(np.repeat(text, each), pieces[places], n, len(v.is_byte))}


def _script(text: Column) -> Column:
    """The script that most letters of a text are in; the first of equal ones, Common without letters."""
    counts = F.array(*[F.struct(F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SCRIPTS)])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["s"]).otherwise("Common")


def measure(docs: DataFrame, text: str = "text", lang: str = "lang", folder: str = VOCABULARIES, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """docs without its text, with fertility's columns: the counts, token_entropy (bits a piece), chars_per_token
    (of words), fallback_share, evenness (entropy by that of as many different pieces; 1 below two pieces)
    and band_key (language, else script). A null text counts as empty."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((read_vocabulary(f"{folder}/{byte_level}"), read_vocabulary(f"{folder}/{pieces}")))
    new = {**dict.fromkeys(_COUNTS, "long"), "token_entropy": "double"}
    made = {*new, "chars_per_token", "fallback_share", "evenness"}
    kept = [c for c in docs.columns if c.lower() != text.lower() and c.lower() not in {*made, "band_key"}]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(lang), F.concat(F.lit("script:"), _script(F.coalesce(F.col(text), F.lit(""))))).alias("band_key"), F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabularies(*shared.value)
        for b in batches:
            for piece in by_bytes(b, "_text", STEP_BYTES):
                got = _measured(piece.column("_text"), v)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *(pa.array(got[k]) for k in new)], [*piece.schema.names[:-1], *new])

    out = rows.mapInArrow(run, f"{schema}, " + ", ".join(f"{k} {t}" for k, t in new.items()))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumns({"chars_per_token": share("word_chars", "n_tokens"), "fallback_share": share("n_fallback", "n_pieces"), "evenness": F.when(F.col("n_pieces") > 1, F.col("token_entropy") / F.log2("n_pieces")).otherwise(1.0)})


def _size_class() -> Column:
    """Half doublings of the number of pieces."""
    return F.floor(F.log2(F.greatest("n_pieces", F.lit(1))) * 2).cast("int")


def bands(measured: DataFrame, floors: dict[str, float] = FLOORS, reach: float = REACH, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """(band_key, size_class, and limits of each measure): where the measures of texts that pass the plain rules
    end. Rows with equal measures count once. A language and length with fewer than least_texts
    of them has no row."""
    different = measured.where(~F.col("base_failed")).select("band_key", _size_class().alias("size_class"), "n_tokens", "n_pieces", "word_chars", "n_fallback", *floors).distinct()
    bins = different.select("band_key", "size_class", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * STEPS).cast("long").alias("bin")) for m in floors])).alias("x"))
    bins = bins.groupBy("band_key", "size_class", "x.measure", "x.bin").agg(F.count("*").alias("c"))
    key = ["band_key", "size_class", "measure"]
    upto = bins.withColumns({"upto": F.sum("c").over(W.partitionBy(*key).orderBy("bin")), "n": F.sum("c").over(W.partitionBy(*key))})
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("n") * q, F.col("bin"))) / STEPS
    q = upto.where(F.col("n") >= least_texts).groupBy(*key).agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv]), F.col("measure")) * F.when(F.col("measure") == "chars_per_token", F.col("q2")).otherwise(1.0)
    width = F.greatest((F.col("q3") - F.col("q1")) * reach, floor)
    end = q.select(*key, F.when(F.col("measure") == "fallback_share", F.col("q3") + width).otherwise(F.col("q1") - width).alias("end"))
    return end.groupBy("band_key", "size_class").agg(*[F.max(F.when(F.col("measure") == m, F.col("end"))).alias(f"{m}_end") for m in floors])


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", folder: str = VOCABULARIES, floors: dict[str, float] = FLOORS, reach: float = REACH, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """docs without its text, with the counts, the measures, base_failed, kept and reason (null if kept).

    A text fails the plain rules with fewer than LEAST_WORDS words or more than MOST_REPEATED percent of them in
    repeated windows; else it is rejected where a measure lies beyond the end of its band: fewer
    characters a token or a poorer mixture, or more byte pieces, than texts of its language and length have. Null and empty texts have
    no words and fail. Repeated rows are judged alike; an empty table gives no rows; texts whose language and
    length are too rare for a band are kept. Columns of docs that clash with new ones are replaced."""
    scratch = Scratch(docs.sparkSession, "quality")
    repeated = F.lit(100) * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    rows = measure(docs, text, lang, folder).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | repeated)
    own = {"size_class", "kept", "reason", *(f"{m}_end" for m in floors)}
    rows = scratch.store(rows.drop(*[c for c in rows.columns if c.lower() in own]))
    limits = bands(rows, floors, reach, least_texts)
    out = rows.withColumn("size_class", _size_class()).join(limits, ["band_key", "size_class"], "left")
    over = {m: F.col(m) > F.col(f"{m}_end") if m == "fallback_share" else F.col(m) < F.col(f"{m}_end") for m in floors}
    reason = F.when(F.col("n_words") < LEAST_WORDS, "few words").when(repeated, "repeated words")
    for m, c in over.items():
        reason = reason.when(c, m)
    return out.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()).drop("size_class", *[f"{m}_end" for m in floors])


def op12_quality(spark, sf_dir):
    rows = quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "fallback_share", "token_entropy", "reason")
