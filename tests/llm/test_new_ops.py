"""Whitening, quality rules and collocations against plain Python, with nulls, empty and long texts,
ties, repeated rows, empty tables and clashing extra columns."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from jamolake.llm import collocations, quality, whitening
from jamolake.llm import _common as common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, rid string, n int, kept string"


# --- whitening ----------------------------------------------------------------------------------

def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [
    [1.0], [0.0, 0.0, 0.0], [2.0, 2.0, 2.0, 1.0], [5.0, 3.0, 1.0, -1.0, -3.0, -5.0], [1.0, 0.0, -1.0], list(np.linspace(1, 2, 40)),
    [10.0**-k for k in range(12)], [7.0] * 10 + [3.0] * 10 + [0.0] * 5, [1e9, *np.linspace(1, 1.01, 20)], [1.0, 1.0 + 1e-12, 1.0 + 2e-12, 5.0],
])
def test_eigen(values):
    a = spectrum(values, len(values))
    got, vectors = whitening.eigen(a)
    size = max(1e-300, np.abs(values).max())
    assert np.allclose(got, sorted(values, reverse=True), rtol=0, atol=1e-13 * size)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)
    assert np.abs(a @ vectors - vectors * got).max() <= 1e-13 * size * len(values)


def test_polar():
    a = spectrum([3.0, 1.0, 1e-6, -1e-9, -2.0])
    e, q = np.linalg.eigh(a)
    assert np.allclose(whitening.polar(a), q @ np.diag(np.sign(e)) @ q.T, atol=1e-6)


def test_exact_products_and_deviations():
    for reach in (5, 10**6, 2**44, 2**52):
        y = np.array([[random.Random(reach + i * 3 + j).randint(-reach, reach) for j in range(3)] for i in range(50)], dtype=np.int64)
        assert whitening._products(y).tolist() == [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)]
        sums = [sum(map(int, c)) for c in y.T]
        for n in (50, 10**7):
            w = whitening.Whitener(n, sums, np.eye(3), np.ones(3), 1.0)
            assert w.deviations(y) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in y]


def vectors(n=300, d=10):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, d)) * np.linspace(1, 0.1, d) @ rng.standard_normal((d, d))
    return [[float(np.float32(v)) for v in row] for row in x]


def test_whitening(spark, tmp_path):
    rows = vectors()
    rows += [rows[0], rows[0], None, [1.0] * 9 + [None], [math.nan] + [0.0] * 9, [math.inf] + [0.0] * 9, [1e300] + [0.0] * 9]
    df = spark.createDataFrame([(i, v, i, "x", None) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, component int, whitened string, label int").repartition(3)
    got = whitening.whiten(df).orderBy("vec_id").collect()
    fit = [v for v in rows if v and all(c is not None and math.isfinite(c) and c < 1e100 for c in v)]
    assert [r.vec_id for r in got] == list(range(302)) and got[0].component == 0 and got[0].label is None
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in fit], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    assert all(r.n == n for r in got) and [int(r.deviation) for r in got] == [sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums)) for v in x]
    y = np.array([[float(Fraction(n * int(c) - int(s), n)) for c, s in zip(v, sums)] for v in x])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    white = np.array([r.whitened for r in got])
    assert white.shape == (n, 8)
    want = y @ q[:, :8] / np.sqrt(e[:8])
    assert np.allclose(white * np.sign((white * want).sum(axis=0)), want, atol=1e-8)
    assert np.allclose([r.explained for r in got], e[:8] / e.sum(), rtol=1e-10)
    assert max(r.identity_error for r in got) == min(r.identity_error for r in got) < 1e-8
    again = whitening.whiten(df.repartition(5, "vec_id")).orderBy("vec_id").collect()
    assert [(r.whitened, r.identity_error) for r in again] == [(r.whitened, r.identity_error) for r in got]


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], schema)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], schema)).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in same] == [(4, 0, [None, None], [0.0, 0.0], None)] * 4
    mixed = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [3.0]), (3, [0.0, 1.0]), (4, [0.0, 3.0]), (5, [])], schema)).orderBy("vec_id").collect()
    assert [r.n for r in mixed] == [2, 2, 2, 2, None] and mixed[4].whitened == []
    assert [[None if v is None else round(abs(v), 9) for v in r.whitened] for r in mixed[:4]] == [[1.0], [1.0], [1.0, None], [1.0, None]]


# --- quality ------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabularies():
    return quality.Vocabularies(*(quality.read_vocabulary(f"{quality.VOCABULARIES}/{f}") for f in (quality.BYTE_LEVEL, quality.PIECES)))


def plain(text, v):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    spans = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if spans[tuple(words[i : i + 5])] > 1 for k in range(5)}
    pieces = Counter(p for w in words for p in v.pieces.encode(w))
    total = sum(pieces.values())
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
        "n_tokens": sum(len(v.byte_level.encode_ordinary(" " + w)) for w in words), "n_pieces": total, "n_fallback": sum(c for p, c in pieces.items() if v.pieces.is_byte(p)),
        "token_entropy": -sum(c / total * math.log2(c / total) for c in pieces.values()) if total else 0.0,
    }


def texts(seed=1):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeéß漢", k=rnd.randint(1, 6))) for _ in range(60)] + [" x", "a b", "😀", "|", "#$%"]
    some = lambda k: "".join(w + rnd.choice([" ", " ", "\n", "\t", "  "]) for w in rnd.choices(vocabulary, k=k))
    out = [some(rnd.randint(0, 80)) for _ in range(60)] + [None, "", " \n\t", "a b c d e a b c d e", "a a a a a a", "x\nx\n\nx", "z" * 5000, some(20_000), "'s 've it's      q"]
    return out + out[:3]


def test_measures(spark, vocabularies):
    rows = texts()
    got = quality._measured(pa.array(["skipped", *rows]).slice(1), vocabularies)
    for i, text in enumerate(rows):
        want = plain(text, vocabularies)
        assert {k: int(got[k][i]) for k in want if k != "token_entropy"} == {k: x for k, x in want.items() if k != "token_entropy"}, text
        assert abs(got["token_entropy"][i] - want["token_entropy"]) < 1e-9
    df = spark.createDataFrame([(i, t, None if i % 7 == 0 else "xx", "r", i, "no") for i, t in enumerate(rows)], DOCS).repartition(3)
    out = {r.doc_id: r for r in quality.measure(df).collect()}
    assert out[1].band_key == "xx" and out[0].band_key.startswith("script:") and out[1].rid == "r" and out[1].n == 1
    assert all(out[i].n_tokens == plain(t, vocabularies)["n_tokens"] for i, t in enumerate(rows))


def test_windows_with_equal_names(monkeypatch):
    monkeypatch.setattr(quality, "windows", lambda keys, width: np.zeros(len(keys), dtype=np.uint64))
    rnd = random.Random(2)
    rows = [" ".join(rnd.choices("ab", k=40)) for _ in range(5)]
    bounds, ids, words = common.tokenize(pa.array(rows), lower=False)
    text = np.repeat(np.arange(5), np.diff(bounds))
    got = np.bincount(text, quality.repeated_words(bounds, ids, text), minlength=5)
    for i, r in enumerate(rows):
        w = r.split()
        spans = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        assert got[i] == len({j + k for j in range(len(w) - 4) if spans[tuple(w[j : j + 5])] > 1 for k in range(5)})


def test_quality_verdicts(spark):
    rnd = random.Random(5)
    vocabulary = [a + b + c for a in ("the", "ing", "er", "st") for b in ("an", "on", "re", "is") for c in ("", "tion", "ly", "ed")]
    good = [" ".join(rnd.choices(vocabulary, k=rnd.randint(60, 64))) for _ in range(80)]
    junk = ["".join(rnd.choices("0123456789abcdefXYZ+/", k=300)) + " " + " ".join("".join(rnd.choices("qxz#$%漢字", k=6)) for _ in range(30)) for _ in range(4)]
    copies = [good[0]] * 200  # copies move no band
    rows = [*good, *junk, *copies, None, "", "too few words", "a b c d e " * 20]
    df = spark.createDataFrame([(i, t, "en", "r", i, "no") for i, t in enumerate(rows)], DOCS).repartition(4)
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert len(got) == len(rows) and all(got[i].kept for i in range(80)) and all(got[i].kept for i in range(84, 284))
    assert [got[i].reason for i in range(284, 288)] == ["few words"] * 3 + ["repeated words"] and all(got[i].base_failed for i in range(284, 288))
    limits = quality.bands(spark.createDataFrame([(r.band_key, r.n_tokens, r.n_pieces, r.word_chars, r.n_fallback, r.chars_per_token, r.fallback_share, r.evenness, r.base_failed) for r in got.values()], "band_key string, n_tokens long, n_pieces long, word_chars long, n_fallback long, chars_per_token double, fallback_share double, evenness double, base_failed boolean"))
    classes = defaultdict(set)
    for r in got.values():
        if not r.base_failed:
            classes[math.floor(math.log2(max(r.n_pieces, 1)) * 2)].add((r.n_tokens, r.n_pieces, r.word_chars, r.n_fallback, r.chars_per_token, r.fallback_share, r.evenness))
    want = {}
    for c, members in classes.items():
        if len(members) >= quality.LEAST_TEXTS:
            ends = {}
            for k, m in ((4, "chars_per_token"), (5, "fallback_share"), (6, "evenness")):
                bins = sorted(math.floor(x[k] * quality.STEPS + 0.5) for x in members)
                q1, q2, q3 = (bins[math.ceil(len(bins) * q) - 1] / quality.STEPS for q in (0.25, 0.5, 0.75))
                width = max((q3 - q1) * quality.REACH, quality.FLOORS[m] * (q2 if m == "chars_per_token" else 1))
                ends[m] = q3 + width if m == "fallback_share" else q1 - width
            want[c] = ends
    found = {r.size_class: {m: r[f"{m}_end"] for m in quality.FLOORS} for r in limits.collect()}
    assert want and found.keys() == want.keys()
    assert all(abs(found[c][m] - want[c][m]) < 1e-9 for c in want for m in quality.FLOORS)
    for i in range(80, 84):
        r = got[i]
        ends = want.get(math.floor(math.log2(r.n_pieces) * 2))
        assert r.kept == (not ends or not (r.chars_per_token < ends["chars_per_token"] or r.fallback_share > ends["fallback_share"] or r.evenness < ends["evenness"]))
    assert quality.quality(spark.createDataFrame([], DOCS)).collect() == []


def test_vocabulary_size(tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "MOST_VOCABULARY", 3)
    (tmp_path / "v").write_bytes(b"four")
    with pytest.raises(ValueError):
        quality.read_vocabulary(str(tmp_path / "v"))


# --- collocations -------------------------------------------------------------------------------

def plain_collocations(rows, least, longest, top, absorbed=80):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        low = (text or "").translate(str.maketrans(common.UPPER, common.LOWER))
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= absorbed * candidates[p[i:j]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def corpus(seed=0):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcDEéß", k=rnd.randint(1, 4))) for _ in range(25)]
    some = lambda k: "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for w in rnd.choices(vocabulary, k=k))
    out = [some(rnd.randint(0, 120)) for _ in range(50)] + [None, "", " .,\n", "a a a a a a a a", some(8000), "New York city. " * 30, " New  York\tCITY"]
    rows = [(i, t, rnd.choice(["en", "de", None, "und"]), "r", i, "k") for i, t in enumerate(out)]
    return rows + rows[:4]


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_collocations(spark, bits):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    for least, longest, top in ((4, 4, 2000), (30, 4, 7), (3, 2, 5)):
        got = collocations.collocations(df, least, longest, top, filter_bits=bits)
        assert sorted(tuple(r) for r in got.select(*names).collect()) == plain_collocations(rows, least, longest, top)


def test_collocations_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", 0, ""), (2, "one two", "en", "", 0, "")], DOCS)).collect() == []


def test_fingerprints_and_collisions(spark, monkeypatch):
    names = np.array([random.Random(i % 7).getrandbits(64) for i in range(200)], dtype=np.uint64)
    base = int(collocations._BASE)
    for n in (1, 2, 4):
        want = [sum(int(names[i + k]) * base**k for k in range(n)) % 2**64 for i in range(200 - n + 1)]
        assert collocations.fingerprints(names, n).tolist() == want
    assert len(collocations.fingerprints(names[:1], 2)) == 0
    # with all names in eight classes fingerprints collide all the time, and texts still decide
    monkeypatch.setattr(collocations, "mix", lambda a, b: (a ^ b) & np.uint64(7))
    rows = corpus(3)[:30]
    piece = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([r[2] or "und" for r in rows]), pa.array(range(30), pa.int64())], ["text", "lang", "id"])
    full = [np.full(1, 2**64 - 1, dtype=np.uint64)] * 4
    counts, where = Counter(), {}
    for b in collocations._texts(piece, 4, full):
        for r in b.to_pylist():
            counts[r["lang"], r["phrase"]] += r["a"] if r["n_words"] else 0
            if r["n_words"]:
                where[r["lang"], r["phrase"]] = (r["id"], r["word"])
    want = Counter()
    for _, text, lang, *_ in rows:
        for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(common.UPPER, common.LOWER))):
            w = re.findall(r"[^\x20\x09]+", p)
            want.update((lang or "und", " ".join(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    assert {k: c for k, c in counts.items() if c} == dict(want)
    for (_, phrase), (rid, word) in where.items():
        w = re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", rows[rid][1].translate(str.maketrans(common.UPPER, common.LOWER)))
        assert " ".join(w[word : word + len(phrase.split(" "))]) == phrase
