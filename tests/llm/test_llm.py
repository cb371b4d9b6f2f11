"""Each operator against brute force or an exact round trip, with nulls, empty and long texts,
repeated rows, empty tables and clashing extra columns."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
from jamolake.llm import exact_dedup, jaccard_join, lm_scoring, mixing, packing, substring_dedup, toxicity, url_filter, vector_dedup, warc
from jamolake.llm import _blocks as blocks
from jamolake.llm import _common as common
from jamolake.llm import _components
from jamolake.llm._components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = {"rid": 7, "block": "x", "name": 1, "fp": 2, "k": "k", "size": 3, "root": 9, "u": "u", "host": "h", "role": 0, "n": 0, "weight": 1.0}


def lower(text):
    return (text or "").translate(str.maketrans(common.UPPER, common.LOWER))


def words(text):
    return WORD.findall(text or "")


def corpus(seed=0, n=60):
    """Copies, near copies, shared passages, nulls, empty, odd spaces, one long text."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeéß", k=rnd.randint(2, 6))) for _ in range(400)]
    text = lambda k: " ".join(rnd.choices(vocabulary, k=k))
    passage, base = text(50), text(120)
    out = [text(rnd.randint(1, 90)) for _ in range(n)]
    out += [out[0]] * 3 + [out[1], out[1] + " ", base] + [" ".join(w if rnd.random() > 0.01 else "zz" for w in base.split()) for _ in range(6)]
    out += [text(10) + " " + passage + "\n" + text(5) for _ in range(4)] + [None, None, "", " \t\n", "\u00a0x", "A b", "a B", text(4000), text(3)]
    rows = [(i, x, "en", rnd.choice(["s1", "s2", "s3", None]), len(x or "")) for i, x in enumerate(out)]
    return rows + [rows[5], rows[5]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    """A stored table with extra columns that clash with the operators' own names."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    df = spark.createDataFrame(rows, SCHEMA)
    df.select("*", *[F.lit(v).alias(c) for c, v in CLASH.items()]).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_tokens():
    import pyarrow as pa

    texts = [None, "", " A  b\x0bÉ\x1c ", "x\u00a0y z"]
    bounds, ids, vocabulary = common.tokenize(pa.array(["skip", *texts]).slice(1), lower=True)
    got = [[vocabulary[i].as_py() for i in ids[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [words(lower(t)) for t in texts]


def test_packed_arrays():
    for a in ([], [1, 5, 2**63]):
        keys = np.array(a, dtype=np.uint64)
        back = blocks.unpack(blocks.pack(blocks.steps(keys), np.arange(len(a), dtype=np.int32)))
        assert np.array_equal(np.cumsum(back[0], dtype=np.uint64), keys) and len(back[1]) == len(a)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 20), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t")).collect()}
    assert got[3] == 1 and got[21] == 7 and got[130] == 100 and 5 not in got


@pytest.mark.parametrize("hub", [0, 500, 999])
def test_components_of_hubs(spark, hub):
    rnd = random.Random(hub)
    edges = [(hub, rnd.randrange(400, 1000)) for _ in range(400)] + [(rnd.randrange(400), rnd.randrange(400)) for _ in range(150)] + [(1, 1)]
    links = {v: set() for e in edges for v in e}
    for a, b in edges:
        links[a].add(b)
        links[b].add(a)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["v"]: r["root"] for r in components(df, common.Scratch(spark, "t")).collect()}
    assert got == {v: root for v, root in reach(links, range(1000)).items() if links[v] - {v}}
    # every salt of a vertex learns the same, and no edge gets lost or doubled
    dealt = _components._with_least(df.distinct().toDF("u", "v"), F.min("v"), 7)
    assert sorted(tuple(r) for r in dealt.collect()) == sorted((a, b, min(y for x, y in edges if x == a)) for a, b in set(edges))


# 1 mixing

def test_mix(spark, docs, rows, empty):
    got = mixing.mix(docs, [3.0, 1.0, 2.0]).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, *_ in rows)
    have = defaultdict(int)
    for _, t, _, s, _ in rows:
        have[s] += len(words(t))
    order = sorted((s for s in have if s is not None), key=str.encode) + [None]
    weight = dict(zip(order, [3, 1, 2, 3]))
    target, free, total = {}, set(order), 1.5 * sum(have.values())
    while True:  # share, cap, share again
        left = total - sum(2 * have[s] for s in order if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * have[s]}
        if not over:
            break
        free -= over
    target = {s: share[s] if s in free else 2.0 * have[s] for s in order}
    source = {i: s for i, _, _, s, _ in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == have[s] and abs(r["target"] - target[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 20 for s in order)
    assert counted(mixing.mix(docs, [3.0, 1.0, 2.0]), "doc_id", "taken") == Counter((r["doc_id"], r["taken"]) for r in got)
    assert mixing.mix(empty, [1.0]).count() == 0


def test_mix_reruns_agree(spark, rows, tmp_path):
    """Files, splits and order of rows change nothing."""
    rnd, seen = random.Random(3), []
    for files in (1, 9):
        spark.createDataFrame(rnd.sample(rows, len(rows)), SCHEMA).repartition(files).write.parquet(f"{tmp_path}/{files}")
        seen.append(counted(mixing.mix(spark.read.parquet(f"{tmp_path}/{files}"), [3.0, 1.0, 2.0]), "doc_id", "taken"))
    assert seen[0] == seen[1]


def test_mix_tilts(spark, tmp_path):
    """Mean copies of documents of like size are the rates that solve the dual, found by bisection."""
    rnd = random.Random(4)
    sizes = {s: [rnd.randint(1, 40) ** 2 for _ in range(3000)] for s in "ab"}
    path = str(tmp_path / "d")
    spark.createDataFrame([(f"{s}{i}", s, n) for s in sizes for i, n in enumerate(sizes[s])], "doc_id string, source string, n long").write.parquet(path)
    got = mixing.mix(spark.read.parquet(path), [1.0, 3.0], total=1.0, size=F.col("n")).collect()
    for s in sizes:
        mine = [r for r in got if r["doc_id"][0] == s]
        mean, target = sum(sizes[s]) / 3000, mine[0]["target"]
        lo, hi = -50.0, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n * min(2.0, math.exp(min(mid * n / mean, 1))) for n in sizes[s]) < target else (lo, mid)
        rate = lambda n: min(2.0, math.exp(min(lo * n / mean, 1)))
        for band in range(0, 1600, 400):
            some = [r for r in mine if band < r["size"] <= band + 400]
            assert len(some) > 300 and abs(sum(r["copies"] for r in some) / len(some) - sum(rate(r["size"]) for r in some) / len(some)) < 0.02
        assert abs(sum(r["taken"] for r in mine) - target) <= 2000


# 2 language model

def test_lm(spark, docs, rows, empty):
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    tokens = [(i, [*words(lower(t)), None]) for i, t, *_ in rows]
    c = Counter(w for i, ws in tokens for w in ws if train(i))
    n, v = sum(c.values()), len(c)
    for size in (None, 2000):
        got = lm_scoring.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, block_bytes=size).collect()
        assert Counter((r["doc_id"], r["in_training"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == Counter((i, train(i), len(ws), sum(c[w] > 0 for w in ws), n) for i, ws in tokens)
        base = {i: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) for i, ws in tokens}
        assert all(abs(r["base_score"] - base[r["doc_id"]]) < 1e-9 and r["score"] < 0 for r in got)
    assert lm_scoring.score(empty, F.lit(True)).count() == 0
    assert all(r["score"] == 0 for r in lm_scoring.score(docs, F.lit(False)).select("score").collect())


def test_interpolated_score(spark, docs, rows, monkeypatch):
    """The score in plain Python, from the weights that were learned."""
    seen, learn = [], lm_scoring.learn_weights
    monkeypatch.setattr(lm_scoring, "learn_weights", lambda *a, **k: seen.append(learn(*a, **k)) or seen[-1])
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    got = lm_scoring.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, block_bytes=3000).collect()
    (weights,) = seen
    texts = [(i, [*words(lower(t)), None]) for i, t, *_ in rows]
    one, two = Counter(), Counter()
    for i, t in texts:
        if train(i):
            one.update([*t, "start of text"])
            two.update(zip(["start of text", *t], t))
    n, v = sum(c for w, c in one.items() if w != "start of text"), len(one) - 1

    def probability(before, token):
        w = weights[0 if not one[before] else min(1 + int(math.log2(one[before])), lm_scoring.BUCKETS - 1)]
        return w[0] * (two[before, token] / one[before] if one[before] else 0) + w[1] * one[token] / n + w[2] / (v + 1)

    want = defaultdict(list)
    for i, t in texts:
        want[i].append(sum(math.log10(probability(b, x)) for b, x in zip(["start of text", *t], t)))
    assert len(got) == len(rows) and all(any(abs(r["score"] - w) < 1e-6 for w in want[r["doc_id"]]) for r in got)
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all()


def test_learned_weights():
    w = lm_scoring.learn_weights(np.array([3, 3]), np.array([0.5, 0.0]), np.array([0.01, 0.01]), np.array([90.0, 10.0]), 1e-4)
    assert w[3, 0] > 0.8 and np.allclose(w.sum(axis=1), 1) and w[0, 0] == 0


# 3 packing

def test_pack(spark, docs, rows, empty):
    got = packing.pack(docs, buckets=4, budget=200).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(words(t))) for i, t, *_ in rows)
    batches = defaultdict(list)
    for r in got:
        assert r["padding"] == r["boundary"] - r["n_tokens"] >= 0 and r["over_budget"] == (r["n_tokens"] > 200)
        batches[r["bucket"], r["batch"]].append(r)
    for (b, k), rs in batches.items():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs))) and len(rs) <= rs[0]["batch_size"] == max(1, 200 // rs[0]["boundary"])
        assert len(rs) == rs[0]["batch_size"] or k == max(x for y, x in batches if y == b)
    assert packing.pack(empty).count() == 0


def test_boundary_is_a_length(spark, tmp_path):
    rnd = random.Random(12)
    lengths = [0, 1, 5, 1024, 1025] + [rnd.randint(1030, 30000) for _ in range(300)]
    path = str(tmp_path / "lengths")
    spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, size long").write.parquet(path)
    got = packing.pack(spark.read.parquet(path), buckets=6, length=F.col("size")).collect()
    assert Counter(r["n_tokens"] for r in got) == Counter(lengths)
    longest = defaultdict(int)
    for r in got:
        longest[r["bucket"]] = max(longest[r["bucket"]], r["n_tokens"])
    assert all(r["boundary"] == max(1, longest[r["bucket"]]) for r in got) and len(longest) == 6


def test_optimal_boundaries():
    rnd = random.Random(1)
    for _ in range(20):
        lengths = sorted(rnd.sample(range(1, 60), 7))
        counts = [rnd.randint(1, 9) for _ in lengths]

        def cost(bounds):
            return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))

        from itertools import combinations

        best = min(cost([*c, lengths[-1]]) for c in combinations(lengths[:-1], 2))
        got = packing.optimal_boundaries(np.array(lengths), np.array(counts), np.array(lengths) * counts, 3)
        assert cost(got) == best and got[-1] == lengths[-1]


def test_boundaries_are_optimal_over_all_lengths():
    """Against the plain recurrence, with lengths far beyond a thousand and hundreds of them."""
    rnd = random.Random(2)
    for _ in range(5):
        x = sorted(rnd.sample(range(1, 20_000), 150))
        n = [rnd.randint(1, 50) if rnd.random() < 0.9 else 5000 for _ in x]
        best = [0.0] + [math.inf] * len(x)
        for _ in range(6):
            best = [math.inf] + [min(best[i] + sum(c * (x[j - 1] - v) for v, c in zip(x[i:j], n[i:j])) for i in range(j)) for j in range(1, len(x) + 1)]
        got = packing.optimal_boundaries(np.array(x), np.array(n), np.array(x) * n, 6)
        assert sum(c * (min(b for b in got if b >= v) - v) for v, c in zip(x, n)) == best[-1] and got == sorted(set(got)) and got[-1] == x[-1]


# 4 toxicity

def test_fold_and_match():
    lexicon = toxicity.Lexicon.of({"idiot": 2.0, "scum*": 1.0}, ("village idiot",))
    a = lexicon.automaton()
    hits = lambda s: toxicity.matched(a, toxicity.fold(s))
    assert hits("You 1D10T!") == (2.0, 1) and hits("іdiоt id\u200biot ＩＤＩＯＴ") == (6.0, 3)
    assert hits("the village idiot") == (0.0, 0) and hits("scumbag") == (1.0, 1) and hits("oscum idiots") == (0.0, 0)
    assert hits(None) == hits("") == (0.0, 0) and hits("42 5 " * 1000) == (0.0, 0)


def brute_matched(lexicon, folded):
    """Every entry and phrase held against every place."""
    inside = lambda a, b: any(x <= a and b <= x + len(e) - 1 for e in lexicon.exceptions for x in range(len(folded)) if folded.startswith(e, x))
    best = [max((e for e in lexicon.entries if folded.startswith(e, i)), key=len, default=None) for i in range(len(folded))]
    kept = [e for i, e in enumerate(best) if e and not inside(i, i + len(e) - 2)]
    return sum(lexicon.entries[e] for e in kept), len(kept)


@pytest.mark.parametrize("seed", range(4))
def test_matches_are_those_of_a_scan(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abo", k=rnd.randint(1, 4))) for _ in range(40)]
    words = {w + rnd.choice(["", "*"]): rnd.randint(1, 9) for w in rnd.sample(vocabulary, 12)}
    lexicon = toxicity.Lexicon.of(words, tuple(" ".join(rnd.choices(vocabulary, k=2)) for _ in range(12)))
    automaton = lexicon.automaton()
    for _ in range(60):
        folded = toxicity.fold(" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 30))))
        assert toxicity.matched(automaton, folded) == brute_matched(lexicon, folded)


def test_lexicon_has_no_cap(spark):
    # 4,500 toxic words, too short for beginnings, each in 30 texts whose word order differs
    rnd = random.Random(6)
    names = ["".join(x) for x in itertools.islice(itertools.product("abcdefghjk", repeat=4), 4500)]
    rows = [(i, " ".join(rnd.sample(names[i % 15 * 300 :][:300], 300)), 1) for i in range(450)] + [(i, f"calm w{i}", 0) for i in range(450, 1650)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    lexicon = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert {toxicity.fold(n) for n in names} <= lexicon.entries.keys()


def test_digits_beside_signs_are_folded():
    lexicon = toxicity.Lexicon.of({"asshole": 2.0, "ass": 1.0})
    a = lexicon.automaton()
    hits = lambda s: toxicity.matched(a, toxicity.fold(s))
    assert hits("4$$hole @55 (4$$) a$5, @$5!") == (6.0, 5) and hits("4\u200b$$h0le") == (2.0, 1)
    assert toxicity.fold("455 4,55 -455% (455) 4:55 4_55 3.14 4\u200b55") == " "


def test_only_proven_copies_count_once():
    import pyarrow as pa

    base = [f"w{i}" for i in range(40)]
    other = [f"v{i}" for i in range(40)]
    texts = [" ".join(base), " ".join(base).upper(), " ".join([*base, "x"]), " ".join([*base[:2], *other]), None, "", "a", "b"]
    got = toxicity._uncopied(pa.RecordBatch.from_pydict({"text": [t], "toxic": [1], "sign": [5]}, pa.schema([("text", pa.string()), ("toxic", pa.int64()), ("sign", pa.int64())])) for t in texts)
    assert [t for b in got for t in b.column("text").to_pylist()] == [texts[0], texts[3], None, "a", "b"]


def test_equal_least_word_pair_is_no_copy(spark):
    # a pair of words with a very low hash gives most texts one sign, yet all are evidence
    rnd = random.Random(4)
    pairs = spark.createDataFrame([(f"p{i} q{i}",) for i in range(20000)], "text string")
    sign = toxicity._sign(F.col("text"))
    pair = pairs.orderBy(F.xxhash64(F.split("text", " ")[0], F.split("text", " ")[1])).first()["text"]
    rows = [(i, pair + " " + " ".join("".join(rnd.choices("cdefgh", k=6)) for _ in range(12)) + (" grumbo" if i % 2 else ""), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    assert df.select(sign.alias("s")).distinct().count() < 40
    lexicon = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert any(e.startswith(" grum") for e in lexicon.entries)


def test_toxicity_learns(spark, empty):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = []
    for i in range(400):
        bad = i % 5 == 0
        text = rnd.choices(vocabulary, k=40) + (["grumbo", "snark" + rnd.choice("abcdef")] * 2 if bad else [])
        rows.append((i, " ".join(text), "en", "s", 0, int(bad)))
    df = spark.createDataFrame(rows, SCHEMA + ", toxic int")
    lexicon = toxicity.fit(df.drop("toxic"), df.where("doc_id % 2 = 0").select("doc_id", "toxic"))
    got = toxicity.score(df, lexicon).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert toxicity.keep_clean(df, lexicon).count() == 320
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "grumbo " * 20000)], "doc_id long, text string")
    assert sorted(r["predicted"] for r in toxicity.score(odd, lexicon).collect()) == [0, 0, 0, 1]
    assert toxicity.score(empty, lexicon).count() == 0
    none = toxicity.fit(df, df.where("toxic = 9").select("doc_id", "toxic"))
    assert not none.entries and all(r["predicted"] == 0 for r in toxicity.score(df, none).collect())


# 5 vectors

def brute_links(v, threshold):
    ok = [x is not None and None not in x and np.isfinite(np.array(x, float)).all() and any(x) for x in v]
    links = {i: set() for i in range(len(v))}
    for i in range(len(v)):
        for j in range(i):
            if ok[i] and ok[j] and len(v[i]) == len(v[j]):
                a, b = np.array(v[i], float), np.array(v[j], float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    return links


def reach(links, ids):
    out = {}
    for i in sorted(links):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        known = [ids[k] for k in seen if ids[k] is not None]
        out[i] = min(known, default=None)
    return out


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    v = [list(map(float, c + rng.normal(scale=0.15, size=16))) for c in np.repeat(centres, 6, axis=0)]
    v += [v[0]] * 5 + [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], []]
    ids = [*range(len(v) - 1), None]
    path = str(tmp_path / "e")
    spark.createDataFrame([(i, x, 1, "raw") for i, x in zip(ids, v)], "vec_id long, embedding array<double>, label int, raw string").repartition(2).write.parquet(path)
    got = vector_dedup.vector_groups(spark.read.parquet(path)).collect()
    links = brute_links(v, 0.9)
    root = reach(links, ids)
    want = Counter((ids[i], len(links[i]), root[i]) for i in links)
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert vector_dedup.vector_groups(spark.read.parquet(path).where("false")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(6)
    c = rng.normal(size=(300, 32))
    v = vector_dedup._unit(np.concatenate([c, c + rng.normal(scale=0.1, size=c.shape), rng.normal(size=(900, 32))])).astype(np.float32)
    g = vector_dedup.Graph.build(v)
    beam, recall = g.audited_beam(0.9)
    true = v @ v.T >= 0.9
    got = sum(int(t[x].sum()) for t, x in zip(true, g.within(v, 0.9, beam)))
    assert recall >= 0.99 and got >= 0.97 * true.sum()
    back = vector_dedup.Graph.from_bytes(g.to_bytes(), 32)
    assert all(np.array_equal(a, b) for a, b in zip(back.within(v[:5], 0.9, beam), g.within(v[:5], 0.9, beam)))


def test_audit_of_a_small_graph():
    rng = np.random.default_rng(12)
    v = rng.normal(size=(150, 16))
    g = vector_dedup.Graph.build(vector_dedup._unit(np.concatenate([v, v + rng.normal(scale=0.03, size=v.shape)])).astype(np.float32))
    within = g.within
    g.within = lambda q, t, beam: within(q, t, beam) if beam > vector_dedup.FIRST_BEAM else [np.zeros(0, dtype=np.int64)] * len(q)
    beam, recall = g.audited_beam(0.9)
    assert beam > vector_dedup.FIRST_BEAM and recall == 1


@pytest.fixture
def shipped_whole():
    """Workers get the module as the test has patched it."""
    cloudpickle.register_pickle_by_value(vector_dedup)
    yield
    cloudpickle.unregister_pickle_by_value(vector_dedup)


def test_weak_searches_widen_and_links_count_for_both(spark, tmp_path, monkeypatch, shipped_whole):
    """A search that finds nothing with its first beams fails the audit; one that misses half its
    hits unaudited still gives both ends of a link the same links."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(400, 16))
    v = [list(map(float, x)) for x in np.concatenate([v, v + rng.normal(scale=0.05, size=v.shape)])]
    path = str(tmp_path / "e")
    spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>").write.parquet(path)
    links = brute_links(v, 0.9)
    assert sum(map(len, links.values())) >= 800
    within = vector_dedup.Graph.within
    monkeypatch.setattr(vector_dedup.Graph, "within", lambda self, q, t, beam: within(self, q, t, beam) if beam > 100 else [np.zeros(0, dtype=np.int64)] * len(q))
    got = vector_dedup.vector_groups(spark.read.parquet(path)).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == {i: len(x) for i, x in links.items()}
    monkeypatch.setattr(vector_dedup, "RECALL", 0.0)
    monkeypatch.setattr(vector_dedup.Graph, "within", lambda self, q, t, beam: [h[h % 2 == 0] for h in within(self, q, t, beam)])
    got = vector_dedup.vector_groups(spark.read.parquet(path)).collect()
    counts, groups = {r["vec_id"]: r["n_links"] for r in got}, Counter(r["component_id"] for r in got)
    pairs = [c for c, n in groups.items() if n == 2]
    assert 50 < len(pairs) < 400 and all(counts[r["vec_id"]] == 1 for r in got if r["component_id"] in pairs)
    assert all(counts[r["vec_id"]] == 0 for r in got if groups[r["component_id"]] == 1)


def test_audit_leaves_out_self_hits():
    rng = np.random.default_rng(9)
    c = rng.normal(size=(1, 32))
    for crowd in (0, 200):  # links are few, or outweighed by those of a large group
        v = rng.normal(size=(400, 32))
        v = vector_dedup._unit(np.concatenate([v, v[:40] + rng.normal(scale=0.05, size=(40, 32)), c + rng.normal(scale=0.02, size=(crowd, 32))])).astype(np.float32)
        g = vector_dedup.Graph.build(v)
        # outside the large group only the point itself is found by a beam
        within = g.within
        g.within = lambda q, t, beam: [x if len(x) > 2 or beam > len(v) * vector_dedup.WIDEST else x[[i for i, n in enumerate(x) if np.array_equal(v[n], r)]] for x, r in zip(within(q, t, beam), q)]
        beam, recall = g.audited_beam(0.9)
        assert beam > len(v) * vector_dedup.WIDEST and recall == 1


def test_audit_tells_what_it_tested(spark, tmp_path):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(3000, 16))
    v = [list(map(float, x)) for x in np.concatenate([v, v[:20] + rng.normal(scale=0.05, size=(20, 16))])]
    path = str(tmp_path / "e")
    spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>").write.parquet(path)
    got = vector_dedup.vector_groups(spark.read.parquet(path)).collect()
    unit = vector_dedup._unit(np.array(v))
    linked = int(((unit @ unit.T >= 0.9).sum(axis=1) > 1).sum())
    # too few for a sample, so all points are asked, and the links found are the share that is told
    assert {r["recall_tested"] for r in got} == {linked} and linked >= 40
    assert {r["recall"] for r in got} != {0.0} and sum(r["n_links"] > 0 for r in got) >= 0.99 * linked


def test_few_links_keep_to_beams(spark, tmp_path, monkeypatch):
    """Without a link to test, planted queries tell that beams find what there is, and no recall is told."""
    rng = np.random.default_rng(13)
    v = rng.normal(size=(6000, 32))
    path = str(tmp_path / "e")
    spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(path)
    monkeypatch.setattr(vector_dedup, "AUDIT", 64)
    monkeypatch.setattr(vector_dedup, "MOST_AUDIT", 256)
    got = vector_dedup.vector_groups(spark.read.parquet(path)).agg(F.count("*").alias("n"), F.sum("n_links").alias("links"), F.max("recall").alias("r"), F.max("recall_tested").alias("t"), F.min("planted_recall").alias("p"), F.max("beam").alias("b")).first()
    assert (got["n"], got["links"], got["r"], got["t"]) == (6000, 0, None, 0)
    assert got["p"] >= vector_dedup.RECALL and got["b"] <= 6000 / vector_dedup.LEAST_SHARDS * vector_dedup.WIDEST


def test_planted_queries_know_their_points():
    v = vector_dedup._unit(np.random.default_rng(14).normal(size=(500, 24))).astype(np.float32)
    g = vector_dedup.Graph.build(v)
    assert g.planted(0.9, vector_dedup.EVERY, 200) == (200, 200)
    g.within = lambda q, t, beam: [np.flatnonzero(v @ x >= t)[:0] for x in q]
    assert g.planted(0.9, 24, 10_000) == (500, 0)
    assert vector_dedup.Graph.build(np.ones((3, 1), dtype=np.float32)).planted(0.9, 24, 5) == (3, 3)


# 6 substrings

@pytest.mark.parametrize("window,least,size", [(35, 16, None), (35, 4, 3000), (5, 16, None)])
def test_substrings(spark, docs, rows, empty, window, least, size):
    texts = [words(t) for _, t, *_ in rows]
    n = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    want = Counter()
    for (i, *_), w in zip(rows, texts):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if n[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    got = substring_dedup.substring_dedup(docs, window, with_text=True, least_level=least, block_bytes=size)
    assert counted(got, "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text") == want
    assert sum(k[2] for k in want) > 0 and substring_dedup.levels(35) == [18, 35]
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_stops_where_nothing_repeats(spark, tmp_path, monkeypatch):
    made, store = [], common.Scratch.store
    monkeypatch.setattr(common.Scratch, "store", lambda self, df, *a, **k: made.append(1) or store(self, df, *a, **k))
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(5)], "doc_id long, text string").write.parquet(path)
    got = substring_dedup.substring_dedup(spark.read.parquet(path), 20, least_level=5).collect()
    assert all(r["n_removed"] == 0 and r["n_words"] == 60 for r in got) and len(got) == 5 and len(made) < 4  # blocks, and three levels otherwise


# 7 WARC

def test_warc(spark, tmp_path):
    pages = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "u\r\nv", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (5, "http://é", "é" * 70000), (2, "http://b/", "x"), (None, "n", "x"), (6, "e", "")]
    df = spark.createDataFrame([(*p, "keep") for p in pages], "page_id long, url string, html string, digest string")
    df.write.parquet(str(tmp_path / "p"))
    for name, compression in (("gz", "gzip"), ("plain", None)):
        out = str(tmp_path / name)
        warc.write_archives(spark.read.parquet(str(tmp_path / "p")), out, compression=compression, file_bytes=40)
        records = warc.read_records(spark, out)
        assert records.count() == 3 * len(pages)
        got = warc.captures_with_origin(warc.assemble(records)).collect()
        assert len(got) == len(pages)
        bodies = Counter()
        for r in got:
            assert r["request"] is not None and r["metadata"] is not None
            first = r["type"] == "response"
            src = r["response"] if first else r["origin"]
            if first:
                body = bytes(r["response"]["block"]).split(b"\r\n\r\n", 1)[1]
                assert r["response"]["digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode() == "sha1:" + src["payload_digest"]
            bodies[r["page_id"], src["payload_bytes"], r["type"], None if first else r["origin"]["page_id"]] += 1
        assert bodies == Counter({(1, 1, "revisit", 2): 1, (2, 1, "response", None): 1, (2, 1, "revisit", 2): 1, (None, 1, "revisit", 2): 1, (3, 0, "revisit", 6): 1, (6, 0, "response", None): 1, (4, 33, "response", None): 1, (5, 140000, "response", None): 1})
    out = str(tmp_path / "least")
    warc.write_archives(spark.read.parquet(str(tmp_path / "p")), out, min_bytes=2)
    assert warc.read_records(spark, out).where("type = 'revisit'").count() == 0
    warc.write_archives(df.where("false"), str(tmp_path / "none"))
    assert warc.read_records(spark, str(tmp_path / "none")).count() == 0


def test_warc_file_sizes(spark, tmp_path):
    """Small pages, then a run of long ones: no archive passes its limit, but one that is a single longer capture."""
    html = ["x" * 100] * 1000 + ["\u00e9" * 60_000 + str(i) for i in range(30)] + ["z" * 600_000] + ["y" * 50] * 100
    df = spark.createDataFrame([(i, f"http://a/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    df.write.parquet(str(tmp_path / "p"))
    out, limit = str(tmp_path / "w"), 400_000
    warc.write_archives(spark.read.parquet(str(tmp_path / "p")), out, compression=None, file_bytes=limit)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "w").glob("part-*"))
    assert 600_000 < sizes[-1] < 602_000 and sizes[-2] <= limit
    assert len(sizes) < 4 * sum(sizes) / limit + 8
    got = warc.captures_with_origin(warc.assemble(warc.read_records(spark, out)))
    assert {r["page_id"]: r["n"] for r in got.selectExpr("page_id", "coalesce(response.payload_bytes, origin.payload_bytes) AS n").collect()} == {i: len(h.encode()) for i, h in enumerate(html)}


# 8 exact duplicates

@pytest.mark.parametrize("size,fingerprint", [(4096, F.xxhash64), (16, F.xxhash64), (16, lambda c: F.xxhash64(c) % 3)], ids=["whole", "blocks", "collisions"])
def test_exact(spark, docs, rows, empty, size, fingerprint):
    got = exact_dedup.exact_dedup(docs, size, fingerprint).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter((i, max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(empty).count() == 0


# 9 near duplicates

@pytest.mark.parametrize("n_words,per_cent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard(spark, docs, rows, empty, n_words, per_cent):
    sets = []
    for _, t, *_ in rows:
        w = words(lower(t))
        sets.append({tuple(w[k : k + n_words]) for k in range(len(w) - n_words + 1)} if len(w) >= n_words else {tuple(w)} if w else set())
    links = {i: {j for j in range(len(sets)) if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= per_cent * len(sets[i] | sets[j])} for i in range(len(sets))}
    root = reach(links, [r[0] for r in rows])
    got = jaccard_join.jaccard_groups(docs, n_words, per_cent)
    assert counted(got, "doc_id", "n_shingles", "component_id") == Counter((r[0], len(s), root[i]) for i, (r, s) in enumerate(zip(rows, sets)))
    assert jaccard_join.jaccard_groups(empty).count() == 0


@pytest.mark.parametrize("n_words,per_cent", [(4, 85), (5, 80)])
def test_jaccard_of_short_texts(spark, tmp_path, n_words, per_cent):
    texts = ["a a a", "a a a a", "a b c", "a b b c", "A  a a", "a a", "a", "a a a a a", "a a a a a a"]
    path = str(tmp_path / "short")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).write.parquet(path)
    shingles = [{tuple(w[k : k + n_words]) for k in range(max(1, len(w) - n_words + 1))} for w in (words(lower(t)) for t in texts)]
    want = Counter((i, min(j for j, y in enumerate(shingles) if x == y)) for i, x in enumerate(shingles))
    assert counted(jaccard_join.jaccard_groups(spark.read.parquet(path), n_words, per_cent), "doc_id", "component_id") == want


def test_group_links_connect_all():
    rnd = random.Random(5)
    base = [rnd.sample(range(10_000), 60) for _ in range(3)]
    sets = [np.unique(np.array([x if rnd.random() > 0.06 else rnd.randrange(10_000) for x in rnd.choice(base)], dtype=np.uint64)) for _ in range(120)] + [np.zeros(0, dtype=np.uint64)] * 2
    links = {i: {j for j in range(len(sets)) if i != j and jaccard_join.similar(sets[i], sets[j], 85)} for i in range(len(sets))}
    got = jaccard_join.group_links(sets, 85)
    assert all(j in links[i] for i, j in got)
    forest = {i: {j for p in got if i in p for j in p if j != i} for i in range(len(sets))}
    ids = range(len(sets))
    assert reach(forest, ids) == reach(links, ids) and len(got) == len(sets) - len(set(reach(links, ids).values()))


def test_candidates_grow_with_the_input(spark, tmp_path, monkeypatch):
    """Groups of near copies that differ from each other about as much as the threshold allows, and a
    passage that many texts share: five times the rows name about five times the candidates at most."""
    made, store = [], common.Scratch.store

    def watched(self, df, *a, **k):
        out = store(self, df, *a, **k)
        made.append(out)
        return out

    monkeypatch.setattr(common.Scratch, "store", watched)
    monkeypatch.setattr(common.Scratch, "drop", lambda self, *dfs: None)
    rnd, rows = random.Random(6), []
    vocabulary = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(3000)]
    bases = [rnd.choices(vocabulary, k=150) for _ in range(3)]
    passage = rnd.choices(vocabulary, k=100)
    for size in (60, 300):
        texts = [" ".join(w if rnd.random() > 0.01 else rnd.choice(vocabulary) for w in b) for b in bases for _ in range(size)]
        texts += [" ".join([*rnd.choices(vocabulary, k=15), *passage, *rnd.choices(vocabulary, k=15)]) for _ in range(size)]
        path = f"{tmp_path}/{size}"
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
        made.clear()
        jaccard_join.jaccard_groups(spark.read.parquet(path), 4, 85).count()
        rows.append(sum(d.count() for d in made if d.columns == ["a", "b"]))
    assert rows[0] >= 60 and rows[1] <= 8 * rows[0]


def test_pages_of_large_blocks(spark, tmp_path, monkeypatch):
    """Near copies in many pages, and texts that share half with them: what is connected does not meet again, so
    rows grow with the input, and no link is lost."""
    kept, store, grown = [], common.Scratch.store, []
    monkeypatch.setattr(common.Scratch, "store", lambda self, df, *a, **k: kept.append(store(self, df, *a, **k)) or kept[-1])
    monkeypatch.setattr(common.Scratch, "drop", lambda self, *dfs: None)
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(3000)]
    base = rnd.choices(vocabulary, k=120)
    for size in (40, 200):
        texts = [" ".join(w if rnd.random() > 0.004 else rnd.choice(vocabulary) for w in base) for _ in range(size)]
        texts += [" ".join([*base[:60], *rnd.choices(vocabulary, k=60)]) for _ in range(3)] + texts[:5]
        path = f"{tmp_path}/{size}"
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
        kept.clear()
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(spark.read.parquet(path), 4, 85).collect()}
        sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
        links = {i: {j for j in range(len(sets)) if i != j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])} for i in range(len(sets))}
        assert got == dict(enumerate(reach(links, range(len(sets))).values()))
        (cut,) = [d for d in kept if "main_pages" in d.columns]
        grown += cut.where("most > 0").selectExpr(f"{size} AS size", "((m - most) * (pages + main_pages) + most * pages) / m AS times").collect()
    # of a block's texts, those of the main component stay one row each, whatever their number
    assert {r["size"] for r in grown} == {40, 200} and all(r["times"] <= 2 for r in grown)


def test_tree_pairs_lose_nothing():
    rng = np.random.default_rng(8)
    base = rng.poisson(8, size=(30, jaccard_join.GROUPS))
    points = np.concatenate([base, base + rng.poisson(0.2, size=base.shape), rng.poisson(8, size=(200, jaccard_join.GROUPS))])
    sizes = points.sum(axis=1)
    i, j = jaccard_join.tree_pairs(points, sizes, np.arange(len(points)), 85)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(len(points)) for b in range(a + 1, len(points)) if np.minimum(points[a], points[b]).sum() >= jaccard_join.least_overlap(sizes[a] + sizes[b], 85)}
    assert got == want and len(want) >= 30


def test_pair_is_named_in_one_block():
    rng = np.random.default_rng(9)
    p, q = rng.integers(-20, 20, size=(200, 16)), rng.integers(-20, 20, size=(200, 16))
    q[:20] = np.arange(100, 116)  # nothing in common with p
    both = [set(x.tolist()) & set(y.tolist()) for x, y in zip(p, q)]
    for s in range(-20, 20):
        got = jaccard_join.named_here(np.full(200, s), p, q)
        assert got.tolist() == [not c or min(c) == s for c in both]


# 10 URLs

@pytest.mark.parametrize("bound", [1000, 0])
def test_urls(spark, bound):
    urls = ["http://A.Example.com/en/7?x#y", "https://example.com/en/8", "x://com/en/", "x://xcom/en/", "http://a.net/de/8#/", "http://example.net/de/8/9", "//org/es/", None, "", "a://b://c/d", "http://org?/es/", "http://org/es/" + "z" * 3000, "http://www.org/es/é"]
    rules = url_filter.QUERY_RULES + [("", "/any", "block"), ("b:", "", "block")]
    pages = [(i, u, "h", "v") for i, u in enumerate(urls)] + [(1, urls[1], "h", "v"), (None, urls[0], "h", "v")]
    df = spark.createDataFrame(pages, "page_id long, url string, rule string, verdict string")
    got = url_filter.url_filter(df, spark.createDataFrame(rules, "host string, path string, verdict string"), broadcast_rules=bound)

    def judge(url):
        m = re.search("://", url or "")
        rest = url[m.end() :] if m else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    assert counted(got, "page_id", "host", "path", "rule", "verdict") == Counter((i, *judge(u)) for i, u, *_ in pages)
    assert url_filter.url_filter(df.where("false"), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    none = url_filter.url_filter(df, spark.createDataFrame([], "host string, path string, verdict string"))
    assert none.where("verdict = 'allow' AND rule IS NULL").count() == len(pages)


# the registered queries

def test_queries(spark, docs, rows, tmp_path):
    """Column names, and the rules that belong to a query rather than its operator."""
    from jamolake.llm.queries import QUERIES

    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(i, [1.0, float(i % 5)], 0) for i in range(30)], "vec_id long, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    spark.createDataFrame([(i, f"http://www.example.com/en/{i % 9}", "x" * (i % 4) or None) for i in range(20)], "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
    want = {
        "op1": ["doc_id", "size", "source_size", "target", "taken"], "op2": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op3": ["doc_id"],
        "op4": ["doc_id", "held_out", "score", "predicted"], "op5": ["vec_id", "n_links", "component_id", "kept"], "op6": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op7": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op8": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op9": ["doc_id", "n_shingles", "component_id"], "op10": ["page_id", "host", "path", "rule", "verdict"],
        "op11": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"], "op12": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op13": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    }
    got = {}
    for name, query in QUERIES.items():
        op = name.split("_")[0]
        df = query(spark, sf)
        assert set(want[op]) <= set(df.columns)
        got[op] = df.collect()
    ids = Counter(r[0] for r in rows)
    assert all(Counter(r["doc_id"] for r in got[op]) == ids for op in ("op1", "op2", "op3", "op4", "op6", "op8", "op9", "op12"))
    assert Counter(r["vec_id"] for r in got["op11"]) == Counter({i: 2 for i in range(30)}) and all(r["n"] == 30 and (r["component"] == 1) == (r["whitened"] is not None) for r in got["op11"])
    number = {i: len(words(t)) for i, t, *_ in rows}
    assert all(r["n_words"] == number[r["doc_id"]] and not (r["base_failed"] and r["kept"]) for r in got["op12"])
    held = lambda i, n, k: zlib.crc32(str(i).encode()) % n == k
    assert all(r["held_out"] == held(r["doc_id"], 7, 2) for r in got["op2"]) and all(r["held_out"] == held(r["doc_id"], 3, 1) and r["predicted"] == (r["score"] >= 0.7) for r in got["op4"])
    last = {i % 4: i for i in range(20)}
    assert all((r["record_type"], r["refers_to"]) == (("response", None) if last[r["page_id"] % 4] == r["page_id"] else ("revisit", last[r["page_id"] % 4])) and r["payload_bytes"] == r["page_id"] % 4 for r in got["op7"])
    assert {r["verdict"] for r in got["op10"]} == {"allow", "block"} and len(got["op5"]) == 30


# pipeline

def test_pipeline(spark, rows, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    distinct = len({t or "" for _, t, *_ in rows})
    assert sizes[0] == len(rows) and sizes[1] == distinct and sizes[2] < distinct and sizes[4] == sizes[3]
    assert corpus_pipeline.run(spark, sf).count() == sizes[4]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_pipeline_decisions(spark, tmp_path):
    """What each stage keeps of planted toxic, copied, nearly copied and clean texts."""
    rnd = random.Random(13)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(300)]
    texts = [" ".join(rnd.choices(vocabulary, k=40) + (["grumbo", "snark" + rnd.choice("abcdef")] * 2 if i % 5 == 0 else [])) for i in range(400)]
    toxic = {i for i in range(400) if i % 5 == 0}
    for k in range(1, 60, 2):
        toxic |= {len(texts) + j for j in range(3)} if k in toxic else set()
        half = texts[k].split()
        texts += [texts[k], texts[k] + " zz", " ".join([*half[:20], *rnd.choices(vocabulary, k=20), *half[40:]])]
    texts += [None, "", " \t", "ha ha ha", "ha ha ha ha", "HA ha ha"]
    sources = [rnd.choice(["s1", "s2", "s3", None]) for _ in texts]
    order = rnd.sample(range(len(texts)), len(texts))
    sf = str(tmp_path)
    spark.createDataFrame([(i, texts[i], "en", sources[i], len(texts[i] or "")) for i in order], SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, got = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        got[name] = counted(docs, "doc_id")

    clean = [i for i in range(len(texts)) if i not in toxic]
    assert got["toxicity"] == Counter((i,) for i in clean) and len(clean) < len(texts)
    last = {texts[i] or "": i for i in clean}
    assert got["exact_dedup"] == Counter((i,) for i in last.values()) and len(last) < len(clean)
    kept = sorted(last.values())
    sets = {}
    for i in kept:
        w = words(lower(texts[i]))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: {j for j in kept if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} for i in kept}
    root = reach(links, range(len(texts)))
    near = [i for i in kept if root[i] == i]
    assert got["near_dedup"] == Counter((i,) for i in near) and len(near) < len(kept)
    # each row at most twice, and the words of each source as its weight asks, unless there are too few
    have, taken = defaultdict(int), defaultdict(int)
    for i in near:
        have[sources[i]] += len(words(texts[i]))
    for (i,), n in got["mixing"].items():
        assert i in near and n <= 2
        taken[sources[i]] += n * len(words(texts[i]))
    names = ["s1", "s2", "s3", None]
    weight, free, total = dict(zip(names, [3, 1, 2, 3])), set(names), 1.5 * sum(have.values())
    while True:
        left = total - sum(2 * have[s] for s in names if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * have[s]}
        if not over:
            break
        free -= over
    assert all(abs(taken[s] - share.get(s, 2 * have[s])) <= 0.05 * share.get(s, 2 * have[s]) + 40 for s in names)
    assert got["packing"] == got["mixing"]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"],) for r in rows) == got["mixing"]
    assert all(r["n_tokens"] == len(words(texts[r["doc_id"]])) and r["padding"] == r["boundary"] - r["n_tokens"] >= 0 for r in rows)
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == len(rows)
