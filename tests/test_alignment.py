import difflib
import functools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jamolake.functions import alignment as a
from jamolake.functions import phonology as p
from jamolake.functions.hangul import text_to_jamo
from jamolake.operators import metrics as m

LETTERS = st.text("ㄱㄴㅏㅇ ", max_size=9)


def slow(e, x):
    """The statuses of the alignment, and its cost, by recursion on the ends of both texts."""

    @functools.cache
    def cost(i, j):
        if not (i and j):
            return i + j
        return min(cost(i - 1, j - 1) + (e[i - 1] != x[j - 1]), cost(i - 1, j) + 1, cost(i, j - 1) + 1)

    def path(i, j):
        if not (i or j):
            return []
        moves = [("correct", i and j and e[i - 1] == x[j - 1], 1, 1), ("substitution", i and j and cost(i, j) == cost(i - 1, j - 1) + 1, 1, 1), ("insertion", j and cost(i, j) == cost(i, j - 1) + 1, 0, 1), ("deletion", i, 1, 0)]
        name, _, up, left = next(m for m in moves if m[1])
        return [*path(i - up, j - left), name]

    return path(len(e), len(x)), cost(len(e), len(x))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(LETTERS, LETTERS), max_size=6))
def test_paths(pairs):
    for (e, x), path in zip(pairs, a.align_all(pairs)):
        status, cost = slow(e, x)
        assert [s["status"] for s in path] == status
        assert sum(s != "correct" for s in status) == cost
        assert "".join(s["expected"] or "" for s in path) == e and "".join(s["actual"] or "" for s in path) == x


def test_small_cases(spark):
    df = spark.createDataFrame([("닥뽀끔", "박뿌금"), ("학꾜에 감니다", "학꾜에 갑니다"), ("", ""), (None, "x")], "x string, y string")
    df = df.withColumn("al", a.align(F.array_join(text_to_jamo(F.col("x")), ""), F.array_join(text_to_jamo(F.col("y")), "")))
    df = df.withColumn("d", a.diagnose(F.array_join(text_to_jamo(F.col("x")), ""), F.array_join(text_to_jamo(F.col("y")), "")))
    rows = df.select(F.col("d.subs").alias("s"), a.alignment_score(F.col("al")).alias("score")).collect()
    assert [tuple(s) for s in rows[0]["s"]] == [("ㄷ", "ㅂ"), ("ㅗ", "ㅜ"), ("ㄲ", "ㄱ")]
    assert [tuple(s) for s in rows[1]["s"]] == [("ㅁ", "ㅂ")]
    assert rows[2]["score"] == 0.0


def test_classify_and_feedback(spark):
    pairs = [("ㄱ", "ㄲ"), ("ㄷ", "ㅈ"), ("ㅂ", "ㅁ"), ("ㅌ", "ㅊ"), ("ㅏ", "ㅓ")]
    got = spark.createDataFrame(pairs, "e string, a string").select(p.classify(F.col("e"), F.col("a")).alias("k")).collect()
    assert [r["k"] for r in got] == ["tensification", "palatalization", "nasalization", "palatalization", "other"]
    f = spark.createDataFrame([("치", "티"), ("가", "각")], "r string, h string").select(p.jamo_feedback(text_to_jamo(F.col("r")), text_to_jamo(F.col("h"))).alias("f")).collect()
    assert [r["f"] for r in f] == ["ㅊ(파찰음(격)) → ㅌ(파열음(격))", ""]


def test_linking_and_metrics(spark):
    rows = m.evaluate(spark.createDataFrame([(1, "s", "음식이", "음시기"), (2, "s", "먹어요", "머거요"), (3, "s", "가", "가"), (4, "", "가", "나")], "utt long, speaker_id string, x string, y string"))
    got = {r["utt"]: r for r in rows.collect()}
    assert got[1]["counts"]["linking"] == 1 and got[2]["counts"]["linking"] == 1 and got[3]["edit_distance"] == 0
    assert got[3]["is_raw"] is False and got[3]["ratio"] == 0.0
    one = m.corpus_metrics(rows).first()
    assert one["n_samples"] == 4 and one["m1_rate"] == 0.75 and one["total_linking"] == 2
    assert m.corpus_metrics(rows.where("false")).first()["m1_rate"] == 0.0
    assert m.subset_report(rows.where("false")).count() == 0
    prof = m.profiles(rows).collect()
    assert len(prof) == 1 and prof[0]["weakness"] == "linking" and prof[0]["n_utterances"] == 3
    assert m.consistency(rows).count() <= 1
    assert m.markdown(m.corpus_metrics(rows), "t").first()["report"].startswith("## t")


def test_rates(spark):
    df = spark.createDataFrame([("a b", "ab"), ("", "x"), ("abcd", "abxd")], "r string, h string")
    got = df.select(a.cer_plain(F.col("r"), F.col("h")).alias("b"), a.cer_squeezed(F.col("r"), F.col("h")).alias("c"), a.cer_scorer(F.col("r"), F.col("h")).alias("d")).collect()
    assert [tuple(x) for x in got] == [(1 / 3, 0.0, 0.0), (None, 1.0, 0.0), (0.25, 0.25, 25.0)]


def test_sequence_matching(spark):
    df = spark.createDataFrame([("abcd", "axcd"), ("", "")], "r string, h string")
    got = df.select(a.opcodes("r", "h").alias("o"), a.similarity("r", "h").alias("s")).collect()
    assert [o["type"] for o in got[0]["o"]] == ["equal", "replace", "equal"] and got[0]["s"] == 0.75
    assert got[1]["s"] == 1.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abcd", max_size=14), st.text("abcd", max_size=14)), max_size=6), st.booleans(), st.integers(0, 2**32))
def test_blocks_in_common(pairs, popular, seed):
    """Against the standard library's matcher, long texts with popular letters included."""
    draw = random.Random(seed)
    long = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz" * 4 + "가나다라마바사아자차카타파하") for _ in range(300))
    pairs = [*pairs, (long, "".join(c for c in long if draw.random() > 0.2))]
    for (x, y), blocks in zip(pairs, a.common_blocks([(a._codes(x), a._codes(y)) for x, y in pairs], popular)):
        want = difflib.SequenceMatcher(None, x, y, autojunk=popular)
        assert a._operations(x, y, blocks) == [{"type": t, "ref": x[i:j], "hyp": y[k:m]} for t, i, j, k, m in want.get_opcodes()]
        assert 2 * sum(k for _, _, k in blocks) == round(want.ratio() * (len(x) + len(y))) or not x + y


def test_blocks_of_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("", "a"), ("a", "")], "r string, h string")
    got = [tuple(r) for r in df.select(a.opcodes("r", "h").alias("o"), a.similarity("r", "h").alias("s")).collect()]
    assert got[:2] == [(None, None)] * 2 and [(o[0]["type"], s) for o, s in got[2:]] == [("insert", 0.0), ("delete", 0.0)]


def test_long_and_empty_pairs_align():
    """Costs beyond 256, tables side by side of very different sizes, and nothing at all."""
    e, x = "ab" * 400, "c" * 350
    (path,) = a.align_all([(e, x)])
    assert [s["status"] for s in path].count("substitution") == 350 and len(path) == 800
    assert a.align_all([("", ""), ("", "ab"), ("ab", "")])[0] == [] and a.align_all([]) == []


def test_distances(spark):
    pairs = [("kitten", "sitting"), ("", "abc"), ("ab" * 400, "ba" * 390), (None, "x"), ("가나", "가다"), ("", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select(a.edit_distance("a", "b").alias("d"), F.levenshtein("a", "b").alias("l")).collect()
    assert [r["d"] for r in got] == [r["l"] for r in got]


def _table_path(a, b):
    cost = [[i or j if not (i and j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, out = len(a), len(b), []
    while i or j:
        kind = 0 if i and j and a[i - 1] == b[j - 1] else 1 if i and j and cost[i - 1][j - 1] + 1 == cost[i][j] else 2 if j and cost[i][j - 1] + 1 == cost[i][j] else 3
        out.append(kind)
        i, j = i - (kind != 2), j - (kind != 3)
    return cost[-1][-1], out[::-1]


def test_bit_columns_and_kept_rows(monkeypatch):
    import random

    import numpy as np

    from jamolake.functions import alignment as al

    rnd = random.Random(3)
    text = lambda: "".join(rnd.choices("abㄱ", k=rnd.choice([0, 1, 2, 31, 63, 64, 65, 127, 128, 140])))
    pairs = [(text(), text()) for _ in range(120)]
    codes = [(al._codes(a), al._codes(b)) for a, b in pairs]
    want = [_table_path(a, b) for a, b in pairs]
    assert al.distances(codes) == [w[0] for w in want] == [al._distance_long(*c) for c in codes]
    for got in (al._steps_together(codes), [al._steps_long(*c) for c in codes], al.steps(codes)):
        assert [g.tolist() for g in got] == [w[1] for w in want]
    monkeypatch.setattr(al, "GROUP", 5)
    monkeypatch.setattr(al, "LONG", 64)
    monkeypatch.setattr(al, "CELLS", 500)
    assert al.distances(codes) == [w[0] for w in want] and [g.tolist() for g in al.steps(codes)] == [w[1] for w in want]
    assert al.distances([]) == [] and al.steps([]) == []
    assert np.array_equal(al.steps([(al._codes(""), al._codes(""))])[0], [])


def test_a_long_pair_in_little_memory():
    import random
    import tracemalloc

    from jamolake.functions import alignment as al

    rnd = random.Random(4)
    a, b = (al._codes("".join(rnd.choices("abcdef", k=8_000))) for _ in range(2))
    tracemalloc.start()
    got = al.steps([(a, b)])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6 and (got != 0).sum() == al.distances([(a, b)])[0]
    i = j = 0
    for kind in got.tolist():
        assert kind != 0 or a[i] == b[j]
        i, j = i + (kind != 2), j + (kind != 3)
    assert (i, j) == (8_000, 8_000)
