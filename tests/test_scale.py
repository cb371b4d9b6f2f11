"""What keeps the queries of sentences and names growing with their input, and no faster."""

from collections import Counter

from pyspark.sql import functions as F

from jamolake.functions import alignment as a
from jamolake.functions import g2p, hangul
from jamolake.operators import metrics as m
from jamolake.plans import base


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_by_their_number(spark, tmp_path):
    spark.range(5500).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert base.spread(df).rdd.getNumPartitions() == 6 and base.spread(df, 500).rdd.getNumPartitions() == 11
    assert base.spread(df).count() == 5500


def test_pairs_are_counted_without_sorting_all(spark):
    given = [(7, "s", "abab"), (3, "s", "ba"), (5, "t", "aab"), (9, "s", "b"), (1, "", "a"), (4, "t", "")]
    rows = spark.createDataFrame([(u, s, [(c, c.upper()) for c in t]) for u, s, t in given], "utt long, speaker_id string, subs array<struct<exp:string,act:string>>").repartition(3)
    got = m.pair_counts(rows)
    assert "SortAggregate" not in plan(got)
    want = {}
    for s in ("s", "t"):
        for c in "ab":
            mine = [(u, t) for u, x, t in given if x == s and c in t]
            want[s, c] = (sum(t.count(c) for _, t in mine), len(mine), min((u, t.index(c)) for u, t in mine))
    found = {(r["speaker_id"], r["exp"]): r for r in m.top_pairs(got, 5).collect()}
    assert {k: (r["n"], r["n_utts"]) for k, r in found.items()} == {k: v[:2] for k, v in want.items()}
    order = lambda s: sorted("ab", key=lambda c: (-want[s, c][0], want[s, c][2]))
    assert all(found[s, c]["rank"] == i + 1 for s in "st" for i, c in enumerate(order(s)))
    assert [(r["exp"], r["n"]) for r in m.top_substitutions(rows, 2).collect()] == [("a", 6), ("b", 5)]
    assert "SortAggregate" not in plan(m.top_substitutions(rows, 2)) and m.pair_counts(rows.where("false")).count() == 0


def test_both_ends_in_one_pass(spark, tmp_path):
    given = [(i, None if i % 7 == 0 else (i * 5 % 11) / 10) for i in range(40)]
    spark.createDataFrame(given, "utt long, cer double").repartition(3).write.parquet(f"{tmp_path}/t")
    got = m.both_ends(spark.read.parquet(f"{tmp_path}/t"), 5)
    assert plan(got).count("FileScan") == 1
    rated = [g for g in given if g[1] is not None]
    want = [("best", *g) for g in sorted(rated, key=lambda g: (g[1], g[0]))[:5]] + [("worst", *g) for g in sorted(rated, key=lambda g: (-g[1], -g[0]))[:5]]
    assert [tuple(r) for r in got.collect()] == want
    few = m.both_ends(spark.createDataFrame([(1, None), (2, 0.5), (3, None)], "utt long, cer double"), 5)
    assert Counter((r["side"], r["utt"]) for r in few.collect()) == Counter((s, u) for s in ("best", "worst") for u in (1, 2, 3))


def test_error_rates_are_found_many_pairs_at_once(spark):
    df = spark.createDataFrame([("가나 다", "가다"), ("", "x"), (None, "x"), ("abc", "")], "r string, h string")
    got = df.select(a.cer_plain(F.col("r"), F.col("h")).alias("p"), a.cer_squeezed(F.col("r"), F.col("h")).alias("s"), a.cer_scorer(F.col("r"), F.col("h")).alias("c"))
    assert "levenshtein" not in plan(got)
    assert [tuple(r) for r in got.collect()] == [(0.5, 1 / 3, 33.3), (None, 1.0, 0.0), (None, None, 0.0), (1.0, 1.0, 100.0)]


def test_letters_are_looked_up_by_place(spark):
    text = "값이 없다 abc|밟고😀ㄱ않던힣가"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = df.select(hangul.jamo_string(F.col("t")).alias("j"), g2p.g2p(F.col("t")).alias("g"), hangul.encode(F.col("t")).alias("e"))
    # of fixed tables one look each: no map is searched letter by letter, no code point goes through hexadecimal digits
    assert not any(f in plan(got) for f in ("unhex", "element_at"))
    rows = got.collect()
    assert rows[0]["j"] == "ㄱㅏㅄㅇㅣ ㅇㅓㅄㄷㅏ abc|ㅂㅏㄼㄱㅗ😀ㄱㅇㅏㄶㄷㅓㄴㅎㅣㅎㄱㅏ" and rows[1]["j"] == "" and rows[2]["j"] is None
    assert rows[0]["g"] == "갑시 없다 abc|밟고😀ㄱ않던히카" and rows[0]["e"] == [hangul.VOCABULARY.get(c, hangul.UNKNOWN) for c in text]


def test_common_runs_side_by_side(monkeypatch):
    import random

    import pandas as pd

    rnd, sizes = random.Random(4), []
    texts = [("".join(rnd.choices("ab c", k=rnd.randrange(9))), "".join(rnd.choices("ab c", k=rnd.randrange(9)))) for _ in range(300)] + [(None, "a"), ("a", None)]
    whole = a._common_together
    monkeypatch.setattr(a, "_common_together", lambda pairs: sizes.append(len(pairs)) or whole(pairs))
    got = a.align_common.func(*(pd.Series(list(t), dtype=object) for t in zip(*texts)))
    assert sizes and max(sizes) == 300

    def want(r, h):
        best = [[0] * (len(h) + 1) for _ in range(len(r) + 1)]
        for i in range(1, len(r) + 1):
            for j in range(1, len(h) + 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + (r[i - 1] == h[j - 1]))
        i, j, out = len(r), len(h), []
        while i or j:
            kind = "equal" if i and j and r[i - 1] == h[j - 1] else "insert" if j and (not i or best[i][j - 1] >= best[i - 1][j]) else "delete"
            i, j = i - (kind != "insert"), j - (kind != "delete")
            out.append({"type": kind, "ref": "" if kind == "insert" else r[i], "hyp": "" if kind == "delete" else h[j]})
        return out[::-1]

    for (r, h), found in zip(texts, got):
        assert found == (None if r is None or h is None else want("".join(r.split()), "".join(h.split())))


def test_similar_texts_make_no_row_a_pair(spark, monkeypatch):
    import random

    from jamolake.operators import joins

    rnd = random.Random(11)
    words = ["the", "er", "on", "ha", "tion", "re", "and", "of"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    lefts = [text(rnd.randrange(1, 60)) for _ in range(150)]
    rights = [text(rnd.randrange(1, 60)) for _ in range(150)] + [t[:-1] + "é" for t in lefts[:60]] + [t[2:] for t in lefts[40:90] if t[2:]]
    pairs = [(i, j, 1 - d / max(len(x), len(y))) for i, x in enumerate(lefts) for (j, y), d in zip(enumerate(rights), a.distances([(a._codes(x), a._codes(y)) for y in rights]))]
    want = {}
    for i, j, s in pairs:
        if s > 0.85:
            want[i] = max(want.get(i, (0, 1)), (s, -j))
    monkeypatch.setattr(joins, "PIECE_LETTERS", 1500)
    left = spark.createDataFrame([(0, i, t) for i, t in enumerate(lefts)], "k int, left_id long, s string")
    right = spark.createDataFrame([(0, j, t) for j, t in enumerate(rights)], "k int, o long, t string")
    got = joins.similar_match(left, right, "k", "o", 0.85)
    # a text goes to some tiles, pairs are made inside of them only
    assert "levenshtein" not in plan(got) and "FlatMapGroupsInArrow" in plan(got)
    assert {r["left_id"]: (r["score"], -r["o"]) for r in got.collect()} == want and len(want) > 60
    found = [(i, j) for x, y, _ in a.near_pairs(lefts, rights, 0.85) for i, j in zip(x.tolist(), y.tolist())]
    assert sorted(found) == [(i, j) for i, j, s in pairs if s > 0.85]


def test_letters_of_a_batch_are_changed_together(spark):
    import pyarrow as pa

    from jamolake.functions import _flat

    texts = ["값이 없다 abc|밟고😀ㄱ않던힣가", "", None, "굳이", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    got = df.select(hangul.jamo_string(F.col("t")).alias("j"), g2p.g2p(F.col("t")).alias("g"), base.stand_in(F.col("t")).alias("s"), base.drop_eleventh(F.col("t")).alias("d"))
    # no built-in function goes through the letters
    assert "ArrowEvalPython" in plan(got) and not any(f in plan(got) for f in ("lambda", "transform("))
    place = lambda c, i: c if c == " " else chr(0xAC00 + (ord(c) * 7919 + i * 31) % 11172)
    rows = {r["d"]: r for r in got.collect()}
    assert rows["굳이"]["j"] == "ㄱㅜㄷㅇㅣ" and rows["굳이"]["g"] == "구디" and rows[""]["j"] == rows[""]["g"] == "" and rows[None]["g"] is None
    for t in texts:
        if t:
            r = rows["".join(c for i, c in enumerate(t) if (i + 1) % 11)]
            assert r["s"] == "".join(place(c, i) for i, c in enumerate(t))
    # of a batch cut into pieces nothing meets across texts
    whole, few = _flat.LETTERS, hangul._jamo_string.func(pa.array(texts)).to_pylist()
    try:
        _flat.LETTERS = 3
        assert hangul._jamo_string.func(pa.array(texts)).to_pylist() == few and g2p._PLAIN.func(pa.array(["각", "이", None, "각이"])).to_pylist() == ["각", "이", None, "가기"]
    finally:
        _flat.LETTERS = whole


def test_texts_that_share_no_piece_do_not_meet(monkeypatch):
    import random

    rnd = random.Random(17)
    word = lambda: "".join(rnd.choices("abcdefgh ", k=rnd.randrange(2, 9)))
    texts = ["".join(word() for _ in range(rnd.randrange(1, 14))) for _ in range(260)]

    def changed(t):
        for _ in range(rnd.randrange(0, len(t) // 6 + 2)):
            at = rnd.randrange(len(t) + 1)
            t = t[:at] + rnd.choice(["", "x", "ab"]) + t[at + rnd.randrange(2) :]
        return t or "a"

    lefts, rights = texts[:200] + ["ab" * 30] * 3, [changed(t) for t in texts] + ["ab" * 30] * 9
    monkeypatch.setattr(a, "STEP", 0)
    monkeypatch.setattr(a, "MOST_MET", 16)
    met, alike = 0, a._met

    def counted(*args):
        nonlocal met
        found = alike(*args)
        met += 0 if found is None else len(found)
        return found

    monkeypatch.setattr(a, "_met", counted)
    for accept in (0.6, 0.85, 0.97):
        want = [(i, j, 1 - d / max(len(x), len(y))) for i, x in enumerate(lefts) for j, (y, d) in enumerate(zip(rights, a.distances([(a._codes(x), a._codes(y)) for y in rights])))]
        got = [f for x in a.near_pairs(lefts, rights, accept) for f in zip(*(v.tolist() for v in x))]
        assert sorted(got) == [f for f in want if f[2] > accept] and len(got) > 60
    # of all pairs few are compared
    assert 0 < met < 3 * len(lefts) * len(rights) / 10
