import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jamolake.functions import arrays as x
from jamolake.functions import text as t
from jamolake.operators import report, segments, splits
from jamolake.plans import queries as library
from jamolake.sources import files, sinks
from jamolake.streaming import sessions

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return c


def rows(df):
    clean = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    df = df[sorted(df.columns)]
    df = df.astype(object).where(df.notna(), None)
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", list(library.ORACLES))
def test_oracle(spark, duck, name):
    got, want = library.QUERIES[name](spark, DIR).toPandas(), duck.sql(library.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_runs(spark, name):
    assert library.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns and set(library.QUERIES) <= set(entry.queries()) and set(library.ORACLES) <= set(entry.oracle_sql())


def test_text(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v")).alias("o")).first()["o"]
    assert one(t.split_transcript, " b/ 안녕 하세요. n/ 네? 아! ") == ["안녕 하세요"]
    assert one(t.parse_transcript, "b/abc. de! fghi?") == ["abc", "fghi"]
    assert one(t.keep_letters, " 가-나  a_1 ") == "가나 a1"
    assert one(t.path_stem, "/a/b/c.d.wav") == "c.d" and one(t.is_coherent, "안녕하세요") is True and one(t.is_coherent, "요") is False


def test_arrays(spark):
    df = spark.createDataFrame([([3.0, 4.0], [[0.1, 0.9], [0.2, 0.8], [0.9, 0.1], [0.3, 0.7]])], "s array<float>, f array<array<float>>")
    r = df.select(x.rms(F.col("s")).alias("rms"), x.greedy_decode(F.col("f")).alias("ctc"), x.encoder_length(F.lit(8000)).alias("n"), x.pcm16(F.array(F.lit(0.5))).alias("pcm"), x.chunk_offsets(F.lit(500_000)).alias("c")).first()
    assert abs(r["rms"] - 12.5**0.5) < 1e-6 and r["ctc"] == [1, 1] and r["n"] == 25 and r["pcm"] == [16383] and r["c"] == [0, 480000]


def test_segments(spark):
    p = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("a", 2.0), ("a", 2.2), ("b", 1.0)], "k string, t double")
    r = segments.merge_regions(p, "k", "t", 1.0)
    assert sorted((x["k"], x["start"], x["end"]) for x in r.collect()) == [("a", 0.0, 0.5), ("a", 2.0, 2.2), ("b", 1.0, 1.0)]
    d = segments.equal_division(r, "k", F.lit(2)).collect()
    assert sorted((x["k"], x["part"], round(x["end"], 2)) for x in d) == [("a", 0, 1.1), ("a", 1, 2.2)]
    gate = spark.createDataFrame([(9, 10), (8, 10), (0, 0)], "n int, m int").select(segments.count_gate(F.col("n"), F.col("m")).alias("ok")).collect()
    assert [g["ok"] for g in gate] == [True, False, True]


def test_splits(spark):
    df = spark.range(40).select((F.col("id") % 10).alias("s"))
    got = splits.speaker_split(df, "s").groupBy("split").agg(F.countDistinct("s").alias("n")).collect()
    assert {r["split"]: r["n"] for r in got} == {"train": 8, "validation": 1, "test": 1}
    assert splits.speaker_split(df.where("s = 3"), "s").select("split").distinct().collect()[0][0] == "test"
    assert splits.speaker_sample(df, "s", 0.01).select("s").distinct().count() == 1
    assert splits.seeded_sample(df, "s", 0).count() == 40


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text('{"wav_path": "a.wav", "duration": 1.5}\nnot json\n\n{"label": "가"}\n', encoding="utf-8")
    got = files.read_splits(spark, str(tmp_path))
    assert got.count() == 2 and got.where("split = 'train' AND duration = 1.5").count() == 1
    assert files.count_lines(spark, str(tmp_path / "*.jsonl")).first()[0] == 3
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/a.json").write_text(json.dumps({"File_id": "a.wav", "Transcript": "안녕", "Patient_info": {"Sex": "F"}}), encoding="utf-8")
    s = files.read_sessions(spark, str(tmp_path / "labels"))
    assert s.select("Transcript", "Patient_info.Sex", "read_error").first() == ("안녕", "F", False)
    assert ("Patient_info.Sex", "string") in files.schema_paths(s.schema)
    assert files.time_fields(spark.createDataFrame([], "a struct<start_time:double,b:array<struct<end:int>>>").schema) == [("a.start_time", "double"), ("a.b[].end", "int")]
    (tmp_path / "results.json").write_text(json.dumps({"results": [{"a": 1}, {"a": 2}]}))
    assert files.read_results(spark, str(tmp_path / "results.json"), spark.createDataFrame([], "a int").schema).count() == 2
    sinks.write_splits(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert sinks.vocabulary_table(spark).count() == 56


def test_stream_equals_batch(spark, tmp_path):
    """Row by row, over a restart. Events come in order of time; a last one, of nobody, is so late that all
    other regions close."""
    from pyspark.sql import Window as W

    events = spark.read.parquet(f"{DIR}/events.parquet").withColumn("part", F.ntile(4).over(W.orderBy("ts")))
    last = events.orderBy(F.desc("ts")).limit(1).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), "event_type", "value", "props", "part")

    def add(part):
        (last if part == 5 else events.where(F.col("part") == part)).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def start(df, mode, name):
        return df.writeStream.outputMode(mode).format("parquet" if mode == "append" else "memory").queryName(name).option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()

    for parts in ((1, 2), (3,), (4,), (5,)):
        for p in parts:
            add(p)
        stream = sessions.read_events(spark, str(tmp_path / "in"), 1)
        for q in (start(sessions.session_regions(stream), "append", "regions"), start(sessions.running_profiles(stream), "complete", "profiles")):
            q.awaitTermination(200)
            assert q.exception() is None
    profiles = lambda df: {(r.user_id, r.event_type): (r.n, round(r.mean_value, 9)) for r in df.collect() if r.user_id != -1}
    assert profiles(spark.table("profiles")) == profiles(sessions.running_profiles(events))
    regions = lambda df: sorted((r.user_id, r.start, r.end, r.n_events, round(r.value, 9)) for r in df.collect() if r.user_id != -1)
    assert regions(spark.read.parquet(str(tmp_path / "regions"))) == regions(sessions.session_regions(events.withColumn("ts", F.col("ts").cast("timestamp"))))


def test_regions_over_buckets(spark):
    import random

    rnd = random.Random(1)
    hot, t = [], 0.0
    for _ in range(3000):
        t += rnd.choice([0.0, 0.1, 0.4, 0.99, 1.0, 1.7, 40.0])
        hot.append(("hot", t - 500))
    rows = hot + [(None, 1.0), (None, 1.5), ("one", 7.0), ("one", None)]
    rnd.shuffle(rows)
    want = set()
    for key in {k for k, _ in rows}:
        runs = []
        for v in sorted(v for k, v in rows if k == key and v is not None):
            if runs and v - runs[-1][1] < 1.0:
                runs[-1] = (runs[-1][0], v, runs[-1][2] + 1)
            else:
                runs.append((v, v, 1))
        want |= {(key, i, *r) for i, r in enumerate(runs) if r[1] - r[0] >= 0.3}
    df = spark.createDataFrame(rows, "k string, t double")
    for bucket in (None, 0.5, 3.0, 1e6):
        got = segments.merge_regions(df, "k", "t", 1.0, 0.3, bucket)
        assert {(r.k, r.region, r.start, r.end, r.n_points) for r in got.collect()} == want
    assert segments.merge_regions(df.where("false"), "k", "t", 1.0).collect() == []


def test_loaders_of_samples(spark, tmp_path):
    """Bounds excluded, blank fields, files that are not there, malformed lines; and the other source
    of pairs where there are no segments."""
    folder, audio = tmp_path / "segments", tmp_path / "audio"
    folder.mkdir(), audio.mkdir()
    for name in ("a", "b", "c", "d"):
        (audio / f"{name}.wav").write_bytes(b"x")
    index = files.audio_index(spark, str(audio)).withColumn("path", F.concat(F.lit("/x/"), F.regexp_extract("path", r"([^/]+)$", 1)))
    lines = [{"wav_path": f"/x/{n}.wav", "transcript": t, "label": "l", "duration": s} for n, t, s in [("a", "t", 5.0), ("b", " ", 5.0), ("c", "t", 10.0), ("d", "t", 1.0), ("e", "t", 5.0)]]
    (folder / "test.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken", "", json.dumps({"wav_path": "", "duration": 3.0})]))
    paths = lambda df: sorted(r["wav_path"] for r in df.collect())
    assert paths(files.load_audio_samples(spark, str(folder))) == ["/x/a.wav", "/x/b.wav", "/x/e.wav"]
    assert paths(files.load_audio_samples(spark, str(folder), audio=index)) == ["/x/a.wav", "/x/b.wav"]
    assert len(paths(files.load_audio_samples(spark, str(folder), n=2))) == 2
    assert paths(files.load_test_data(spark, str(folder), audio=index)) == ["/x/a.wav", "/x/c.wav"]
    docs = tmp_path / "labels" / "deep"
    docs.mkdir(parents=True)
    for stem, text in (("a", " 먹어요 "), ("b", " "), ("z", "x")):
        (docs / f"{stem}.json").write_text(json.dumps({"File_id": f"{stem}.wav", "Transcript": text, "Patient_info": {"Sex": "F"}}, ensure_ascii=False))
    (docs / "c.json").write_text("{")
    (pair,) = files.read_pairs(spark, str(tmp_path / "none"), "train", str(tmp_path / "labels"), str(audio)).collect()
    assert (pair["transcript"], pair["label"], pair["speaker_id"], pair["sex"], pair["age"]) == ("먹어요", "머거요", "a", "F", "")
    assert paths(files.read_pairs(spark, str(folder), "test", "", "")) == [f"/x/{n}.wav" for n in "abcde"]
    assert [p.rsplit("/", 1)[1] for p in files.first_documents(spark, str(tmp_path / "labels"), 2)] == ["a.json", "b.json"]
    assert files.read_sessions(spark, files.first_documents(spark, str(tmp_path / "labels"), 2)).count() == 2


def test_written_vocabulary_and_report(spark, tmp_path):
    sinks.write_vocabulary(spark, f"{tmp_path}/v")
    text = "".join(p.read_text() for p in (tmp_path / "v").glob("part-*"))
    assert json.loads(text)["<pad>"] == 0 and len(json.loads(text)) == 56
    sections = [report.markdown_table(spark.createDataFrame([(1, "x")], "k int, v string"), t, ["k"]) for t in ("A", "B")]
    sinks.write_text(report.joined_report(sections), f"{tmp_path}/r")
    assert "".join(p.read_text() for p in (tmp_path / "r").glob("part-*")) == "## A\n| k | v |\n|---|---|\n| 1 | x |\n\n## B\n| k | v |\n|---|---|\n| 1 | x |\n"
    sinks.write_signals(spark.createDataFrame([("a", [0.5]), ("b", None)], "stem string, signal array<float>"), f"{tmp_path}/s")
    assert files.read_signals(spark, f"{tmp_path}/s").count() == 1 and files.read_signals(spark, f"{tmp_path}/none").count() == 0


def test_batches_lose_a_common_start(spark):
    df = spark.createDataFrame([(1, 1, [7, 1]), (2, 1, [7, 1, 2]), (3, 2, [7]), (4, 2, [1, 7]), (5, 3, [])], "k int, b int, l array<int>")
    got = {r["k"]: r["l"] for r in x.pad_batches(df, "l", "b", start=7).collect()}
    assert got == {1: [1, -100], 2: [1, 2], 3: [7, -100], 4: [1, 7], 5: []}


def test_places(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") % 9 != 0, F.concat(F.lit("p/"), F.md5(F.col("id").cast("string")))))
    got = splits.placed_rows(df, "s", "id", ranges=16, sample=100).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 1001)) and [r["id"] for r in got] == [r["id"] for r in df.orderBy("s", "id").collect()]
    assert splits.positional_split(df.where("false"), "s", "id").count() == 0


def test_keywords_keep_their_spelling():
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("items", "section", "startTime", "ENDTIME", "Utterance", "x_offset")])
    assert [p for p, _ in files.time_fields(schema)] == ["startTime", "x_offset"]


def test_order_statistics(spark):
    import random

    import numpy as np

    from jamolake.operators import selection

    rnd = random.Random(7)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(500)] + [("b", float(rnd.randint(0, 3))) for _ in range(400)] + [("c", 5.0), (None, 1.0), (None, 2.0), ("d", None)] + [("e", rnd.choice([1e300, -1e-300, 0.0])) for _ in range(50)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    for ranges in (2, 64):
        got = {r.k: r for r in selection.order_statistics(df, "v", qs, "k", ranges=ranges).collect()}
        assert set(got) == {"a", "b", "c", None, "e"}
        for k, r in got.items():
            v = [x for j, x in rows if j == k]
            assert r.n == len(v) and np.allclose([r[f"q{i}"] for i in range(5)], np.quantile(v, qs), rtol=1e-12)
    every = [x for _, x in rows if x is not None]
    assert np.allclose(list(selection.order_statistics(df, "v", qs).first())[1:], np.quantile(every, qs), rtol=1e-12)
    assert selection.order_statistics(df.where("false"), "v", qs).collect() == []
    assert {(r.k, r.m) for r in selection.with_medians(df.groupBy("k").count(), df, "v", "m", "k").where("k IN ('c', 'd') OR k IS NULL").collect()} == {("c", 5.0), ("d", None), (None, 1.5)}


def test_similar_match(spark):
    import random

    from jamolake.operators.joins import similar_match

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(5)

    def changed(s, n):
        for _ in range(n):
            at = rng.randrange(len(s) + 1)
            s = s[:at] + rng.choice(["", "x", "aa", "b"]) + s[at + rng.randrange(2) :]
        return s

    base = ["".join(rng.choice("ab c") for _ in range(rng.choice([1, 2, 3, 5, 9, 30]))) for _ in range(25)]
    left = [(i % 2, i, s) for i, s in enumerate(base + base[:5])] + [(None, 90, "ab"), (0, 91, None), (0, 92, "")]
    right = [(i % 2, i, changed(s, rng.randrange(4))) for i, s in enumerate(base * 2)] + [(0, 90, None), (0, 91, ""), (None, 92, "ab"), (0, 93, base[0]), (0, 94, base[0])]
    for accept in (0.2, 0.5, 0.75, 0.8, 0.85):
        want = []
        for k, i, s in left:
            found = [(1 - distance(s, t) / max(len(s), len(t)), -o) for k2, o, t in right if k is not None and k == k2 and s and t]
            found = [f for f in found if f[0] > accept]
            if found:
                score, o = max(found)
                want.append((k, i, -o, score))
        got = similar_match(spark.createDataFrame(left, "k int, left_id int, s string"), spark.createDataFrame(right, "k int, o int, t string"), "k", "o", accept)
        assert sorted(map(tuple, got.select("k", "left_id", "o", "score").collect())) == sorted(want)
    none = similar_match(spark.createDataFrame([], "k int, left_id int, s string"), spark.createDataFrame(right, "k int, o int, t string"), "k", "o")
    assert none.count() == 0
