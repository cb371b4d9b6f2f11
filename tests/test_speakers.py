"""Speaker profiles: a stream, stopped and started again, against a batch and against plain Python."""

import random
from datetime import datetime, timedelta

from jamolake.streaming import speakers

SCHEMA = "speaker_id long, ts timestamp, is_raw boolean, edits int, rule_hits int"


def made():
    rnd = random.Random(2)
    rows = []
    for s in range(6):
        t = datetime(2024, 1, 1)
        for _ in range(40):
            t += timedelta(hours=rnd.choice([0, 1, 5, 24, 47, 48, 49, 200]), microseconds=rnd.choice([0, 1, 999]))
            rows.append((s, t, rnd.choice([True, False, None]), rnd.choice([1, 2, None]), rnd.randint(0, 3)))
    rows += [rows[0], rows[0], (None, datetime(2024, 1, 2), True, 1, 1), (3, None, True, 1, 1)]
    return sorted(rows, key=lambda r: r[1] or datetime(2024, 1, 3))


def plain(rows):
    out = set()
    for s in {r[0] for r in rows if r[0] is not None}:
        now = None
        for r in sorted((r for r in rows if r[0] == s and r[1]), key=lambda r: r[1]):
            if now and r[1] - now[-1] > timedelta(days=2):
                out.add((s, *now))
                now = None
            now = (*(a + b for a, b in zip(now[:4] if now else (0,) * 4, (1, int(r[2] or 0), r[3] or 0, r[4]))), now[4] if now else r[1], r[1])
        out.add((s, *now))
    return out


def found(df):
    return {tuple(r) for r in df.collect() if r.speaker_id != -1}


def test_batch(spark):
    rows = made()
    got = found(speakers.speaker_profiles(spark.createDataFrame(rows, SCHEMA), "2 days"))
    assert got == plain(rows)
    assert speakers.speaker_profiles(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stream_over_restarts(spark, tmp_path):
    rows = made()
    cuts = [0, 70, 150, len(rows)]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])] + [[(-1, datetime(2030, 1, 1), None, None, 0)], [(-1, datetime(2031, 1, 1), None, None, 0)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = speakers.speaker_profiles(stream, "2 days").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.speaker_id != -1]
    assert len(got) == len(set(got)) and set(got) == plain(rows)
