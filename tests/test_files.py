"""WAV files as a data source, providers in workers, counters of a job, and signals against plain numpy."""

import io
import math
import struct
import wave

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from jamolake.functions import signals
from jamolake.operators import providers, segments
from jamolake.plans import files as plans
from jamolake.sources import files, riff, sinks, wav

SF = "/root/testdata/sf0.001"


def wav_file(data, kind=1, channels=1, rate=16000, bits=16, extra=b"", extensible=False):
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if extensible:
        form += struct.pack("<HHIH14s", 22, bits, 0, kind, b"\0" * 14)
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + extra + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data


def test_headers_and_samples():
    x = np.array([0.0, 0.5, -0.5, 0.25, -1.0, 0.75])
    kinds = [(1, 8, (x * 128 + 128).astype(np.uint8).tobytes()), (1, 16, (x * 2**15).astype("<i2").tobytes()), (1, 24, b"".join(struct.pack("<i", int(v * 2**23))[:3] for v in x)), (1, 32, (x * 2**31).astype("<i4").tobytes()), (3, 32, x.astype("<f4").tobytes()), (3, 64, x.astype("<f8").tobytes())]
    for kind, bits, data in kinds:
        for extra in (b"", b"LIST" + struct.pack("<I", 3) + b"abc\0"):
            raw = wav_file(data, kind, 1, 8000, bits, extra, extensible=bool(extra))
            h = riff.read_header(io.BytesIO(raw), len(raw))
            assert (h.rate, h.channels, h.bits, h.n_samples, h.duration) == (8000, 1, bits, 6, 6 / 8000)
            assert np.allclose(riff.samples(h, raw[h.start : h.start + h.n_bytes]), x, atol=1e-6)
    stereo = wav_file((np.array([[0.5, 0.0], [0.25, 0.75]]) * 2**15).astype("<i2").tobytes(), channels=2)
    h = riff.read_header(io.BytesIO(stereo), len(stereo))
    assert h.n_samples == 2 and riff.samples(h, stereo[h.start :]).tolist() == [0.25, 0.5]
    cut = wav_file(b"\0" * 100)[:-41]
    assert riff.read_header(io.BytesIO(cut), len(cut)).n_samples == 29
    for bad in (b"", b"RIFF", b"nothing at all, really", wav_file(b"", bits=12), wav_file(b"", channels=0), wav_file(b"", rate=0), wav_file(b"\0\0")[:40]):
        with pytest.raises(riff.NotWav):
            riff.read_header(io.BytesIO(bad), len(bad))
    with wave.open(io.BytesIO(riff.encode(np.array([2.0, np.nan, -0.5, 0.5]), 16000))) as w:
        assert np.frombuffer(w.readframes(9), "<i2").tolist() == [32767, 0, -16384, 16384]


@pytest.fixture
def folder(spark, tmp_path):
    wav.register(spark)
    for i, seconds in enumerate((0.5, 1.0, 2.0)):
        (tmp_path / "in" / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "deep" / f"r{i}.wav").write_bytes(riff.encode(np.full(int(8000 * seconds), 0.25), 8000))
    (tmp_path / "in" / "broken.wav").write_bytes(b"nothing")
    (tmp_path / "in" / "other.txt").write_bytes(b"x")
    return f"file://{tmp_path}/in"


def test_wav_reader(spark, folder):
    got = {r.stem: r for r in spark.read.format("wav").load(folder).collect()}
    assert set(got) == {"r0", "r1", "r2", "broken"} and got["broken"].signal is None and "NotWav" in got["broken"].error
    assert (got["r2"].rate, got["r2"].n_samples, got["r2"].duration, len(got["r2"].signal)) == (8000, 16000, 2.0, 16000)
    headers = spark.read.format("wav").schema("stem string, duration double")
    assert {r.stem for r in headers.load(folder).where("duration >= 1 AND duration < 2").collect()} == {"r1"}
    assert {r.stem for r in headers.option("minDuration", 0.6).load(folder).collect()} == {"r1", "r2"}
    resampled = {r.stem: r.signal for r in files.read_audio(spark, folder, 1.0, 1.0).collect()}
    assert set(resampled) == {"r1"} and len(resampled["r1"]) == 16000 and abs(resampled["r1"][8000] - 0.25) < 1e-3
    assert files.audio_durations(spark, folder).where("error IS NULL").count() == 3
    assert spark.read.format("wav").load(folder + "/nowhere").count() == 0
    with pytest.raises(PySparkException):
        spark.read.format("wav").schema("loudness double").load(folder).collect()


def test_headers_read_no_samples(folder, monkeypatch):
    monkeypatch.setattr(riff, "samples", lambda *a: pytest.fail("samples were read"))
    r = wav.WavReader(wav.T.StructType([wav.COLUMNS["stem"], wav.COLUMNS["duration"]]), {"path": folder, "partitionBytes": "1"})
    parts = r.partitions()
    assert len(parts) == 4 and sum(b.num_rows for p in parts for b in r.read(p)) == 4


def test_filters_in_the_reader():
    r = wav.WavReader(wav.COLUMNS, {"path": "x"})
    rest = list(r.pushFilters([wav.GreaterThan(("duration",), 1), wav.GreaterThan(("duration",), 2.5), wav.LessThanOrEqual(("duration",), 9), wav.LessThan(("rate",), 9)]))
    assert len(rest) == 1 and (r.strict_low, r.high) == (2.5, 9.0) and [r._fits(d) for d in (2.5, 2.6, 9.0, 9.1)] == [False, True, True, False]


def test_writer_commits(spark, tmp_path):
    out = f"file://{tmp_path}/wav"
    rows = spark.createDataFrame([("s", i, i * 0.1, i * 0.1 + 0.1, [0.5] * 8000) for i in range(4)], "stem string, index int, start double, end double, signal array<float>")
    assert {r.stem for r in sinks.write_segments(rows.where("index < 2"), out).collect()} == {"s_seg0000", "s_seg0001"}
    (tmp_path / "wav" / "s_seg0000.wav").write_bytes(b"kept")
    found = sinks.write_segments(rows, out)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "wav").iterdir()}
    assert found.count() == 4 and found.count() == 4  # a second action writes nothing
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "wav").iterdir()} == before and len(before) == 4
    assert (tmp_path / "wav" / "s_seg0000.wav").read_bytes() == b"kept"
    with wave.open(str(tmp_path / "wav" / "s_seg0003.wav")) as w:
        assert w.getnframes() == 1600 and w.getframerate() == 16000
    named = spark.createDataFrame([("a.wav", [0.5]), ("b.wav", None), ("a.wav", [0.5])], "name string, signal array<double>").repartition(2)
    named.write.format("wav").mode("overwrite").save(out)
    assert [p.name for p in (tmp_path / "wav").iterdir()] == ["a.wav"]


def test_failed_job_leaves_nothing(spark, tmp_path):
    wav.register(spark)
    rows = spark.range(20, numPartitions=4).select(F.format_string("n%d.wav", "id").alias("name"), F.array(F.when(F.col("id") < 15, 0.5).otherwise(F.raise_error(F.lit("task fails")).cast("double"))).alias("signal"))
    with pytest.raises(PySparkException):
        rows.write.format("wav").mode("append").save(f"file://{tmp_path}/wav")
    assert not (tmp_path / "wav").exists() or list((tmp_path / "wav").iterdir()) == []


def test_splits_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", 1.5), ("test", "b", None), ("test", None, 2.0)], "split string, wav_path string, duration double")
    sinks.write_splits(rows, str(tmp_path / "s"))
    (tmp_path / "s" / "split=test" / "more.json").write_text("no record\n\n")
    got = {(r.split, r.wav_path, r.duration) for r in files.read_splits(spark, str(tmp_path / "s")).collect()}
    assert got == {("train", "a", 1.5), ("test", "b", None), ("test", None, 2.0)}


# --- providers ----------------------------------------------------------------------------------

def test_provider_is_opened_once(spark, tmp_path):
    log = str(tmp_path / "opened")

    def first():
        with open(log, "a") as f:
            f.write("x")

        def run(texts):
            if sum(map(len, texts)) > 50 and len(texts) > 1:
                raise MemoryError("batch of too many bytes")
            if "bad" in texts:
                raise KeyError("bad")
            return [None if x == "nothing" else x[::-1] for x in texts]

        return run

    rows = spark.createDataFrame([(i, "bad" if i % 7 == 0 else "nothing" if i % 7 == 1 else None if i % 7 == 2 else f"text{i}", "old") for i in range(70)], "id int, t string, error string").coalesce(1)
    got = {r.id: r for r in providers.provide(rows, "t", first, batch_bytes=40).collect()}
    assert len(got) == 70 and len(open(log).read()) == 1
    for i, r in got.items():
        want = (None, None, "KeyError: 'bad'") if i % 7 == 0 else (None, 1, None) if i % 7 == 1 else (None, None, None) if i % 7 == 2 else (f"text{i}"[::-1], 1, None)
        assert (r.label, r.provider, r.error) == want and r.t == (None if i % 7 == 2 else r.t)


def test_provider_that_does_not_open(spark):
    def broken():
        raise ImportError("no such engine")

    rows = spark.createDataFrame([("a",), (None,)], "t string")
    assert {(r.t, r.label, r.provider, r.error) for r in providers.provide(rows, "t", broken, lambda: lambda ts: [t * 2 for t in ts]).collect()} == {("a", "aa", 2, None), (None, None, None, None)}
    assert {(r.label, r.error) for r in providers.provide(rows, "t", broken).collect()} == {(None, "ImportError: no such engine"), (None, None)}
    assert {r.error for r in providers.provide(rows, "t", lambda: lambda ts: []).collect()} == {"ValueError: 0 results of 1 texts", None}
    assert providers.provide(rows.where("false"), "t", broken).collect() == []


# --- counters -----------------------------------------------------------------------------------

def test_counters_of_the_job(spark, tmp_path):
    s = plans.segmented(spark, SF).withColumns({"load_error": F.col("session") % 19 == 0, "vad_error": F.col("session") % 23 == 0}).drop("sentences", "n_regions", "n_sentences", "reason", "pairs")
    d = segments.segment_sessions(s)
    rows, watch = segments.observed(d)
    out = segments.session_segments(rows, "session")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    out.write.parquet(str(tmp_path / "o"))
    got = {r.reason: r.n for r in segments.counters(spark, watch).collect()}
    want = {r.reason: r.n for r in d.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert {k: n for k, n in got.items() if n and k not in ("total", "segments", "bad_duration")} == want and got["total"] == d.count()
    assert got["load_error"] > 0 and got["vad_error"] > 0 and got["segments"] == spark.read.parquet(str(tmp_path / "o")).count()


# --- signals ------------------------------------------------------------------------------------

def tone(hz, rate, seconds=1.0):
    return np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


def test_tones_do_not_fold():
    inside, outside = (signals.resample_one(tone(f, 48_000), 48_000, 16_000)[200:-200] for f in (3_000, 10_000))
    assert len(signals.resample_one(tone(10, 48_000), 48_000, 16_000)) == 16_000
    assert np.abs(inside - tone(3_000, 16_000)[200:-200]).max() < 1e-3
    assert 20 * math.log10(np.sqrt((outside**2).mean()) / math.sqrt(0.5)) < -60
    up = signals.resample_one(tone(440, 11_025), 11_025, 16_000)
    assert len(up) == 16_000 and np.abs(up[200:-200] - tone(440, 16_000)[200:-200]).max() < 1e-3


@pytest.mark.parametrize("up, down", [(1, 3), (3, 1), (8, 5), (160, 441), (2, 3)])
def test_resampling_is_a_convolution(up, down, monkeypatch):
    x = np.random.default_rng(up).standard_normal(97)
    monkeypatch.setattr(signals, "CELLS", 100)
    m = max(up, down)
    half = 4 * m
    h = np.sinc(np.arange(-half, half + 1) / m) * np.i0(5 * np.sqrt(1 - (np.arange(-half, half + 1) / half) ** 2))
    h *= up / h.sum()
    want = [sum(x[n] * h[q * down - n * up + half] for n in range(97) if 0 <= q * down - n * up + half <= 2 * half) for q in range(-(-97 * up // down))]
    assert np.allclose(signals.resample_one(x, down, up, 4, 5.0), want, atol=1e-12)


def test_mel_features(spark):
    x = tone(440, 16_000, 0.1) + 0.1 * np.random.default_rng(0).standard_normal(1600)
    padded, window = np.pad(x, 200, mode="reflect"), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(400), np.arange(201)) / 400)
    power = np.array([np.abs((padded[f * 160 : f * 160 + 400] * window) @ turn) ** 2 for f in range(10)])
    want = np.log10(np.maximum(signals.mel_bank(16_000, 400, 80) @ power.T, 1e-10))
    want = (np.maximum(want, want.max() - 8) + 4) / 4
    assert np.allclose(signals.log_mel_many(x[None])[0], want, atol=1e-9)
    assert np.allclose(signals.mel_bank(16_000, 400, 80) @ np.ones(201) * 40, 1, atol=0.5)  # triangles of one area
    df = spark.createDataFrame([(1, x.tolist()), (2, None), (3, []), (4, [0.5] * 20_000)], "id int, s array<double>")
    got = {r.id: r.m for r in df.select("id", signals.log_mel(F.col("s"), 1.0).alias("m")).collect()}
    assert got[2] is None and all(len(got[i]) == 80 and len(got[i][0]) == 100 for i in (1, 3, 4))
    free = {r.id: r.m for r in df.select("id", signals.log_mel(F.col("s"), None, double=True).alias("m")).collect()}
    assert np.allclose(free[1], want, atol=1e-9) and free[3] == [[]] * 80 and len(free[4][0]) == 125


def test_signal_edges(spark):
    df = spark.createDataFrame([(1, None, 16_000), (2, [], 8_000), (3, [1.0, None, 1.0], None), (4, [1.0, None, 1.0], 16_000), (5, [1.0], -5)], "id int, s array<float>, r int")
    got = {r.id: (r.a, r.b, r.c) for r in df.select("id", signals.resample(F.col("s"), F.col("r")).alias("a"), signals.trim_silence(F.col("s")).alias("b"), signals.unit_variance(F.col("s")).alias("c")).collect()}
    assert got[1] == (None, None, None) and got[2] == ([], [], []) and got[3][0] is None and got[4][0] == [1.0, 0.0, 1.0] and got[5][0] is None and got[5][1] == [1.0]


def test_silent_ends(spark):
    x = np.concatenate([np.zeros(9_000), 0.5 * tone(300, 16_000), np.zeros(7_777)])
    got = spark.createDataFrame([(x.tolist(),)], "s array<double>").select(signals.trim_silence(F.col("s")).alias("t")).first().t
    frames = [math.fsum(v * v for v in x[max(0, c - 1024) : c + 1024]) for c in range(0, len(x) + 1, 512)]
    loud = [i for i, p in enumerate(frames) if p > max(frames) * 10**-2.5]
    assert len(got) == min(len(x), (loud[-1] + 1) * 512) - loud[0] * 512
    short = spark.createDataFrame([([0.0] * 5000 + [1.0] * 3 + [0.0] * 5000,)], "s array<float>")
    assert len(short.select(signals.trim_silence(F.col("s"), least=6000).alias("t")).first().t) == 10_003
    assert signals.loud_span(np.zeros(100), 25, 8, 4) == (0, 0)
