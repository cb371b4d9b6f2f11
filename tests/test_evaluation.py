from pathlib import Path

from pyspark.sql import functions as F

from jamolake.operators import evaluation as e
from jamolake.operators import metrics as m


def _rows(spark, pairs):
    df = spark.createDataFrame([(i, s, x, y) for i, (s, x, y) in enumerate(pairs)], "utt long, speaker_id string, x string, y string")
    return m.evaluate(df)


def _report(folder):
    return [line for part in sorted(Path(folder, "report").glob("part-*")) for line in part.read_text(encoding="utf-8").splitlines()]


def test_written_evaluation(spark, tmp_path):
    """Three speakers, one with too few utterances; the report's files are in order when put together."""
    said = ("닥꼬기를 먹었어요", "박고기를 먹었어요")
    rows = _rows(spark, [("a", *said)] * 3 + [("b", *said[::-1])] * 4 + [("c", "가", "나"), (None, None, "x"), ("", "x", None)])
    e.write_evaluation(rows, str(tmp_path / "e"))
    lines = _report(tmp_path / "e")
    heads = [s for s in lines if s.startswith("#")]
    assert heads[:6] == ["# Evaluation", "## M1 to M3", "## M4", "## M5", "### b (4)", "### a (3)"] and lines[1] == "- utterances: 10"
    b = lines[lines.index("### b (4)") :]
    assert b[1] == "- weakest: tensification" and "| 2 | ㄱ→ㄲ | 4/4 | 100.0% | 4 |" in b[: b.index("### a (3)")]
    # most edits first, raw ones before, then the order of appearance
    shown = [s for s in heads[6:] if s[4:].isdigit()]
    assert shown == ["### 0", "### 1", "### 2", "### 3", "### 4"]
    profiles = e.read_evaluation(spark, str(tmp_path / "e"), "profiles").orderBy("speaker_id").collect()
    assert [(p["speaker_id"], p["n_utterances"]) for p in profiles] == [("a", 3), ("b", 4)]
    want = m.corpus_metrics(rows).first().asDict()
    got = e.read_evaluation(spark, str(tmp_path / "e"), "metrics").first()
    assert {k: got["metrics_full"][k] for k in want} == want and got["consistency"]["n_speakers"] == 2
    assert spark.read.json(str(tmp_path / "e/results")).where(F.col("x").isNull()).count() == 1


def test_evaluation_of_an_empty_table(spark, tmp_path):
    e.write_evaluation(_rows(spark, [("a", "가", "나")]).limit(0), str(tmp_path / "e"))
    lines = _report(tmp_path / "e")
    assert lines[1:3] == ["- utterances: 0", "- coherent: 0 (0.0%)"] and "| M2 edits | 0.00 | 0.00 |" in lines
    assert e.read_evaluation(spark, str(tmp_path / "e"), "profiles").count() == 0
