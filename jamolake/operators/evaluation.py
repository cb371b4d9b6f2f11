"""One evaluation in one folder: its rows, the document of its metrics, speaker profiles and the report.

Rows are written first and everything else is made from what was written, so that alignments are found
once. Nothing but metrics is gathered: rows and profiles stay JSON lines of many tasks, and the report is
lines in order, however many speakers it has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics as m
from .report import CATEGORY_NAMES, demo_line, percent

SUBSETS = ["full", "coherent"]


def metrics_document(rows: DataFrame) -> DataFrame:
    """One row (metrics_full, metrics_coherent, consistency), each a struct of M1 to M4 or M5; null for a subset
    without rows."""
    s = m.subset_report(rows)
    of = lambda k: F.max(F.when(F.col("subset") == k, F.struct(*[c for c in s.columns if c != "subset"])))
    per_speaker = m.consistency_report(m.consistency(rows))
    # one row each
    return s.agg(*[of(k).alias(f"metrics_{k}") for k in SUBSETS]).join(F.broadcast(per_speaker.select(F.struct("*").alias("consistency"))))


def _fixed(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(F.coalesce(value, F.lit(0.0)), digits))


def _cells(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _table(*names: str) -> list[Column]:
    return [F.lit(f"| {' | '.join(names)} |"), F.lit("|" + "---|" * len(names))]


def _of_both(field: str, shown) -> list[Column]:
    return [shown(F.coalesce(F.col(f"metrics_{s}.{field}"), F.lit(0))) for s in SUBSETS]


def _whole(value: Column) -> Column:
    return value.cast("long").cast("string")


def _lines(rows: DataFrame, section: int, lines: list[Column], *order: Column) -> DataFrame:
    """The lines of each row, given in arrays; rows are ordered by two numbers."""
    keys = [k.cast("long") for k in (*order, F.lit(0), F.lit(0))[:2]]
    return rows.select(F.lit(section).alias("section"), keys[0].alias("first"), keys[1].alias("second"), F.posexplode(F.concat(*lines)).alias("place", "line"))


def report_lines(rows: DataFrame, document: DataFrame, profiles: DataFrame, demos: int = 5) -> DataFrame:
    """(section, first, second, place, line), the order of a Markdown report and its lines: what was evaluated,
    M1 to M3 and M4 of all and of coherent rows, M5, a profile a speaker, the coherent row with most
    hits of each category, and the first `demos` of those that show most."""
    names = {**CATEGORY_NAMES, "other": "-"}
    share = F.coalesce(F.col("metrics_coherent.share_of_all"), F.lit(0.0))
    head = [F.lit("# Evaluation"), F.concat(F.lit("- utterances: "), _of_both("n_samples", _whole)[0]), F.concat(F.lit("- coherent: "), _of_both("n_samples", _whole)[1], F.lit(" ("), percent(share), F.lit(")"))]
    measures = {"utterances": ("n_samples", _whole), "M1 raw outputs": ("m1_rate", percent), "M2 edits": ("m2_mean", _fixed), "M3 rule hits": ("m3_hits_mean", _fixed), "M3 with a hit": ("m3_hit_rate", percent), "M3 ratio": ("m3_ratio_mean", percent)}
    kinds = [_cells(F.lit(n), *[x for pair in zip(_of_both(f"total_{c}", _whole), _of_both(f"prevalence_{c}", percent) if c in CATEGORY_NAMES else [F.lit("-")] * 2) for x in pair]) for c, n in names.items()]
    m5 = {"speakers": _whole(F.col("consistency.n_speakers")), "mean": percent(F.coalesce("consistency.mean", F.lit(0.0))), "median": percent(F.coalesce("consistency.median", F.lit(0.0))), "half and more": _whole(F.col("consistency.n_half"))}
    parts = [
        _lines(document, 0, [F.array(*head)]),
        _lines(document, 1, [F.array(F.lit("## M1 to M3"), *_table("measure", "all", "coherent"), *[_cells(F.lit(n), *_of_both(*f)) for n, f in measures.items()])]),
        _lines(document, 2, [F.array(F.lit("## M4"), *_table("category", "hits", "utterances", "coherent hits", "coherent utterances"), *kinds)]),
        _lines(document, 3, [F.array(F.lit("## M5"), *_table("of speakers", "value"), *[_cells(F.lit(n), v) for n, v in m5.items()])]),
    ]
    n = F.col("n_utterances")
    of_n = lambda part: F.concat(_whole(part), F.lit("/"), _whole(n))
    each = [_cells(F.lit(k), of_n(F.col(f"utts_{c}")), percent(F.col(f"utts_{c}") / n), _whole(F.col(f"total_{c}"))) for c, k in CATEGORY_NAMES.items()]
    title = [F.concat(F.lit("### "), F.col("speaker_id"), F.lit(" ("), _whole(n), F.lit(")")), F.concat(F.lit("- weakest: "), F.col("weakness"))]
    shown = F.transform(F.coalesce("patterns", F.array()), lambda s, i: _cells(_whole(i + 1), F.concat(s["exp"], F.lit("→"), s["act"]), of_n(s["n_utts"]), percent(s["n_utts"] / n), _whole(s["n"])))
    parts.append(_lines(profiles, 4, [F.array(*title, *_table("category", "utterances", "share", "hits"), *each, *_table("rank", "pair", "utterances", "share", "times")), shown], -n, F.col("first_utt")))
    coherent = rows.where("coherent")
    best = m.best_per_category(coherent).select("utt", "category").join(coherent, "utt")  # a row a category
    demo = [F.concat(F.lit("- X: "), F.coalesce("x", F.lit(""))), F.concat(F.lit("- Y: "), F.coalesce("y", F.lit(""))), F.concat(F.lit("- "), demo_line())]
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_NAMES]), F.col("category"))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_NAMES.items() for x in kv]), F.col("category"))
    parts.append(_lines(best, 5, [F.array(F.concat(F.lit("### "), named), *demo)], place))
    parts.append(_lines(m.high_disclosure(rows, demos), 6, [F.array(F.concat(F.lit("### "), F.col("utt").cast("string")), *demo)], F.when(F.col("is_raw"), 0).otherwise(2**31) - F.col("edit_distance"), F.col("utt")))
    return reduce(DataFrame.unionByName, parts)


def write_evaluation(rows: DataFrame, folder: str, demos: int = 5) -> None:
    """Evaluation rows (see metrics.evaluate) as results/, then from these metrics/ (one JSON object), profiles/
    (a JSON line a speaker) and report/ (text whose part files are in order)."""
    spark = rows.sparkSession
    kept = rows.drop("steps")
    kept.write.option("ignoreNullFields", False).json(f"{folder}/results")
    stored = spark.read.schema(kept.schema).json(f"{folder}/results")
    metrics_document(stored).write.json(f"{folder}/metrics")
    m.profiles(stored).write.json(f"{folder}/profiles")
    document, profiles = read_evaluation(spark, folder, "metrics"), read_evaluation(spark, folder, "profiles")
    report_lines(stored, document, profiles, demos).orderBy("section", "first", "second", "place").select("line").write.text(f"{folder}/report")


_COUNTS = ", ".join(f"total_{c}: bigint" for c in m.CATEGORIES) + ", " + ", ".join(f"utts_{c}: bigint" for c in m.CATEGORIES)
_NUMBERS = "n_samples: bigint, m1_rate: double, m2_mean: double, m2_median: double, m2_p25: double, m2_p75: double, m3_hits_mean: double, m3_hits_median: double, m3_with_hit: bigint, m3_hit_rate: double, m3_ratio_mean: double, m3_ratio_median: double, " + ", ".join(f"total_{c}: bigint" for c in [*m.CATEGORIES, "other"]) + ", " + ", ".join(f"prevalence_{c}: double" for c in m.CATEGORIES) + ", share_of_all: double"
SCHEMAS = {
    "metrics": f"metrics_full struct<{_NUMBERS}>, metrics_coherent struct<{_NUMBERS}>, consistency struct<n_speakers: bigint, mean: double, n_half: bigint, median: double>",
    "profiles": "speaker_id string, n_utterances bigint, first_utt bigint, " + _COUNTS.replace(":", "") + ", patterns array<struct<rank: int, exp: string, act: string, n: bigint, n_utts: bigint>>, " + ", ".join(f"rate_{c} double" for c in m.CATEGORIES) + ", weakness string",
}


def read_evaluation(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """metrics or profiles of an evaluation that was written."""
    return spark.read.schema(SCHEMAS[part]).json(f"{folder}/{part}")
