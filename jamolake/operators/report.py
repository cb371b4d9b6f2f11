"""What is shown of evaluation rows: lines, previews, reports and score changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent_score

# The names under which categories are shown.
CATEGORY_NAMES = {"tensification": "경음화", "palatalization": "구개음화", "nasalization": "비음화", "linking": "연음화"}


def preview(text: Column, n: int = 30) -> Column:
    """The first characters."""
    return F.substring(text, 1, n)


def percent(share: Column) -> Column:
    """A share in per cent with one digit."""
    return F.format_string("%.1f%%", F.bround(share * 100, 1))


def demo_line(pairs: int = 6) -> Column:
    """Of an evaluation row: edits, hits, their ratio, the categories that occur and the first pairs."""
    each = [F.when(F.col(f"counts.{c}") > 0, F.concat(F.lit(f"{name}×"), F.col(f"counts.{c}").cast("string"))) for c, name in CATEGORY_NAMES.items()]
    kinds = F.concat_ws(", ", *each)
    subs = F.array_join(F.transform(F.slice("subs", 1, pairs), lambda s: F.concat(s["exp"], F.lit("→"), s["act"])), ", ")
    return F.concat_ws(" ", F.col("edit_distance").cast("string"), F.col("rule_hits").cast("string"), percent(F.col("ratio")), F.when(kinds != "", F.concat(F.lit("["), kinds, F.lit("]"))), F.nullif(subs, F.lit("")))


def demo_text() -> Column:
    """The same as a block of lines, the two outputs above."""
    return F.concat_ws("\n", F.concat(F.lit("X: "), F.col("x")), F.concat(F.lit("Y: "), F.col("y")), demo_line())


def score_delta(spelling: Column, phonetic: Column, said: Column) -> Column:
    """struct<spelling, phonetic, delta>: scores of what was said against either reference."""
    score = lambda ref: percent_score(F.levenshtein(ref, said) / F.greatest(F.length(ref), F.lit(1)))
    return F.struct(score(spelling).alias("spelling"), score(phonetic).alias("phonetic"), F.bround(score(phonetic) - score(spelling), 1).alias("delta"))


def error_row(target: Column, score: Column, error: Column) -> Column:
    """struct<target_text, score, error>: a row that failed has its error and a score of 0."""
    return F.struct(target.alias("target_text"), F.when(error.isNull(), score).otherwise(0.0).alias("score"), error.alias("error"))


def markdown_table(rows: DataFrame, title: str, order: list[str], most: int = 50) -> DataFrame:
    """One row, report: a Markdown table of the first rows in that order. A report shows at most
    that many."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns]
    lines = rows.orderBy(*order).limit(most).select(F.struct(*order, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("_line")).alias("row"))
    head = [F.lit(f"## {title}"), F.lit(f"| {' | '.join(rows.columns)} |"), F.lit("|" + "---|" * len(rows.columns))]
    return lines.agg(F.concat_ws("\n", *head, F.transform(F.sort_array(F.collect_list("row")), lambda r: r["_line"])).alias("report"))


def console_lines(metrics: DataFrame) -> DataFrame:
    """A metrics row as (place, line): a name and a value each."""
    lines = F.array(*[F.format_string(f"{c:<28} %s", F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in metrics.columns])
    return metrics.select(F.posexplode(lines).alias("place", "line"))


def joined_report(sections: list[DataFrame]) -> DataFrame:
    """One row with the reports of all sections, in order; a handful of rows meet."""
    out = sections[0].select(F.lit(0).alias("at"), "report")
    for i, s in enumerate(sections[1:], 1):
        out = out.unionByName(s.select(F.lit(i).alias("at"), "report"))
    return out.agg(F.concat_ws("\n\n", F.transform(F.sort_array(F.collect_list(F.struct("at", "report"))), lambda r: r["report"])).alias("report"))
