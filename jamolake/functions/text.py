"""Cleaning and cutting transcripts; grades and other small projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Usual sentence endings and particles.
COHERENT_ENDINGS = "다요까죠네서에을를고"


def strip(text: Column) -> Column:
    """Without white space (not only spaces) at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def keep_letters(text: Column) -> Column:
    """Hangul, Latin letters, digits and single spaces."""
    return collapse_spaces(F.regexp_replace(text, r"[^가-힣a-zA-Z0-9\s]", ""))


def _pieces(text: Column, ends: str, least: int) -> Column:
    return F.filter(F.transform(F.split(text, ends), strip), lambda s: F.length(s) >= least)


def split_transcript(text: Column) -> Column:
    """Sentences of two characters or more, without breath and noise marks (a letter and a slash)."""
    for mark in (r"\s*b/\s*", r"\s*[a-z]/\s*"):
        text = F.regexp_replace(text, mark, " ")
    return _pieces(strip(text), r"[.?!。]\s*", 2)


def parse_transcript(text: Column) -> Column:
    """The stricter cut: three characters or more, breath marks only."""
    return _pieces(collapse_spaces(F.regexp_replace(text, "b/", "")), r"[.!?]", 3)


def is_coherent(text: Column) -> Column:
    """Five characters or more, seven in ten of them Hangul, and one of the usual endings anywhere."""
    hangul = F.length(F.regexp_replace(text, "[^가-힣]", ""))
    return (F.length(text) >= 5) & (hangul / F.greatest(F.length(text), F.lit(1)) >= 0.7) & text.rlike(f"[{COHERENT_ENDINGS}]")


def path_stem(path: Column) -> Column:
    """The file name without folders and its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def first_filled(*candidates: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def percent_score(cer: Column) -> Column:
    return F.greatest(F.lit(0.0), F.bround((1 - cer) * 100, 1))


def grade(score: Column) -> Column:
    """Five levels."""
    return F.when(score >= 95, "perfect").when(score >= 85, "great").when(score >= 70, "good").when(score >= 50, "practise").otherwise("together")


def grade_of_four(score: Column) -> Column:
    """Four levels, of the page where single recordings are tried."""
    return F.when(score >= 90, "great").when(score >= 75, "good").when(score >= 50, "practise").otherwise("together")


def colour(score: Column) -> Column:
    """Three levels."""
    return F.when(score >= 80, "green").when(score >= 50, "yellow").otherwise("red")


def bar(score: Column, cells: int = 20) -> Column:
    n = F.floor(score / (100 / cells)).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), cells - n))


def match_rate(a: Column, b: Column) -> Column:
    """Characters that agree, place by place, over the longer length; 0 for two empty texts."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & (x != ""))
    return F.coalesce(F.size(F.filter(same, lambda x: F.coalesce(x, F.lit(False)))) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0)), F.lit(0.0))


def nearly_matches(a: Column, b: Column) -> Column:
    """More than half agree, of texts of more than three characters."""
    return (match_rate(a, b) > 0.5) & (F.length(a) > 3) & (F.length(b) > 3)


def or_empty(value: Column) -> Column:
    """A text, '' for null: fields of a missing struct too."""
    return F.coalesce(value.cast("string"), F.lit(""))


def in_folder(path: Column, folders: dict[str, str]) -> Column:
    """A path with some of its parts replaced, in that order."""
    for old, new in folders.items():
        path = F.replace(path, F.lit(old), F.lit(new))
    return path


def label_of(transcript: Column, label: Column, again: Column, provider) -> Column:
    """The stored label, or where asked the transcript's pronunciation by that provider (a function
    of a column); null if what it is taken from is blank."""
    said, kept = strip(provider(strip(transcript))), strip(label)
    return F.when(again & ~is_blank(transcript), said).when(~again & ~is_blank(label), kept)
