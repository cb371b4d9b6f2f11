"""Row filters of utterance records. Null durations count as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip


def duration_within(duration: Column, low: float = 0.5, high: float = 25.0) -> Column:
    return F.coalesce(duration, F.lit(0.0)).between(low, high)


def duration_between(duration: Column, low: float = 1.0, high: float = 10.0) -> Column:
    """Both ends excluded."""
    d = F.coalesce(duration, F.lit(0.0))
    return (d > low) & (d < high)


def duration_reason(duration: Column, low: float = 0.5, high: float = 25.0) -> Column:
    d = F.coalesce(duration, F.lit(0.0))
    return F.when(d < low, "short").when(d > high, "long").otherwise("kept")


def filled(*columns: Column) -> Column:
    out = ~is_blank(columns[0])
    for c in columns[1:]:
        out = out & ~is_blank(c)
    return out


def usable_label(label: Column, least: int = 2) -> Column:
    return F.coalesce(F.length(label) >= least, F.lit(False))


def corrected(cer: Column, below: float = 0.15) -> Column:
    return cer < below


def exact_match(a: Column, b: Column) -> Column:
    return strip(a) == strip(b)


def worth_scoring(n_samples: Column, output: Column, rate: int = 16_000, least: float = 0.3) -> Column:
    """A signal that is long enough, and an output that is not empty."""
    return (n_samples >= least * rate) & (F.coalesce(output, F.lit("")) != "")
