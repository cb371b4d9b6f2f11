"""Differences between letter sequences, sorted by phonological rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hangul import COMPOUND_FINALS, INITIALS

# Fixed values: (expected, actual) letters of each rule; an earlier rule goes first.
TENSE = {"ㄱ": "ㄲ", "ㄷ": "ㄸ", "ㅂ": "ㅃ", "ㅅ": "ㅆ", "ㅈ": "ㅉ"}
PALATAL = {"ㄷ": "ㅈ", "ㅌ": "ㅊ"}
NASAL = {"ㄱ": "ㅇ", "ㄷ": "ㄴ", "ㅂ": "ㅁ"}
CATEGORIES = ["tensification", "palatalization", "nasalization", "linking"]
# The articulation class of each letter.
SOUND_CLASS = {
    "ㄱ": "파열음(연)", "ㄷ": "파열음(연)", "ㅂ": "파열음(연)", "ㄲ": "파열음(경)", "ㄸ": "파열음(경)", "ㅃ": "파열음(경)", "ㅋ": "파열음(격)", "ㅌ": "파열음(격)", "ㅍ": "파열음(격)",
    "ㅈ": "파찰음(연)", "ㅉ": "파찰음(경)", "ㅊ": "파찰음(격)", "ㅅ": "마찰음(연)", "ㅆ": "마찰음(경)", "ㅎ": "마찰음", "ㄴ": "비음", "ㅁ": "비음", "ㅇ": "비음", "ㄹ": "유음",
    "ㅏ": "저모음", "ㅓ": "중모음", "ㅗ": "고모음(원순)", "ㅜ": "고모음(원순)", "ㅡ": "고모음", "ㅣ": "고모음(전설)", "ㅐ": "중모음(전설)", "ㅔ": "중모음(전설)", "ㅑ": "이중모음", "ㅕ": "이중모음", "ㅛ": "이중모음", "ㅠ": "이중모음",
}

#: Consonants before a silent initial that make its loss a link; the silent one itself does not.
LINKING = [c for c in INITIALS if c != "ㅇ"] + list(COMPOUND_FINALS)


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def classify(expected: Column, actual: Column) -> Column:
    pair = F.concat(expected, actual)
    of = lambda rule: pair.isin([e + a for e, a in rule.items()])
    return F.when(of(TENSE), "tensification").when(of(PALATAL), "palatalization").when(of(NASAL), "nasalization").otherwise("other")


def sound_class(jamo: Column) -> Column:
    return F.element_at(_map(SOUND_CLASS), jamo)


def linking_count(alignment: Column) -> Column:
    """Lost silent initials right after an expected consonant; insertions do not count."""
    said = F.transform(F.filter(alignment, lambda s: s["status"] != "insertion"), lambda s: F.struct(s["expected"].alias("e"), (s["status"] == "deletion").alias("lost")))
    before = F.concat(F.array(F.lit("")), F.transform(said, lambda s: s["e"]))
    hits = F.filter(F.arrays_zip(said.alias("s"), before.alias("b")), lambda p: F.coalesce(p["s"]["lost"] & (p["s"]["e"] == "ㅇ") & p["b"].isin(LINKING), F.lit(False)))
    return F.size(hits)


def rule_counts(subs: Column, linking: Column) -> Column:
    """struct of the hits of each category, other substitutions included."""
    kinds = F.transform(subs, lambda s: classify(s["exp"], s["act"]))
    count = lambda name: F.size(F.filter(kinds, lambda k: k == name))
    return F.struct(*[count(c).alias(c) for c in CATEGORIES[:3]], linking.alias("linking"), count("other").alias("other"))


def jamo_feedback(reference: Column, hypothesis: Column) -> Column:
    """Up to two letters that differ, with their classes; empty unless as many letters."""
    shown = lambda c: F.concat(c, F.coalesce(F.concat(F.lit("("), sound_class(c), F.lit(")")), F.lit("")))
    pairs = F.filter(F.arrays_zip(reference.alias("r"), hypothesis.alias("h")), lambda p: p["r"] != p["h"])
    text = F.array_join(F.transform(F.slice(pairs, 1, 2), lambda p: F.concat(shown(p["r"]), F.lit(" → "), shown(p["h"]))), "  ")
    return F.when(F.size(reference) == F.size(hypothesis), text).otherwise("")
