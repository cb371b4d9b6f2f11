"""Corpus metrics and speaker profiles over evaluation rows.

An evaluation row (see evaluate()) has: utt, speaker_id, x, y (two outputs), is_raw, coherent,
edit_distance, n_jamo_x, n_jamo_y, rule_hits, ratio, counts (struct by category), subs (array of
exp, act). utt is the order of appearance where ties are broken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.alignment import diagnose
from ..functions.hangul import jamo_string
from ..functions.phonology import CATEGORIES, rule_counts
from ..functions.text import is_coherent, strip
from .selection import with_medians


def evaluate(pairs: DataFrame) -> DataFrame:
    """(utt, speaker_id, x, y) to evaluation rows, with the steps of each kind besides."""
    d = pairs.withColumn("jx", jamo_string(F.col("x"))).withColumn("jy", jamo_string(F.col("y"))).withColumn("steps", diagnose("jx", "jy"))
    edits = F.col("steps.substitution") + F.col("steps.insertion") + F.col("steps.deletion")
    c = d.withColumn("counts", rule_counts(F.col("steps.subs"), F.col("steps.linking"))).withColumn("edit_distance", edits)
    hits = sum((F.col(f"counts.{k}") for k in CATEGORIES[1:]), F.col(f"counts.{CATEGORIES[0]}"))
    e = c.withColumn("rule_hits", hits)
    return e.select("utt", "speaker_id", "x", "y", (strip(F.col("x")) != strip(F.col("y"))).alias("is_raw"), is_coherent(F.col("x")).alias("coherent"), "edit_distance", F.length("jx").alias("n_jamo_x"), F.length("jy").alias("n_jamo_y"), "rule_hits", F.when(F.col("edit_distance") > 0, F.col("rule_hits") / F.col("edit_distance")).otherwise(0.0).alias("ratio"), "counts", F.col("steps.subs").alias("subs"), "steps")


def share(flag: Column) -> Column:
    """The share of rows, to four digits; 0 without rows."""
    return F.coalesce(F.bround(F.avg(flag.cast("int")), 4), F.lit(0.0))


def quartiles(value: Column, name: str) -> list[Column]:
    p = lambda q: F.percentile(value, F.lit(q))
    return [F.bround(F.avg(value), 4).alias(f"{name}_mean"), F.bround(p(0.5), 4).alias(f"{name}_median"), F.bround(p(0.25), 4).alias(f"{name}_p25"), F.bround(p(0.75), 4).alias(f"{name}_p75")]


def summary(value: Column, name: str) -> list[Column]:
    """Mean, median and population deviation."""
    return [F.bround(F.avg(value), 4).alias(f"{name}_mean"), F.bround(F.percentile(value, F.lit(0.5)), 4).alias(f"{name}_median"), F.bround(F.stddev_pop(value), 4).alias(f"{name}_std")]


def corpus_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """M1 to M4, in one pass."""
    hits = [F.sum(f"counts.{k}").alias(f"total_{k}") for k in [*CATEGORIES, "other"]]
    prevalence = [share(F.col(f"counts.{k}") > 0).alias(f"prevalence_{k}") for k in CATEGORIES]
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_samples"), share(F.col("is_raw")).alias("m1_rate"), *quartiles(F.col("edit_distance"), "m2"),
        F.bround(F.avg("rule_hits"), 4).alias("m3_hits_mean"), F.bround(F.percentile("rule_hits", F.lit(0.5)), 4).alias("m3_hits_median"),
        F.count_if(F.col("rule_hits") >= 1).alias("m3_with_hit"), share(F.col("rule_hits") >= 1).alias("m3_hit_rate"),
        F.bround(F.avg("ratio"), 4).alias("m3_ratio_mean"), F.bround(F.percentile("ratio", F.lit(0.5)), 4).alias("m3_ratio_median"), *hits, *prevalence,
    )


def subset_report(rows: DataFrame) -> DataFrame:
    """The metrics of all rows and of the coherent ones, and the coherent share."""
    twice = rows.withColumn("subset", F.explode(F.when(F.col("coherent"), F.array(F.lit("full"), F.lit("coherent"))).otherwise(F.array(F.lit("full")))))
    total = F.max(F.when(F.col("subset") == "full", F.col("n_samples"))).over(W.partitionBy())  # of two rows
    return corpus_metrics(twice, "subset").withColumn("share_of_all", F.bround(F.col("n_samples") / F.greatest(total, F.lit(1)), 4))


def _pairs(rows: DataFrame, *by: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """Per `by` and substitution what a batch of rows holds of it: occurrences, utterances, the first of
    these with the place of it there, and the sums of some long columns over the occurrences. Counted in the
    batch, so that what is shuffled is a row a pair and not one an occurrence."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            subs, flat = batch.column("subs"), batch.column("subs").flatten()
            sizes = pc.list_value_length(subs).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keys, pair = [], np.zeros(len(row), dtype=np.int64)
            for part in [*(batch.column(c).take(pa.array(row)) for c in by), pc.struct_field(flat, "exp"), pc.struct_field(flat, "act")]:
                keys.append(part)
                coded = part.dictionary_encode(null_encoding="encode")
                pair = np.unique(pair * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            # in order of utterance, then place
            order = np.lexsort((pos, pc.rank(batch.column("utt"), tiebreaker="dense").to_numpy()[row], pair))
            start = np.flatnonzero(np.diff(pair[order], prepend=-1))
            first = pa.array(order[start])
            n_utts = np.bincount(np.unique(pair * len(sizes) + row) // len(sizes))
            added = [np.add.reduceat(batch.column(c).to_numpy(zero_copy_only=False)[row[order]].astype(np.int64), start) for c in sums]
            columns = [*(k.take(first) for k in keys), np.diff(start, append=len(order)), n_utts, batch.column("utt").take(pa.array(row[order[start]])), pos[order[start]].astype(np.int32), *added]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [*by, "exp", "act", "n", "n_utts", "utt", "pos", *sums])

    schema = [*(f"{c} {kinds[c]}" for c in by), "exp string, act string, n long, n_utts long", f"utt {kinds['utt']}", "pos int", *(f"{c} long" for c in sums)]
    return rows.select(*by, "utt", "subs", *sums).mapInArrow(run, ", ".join(schema))


def _counted(pairs: DataFrame, *by: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """The counts of batches summed up, with the first utterance and what orders pairs by their first place."""
    whole = dict(pairs.dtypes)["utt"] in ("bigint", "int")
    # one number where utterances are numbers, as a struct's minimum would have all rows sorted
    first = F.col("utt").cast("decimal(20,0)") * 2**31 + F.col("pos") if whole else F.struct("utt", "pos")
    return pairs.groupBy(*by, "exp", "act").agg(F.sum("n").alias("n"), F.sum("n_utts").alias("n_utts"), F.min("utt").alias("first_utt"), F.min(first).alias("first"), *[F.sum(c).alias(c) for c in sums])


def pair_counts(rows: DataFrame) -> DataFrame:
    """Per speaker and substitution: occurrences, utterances that hold it, and where it came first.
    Summed before the shuffle, so a speaker with a third of all rows is counted in parts."""
    return _counted(_pairs(rows.where("speaker_id <> ''"), "speaker_id"), "speaker_id")


def top_pairs(counts: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("speaker_id").orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def speakers(rows: DataFrame, min_utts: int = 3, k: int = 5) -> DataFrame:
    """Per speaker with enough utterances: counts by category, and the top substitutions (patterns;
    null if there are none). One pass over the rows: an entry without letters stands for the
    utterance itself. A speaker has as many pairs as there are of letters, so a window is small."""
    own = F.array(F.struct(F.lit(None).cast("string").alias("exp"), F.lit(None).cast("string").alias("act")))
    letters = F.transform("subs", lambda s: F.struct(s["exp"].alias("exp"), s["act"].alias("act")))
    sums = tuple(f"{t}_{c}" for t in ("total", "utts") for c in CATEGORIES)
    hits = [F.coalesce(F.col(f"counts.{c}"), F.lit(0)).cast("long").alias(f"total_{c}") for c in CATEGORIES] + [F.coalesce(F.col(f"counts.{c}") > 0, F.lit(False)).cast("long").alias(f"utts_{c}") for c in CATEGORIES]
    each = rows.where("speaker_id <> ''").select("speaker_id", "utt", F.concat(own, F.coalesce(letters, F.array().cast("array<struct<exp:string,act:string>>"))).alias("subs"), *hits)
    mine = F.col("exp").isNull()
    order = W.partitionBy("speaker_id").orderBy(F.col("exp").isNotNull(), F.desc("n"), "first")
    ranked = _counted(_pairs(each, "speaker_id", sums=sums), "speaker_id", sums=sums).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") <= k)
    of = lambda c: F.max(F.when(mine, F.col(c)))
    top = F.sort_array(F.collect_list(F.when(~mine, F.struct("rank", "exp", "act", "n", "n_utts"))))
    out = ranked.groupBy("speaker_id").agg(of("n").alias("n_utterances"), of("first_utt").alias("first_utt"), *[of(c).alias(c) for c in sums], top.alias("patterns"))
    return out.where(F.col("n_utterances") >= min_utts).withColumn("patterns", F.when(F.size("patterns") > 0, F.col("patterns")))


def consistency(rows: DataFrame, min_utts: int = 3) -> DataFrame:
    """M5: of each speaker with enough utterances, the most frequent substitution and the share of
    their utterances that hold it."""
    top = speakers(rows, min_utts, 1).where("patterns IS NOT NULL").withColumn("p", F.col("patterns")[0])
    return top.select("speaker_id", "n_utterances", "p.exp", "p.act", (F.col("p.n_utts") / F.col("n_utterances")).alias("consistency"))


def consistency_report(per_speaker: DataFrame) -> DataFrame:
    s = per_speaker.agg(F.count("*").alias("n_speakers"), F.bround(F.avg("consistency"), 4).alias("mean"), F.count_if(F.col("consistency") >= 0.5).alias("n_half"))
    return with_medians(s, per_speaker, "consistency", "median").withColumn("median", F.bround("median", 4))


def weakness() -> Column:
    """The category in most utterances; the earlier one on ties, 'none' if there is none."""
    best = F.array_max(F.array(*[F.struct(F.col(f"utts_{k}").alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(CATEGORIES)]))
    return F.when(best["n"] > 0, best["k"]).otherwise("none")


def profiles(rows: DataFrame, min_utts: int = 3, k: int = 5) -> DataFrame:
    """Per speaker: counts and shares by category, the weakest one and the top substitutions."""
    rates = [F.bround(F.col(f"utts_{c}") / F.col("n_utterances"), 4).alias(f"rate_{c}") for c in CATEGORIES]
    return speakers(rows, min_utts, k).select("*", *rates, weakness().alias("weakness")).orderBy(F.desc("n_utterances"), "first_utt")


def top_substitutions(rows: DataFrame, k: int = 15) -> DataFrame:
    """The substitutions seen most often, the one that came first on ties."""
    return _counted(_pairs(rows)).orderBy(F.desc("n"), "first").limit(k).select("exp", "act", "n")


def high_disclosure(rows: DataFrame, k: int = 5) -> DataFrame:
    """The coherent rows that show most: raw outputs first, then those with most edits, then the first."""
    return rows.where("coherent").orderBy(F.desc("is_raw"), F.desc("edit_distance"), "utt").limit(k)


def both_ends(rows: DataFrame, k: int) -> DataFrame:
    """(side, utt, cer): the k rows with the least error rate, the first of equal ones, and the k with the greatest,
    the last of equal ones; rows without a rate come last on both sides. The rows are made once: of each task's
    only its own ends go on."""
    kinds = dict(rows.dtypes)
    orders = {"best": [("cer", "ascending"), ("utt", "ascending")], "worst": [("cer", "descending"), ("utt", "descending")]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, pa.Table] = {}
        for batch in batches:
            for side, order in orders.items():
                t = pa.Table.from_batches([batch.select(["utt", "cer"])])
                t = pa.concat_tables([kept[side], t]) if side in kept else t
                kept[side] = t.take(pc.sort_indices(t, sort_keys=order, null_placement="at_end")[:k])
        for side, t in kept.items():
            yield from t.add_column(0, "side", pa.array([side] * len(t), pa.string())).to_batches()

    ends = rows.select("utt", "cer").mapInArrow(run, f"side string, utt {kinds['utt']}, cer double")
    up, down = (F.when(F.col("side") == s, F.col("cer")) for s in ("best", "worst"))
    order = W.partitionBy("side").orderBy(F.col("cer").isNull(), F.asc(up), F.desc(down), F.asc(F.when(F.col("side") == "best", F.col("utt"))), F.desc("utt"))
    return ends.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).orderBy("side", "place").drop("place")


def best_per_category(rows: DataFrame) -> DataFrame:
    """For each category the row with most hits, the first on ties."""
    each = rows.select("utt", "x", "y", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in CATEGORIES]), F.array(*[F.col(f"counts.{c}") for c in CATEGORIES]))).alias("category", "hits")).where("hits > 0")
    return each.groupBy("category").agg(F.max_by(F.struct("utt", "x", "y", "hits"), F.struct("hits", -F.col("utt"))).alias("best")).select("category", "best.*")


def buckets(cer: Column) -> list[Column]:
    """Counts and shares of error rates below 0.3, below 0.6 and above."""
    names = {"low": cer < 0.3, "mid": (cer >= 0.3) & (cer < 0.6), "high": cer >= 0.6}
    return [F.count_if(c).alias(f"n_{n}") for n, c in names.items()] + [share(c).alias(f"share_{n}") for n, c in names.items()]


def micro_macro(edits: Column, ref_len: Column) -> list[Column]:
    return [F.bround(F.sum(edits) / F.sum(ref_len), 4).alias("micro_cer"), F.bround(F.avg(edits / ref_len), 4).alias("macro_cer")]


def markdown(metrics: DataFrame, title: str) -> DataFrame:
    """One row with a Markdown table of a metrics row's columns."""
    line = lambda c: F.format_string(f"| {c} | %s |", F.coalesce(F.col(c).cast("string"), F.lit("-")))
    return metrics.select(F.concat_ws("\n", F.lit(f"## {title}"), F.lit("| metric | value |"), F.lit("|---|---|"), *[line(c) for c in metrics.columns]).alias("report"))
