"""Queries of distances, error rates, alignments and the metrics over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alignment as a
from ..functions import hangul as h
from ..operators import metrics as m
from ._registry import registry
from .base import SENT, SQL_BLOCKS, SQL_OPERATIONS, UTT, sentences, sql_jamo, sql_text, utterances

QUERIES, ORACLES, query = registry()

# letters as one byte each, as the oracle's levenshtein counts bytes
_JX, _JY = sql_jamo("cx", ascii_letters=True), sql_jamo("cy", ascii_letters=True)
_D = f"{UTT}, d AS (SELECT utt, conv_id, role, {_JX} AS jx, {_JY} AS jy, levenshtein({_JX}, {_JY})::BIGINT AS edits FROM utt)"


def distances(spark, sf):
    j = utterances(spark, sf).select("utt", "conv_id", "role", h.jamo_string(F.col("x")).alias("jx"), h.jamo_string(F.col("y")).alias("jy"))
    return j.withColumn("edits", a.edit_distance("jx", "jy").cast("long"))


_Q = "round_even(avg({v}), 4) AS m2_mean, round_even(quantile_cont({v}, 0.5), 4) AS m2_median, round_even(quantile_cont({v}, 0.25), 4) AS m2_p25, round_even(quantile_cont({v}, 0.75), 4) AS m2_p75"


@query("flagship_edit_distance_by_role", f"WITH {_D} SELECT role, count(*) AS n, {_Q.format(v='edits')} FROM d GROUP BY role")
def flagship(spark, sf):
    return distances(spark, sf).groupBy("role").agg(F.count("*").alias("n"), *m.quartiles(F.col("edits"), "m2"))


@query("aln_edit_distance", f"WITH {_D} SELECT utt, edits FROM d")
def aln_edit_distance(spark, sf):
    return distances(spark, sf).select("utt", "edits")


@query("aln_cer_variants", f"""WITH {_D}, e AS (SELECT utt, jx, jy, edits, replace(jx, ' ', '') AS rx, replace(jy, ' ', '') AS ry FROM d)
SELECT utt, edits / nullif(length(jx), 0) AS plain, levenshtein(rx, ry) / greatest(length(rx), 1) AS squeezed,
  CASE WHEN length(rx) > 0 THEN round_even(100 * levenshtein(rx, ry)::DOUBLE / length(rx), 1) ELSE 0 END AS scorer FROM e""")
def aln_cer_variants(spark, sf):
    x, y = F.col("jx"), F.col("jy")
    return distances(spark, sf).select("utt", a.cer_plain(x, y).alias("plain"), a.cer_squeezed(x, y).alias("squeezed"), a.cer_scorer(x, y).alias("scorer"))


_C = f"{_D}, c AS (SELECT utt, conv_id, role, edits, length(jx) AS n, edits / nullif(length(jx), 0) AS cer FROM d)"


def rates(spark, sf):
    return distances(spark, sf).select("utt", "conv_id", "role", "edits", F.length("jx").alias("n"), (F.col("edits") / F.nullif(F.length("jx"), F.lit(0))).alias("cer"))


@query("agg_cer_summary", f"WITH {_C} SELECT role, round_even(avg(cer), 4) AS cer_mean, round_even(quantile_cont(cer, 0.5), 4) AS cer_median, round_even(stddev_pop(cer), 4) AS cer_std FROM c GROUP BY role")
def agg_cer_summary(spark, sf):
    return rates(spark, sf).groupBy("role").agg(*m.summary(F.col("cer"), "cer"))


@query("agg_cer_buckets", f"""WITH {_C} SELECT role, count_if(cer < 0.3)::BIGINT AS n_low, count_if(cer >= 0.3 AND cer < 0.6)::BIGINT AS n_mid, count_if(cer >= 0.6)::BIGINT AS n_high,
  round_even(avg((cer < 0.3)::INTEGER), 4) AS share_low, round_even(avg((cer >= 0.3 AND cer < 0.6)::INTEGER), 4) AS share_mid, round_even(avg((cer >= 0.6)::INTEGER), 4) AS share_high FROM c GROUP BY role""")
def agg_cer_buckets(spark, sf):
    return rates(spark, sf).groupBy("role").agg(*m.buckets(F.col("cer")))


@query("agg_micro_macro_cer", f"WITH {_C} SELECT role, round_even(sum(edits)::DOUBLE / sum(n), 4) AS micro_cer, round_even(avg(edits / n), 4) AS macro_cer FROM c WHERE n > 0 GROUP BY role")
def agg_micro_macro_cer(spark, sf):
    return rates(spark, sf).where("n > 0").groupBy("role").agg(*m.micro_macro(F.col("edits"), F.col("n")))


@query("agg_m1_rejection", f"WITH {UTT} SELECT role, round_even(avg(({sql_text('cx')} <> {sql_text('cy')})::INTEGER), 4) AS m1_rate FROM utt GROUP BY role")
def agg_m1_rejection(spark, sf):
    from ..functions.text import strip

    return utterances(spark, sf).groupBy("role").agg(m.share(strip(F.col("x")) != strip(F.col("y"))).alias("m1_rate"))


@query("ord_topk_edits", f"WITH {_D} SELECT utt, edits FROM d ORDER BY edits DESC, utt LIMIT 5")
def ord_topk_edits(spark, sf):
    return distances(spark, sf).select("utt", "edits").orderBy(F.desc("edits"), "utt").limit(5)


@query("ord_best_worst", f"""WITH {_C}, b AS (SELECT 'best' AS side, utt, cer FROM c ORDER BY cer, utt LIMIT 5), w AS (SELECT 'worst' AS side, utt, cer FROM c ORDER BY cer DESC, utt DESC LIMIT 5)
SELECT * FROM b UNION ALL SELECT * FROM w""")
def ord_best_worst(spark, sf):
    return m.both_ends(rates(spark, sf).select("utt", "cer"), 5)


# alignments: SQL has the distance but not the path, so tests hold these against brute force

def aligned(spark, sf):
    return m.evaluate(utterances(spark, sf).select("utt", F.col("conv_id").cast("string").alias("speaker_id"), "x", "y"))


@query("aln_steps")
def aln_steps(spark, sf):
    return aligned(spark, sf).select("utt", *[F.col(f"steps.{s}").cast("long").alias(s) for s in ("correct", "substitution", "insertion", "deletion")])


@query("aln_score")
def aln_score(spark, sf):
    n = F.col("steps.correct") + F.col("edit_distance")
    score = F.when(n > 0, F.col("steps.correct") / n).otherwise(0.0)
    return aligned(spark, sf).select("utt", F.bround(score, 4).alias("score"), F.col("edit_distance").alias("errors"), "edit_distance", "rule_hits", "ratio")


_CHARS = "list_transform({}, lambda c: chr(c::INTEGER))"
_SQUEEZED = f"WITH RECURSIVE {UTT}, j AS (SELECT utt, {_CHARS.format('list_filter(cx, lambda c: c <> 32)')} AS a, {_CHARS.format('list_filter(cy, lambda c: c <> 32)')} AS b FROM utt),\n{SQL_BLOCKS}"


@query("aln_opcodes", f"{_SQUEEZED},\n{SQL_OPERATIONS} SELECT utt, type, count(*) AS n, sum(length(ref))::BIGINT AS ref_chars, sum(length(hyp))::BIGINT AS hyp_chars FROM t GROUP BY utt, type")
def aln_opcodes(spark, sf):
    ops = utterances(spark, sf).select("utt", F.explode(a.opcodes(a.without_spaces(F.col("x")), a.without_spaces(F.col("y")))).alias("o"))
    return ops.groupBy("utt", "o.type").agg(F.count("*").alias("n"), F.sum(F.length("o.ref")).alias("ref_chars"), F.sum(F.length("o.hyp")).alias("hyp_chars"))


@query("aln_similarity")
def aln_similarity(spark, sf):
    # some sentences have popular letters, of which the SQL of ali_similarity knows nothing
    return utterances(spark, sf).select("utt", a.similarity("x", "y").alias("ratio"))


@query("fn_jamo_feedback")
def fn_jamo_feedback(spark, sf):
    from ..functions.phonology import jamo_feedback

    pairs = utterances(spark, sf).select("utt", F.posexplode(F.arrays_zip(h.chars(F.col("x")).alias("x"), h.chars(F.col("y")).alias("y"))).alias("pos", "p")).where("p.x <> p.y")
    return pairs.select("utt", "pos", jamo_feedback(h.text_to_jamo(F.col("p.x")), h.text_to_jamo(F.col("p.y"))).alias("feedback"))


@query("win_linking_count")
def win_linking_count(spark, sf):
    return aligned(spark, sf).select("utt", F.col("counts.linking").alias("n_links"))


@query("agg_corpus_metrics")
def agg_corpus_metrics(spark, sf):
    return m.corpus_metrics(aligned(spark, sf))


@query("agg_subset_report")
def agg_subset_report(spark, sf):
    return m.subset_report(aligned(spark, sf))


@query("agg_m5_consistency")
def agg_m5_consistency(spark, sf):
    return m.consistency(aligned(spark, sf))


@query("agg_m5_report")
def agg_m5_report(spark, sf):
    return m.consistency_report(m.consistency(aligned(spark, sf)))


@query("agg_speaker_profiles")
def agg_speaker_profiles(spark, sf):
    p = m.profiles(aligned(spark, sf))
    return p.withColumn("patterns", F.to_json("patterns"))


@query("win_best_per_category")
def win_best_per_category(spark, sf):
    return m.best_per_category(aligned(spark, sf))


@query("agg_top_substitutions")
def agg_top_substitutions(spark, sf):
    return m.top_substitutions(aligned(spark, sf))


@query("snk_markdown_report")
def snk_markdown_report(spark, sf):
    return m.markdown(m.corpus_metrics(aligned(spark, sf)), "Corpus metrics")


# letters paired by place: the same counting, expressible in SQL

_P = f"""{UTT}, j AS (SELECT utt, conv_id, {sql_jamo('cx')} AS x, {sql_jamo('cy')} AS y FROM utt),
z AS (SELECT utt, conv_id, y, e, o FROM j, unnest(string_split(x, '')) WITH ORDINALITY AS u(e, o)),
p AS (SELECT utt, conv_id, e AS exp, substr(y, o::INTEGER, 1) AS act, o - 1 AS pos FROM z WHERE o <= length(y) AND substr(y, o::INTEGER, 1) <> e)"""


def place_pairs(spark, sf):
    """Evaluation rows whose substitutions are the letters that differ place by place."""
    j = utterances(spark, sf).select("utt", F.col("conv_id").cast("string").alias("speaker_id"), F.arrays_zip(h.text_to_jamo(F.col("x")).alias("exp"), h.text_to_jamo(F.col("y")).alias("act")).alias("z"))
    differ = F.filter(F.transform("z", lambda p, i: F.struct(p["exp"].alias("exp"), p["act"].alias("act"), i.alias("at"))), lambda p: p["exp"] != p["act"])
    return j.select("utt", "speaker_id", differ.alias("subs"))


@query("win_topk_pairs", f"""WITH {_P}, n AS (SELECT conv_id, exp, act, count(*) AS n, count(DISTINCT utt) AS n_utts, min(utt * 100000 + pos) AS first FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS rank FROM n)
SELECT conv_id::VARCHAR AS speaker_id, exp, act, n, n_utts, rank FROM r WHERE rank <= 3""")
def win_topk_pairs(spark, sf):
    return m.top_pairs(m.pair_counts(place_pairs(spark, sf)), 3).select("speaker_id", "exp", "act", "n", "n_utts", F.col("rank").cast("long").alias("rank"))


_FOLD = r"regexp_replace(s, '[^\x00-\x7F]', '?', 'g')"


@query("jon_best_match", rf"""WITH {SENT}, u AS (SELECT conv_id, utt, {_FOLD} AS s FROM sent WHERE role = 'user'), a AS (SELECT conv_id, utt AS other, {_FOLD} AS t FROM sent WHERE role = 'assistant'),
p AS (SELECT u.conv_id, u.utt AS left_id, other, 1 - levenshtein(s, t)::DOUBLE / greatest(length(s), length(t)) AS score FROM u JOIN a USING (conv_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, other) AS k FROM p WHERE score > 0.2)
SELECT conv_id, left_id, other, round_even(score, 6) AS score FROM r WHERE k = 1""")
def jon_best_match(spark, sf):
    from ..operators.joins import best_match

    s = sentences(spark, sf).withColumn("s", F.regexp_replace("s", r"[^\x00-\x7F]", "?"))
    left = s.where("role = 'user'").select("conv_id", F.col("utt").alias("left_id"), "s")
    right = s.where("role = 'assistant'").select("conv_id", F.col("utt").alias("other"), F.col("s").alias("t"))
    score = 1 - F.levenshtein("s", "t") / F.greatest(F.length("s"), F.length("t"))
    return best_match(left, right, "conv_id", "other", score, 0.2).withColumn("score", F.bround("score", 6))


@query("jon_similar_sentence", rf"""WITH {SENT}, u AS (SELECT DISTINCT {_FOLD} AS s FROM sent WHERE role = 'user'), a AS (SELECT {_FOLD} AS t, min(utt) AS other FROM sent WHERE role = 'assistant' GROUP BY t),
p AS (SELECT s, other, 1 - levenshtein(s, t)::DOUBLE / greatest(length(s), length(t)) AS score FROM u JOIN a ON least(length(s), length(t)) > 0.84 * greatest(length(s), length(t))),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, other) AS k FROM p WHERE score > 0.85)
SELECT utt AS left_id, other, round_even(score, 6) AS score FROM sent JOIN r ON {_FOLD.replace('(s,', '(sent.s,')} = r.s WHERE k = 1 AND role = 'user'""")
def jon_similar_sentence(spark, sf):
    from ..operators.joins import similar_match

    s = sentences(spark, sf).select(F.lit(0).alias("corpus"), "role", "utt", F.regexp_replace("s", r"[^\x00-\x7F]", "?").alias("s"))
    left = s.where("role = 'user'").select("corpus", F.col("utt").alias("left_id"), "s")
    right = s.where("role = 'assistant'").select("corpus", F.col("utt").alias("other"), F.col("s").alias("t"))
    return similar_match(left, right, "corpus", "other", 0.85).select("left_id", "other", F.bround("score", 6).alias("score"))
