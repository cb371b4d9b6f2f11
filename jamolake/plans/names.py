"""Alignments and the metrics over them on short texts, where SQL can express the path.

Utterances are the names of all parts and speakers their brands. Letters stand for the syllables
below; y has other letters for some, so that every rule occurs, and lacks one. Every fifth is x.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alignment as a
from ..functions import hangul as h
from ..functions import phonology as p
from ..functions import text as t
from ..operators import metrics as m
from ..operators import report as r
from ..operators.evaluation import read_evaluation, write_evaluation
from ..sources.scratch import new_folder
from ._registry import registry
from .base import PIECE_ROWS, SQL_BLOCKS, SQL_OPERATIONS, spread, sql_jamo, table

QUERIES, ORACLES, query = registry()

_LETTERS, _SYLLABLES = "abcdefghijklmnopqrstuvwxyz", "가까각다바빠사닫자짜앙를난요고꼬나에맘을두뚜랍씨어쓰"
_SAID = "aeioucd", "bfjpvki"


def names(spark, sf):
    part = spread(table(spark, sf, "part"), 10 * PIECE_ROWS).select(F.col("p_partkey").alias("utt"), F.col("p_brand").alias("speaker_id"), "p_name")
    said, at = F.translate("p_name", *_SAID), (F.col("utt") % 7).cast("int")
    short = F.concat(F.substring(said, F.lit(1), at), F.substring(said, at + 2, F.length("p_name")))
    syllables = lambda c: F.translate(c, _LETTERS, _SYLLABLES)
    x = syllables(F.col("p_name"))
    return part.select("utt", "speaker_id", x.alias("x"), F.when(F.col("utt") % 5 == 0, x).otherwise(syllables(short)).alias("y"))


def rows(spark, sf):
    return m.evaluate(names(spark, sf))


# --- the same in SQL -------------------------------------------------------------------------

_IN = lambda pairs: ", ".join(f"'{e}{x}'" for e, x in pairs.items())
_CODES = "list_transform(string_split({}, ''), lambda c: unicode(c))"
NAMES = f"""n AS (SELECT p_partkey AS utt, p_brand AS speaker_id, translate(p_name, '{_LETTERS}', '{_SYLLABLES}') AS x, p_partkey % 7 AS k, translate(p_name, '{_SAID[0]}', '{_SAID[1]}') AS s FROM part),
nm AS (SELECT utt, speaker_id, x, CASE WHEN utt % 5 = 0 THEN x ELSE translate(substr(s, 1, k) || substr(s, k + 2), '{_LETTERS}', '{_SYLLABLES}') END AS y FROM n),
j AS (SELECT *, {sql_jamo(_CODES.format('x'))} AS jx, {sql_jamo(_CODES.format('y'))} AS jy, string_split({sql_jamo(_CODES.format('x'))}, '') AS a, string_split({sql_jamo(_CODES.format('y'))}, '') AS b FROM nm)"""


def _walk(cell: str, kind: str) -> str:
    """Recursive CTEs: t fills a row of each pair's table at a time, s reads it from the end."""
    return f"""t AS (SELECT utt, a, b, 0 AS i, [{cell.split(';')[0]}] AS g FROM j UNION ALL SELECT utt, a, b, i + 1, list_append(g, {cell.split(';')[1]}) FROM t WHERE i < len(a)),
full_t AS MATERIALIZED (SELECT * FROM t WHERE i = len(a)),
s AS (SELECT utt, len(a)::BIGINT AS i, len(b)::BIGINT AS j, 0 AS step, '' AS kind, '' AS e, '' AS h FROM full_t
  UNION ALL SELECT utt, i - (kind NOT IN ('insertion', 'insert'))::BIGINT, j - (kind NOT IN ('deletion', 'delete'))::BIGINT, step + 1, kind, CASE WHEN kind NOT IN ('insertion', 'insert') THEN a[i] END, CASE WHEN kind NOT IN ('deletion', 'delete') THEN b[j] END
  FROM (SELECT s.utt, s.i, s.j, step, a, b, {kind} AS kind FROM s JOIN full_t f ON s.utt = f.utt WHERE s.i > 0 OR s.j > 0) q),
st AS MATERIALIZED (SELECT utt, step, kind, e, h FROM s WHERE step > 0)"""


_COST = "range(0, len(b) + 1); list_transform(range(0, len(b) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda k: least(g[i + 1][k + 1] + 1, CASE WHEN k = 0 THEN 1000000 WHEN b[k] = a[i + 1] THEN g[i + 1][k] ELSE g[i + 1][k] + 1 END) - k)) + j)"
_STEP = "CASE WHEN s.i > 0 AND s.j > 0 AND a[s.i] = b[s.j] THEN 'correct' WHEN s.i > 0 AND s.j > 0 AND g[s.i + 1][s.j + 1] = g[s.i][s.j] + 1 THEN 'substitution' WHEN s.j > 0 AND g[s.i + 1][s.j + 1] = g[s.i + 1][s.j] + 1 THEN 'insertion' ELSE 'deletion' END"
_LCS = "list_transform(range(0, len(b) + 1), lambda j: j * 0); list_transform(range(0, len(b) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k: greatest(g[i + 1][k + 1], CASE WHEN k > 0 AND b[k] = a[i + 1] THEN g[i + 1][k] + 1 ELSE 0 END))))"
_LCS_STEP = "CASE WHEN s.i > 0 AND s.j > 0 AND a[s.i] = b[s.j] THEN 'equal' WHEN s.j > 0 AND (s.i = 0 OR g[s.i + 1][s.j] >= g[s.i][s.j + 1]) THEN 'insert' ELSE 'delete' END"
STEPS = f"WITH RECURSIVE {NAMES},\n{_walk(_COST, _STEP)}"
_CATS = p.CATEGORIES
ROWS = f"""{STEPS},
sb AS MATERIALIZED (SELECT utt, step, e AS exp, h AS act, CASE WHEN e || h IN ({_IN(p.TENSE)}) THEN 'tensification' WHEN e || h IN ({_IN(p.PALATAL)}) THEN 'palatalization' WHEN e || h IN ({_IN(p.NASAL)}) THEN 'nasalization' ELSE 'other' END AS cat FROM st WHERE kind = 'substitution'),
ln AS (SELECT utt, kind, e, lag(e) OVER (PARTITION BY utt ORDER BY step DESC) AS b4 FROM st WHERE kind <> 'insertion'),
c1 AS (SELECT utt, {', '.join(f"count(*) FILTER (cat = '{c}') AS {c}" for c in [*_CATS[:3], 'other'])} FROM sb GROUP BY utt),
c2 AS (SELECT utt, count(*) AS linking FROM ln WHERE kind = 'deletion' AND e = 'ㅇ' AND b4 IN ({', '.join(f"'{c}'" for c in p.LINKING)}) GROUP BY utt),
c3 AS (SELECT utt, count(*) FILTER (kind <> 'correct') AS edit_distance, count(*) FILTER (kind = 'correct') AS good, count(*) AS n_steps FROM st GROUP BY utt),
ev AS (SELECT utt, speaker_id, x, y, trim(x) <> trim(y) AS is_raw, length(x) >= 5 AND length(regexp_replace(x, '[^가-힣]', '', 'g')) / length(x) >= 0.7 AND regexp_matches(x, '[{t.COHERENT_ENDINGS}]') AS coherent,
  edit_distance, good, n_steps, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in [*_CATS, 'other'])}, {' + '.join(f'coalesce({c}, 0)' for c in _CATS)} AS rule_hits
  FROM j JOIN c3 USING (utt) LEFT JOIN c1 USING (utt) LEFT JOIN c2 USING (utt)),
er AS MATERIALIZED (SELECT *, CASE WHEN edit_distance > 0 THEN rule_hits / edit_distance ELSE 0 END AS ratio FROM ev)"""


@query("ali_path", f"{STEPS} SELECT utt, string_agg(coalesce(e, '-') || coalesce(h, '-') || substr(kind, 1, 1), ' ' ORDER BY step DESC) AS path FROM st GROUP BY utt")
def ali_path(spark, sf):
    said = F.transform("alignment", lambda s: F.concat(F.coalesce(s["expected"], F.lit("-")), F.coalesce(s["actual"], F.lit("-")), F.substring(s["status"], 1, 1)))
    jamo = names(spark, sf).withColumn("alignment", a.align(h.jamo_string(F.col("x")), h.jamo_string(F.col("y"))))
    return jamo.select("utt", F.array_join(said, " ").alias("path"))


@query("ali_score", f"{ROWS} SELECT utt, good / n_steps AS score, 1 - good / n_steps AS cer, edit_distance AS errors, CASE WHEN 1 - good / n_steps < 0.15 THEN 'corrected' ELSE 'raw' END AS flag, x = y AS exact FROM er")
def ali_score(spark, sf):
    from ..operators.filters import corrected, exact_match

    d = names(spark, sf).withColumn("alignment", a.align(h.jamo_string(F.col("x")), h.jamo_string(F.col("y"))))
    cer = a.cer_alignment(F.col("alignment"))
    return d.select("utt", a.alignment_score(F.col("alignment")).alias("score"), cer.alias("cer"), F.size(a.alignment_errors(F.col("alignment"))).cast("long").alias("errors"), F.when(corrected(cer), "corrected").otherwise("raw").alias("flag"), exact_match(F.col("x"), F.col("y")).alias("exact"))


@query("ali_rows", f"{ROWS} SELECT utt, speaker_id, is_raw, coherent, edit_distance, rule_hits, ratio, {', '.join(_CATS)}, other FROM er")
def ali_rows(spark, sf):
    return rows(spark, sf).select("utt", "speaker_id", "is_raw", "coherent", F.col("edit_distance").cast("long").alias("edit_distance"), F.col("rule_hits").cast("long").alias("rule_hits"), "ratio", *[F.col(f"counts.{c}").cast("long").alias(c) for c in [*_CATS, "other"]])


_Q = lambda v, n: f"round_even(avg({v}), 4) AS {n}_mean, round_even(quantile_cont({v}, 0.5), 4) AS {n}_median"
_METRICS = f"""count(*) AS n_samples, round_even(avg(is_raw::INT), 4) AS m1_rate, {_Q('edit_distance', 'm2')}, round_even(quantile_cont(edit_distance, 0.25), 4) AS m2_p25, round_even(quantile_cont(edit_distance, 0.75), 4) AS m2_p75,
{_Q('rule_hits', 'm3_hits')}, count(*) FILTER (rule_hits >= 1) AS m3_with_hit, round_even(avg((rule_hits >= 1)::INT), 4) AS m3_hit_rate, {_Q('ratio', 'm3_ratio')},
{', '.join(f'sum({c})::BIGINT AS total_{c}' for c in [*_CATS, 'other'])}, {', '.join(f'round_even(avg(({c} > 0)::INT), 4) AS prevalence_{c}' for c in _CATS)}"""


@query("ali_corpus_metrics", f"{ROWS} SELECT {_METRICS} FROM er")
def ali_corpus_metrics(spark, sf):
    return m.corpus_metrics(rows(spark, sf))


@query("ali_subset_report", f"{ROWS}, f AS (SELECT 'full' AS subset, * FROM er UNION ALL SELECT 'coherent', * FROM er WHERE coherent) SELECT subset, {_METRICS}, round_even(count(*) / greatest((SELECT count(*) FROM er), 1), 4) AS share_of_all FROM f GROUP BY subset")
def ali_subset_report(spark, sf):
    return m.subset_report(rows(spark, sf))


_PAIRS = """pc AS (SELECT speaker_id, exp, act, count(*) AS n, count(DISTINCT sb.utt) AS n_utts, min(sb.utt * 1000 - step) AS first FROM sb JOIN er USING (utt) GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY n DESC, first) AS rank FROM pc),
sp AS (SELECT speaker_id, count(*) AS n_utterances, min(utt) AS first_utt, """ + ", ".join(f"sum({c})::BIGINT AS total_{c}, count(*) FILTER ({c} > 0) AS utts_{c}" for c in _CATS) + " FROM er GROUP BY speaker_id HAVING count(*) >= 3)"


@query("ali_m5_consistency", f"{ROWS}, {_PAIRS} SELECT speaker_id, n_utterances, exp, act, n_utts / n_utterances AS consistency FROM pr JOIN sp USING (speaker_id) WHERE rank = 1")
def ali_m5_consistency(spark, sf):
    return m.consistency(rows(spark, sf))


@query("ali_m5_report", f"{ROWS}, {_PAIRS}, c AS (SELECT n_utts / n_utterances AS c FROM pr JOIN sp USING (speaker_id) WHERE rank = 1) SELECT count(*) AS n_speakers, round_even(avg(c), 4) AS mean, round_even(quantile_cont(c, 0.5), 4) AS median, count(*) FILTER (c >= 0.5) AS n_half FROM c")
def ali_m5_report(spark, sf):
    return m.consistency_report(m.consistency(rows(spark, sf)))


_WEAK = "CASE WHEN greatest({u}) = 0 THEN 'none' {w} END".format(u=", ".join(f"utts_{c}" for c in _CATS), w=" ".join(f"WHEN utts_{c} = greatest({', '.join(f'utts_{d}' for d in _CATS)}) THEN '{c}'" for c in _CATS))


@query("ali_profiles", f"""{ROWS}, {_PAIRS}, tp AS (SELECT speaker_id, string_agg(exp || act || ' ' || n || ' ' || n_utts, ', ' ORDER BY rank) AS patterns FROM pr WHERE rank <= 5 GROUP BY speaker_id)
SELECT sp.*, {', '.join(f'round_even(utts_{c} / n_utterances, 4) AS rate_{c}' for c in _CATS)}, {_WEAK} AS weakness, patterns FROM sp LEFT JOIN tp USING (speaker_id)""")
def ali_profiles(spark, sf):
    shown = F.array_join(F.transform("patterns", lambda s: F.concat(s["exp"], s["act"], F.lit(" "), s["n"].cast("string"), F.lit(" "), s["n_utts"].cast("string"))), ", ")
    return m.profiles(rows(spark, sf)).withColumn("patterns", shown)


@query("ali_best_per_category", " UNION ALL ".join(f"(SELECT '{c}' AS category, utt, x, y, {c} AS hits FROM e WHERE {c} > 0 ORDER BY {c} DESC, utt LIMIT 1)" for c in _CATS).join([f"{ROWS}, e AS MATERIALIZED (SELECT * FROM er) ", ""]))
def ali_best_per_category(spark, sf):
    return m.best_per_category(rows(spark, sf)).withColumn("hits", F.col("hits").cast("long"))


@query("ali_top_substitutions", f"{ROWS} SELECT exp, act, count(*) AS n FROM sb GROUP BY ALL ORDER BY n DESC, min(utt * 1000 - step) LIMIT 15")
def ali_top_substitutions(spark, sf):
    return m.top_substitutions(rows(spark, sf), 15)


@query("ali_disclosure", f"{ROWS} SELECT utt, is_raw, edit_distance FROM er WHERE coherent ORDER BY is_raw DESC, edit_distance DESC, utt LIMIT 5")
def ali_disclosure(spark, sf):
    return m.high_disclosure(rows(spark, sf), 5).select("utt", "is_raw", F.col("edit_distance").cast("long").alias("edit_distance"))


_KO = " || ".join(f"CASE WHEN {c} > 0 THEN '{k}×' || {c} || ', ' ELSE '' END" for c, k in r.CATEGORY_NAMES.items())
_TENTHS = "round_even(ratio * 1000, 0)::BIGINT"


_DEMO = f"""ss AS (SELECT utt, string_agg(exp || '→' || act, ', ' ORDER BY step DESC) AS subs FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY step DESC) AS k FROM sb) q WHERE k <= 6 GROUP BY utt),
k AS (SELECT *, {_KO} AS c FROM er),
dl AS (SELECT utt, edit_distance || ' ' || rule_hits || ' ' || ({_TENTHS} // 10) || '.' || ({_TENTHS} % 10) || '%' || CASE WHEN c <> '' THEN ' [' || substr(c, 1, length(c) - 2) || ']' ELSE '' END || coalesce(' ' || subs, '') AS line, x FROM k LEFT JOIN ss USING (utt))"""


@query("ali_demo", f"{ROWS}, {_DEMO} SELECT utt, line, substr(x, 1, 6) AS preview FROM dl")
def ali_demo(spark, sf):
    return rows(spark, sf).select("utt", r.demo_line().alias("line"), r.preview(F.col("x"), 6).alias("preview"))


_PCT = lambda v: f"(round_even(1000 * ({v}), 0)::BIGINT // 10) || '.' || (round_even(1000 * ({v}), 0)::BIGINT % 10) || '%'"
_FIX = lambda v: f"(round_even(100 * ({v}), 0)::BIGINT // 100) || '.' || lpad((round_even(100 * ({v}), 0)::BIGINT % 100)::VARCHAR, 2, '0')"
_STR = lambda v: f"({v})::VARCHAR"


def _cells(*cells: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(cells) + " || ' |'"


def _heads(*names: str) -> str:
    return f"'| {' | '.join(names)} |', '|{'---|' * len(names)}'"


_MEASURES = [("utterances", "n_samples", _STR), ("M1 raw outputs", "m1_rate", _PCT), ("M2 edits", "m2_mean", _FIX), ("M3 rule hits", "m3_hits_mean", _FIX), ("M3 with a hit", "m3_hit_rate", _PCT), ("M3 ratio", "m3_ratio_mean", _PCT)]
_KINDS = [_cells(f"'{k}'", _STR(f"f.total_{c}"), _PCT(f"f.prevalence_{c}"), _STR(f"c.total_{c}"), _PCT(f"c.prevalence_{c}")) for c, k in r.CATEGORY_NAMES.items()] + [_cells("'-'", _STR("f.total_other"), "'-'", _STR("c.total_other"), "'-'")]
_OF = lambda v: f"{v} || '/' || n_utterances"
_EACH = [_cells(f"'{k}'", _OF(f"utts_{c}"), _PCT(f"utts_{c} / n_utterances"), _STR(f"total_{c}")) for c, k in r.CATEGORY_NAMES.items()]
_SHOWN = lambda t: f"'- X: ' || {t}.x, '- Y: ' || {t}.y, '- ' || dl.line"


@query("ali_evaluation", f"""{ROWS}, {_PAIRS}, {_DEMO}, fc AS (SELECT 'full' AS subset, * FROM er UNION ALL SELECT 'coherent', * FROM er WHERE coherent), sr AS (SELECT subset, {_METRICS} FROM fc GROUP BY subset),
cs AS (SELECT n_utts / n_utterances AS c FROM pr JOIN sp USING (speaker_id) WHERE rank = 1),
m5 AS (SELECT count(*) AS n, round_even(avg(c), 4) AS mean, round_even(quantile_cont(c, 0.5), 4) AS median, count(*) FILTER (c >= 0.5) AS n_half FROM cs),
best AS ({" UNION ALL ".join(f"(SELECT '{k}' AS name, utt, x, y FROM er WHERE coherent AND {c} > 0 ORDER BY {c} DESC, utt LIMIT 1)" for c, k in r.CATEGORY_NAMES.items())}),
most AS (SELECT utt, x, y FROM er WHERE coherent ORDER BY is_raw DESC, edit_distance DESC, utt LIMIT 5),
lines AS (SELECT 0 AS section, unnest(['# Evaluation', '- utterances: ' || f.n_samples, '- coherent: ' || c.n_samples || ' (' || {_PCT("c.n_samples / f.n_samples")} || ')']) AS line FROM sr f, sr c WHERE f.subset = 'full' AND c.subset = 'coherent'
  UNION ALL SELECT 1, unnest(['## M1 to M3', {_heads("measure", "all", "coherent")}, {", ".join(_cells(f"'{n}'", f("f." + v), f("c." + v)) for n, v, f in _MEASURES)}]) FROM sr f, sr c WHERE f.subset = 'full' AND c.subset = 'coherent'
  UNION ALL SELECT 2, unnest(['## M4', {_heads("category", "hits", "utterances", "coherent hits", "coherent utterances")}, {", ".join(_KINDS)}]) FROM sr f, sr c WHERE f.subset = 'full' AND c.subset = 'coherent'
  UNION ALL SELECT 3, unnest(['## M5', {_heads("of speakers", "value")}, {_cells("'speakers'", _STR("n"))}, {_cells("'mean'", _PCT("mean"))}, {_cells("'median'", _PCT("median"))}, {_cells("'half and more'", _STR("n_half"))}]) FROM m5
  UNION ALL SELECT 4, unnest(['### ' || speaker_id || ' (' || n_utterances || ')', '- weakest: ' || {_WEAK}, {_heads("category", "utterances", "share", "hits")}, {", ".join(_EACH)}, {_heads("rank", "pair", "utterances", "share", "times")}]) FROM sp
  UNION ALL SELECT 4, {_cells(_STR("rank"), "exp || '→' || act", _OF("n_utts"), _PCT("n_utts / n_utterances"), _STR("n"))} FROM pr JOIN sp USING (speaker_id) WHERE rank <= 5
  UNION ALL SELECT 5, unnest(['### ' || name, {_SHOWN('best')}]) FROM best JOIN dl USING (utt)
  UNION ALL SELECT 6, unnest(['### ' || utt, {_SHOWN('most')}]) FROM most JOIN dl USING (utt))
SELECT line, count(*) AS n FROM lines GROUP BY line UNION ALL SELECT 'results', count(*) FROM er UNION ALL SELECT 'edits', sum(edit_distance)::BIGINT FROM er UNION ALL SELECT 'profiles', count(*) FROM sp
UNION ALL SELECT 'coherent', n_samples FROM sr WHERE subset = 'coherent'""")
def ali_evaluation(spark, sf):
    """SNK4, SNK5, SRC6: an evaluation written as rows, metrics, profiles and a report, all read back."""
    folder = new_folder(spark, "evaluation")
    write_evaluation(rows(spark, sf), folder)
    results = spark.read.schema("edit_distance long").json(f"{folder}/results")
    n = F.count("*").alias("n")
    parts = [
        spark.read.text(f"{folder}/report").groupBy(F.col("value").alias("line")).agg(n),
        results.agg(n).select(F.lit("results").alias("line"), "n"),
        results.agg(F.sum("edit_distance").alias("n")).select(F.lit("edits").alias("line"), "n"),
        read_evaluation(spark, folder, "profiles").agg(n).select(F.lit("profiles").alias("line"), "n"),
        read_evaluation(spark, folder, "metrics").select(F.lit("coherent").alias("line"), F.col("metrics_coherent.n_samples").alias("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


_PLACE = f"{NAMES}, q AS (SELECT utt, unnest(range(1, least(length(x), length(y)) + 1)) AS pos, x, y FROM nm), w AS (SELECT utt, pos - 1 AS pos, substr(x, pos, 1) AS e, substr(y, pos, 1) AS h FROM q WHERE substr(x, pos, 1) <> substr(y, pos, 1)), z AS (SELECT *, {sql_jamo('[unicode(e)]')} AS je, {sql_jamo('[unicode(h)]')} AS jh FROM w)"
_CLASS = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '({v})'" for k, v in p.SOUND_CLASS.items()) + " ELSE '' END"


@query("ali_feedback", f"""WITH {_PLACE}, d AS (SELECT utt, pos, o, substr(je, o::INT, 1) AS e, substr(jh, o::INT, 1) AS h FROM (SELECT *, unnest(range(1, length(je) + 1)) AS o FROM z WHERE length(je) = length(jh)) q WHERE substr(je, o::INT, 1) <> substr(jh, o::INT, 1)),
f AS (SELECT *, row_number() OVER (PARTITION BY utt, pos ORDER BY o) AS k FROM d), g AS (SELECT utt, pos, string_agg(e || {_CLASS.format(c='e')} || ' → ' || h || {_CLASS.format(c='h')}, '  ' ORDER BY o) AS t FROM f WHERE k <= 2 GROUP BY utt, pos)
SELECT utt, pos, coalesce(t, '') AS feedback FROM z LEFT JOIN g USING (utt, pos)""")
def ali_feedback(spark, sf):
    pairs = names(spark, sf).select("utt", F.posexplode(F.arrays_zip(h.chars(F.col("x")).alias("x"), h.chars(F.col("y")).alias("y"))).alias("pos", "p")).where("p.x <> p.y")
    return pairs.select("utt", F.col("pos").cast("long").alias("pos"), p.jamo_feedback(h.text_to_jamo(F.col("p.x")), h.text_to_jamo(F.col("p.y"))).alias("feedback"))


@query("ali_sound_class", f"WITH {NAMES}, u AS (SELECT unnest(a) AS c FROM j) SELECT c AS letter, {_CLASS.format(c='c')} AS class, count(*) AS n FROM u GROUP BY ALL")
def ali_sound_class(spark, sf):
    letters = names(spark, sf).select(F.explode(h.text_to_jamo(F.col("x"))).alias("letter"))
    return letters.groupBy("letter").agg(F.count("*").alias("n")).select("letter", F.coalesce(F.concat(F.lit("("), p.sound_class(F.col("letter")), F.lit(")")), F.lit("")).alias("class"), "n")


_SYL = NAMES.replace("j AS (SELECT *", "j0 AS (SELECT *") + ", j AS (SELECT utt, string_split(regexp_replace(x, '\\s', '', 'g'), '') AS a, string_split(regexp_replace(y, '\\s', '', 'g'), '') AS b FROM nm)"


@query("ali_common_runs", f"WITH RECURSIVE {_SYL},\n{_walk(_LCS, _LCS_STEP)} SELECT utt, string_agg(coalesce(e, '-') || coalesce(h, '-') || substr(kind, 1, 1), ' ' ORDER BY step DESC) AS path FROM st GROUP BY utt")
def ali_common_runs(spark, sf):
    steps = names(spark, sf).select("utt", a.align_common(F.col("x"), F.col("y")).alias("s"))
    dash = lambda c: F.when(c == "", "-").otherwise(c)
    return steps.select("utt", F.array_join(F.transform("s", lambda o: F.concat(dash(o["ref"]), dash(o["hyp"]), F.substring(o["type"], 1, 1))), " ").alias("path"))


_BLOCKS = f"{_SYL},\n{SQL_BLOCKS}"


@query("ali_opcodes", f"""WITH RECURSIVE {_BLOCKS},
{SQL_OPERATIONS}
SELECT utt, row_number() OVER (PARTITION BY utt ORDER BY i, part) - 1 AS pos, type, ref, hyp FROM t""")
def ali_opcodes(spark, sf):
    """ALN7: blocks that are equal, replaced, deleted or inserted."""
    squeezed = lambda c: F.regexp_replace(c, r"\s", "")
    ops = names(spark, sf).select("utt", F.posexplode(a.opcodes(squeezed("x"), squeezed("y"))).alias("pos", "o"))
    return ops.select("utt", F.col("pos").cast("long").alias("pos"), "o.type", "o.ref", "o.hyp")


@query("ali_similarity", f"WITH RECURSIVE {_BLOCKS}, s AS (SELECT utt, sum(k) AS k FROM bl GROUP BY utt) SELECT utt, 2 * coalesce(k, 0) / (len(a) + len(b)) AS ratio FROM j LEFT JOIN s USING (utt)")
def ali_similarity(spark, sf):
    """ALN8: 2 * letters in common / letters."""
    squeezed = lambda c: F.regexp_replace(c, r"\s", "")
    return names(spark, sf).select("utt", a.similarity(squeezed("x"), squeezed("y")).alias("ratio"))


_ASCII = f"WITH n AS (SELECT p_partkey AS utt, p_name AS x, translate(p_name, '{_SAID[0]}', '{_SAID[1]}') AS s, p_partkey % 7 AS k FROM part), q AS (SELECT utt, x, CASE WHEN utt % 5 = 0 THEN x ELSE substr(s, 1, k) || substr(s, k + 2) END AS y, s FROM n)"


def latin(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("utt"), F.col("p_name").alias("x"))
    said, at = F.translate("x", *_SAID), (F.col("utt") % 7).cast("int")
    short = F.concat(F.substring(said, F.lit(1), at), F.substring(said, at + 2, F.length("x")))
    return part.select("utt", "x", F.when(F.col("utt") % 5 == 0, F.col("x")).otherwise(short).alias("y"), said.alias("s"))


@query("ali_cer_any_space", rf"{_ASCII} SELECT utt, levenshtein(regexp_replace(x, '\s', '', 'g'), regexp_replace(y, '\s', '', 'g')) / greatest(length(regexp_replace(x, '\s', '', 'g')), 1) AS cer FROM q")
def ali_cer_any_space(spark, sf):
    return latin(spark, sf).select("utt", a.cer_any_space(F.col("x"), F.col("y")).alias("cer"))


@query("ali_cer_library", f"{_ASCII} SELECT utt, CASE WHEN utt % 11 = 0 THEN levenshtein(' ', x) / length(x) ELSE levenshtein(y, x) / length(x) END AS cer FROM q")
def ali_cer_library(spark, sf):
    y = F.when(F.col("utt") % 11 != 0, F.col("y")).otherwise("")
    return latin(spark, sf).select("utt", a.cer_library(F.col("x"), y).alias("cer"))


_SCORE = "greatest(0.0, round_even((1 - levenshtein({r}, y) / greatest(length({r}), 1)) * 100, 1))"


@query("ali_score_delta", f"{_ASCII}, d AS (SELECT utt, {_SCORE.format(r='x')} AS spelling, {_SCORE.format(r='s')} AS phonetic FROM q) SELECT utt, spelling, phonetic, round_even(phonetic - spelling, 1) AS delta, round_even((SELECT avg(phonetic) FROM d), 4) AS mean FROM d")
def ali_score_delta(spark, sf):
    d = latin(spark, sf).select("utt", r.score_delta(F.col("x"), F.col("s"), F.col("y")).alias("d")).select("utt", "d.*")
    # one row with the mean of all
    return d.join(F.broadcast(d.agg(F.bround(F.avg("phonetic"), 4).alias("mean"))))
