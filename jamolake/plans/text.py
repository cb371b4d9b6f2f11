"""Queries of the text functions: letters, pronunciation, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hangul as h
from ..functions import text as t
from ..functions.g2p import g2p
from ..functions.phonology import NASAL, PALATAL, TENSE, classify
from ._registry import registry
from .base import SENT, UTT, sentences, sql_jamo, sql_split, sql_text, table, utterances

QUERIES, ORACLES, query = registry()
_I, _V, _F = h.INITIALS, h.VOWELS, h.FINALS


@query("fn_decompose", f"""WITH {UTT}, c AS (SELECT unnest(cx) AS c FROM utt)
SELECT substr('{_I}', ((c - 44032) // 588 + 1)::INTEGER, 1) AS initial, substr('{_V}', ((c - 44032) % 588 // 28 + 1)::INTEGER, 1) AS vowel,
  CASE WHEN (c - 44032) % 28 > 0 THEN substr('{_F}', ((c - 44032) % 28 + 1)::INTEGER, 1) END AS final, count(*) AS n
FROM c WHERE c >= 44032 GROUP BY ALL""")
def fn_decompose(spark, sf):
    c = utterances(spark, sf).select(F.explode(h.chars(F.col("x"))).alias("c")).select(h.decompose(F.col("c")).alias("d")).where("d IS NOT NULL")
    return c.groupBy("d.initial", "d.vowel", "d.final").agg(F.count("*").alias("n"))


@query("fn_compose_roundtrip", f"WITH {UTT} SELECT role, count(*) AS n, count(*) AS n_same FROM utt, unnest(cx) AS u(c) WHERE c >= 44032 GROUP BY role")
def fn_compose_roundtrip(spark, sf):
    c = utterances(spark, sf).select("role", F.explode(h.chars(F.col("x"))).alias("c")).withColumn("code", F.ascii("c")).where(h.is_syllable(F.col("code")))
    back = h.compose(h.initial_of(F.col("code")), h.vowel_of(F.col("code")), h.final_of(F.col("code")))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.count_if(back == F.col("c")).alias("n_same"))


@query("fn_text_to_jamo", f"WITH {UTT} SELECT utt, {sql_jamo('cx')} AS jamo, length({sql_jamo('cx')})::BIGINT AS n FROM utt")
def fn_text_to_jamo(spark, sf):
    a = utterances(spark, sf).withColumn("letters", h.text_to_jamo(F.col("x")))
    return a.select("utt", F.array_join("letters", "").alias("jamo"), F.size("letters").cast("long").alias("n"))


_BARRED = sql_jamo("cx", other="CASE WHEN c = 32 THEN '|' ELSE '' END")


@query("fn_syllable_to_jamo", f"WITH {UTT} SELECT utt, {_BARRED} AS jamo FROM utt")
def fn_syllable_to_jamo(spark, sf):
    return utterances(spark, sf).select("utt", h.syllable_to_jamo(F.col("x")).alias("jamo"))


@query("fn_jamo_to_syllable", f"WITH {UTT} SELECT utt, regexp_replace(trim({sql_text('cx')}), ' +', ' ', 'g') AS text FROM utt")
def fn_jamo_to_syllable(spark, sf):
    return utterances(spark, sf).select("utt", h.jamo_to_syllable(h.syllable_to_jamo(F.col("x"))).alias("text"))


_IDS = "map {" + ", ".join(f"'{k}': {v}" for k, v in h.VOCABULARY.items()) + "}"


@query("fn_vocab_encode", f"""WITH {UTT}, j AS (SELECT utt, {sql_jamo('cx')} AS jamo, {_IDS} AS ids FROM utt),
e AS (SELECT utt, list_transform(string_split(jamo, ''), lambda c: coalesce(ids[c], {h.UNKNOWN})) AS l FROM j)
SELECT utt, array_to_string(l, ' ') AS tokens, len(l)::BIGINT AS n FROM e""")
def fn_vocab_encode(spark, sf):
    a = utterances(spark, sf).withColumn("l", h.encode(h.jamo_string(F.col("x"))))
    return a.select("utt", F.array_join(F.transform("l", lambda v: v.cast("string")), " ").alias("tokens"), F.size("l").cast("long").alias("n"))


_TOKENS = ", ".join(f"'{c}'" for c in h.VOCABULARY)


@query("set_vocab_diff", f"WITH c AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS c FROM documents) SELECT lang, c FROM c WHERE c NOT IN ({_TOKENS})")
def set_vocab_diff(spark, sf):
    missing = table(spark, sf, "documents").select("lang", F.explode(h.out_of_vocabulary(F.col("text"))).alias("c"))
    return missing.distinct()


@query("fn_syllable_groups", f"WITH {UTT} SELECT utt, (2 * len(string_split({sql_text('cx')}, ' ')) - 1)::BIGINT AS n_groups FROM utt")
def fn_syllable_groups(spark, sf):
    return utterances(spark, sf).select("utt", F.size(h.syllable_groups(F.col("x"))).cast("long").alias("n_groups"))


@query("fn_g2p", f"WITH {UTT} SELECT s.utt, {sql_text('s.cx')} AS x, {sql_text('s.cg')} AS spoken FROM spoken s")
def fn_g2p(spark, sf):
    return utterances(spark, sf).select("utt", "x", g2p(F.col("x")).alias("spoken"))


@query("fn_split_transcript", f"""WITH l AS (SELECT doc_id, {sql_split('text')} AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS n_sentences, md5(array_to_string(l, '|')) AS digest FROM l""")
def fn_split_transcript(spark, sf):
    l = table(spark, sf, "documents").select("doc_id", t.split_transcript(F.col("text")).alias("l"))
    return l.select("doc_id", F.size("l").cast("long").alias("n_sentences"), F.md5(F.array_join("l", "|")).alias("digest"))


@query("fn_parse_transcript", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(
  regexp_replace(regexp_replace(regexp_replace(text, 'b/', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '[.!?]'),
  lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: length(p) >= 3) AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS n_sentences, md5(array_to_string(l, '|')) AS digest FROM l""")
def fn_parse_transcript(spark, sf):
    l = table(spark, sf, "documents").select("doc_id", t.parse_transcript(F.col("text")).alias("l"))
    return l.select("doc_id", F.size("l").cast("long").alias("n_sentences"), F.md5(F.array_join("l", "|")).alias("digest"))


@query("fn_text_cleanup", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[^가-힣a-zA-Z0-9\s]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS letters,
  md5(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS squeezed FROM documents""")
def fn_text_cleanup(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(t.keep_letters(F.col("text"))).alias("letters"), F.md5(t.collapse_spaces(F.col("text"))).alias("squeezed"))


_RULES = "CASE " + " ".join(f"WHEN e = '{e}' AND a = '{a}' THEN '{name}'" for name, m in (("tensification", TENSE), ("palatalization", PALATAL), ("nasalization", NASAL)) for e, a in m.items()) + " ELSE 'other' END"


@query("fn_classify", f"""WITH {UTT}, j AS (SELECT {sql_jamo('cx')} AS x, {sql_jamo('cy')} AS y FROM utt),
p AS (SELECT e, y, o FROM j, unnest(string_split(x, '')) WITH ORDINALITY AS u(e, o)),
q AS (SELECT e, substr(y, o::INTEGER, 1) AS a FROM p WHERE o <= length(y))
SELECT {_RULES} AS category, count(*) AS n FROM q WHERE e <> a GROUP BY 1""")
def fn_classify(spark, sf):
    j = utterances(spark, sf).select(F.arrays_zip(h.text_to_jamo(F.col("x")).alias("e"), h.text_to_jamo(F.col("y")).alias("a")).alias("z")).select(F.inline("z"))
    return j.where("e <> a").groupBy(classify(F.col("e"), F.col("a")).alias("category")).agg(F.count("*").alias("n"))


_ENDINGS = t.COHERENT_ENDINGS


@query("flt_coherent", rf"""WITH {UTT}, t AS (SELECT role, {sql_text('cy')} AS y FROM utt)
SELECT role, count(*) AS n, count_if(length(y) >= 5 AND length(regexp_replace(y, '[^가-힣]', '', 'g')) >= 0.7 * length(y) AND regexp_matches(y, '[{_ENDINGS}]'))::BIGINT AS n_coherent FROM t GROUP BY role""")
def flt_coherent(spark, sf):
    return utterances(spark, sf).groupBy("role").agg(F.count("*").alias("n"), F.count_if(t.is_coherent(F.col("y"))).alias("n_coherent"))


@query("fn_match_rate", rf"""WITH {UTT}, t AS (SELECT utt, {sql_text('cx')} AS x, {sql_text('cy')} AS y FROM utt)
SELECT utt, coalesce((SELECT count(*) FROM unnest(string_split(x, '')) WITH ORDINALITY AS u(c, o) WHERE o <= length(y) AND substr(y, o::INTEGER, 1) = c)::DOUBLE / nullif(greatest(length(x), length(y)), 0), 0) AS rate FROM t""")
def fn_match_rate(spark, sf):
    return utterances(spark, sf).select("utt", t.match_rate(F.col("x"), F.col("y")).alias("rate"))


@query("prj_path_stem", r"SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+?)(?:\.[^./]*)?$', 1) AS stem FROM pages")
def prj_path_stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.path_stem(F.regexp_replace("url", r"[?#].*$", "")).alias("stem"))


@query("prj_first_filled", "SELECT conv_id, turn, coalesce(nullif(CASE WHEN role = 'user' THEN '' ELSE role END, ''), nullif(text, '')) AS v FROM conversations")
def prj_first_filled(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", t.first_filled(F.when(F.col("role") == "user", "").otherwise(F.col("role")), F.col("text")).alias("v"))


@query("prj_grade", """WITH s AS (SELECT event_id, greatest(0, round_even((1 - least(value, 100) / 100) * 100, 1)) AS score FROM events)
SELECT CASE WHEN score >= 95 THEN 'perfect' WHEN score >= 85 THEN 'great' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'practise' ELSE 'together' END AS grade,
  CASE WHEN score >= 80 THEN 'green' WHEN score >= 50 THEN 'yellow' ELSE 'red' END AS colour,
  repeat('█', floor(score / 5)::INTEGER) || repeat('░', (20 - floor(score / 5))::INTEGER) AS bar, count(*) AS n FROM s GROUP BY ALL""")
def prj_grade(spark, sf):
    s = table(spark, sf, "events").select(t.percent_score(F.least("value", F.lit(100.0)) / 100).alias("score"))
    return s.groupBy(t.grade(F.col("score")).alias("grade"), t.colour(F.col("score")).alias("colour"), t.bar(F.col("score")).alias("bar")).agg(F.count("*").alias("n"))


@query("src_count_lines", "SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) q WHERE trim(line) <> ''")
def src_count_lines(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.trim("line") != "").agg(F.count("*").alias("n"))


@query("src_utterances", f"WITH {SENT} SELECT utt, role, s FROM sent")
def src_utterances(spark, sf):
    return sentences(spark, sf).select("utt", "role", "s")


@query("prj_grade_of_four", """WITH s AS (SELECT event_id, greatest(0, round_even((1 - least(value, 100) / 100) * 100, 1)) AS score FROM events)
SELECT CASE WHEN score >= 90 THEN 'great' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'practise' ELSE 'together' END AS grade, count(*) AS n FROM s GROUP BY grade""")
def prj_grade_of_four(spark, sf):
    s = table(spark, sf, "events").select(t.percent_score(F.least("value", F.lit(100.0)) / 100).alias("score"))
    return s.groupBy(t.grade_of_four(F.col("score")).alias("grade")).agg(F.count("*").alias("n"))


@query("fn_compose_text", f"WITH {UTT} SELECT utt, {sql_text('cx')} AS text FROM utt")
def fn_compose_text(spark, sf):
    def again(c):
        code = F.ascii(c)
        return F.when(h.is_syllable(code), h.compose(h.initial_of(code), h.vowel_of(code), h.final_of(code))).otherwise(c)

    return utterances(spark, sf).select("utt", F.array_join(F.transform(h.chars(F.col("x")), again), "").alias("text"))


@query("fn_group_letters", f"""WITH {UTT}, w AS (SELECT utt, string_split({sql_jamo('cx')}, ' ') AS l FROM utt)
SELECT utt, array_to_string(list_transform(l, lambda x: array_to_string(string_split(x, ''), '-')), '/ /') AS letters FROM w""")
def fn_group_letters(spark, sf):
    groups = F.transform(h.syllable_groups(F.col("x")), lambda g: F.array_join(g, "-"))
    return utterances(spark, sf).select("utt", F.array_join(groups, "/").alias("letters"))


@query("fn_joined_letters", f"WITH {UTT} SELECT utt, replace({sql_jamo('cx')}, ' ', '') AS letters FROM utt")
def fn_joined_letters(spark, sf):
    return utterances(spark, sf).select("utt", h.joined_letters(F.col("x")).alias("letters"))
