"""Relations that the queries share, each as a DataFrame and as SQL for the oracle.

Utterances are the sentences of all conversations. As no table holds Hangul, each character but
a space stands for the syllable U+AC00 + (code point * 7919 + place * 31) % 11172; x is that
text, y its pronunciation without every 11th character.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions._flat import letterwise
from ..functions.g2p import RULES, g2p
from ..functions.hangul import FINALS, FIRST, INITIALS, VOWELS
from ..functions.text import split_transcript


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a conversation's text in a task, and tasks at most.
PIECE_ROWS, MOST_PIECES = 1000, 20_000


def spread(df: DataFrame, rows: int = PIECE_ROWS) -> DataFrame:
    """A stored table over tasks of about so many rows, over all cores at least: what is done with each of these
    rows costs far more than moving it, and files, whose texts are packed, say little of that. Rows are counted
    in the files' footers."""
    pieces = min(MOST_PIECES, -(-df.count() // rows))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, pieces))


@letterwise
def stand_in(codes, place, row):
    return np.where(codes == 32, 32, FIRST + (codes * 7919 + place * 31) % 11172), np.ones(len(codes), dtype=np.int64)


@letterwise
def drop_eleventh(codes, place, row):
    kept = (place + 1) % 11 != 0
    return codes[kept], kept.astype(np.int64)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return t.select("conv_id", "turn", "role", F.posexplode(split_transcript(F.col("text"))).alias("pos", "s")).withColumn("pos", F.col("pos").cast("long")).withColumn("utt", F.col("conv_id") * 1_000_000 + F.col("turn") * 10_000 + F.col("pos"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt, conv_id, role, x, y); conv_id is the speaker. Stored nowhere: text goes through
    each function once."""
    return sentences(spark, sf_dir).select("utt", "conv_id", "role", stand_in(F.col("s")).alias("x")).withColumn("y", drop_eleventh(g2p(F.col("x"))))


# --- the same in SQL -------------------------------------------------------------------------

_ASCII = {c: chr(48 + i) for i, c in enumerate(dict.fromkeys(INITIALS + VOWELS + FINALS.strip()))}
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def sql_split(text: str) -> str:
    inner = rf"regexp_replace(regexp_replace({text}, '\s*b/\s*', ' ', 'g'), '\s*[a-z]/\s*', ' ', 'g')"
    return rf"list_filter(list_transform(regexp_split_to_array({_STRIP.format(inner)}, '[.?!。]\s*'), lambda p: {_STRIP.format('p')}), lambda p: length(p) >= 2)"


def sql_jamo(codes: str, ascii_letters: bool = False, other: str = "chr(c::INTEGER)") -> str:
    """Letters of a list of code points; one ASCII character a letter for byte-wise functions."""
    i, v, f = (("".join(_ASCII.get(c, " ") for c in t) if ascii_letters else t).replace("'", "''") for t in (INITIALS, VOWELS, FINALS))
    return f"array_to_string(list_transform({codes}, lambda c: CASE WHEN c >= {FIRST} THEN substr('{i}', ((c - {FIRST}) // 588 + 1)::INTEGER, 1) || substr('{v}', ((c - {FIRST}) % 588 // 28 + 1)::INTEGER, 1) || CASE WHEN (c - {FIRST}) % 28 > 0 THEN substr('{f}', ((c - {FIRST}) % 28 + 1)::INTEGER, 1) ELSE '' END ELSE {other} END), '')"


def sql_text(codes: str) -> str:
    return f"array_to_string(list_transform({codes}, lambda c: chr(c::INTEGER)), '')"


_KEY = "CASE WHEN {a} >= 44032 AND {b} >= 44032 THEN (({a} - 44032) % 28) * 19 + ({b} - 44032) // 588 END"
_NF = "map {" + ", ".join(f"{k}: {v[0]}" for k, v in RULES.items()) + "}"
_NI = "map {" + ", ".join(f"{k}: {v[1]}" for k, v in RULES.items()) + "}"

SENT = f"""sent AS (SELECT conv_id, turn, role, o - 1 AS pos, s, conv_id * 1000000 + turn * 10000 + o - 1 AS utt
  FROM (SELECT conv_id, turn, role, {sql_split('text')} AS l FROM conversations) q, unnest(l) WITH ORDINALITY AS u(s, o))"""
UTT = f"""{SENT},
coded AS (SELECT utt, conv_id, role, list_transform(string_split(s, ''), lambda c, i: CASE WHEN c = ' ' THEN 32 ELSE 44032 + (unicode(c)::BIGINT * 7919 + (i - 1) * 31) % 11172 END) AS cx FROM sent),
ruled AS (SELECT utt, conv_id, role, cx, {_NF} AS nf, {_NI} AS ni FROM coded),
spoken AS (SELECT utt, conv_id, role, cx, list_transform(cx, lambda c, i: CASE WHEN c >= 44032 THEN
  c - (c - 44032) // 588 * 588 - (c - 44032) % 28 + coalesce(ni[{_KEY.format(a='cx[i - 1]', b='c')}], (c - 44032) // 588) * 588 + coalesce(nf[{_KEY.format(a='c', b='cx[i + 1]')}], (c - 44032) % 28) ELSE c END) AS cg FROM ruled),
utt AS (SELECT utt, conv_id, role, cx, list_filter(cg, lambda c, i: i % 11 <> 0) AS cy FROM spoken)"""

# Blocks in common of lists a and b of a relation j: windows of the level before are cut at their longest run; a run's place is one number, the greatest first.
SQL_BLOCKS = """same AS (SELECT utt, i, j, i - row_number() OVER (PARTITION BY utt, i - j ORDER BY i) AS island FROM (SELECT utt, a, b, i, unnest(range(0, len(b))) AS j FROM (SELECT utt, a, b, unnest(range(0, len(a))) AS i FROM j) q) q WHERE a[i + 1] = b[j + 1]),
runs AS MATERIALIZED (SELECT utt, i, j, max(i) OVER (PARTITION BY utt, i - j, island) + 1 - i AS n FROM same),
w AS (SELECT utt, 0::BIGINT AS a1, len(a)::BIGINT AS a2, 0::BIGINT AS b1, len(b)::BIGINT AS b2, max(n * 10000000000 + (99999 - i) * 100000 + 99999 - runs.j)::BIGINT AS best FROM j JOIN runs USING (utt) GROUP BY ALL
  UNION ALL SELECT utt, a1, a2, b1, b2, max(least(n, a2 - runs.i, b2 - runs.j) * 10000000000 + (99999 - runs.i) * 100000 + 99999 - runs.j)::BIGINT FROM
  (SELECT utt, unnest([a1, i + k]) AS a1, unnest([i, a2]) AS a2, unnest([b1, j + k]) AS b1, unnest([j, b2]) AS b2 FROM (SELECT *, best // 10000000000 AS k, 99999 - best // 100000 % 100000 AS i, 99999 - best % 100000 AS j FROM w) q) c
  JOIN runs USING (utt) WHERE runs.i >= a1 AND runs.i < a2 AND runs.j >= b1 AND runs.j < b2 GROUP BY utt, a1, a2, b1, b2),
bl AS (SELECT utt, 99999 - best // 100000 % 100000 AS i, 99999 - best % 100000 AS j, best // 10000000000 AS k FROM w)"""
SQL_OPERATIONS = """e AS (SELECT * FROM bl UNION ALL SELECT utt, len(a), len(b), 0 FROM j),
g AS (SELECT utt, i, j, k, lag(i + k, 1, 0) OVER o AS i0, lag(j + k, 1, 0) OVER o AS j0 FROM e WINDOW o AS (PARTITION BY utt ORDER BY i, j, k DESC)),
t AS (SELECT utt, i, 0 AS part, CASE WHEN i0 < i AND j0 < g.j THEN 'replace' WHEN i0 < i THEN 'delete' ELSE 'insert' END AS type, array_to_string(a[i0 + 1 : i], '') AS ref, array_to_string(b[j0 + 1 : g.j], '') AS hyp FROM g JOIN j USING (utt) WHERE i0 < i OR j0 < g.j
  UNION ALL SELECT utt, i, 1, 'equal', array_to_string(a[i + 1 : i + k], ''), array_to_string(b[g.j + 1 : g.j + k], '') FROM g JOIN j USING (utt) WHERE k > 0)"""
