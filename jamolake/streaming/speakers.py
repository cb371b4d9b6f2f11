"""Long-term speaker profiles over streams of evaluation rows, with state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Fixed value: the state store that keeps such state.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A speaker's profile: utterances, raw ones, edits and rule hits in all, the first and the last time.
SUMS = ["n_utterances", "n_raw", "edits", "rule_hits"]
PROFILE = T.StructType([*(T.StructField(c, T.LongType()) for c in SUMS), T.StructField("first_ts", T.TimestampType()), T.StructField("last_ts", T.TimestampType())])
OUTPUT = T.StructType([T.StructField("speaker_id", T.LongType()), *PROFILE.fields])


class Profiles(StatefulProcessor):
    """One profile a speaker, in microseconds and whole numbers, so that neither the order of rows nor the cut into
    batches changes it. A profile is given out, and its state freed, when the watermark is `quiet`
    milliseconds past its last utterance; a speaker who comes back begins a new one."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("profile", T.StructType([*(T.StructField(c, T.LongType()) for c in SUMS), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        parts = [p for p in rows if len(p)]
        given = pd.concat(parts, ignore_index=True)
        given["us"] = given.pop("ts").astype("datetime64[us]").astype("int64")
        done = []
        for r in given.sort_values("us", kind="stable").itertuples(index=False):
            if now is not None and r.us - now[5] > self.quiet_ms * 1000:
                done.append(now)
                now = None
            one = (1, int(r.is_raw), int(r.edits), int(r.rule_hits))
            now = (*one, r.us, r.us) if now is None else (*(a + b for a, b in zip(now, one)), min(now[4], r.us), max(now[5], r.us))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.state.update(tuple(now))
        self.handle.registerTimer(now[5] // 1000 + self.quiet_ms + 1)
        yield self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.state.get()
        self.state.clear()
        yield self._rows(key, [now])

    def _rows(self, key, profiles: list) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], *p) for p in profiles], columns=OUTPUT.names)
        for c in ("first_ts", "last_ts"):
            out[c] = pd.to_datetime(out[c].astype("int64"), unit="us")
        return out

    def close(self) -> None:
        pass


def speaker_profiles(rows: DataFrame, quiet: str = "7 days", late: str = "1 hour") -> DataFrame:
    """(speaker_id, n_utterances, n_raw, edits, rule_hits, first_ts, last_ts) of rows (speaker_id long, ts timestamp,
    is_raw, edits, rule_hits): a profile for each stretch of a speaker's utterances that are no more than
    `quiet` apart. On a stream the watermark closes profiles (append output; rows later than `late` are
    dropped); a batch gives the same rows at once. Rows without speaker or time are left out; null
    flags and numbers count as 0."""
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    rows = rows.where(F.col("speaker_id").isNotNull() & F.col("ts").isNotNull()).select("speaker_id", "ts", whole("is_raw"), whole("edits"), whole("rule_hits"))
    if rows.isStreaming:
        quiet_ms = int(rows.sparkSession.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL '{quiet.split()[0]}' {quiet.split()[1]})").first()[0])
        rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
        return rows.withWatermark("ts", late).groupBy("speaker_id").transformWithStateInPandas(Profiles(quiet_ms), OUTPUT, "Append", "EventTime")
    w = F.session_window("ts", quiet)
    sums = [F.count("*").alias("n_utterances"), F.sum("is_raw").alias("n_raw"), F.sum("edits").alias("edits"), F.sum("rule_hits").alias("rule_hits")]
    return rows.groupBy("speaker_id", w).agg(*sums, F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("session_window")
