"""Writers of segment records, signals, metrics and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hangul import VOCABULARY
from . import wav


def write_splits(rows: DataFrame, folder: str) -> None:
    """JSON lines under split=..., UTF-8 as it is. Rows of a split are written by many tasks."""
    rows.write.partitionBy("split").option("ignoreNullFields", False).json(folder)


def write_signals(rows: DataFrame, folder: str, signal: str = "signal") -> None:
    """The decoded cache: rows without a signal are left out."""
    rows.where(F.col(signal).isNotNull()).write.parquet(folder)


def segment_name(stem: Column, index: Column) -> Column:
    return F.format_string("%s_seg%04d.wav", stem, index)


def segment_signal(signal: Column, start: Column, end: Column, rate: int = 16_000) -> Column:
    """Samples from int(start * rate) up to int(end * rate)."""
    a, b = (start * rate).cast("int"), (end * rate).cast("int")
    return F.slice(signal, a + 1, F.greatest(F.lit(0), b - a))


def write_segments(segments: DataFrame, folder: str, rate: int = 16_000) -> DataFrame:
    """Writes segments (stem, index, start, end, signal) as 16-bit WAV files, named by segment_name, and
    returns what then lies in the folder (path, stem, n_samples, duration). It writes at once, and only
    when all tasks have succeeded do files get their names; those that are there already are left as they
    are, so that a run that was cut short goes on."""
    spark = segments.sparkSession
    wav.register(spark)
    rows = segments.select(segment_name(F.col("stem"), F.col("index")).alias("name"), segment_signal(F.col("signal"), F.col("start"), F.col("end"), rate).alias("signal"))
    rows.write.format("wav").mode("append").option("rate", rate).save(folder)
    return spark.read.format("wav").schema("path string, stem string, n_samples long, duration double").load(folder)


def write_text(report: DataFrame, path: str) -> None:
    """A report of one row as it is."""
    report.select("report").coalesce(1).write.text(path)


def write_vocabulary(spark: SparkSession, path: str) -> None:
    """The vocabulary as one JSON object, token by token."""
    spark.range(1).select(F.to_json(F.create_map(*[F.lit(x) for kv in VOCABULARY.items() for x in kv])).alias("value")).coalesce(1).write.text(path)


def vocabulary_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VOCABULARY.items()), "token string, id int")
