"""Readers of transcripts, labels, audio and earlier results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.g2p import g2p
from ..functions.signals import SAMPLE_RATE
from ..functions.text import first_filled, or_empty, path_stem, strip
from ..operators.filters import duration_between, filled
from ..operators.splits import seeded_sample
from . import wav

SPLITS = ["train", "validation", "test"]
#: A segment record; sources may have fewer of its fields.
SEGMENT = T.StructType([T.StructField(n, k) for n, k in [
    ("wav_path", T.StringType()), ("transcript", T.StringType()), ("label", T.StringType()), ("duration", T.DoubleType()), ("speaker_id", T.StringType()),
    ("segment_idx", T.IntegerType()), ("n_regions", T.IntegerType()), ("n_sentences", T.IntegerType()), ("disease_type", T.StringType()), ("subcategory", T.StringType()),
    ("sex", T.StringType()), ("age", T.StringType()), ("npy_path", T.StringType()),
]])
#: A recording's label document.
SESSION = T.StructType([
    T.StructField("File_id", T.StringType()), T.StructField("Transcript", T.StringType()),
    T.StructField("Patient_info", T.StructType([T.StructField("Sex", T.StringType()), T.StructField("Age", T.StringType())])),
    T.StructField("Disease_info", T.StructType([T.StructField(n, T.StringType()) for n in ("Type", "Subcategory1", "Subcategory2")])),
])
# Parts of a field's name, in this spelling, that tell of times or segments.
KEYWORDS = ["time", "start", "end", "duration", "begin", "offset", "Time", "Start", "End", "Duration", "Begin", "Offset", "sentence", "Sentence", "segment", "Segment", "utterance"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern leads to anything, in whatever store the session reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Segment records of a JSON-lines split; malformed and blank lines are dropped. Prefers the
    cached form, takes what sinks.write_splits wrote too, and is empty if there is no such split."""
    for name in (f"{split}_npy.jsonl", f"{split}.jsonl", f"split={split}"):
        if exists(spark, f"{folder}/{name}"):
            return spark.read.schema(SEGMENT).option("mode", "DROPMALFORMED").json(f"{folder}/{name}")
    return spark.createDataFrame([], SEGMENT)


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for s in SPLITS:
        part = read_split(spark, folder, s).withColumn("split", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out


def load_samples(spark: SparkSession, folder: str, split: str, n: int, low: float, high: float, seed: int = 42, filled_fields: tuple[str, ...] = ("wav_path",), audio: DataFrame | None = None) -> DataFrame:
    """A sample of a split's records to evaluate on: durations between low and high, both excluded,
    those fields not blank, and the file there if an index of audio (path) is given; n rows in hash
    order of the path, all for n <= 0."""
    rows = read_split(spark, folder, split).where(duration_between(F.col("duration"), low, high) & filled(*[F.col(c) for c in filled_fields]))
    if audio is not None:
        rows = rows.join(audio.select(F.col("path").alias("wav_path")), "wav_path", "left_semi")
    return seeded_sample(rows, "wav_path", n, seed)


def load_audio_samples(spark: SparkSession, folder: str, n: int = 200, low: float = 1.0, high: float = 10.0, seed: int = 42, audio: DataFrame | None = None) -> DataFrame:
    """Recordings to run both recognisers on; only the path has to be there."""
    return load_samples(spark, folder, "test", n, low, high, seed, audio=audio)


def load_test_data(spark: SparkSession, folder: str, n: int = 200, low: float = 1.0, high: float = 20.0, seed: int = 42, audio: DataFrame | None = None) -> DataFrame:
    """Recordings to score against their transcript and label."""
    return load_samples(spark, folder, "test", n, low, high, seed, ("wav_path", "transcript", "label"), audio)


def read_pairs(spark: SparkSession, segments: str, split: str, documents: str, audio: str, provider=g2p) -> DataFrame:
    """(wav_path, transcript, label, speaker_id, sex, age): a split's segments if there are any files of
    it, else the label documents that have audio, labelled with their pronunciation."""
    if exists(spark, f"{segments}/{split}_npy.jsonl") or exists(spark, f"{segments}/{split}.jsonl"):
        rows = read_split(spark, segments, split).where(filled(F.col("label"), F.col("wav_path")))
        return rows.select("wav_path", "transcript", "label", "speaker_id", "sex", "age")
    d = read_sessions(spark, documents).where(~F.col("read_error")).select(path_stem(F.coalesce("File_id", F.lit(""))).alias("stem"), strip(F.col("Transcript")).alias("transcript"), or_empty(F.col("Patient_info.Sex")).alias("sex"), or_empty(F.col("Patient_info.Age")).alias("age"))
    d = d.where(filled(F.col("transcript"))).join(audio_index(spark, audio), "stem")
    return d.select(F.col("path").alias("wav_path"), "transcript", strip(provider(F.col("transcript"))).alias("label"), F.col("stem").alias("speaker_id"), "sex", "age")


def read_signals(spark: SparkSession, folder: str) -> DataFrame:
    """The decoded cache that sinks.write_signals wrote; empty (stem, signal) if there is none."""
    return spark.read.parquet(folder) if exists(spark, folder) else spark.createDataFrame([], "stem string, signal array<float>")


def first_documents(spark: SparkSession, folder: str, n: int) -> list[str]:
    """The paths of the first n label documents in order; names alone are read. For trial runs, so n
    is small."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(folder)
    return [r["path"] for r in files.select("path").orderBy("path").limit(n).collect()]


def read_sessions(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Label documents below a folder (or those paths), one row each, with path; broken ones have
    read_error."""
    schema = T.StructType([*SESSION.fields, T.StructField("_broken", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("columnNameOfCorruptRecord", "_broken").json(folder).withColumn("path", F.input_file_name())
    return rows.withColumn("read_error", F.col("_broken").isNotNull()).drop("_broken")


def audio_index(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """(stem, path) of audio files; the last path of a stem. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select(path_stem(F.col("path")).alias("stem"), "path").groupBy("stem").agg(F.max("path").alias("path"))


def read_audio(spark: SparkSession, folder: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """(stem, path, signal): mono samples at 16 kHz, null where a file is no WAV file; recordings of between low
    and high seconds, both included, where these are given, told by headers alone."""
    wav.register(spark)
    bounds = {k: v for k, v in (("minDuration", low), ("maxDuration", high)) if v is not None}
    return spark.read.format("wav").schema("stem string, path string, signal array<float>").option("rate", SAMPLE_RATE).options(**bounds).load(folder)


def audio_durations(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, path, rate, channels, n_samples, duration, error) of WAV files; no samples are read."""
    wav.register(spark)
    return spark.read.format("wav").schema("stem string, path string, rate int, channels int, n_samples long, duration double, error string").load(folder)


def read_results(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """The rows under 'results' of a stored evaluation; none if the key is missing."""
    doc = spark.read.schema(T.StructType([T.StructField("results", T.ArrayType(row))])).option("multiLine", True).json(path)
    return doc.select(F.inline("results"))


def transcript_text(df: DataFrame) -> Column:
    """The first filled one of the keys under which transcripts are found."""
    names = {f.name: f.dataType for f in df.schema}
    keys = [k for k in ("Transcript", "transcript") if k in names]
    if isinstance(names.get("transcription"), T.StructType) and "kor" in names["transcription"].names:
        keys.append("transcription.kor")
    keys += [k for k in ("발화내용", "text") if k in names]
    return first_filled(*[F.col(k) for k in keys]) if keys else F.lit(None).cast("string")


def schema_paths(schema: T.DataType, depth: int = 3, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) of all fields down to a depth; the elements of arrays under []."""
    out = []
    if depth and isinstance(schema, T.StructType):
        for f in schema.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            out.append((path, f.dataType.simpleString()))
            out += schema_paths(f.dataType, depth - 1, path)
    elif isinstance(schema, T.ArrayType):
        out += schema_paths(schema.elementType, depth, f"{prefix}[]")
    return out


def time_fields(schema: T.StructType, keywords: list[str] = KEYWORDS) -> list[tuple[str, str]]:
    """Fields whose own name holds one of the keywords, spelled like that."""
    return [(p, t) for p, t in schema_paths(schema, 99) if any(k in p.rsplit(".", 1)[-1] for k in keywords)]


def count_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines that are not blank."""
    return spark.read.text(pattern).where(F.trim("value") != "").agg(F.count("*").alias("n"))
