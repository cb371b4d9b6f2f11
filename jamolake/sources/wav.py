"""Folders of WAV files as a Spark data source.

    spark.read.format("wav").load(folder)              all columns of COLUMNS
    spark.read.format("wav").schema("path string, duration double").load(folder)
    segments.write.format("wav").mode("append").option("rate", 16000).save(folder)

The schema that is asked for decides what is read: without `signal`, headers alone. Files are listed
once and dealt to tasks by bytes. Writers put files into a folder of the job; they get their places
when all tasks have succeeded, so a failed job leaves nothing and a task that is run again does no
harm. Files that are there already are left as they are, so a run that was cut short goes on.

Folders are opened by Arrow (local paths, file:, hdfs:, s3:, gs:) on the driver and in tasks.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.signals import resample_one
from . import riff

COLUMNS = T.StructType([T.StructField(n, k) for n, k in [
    ("path", T.StringType()), ("stem", T.StringType()), ("rate", T.IntegerType()), ("channels", T.IntegerType()), ("bits", T.IntegerType()),
    ("n_samples", T.LongType()), ("duration", T.DoubleType()), ("signal", T.ArrayType(T.FloatType())), ("error", T.StringType()),
]])
#: Bytes of files that a task gets, what opening a file counts as, and bytes of samples in a batch.
PARTITION_BYTES, OPEN_BYTES, BATCH_BYTES = 64 << 20, 64 << 10, 16 << 20


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


@dataclass
class Files(InputPartition):
    found: list[tuple[str, int]] = field(default_factory=list)


class WavReader(DataSourceReader):
    """Options: rate (mono signals at this rate; else at the file's own), minDuration and maxDuration in seconds,
    both included, partitionBytes, ending (of names; .wav). A file that cannot be read
    gives a row with error, and nulls where nothing is known. Duration filters drop such rows."""

    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        if unknown := [f.name for f in schema if f.name not in COLUMNS.names]:
            raise ValueError(f"no such columns of WAV files: {unknown}")
        self.names, self.folder = schema.names, options["path"]
        self.rate = int(options.get("rate", 0)) or None
        self.low, self.high = (float(v) if (v := options.get(k)) is not None else None for k in ("minDuration", "maxDuration"))
        self.strict_low = self.strict_high = None
        self.bytes, self.ending = int(options.get("partitionBytes", PARTITION_BYTES)), options.get("ending", ".wav")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of duration are checked as soon as a header is read."""
        places = {GreaterThan: ("strict_low", max), GreaterThanOrEqual: ("low", max), LessThan: ("strict_high", min), LessThanOrEqual: ("high", min)}
        for f in filters:
            if type(f) in places and f.attribute == ("duration",):
                name, pick = places[type(f)]
                have = getattr(self, name)
                setattr(self, name, float(f.value) if have is None else pick(have, float(f.value)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, path = _open(self.folder)
        found = sorted((i.path, i.size) for i in store.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True)) if i.is_file and i.path.endswith(self.ending) and not any(part[:1] in "._" for part in i.path[len(path) :].strip("/").split("/")))
        out, held = [Files()], 0
        for f in found:
            cost = OPEN_BYTES + (f[1] if "signal" in self.names else 0)
            if out[-1].found and held + cost > self.bytes:
                out.append(Files())
                held = 0
            out[-1].found.append(f)
            held += cost
        return out

    def _fits(self, duration: float) -> bool:
        return (self.low is None or duration >= self.low) and (self.high is None or duration <= self.high) and (self.strict_low is None or duration > self.strict_low) and (self.strict_high is None or duration < self.strict_high)

    def _row(self, store: pafs.FileSystem, path: str, size: int) -> dict | None:
        row = dict.fromkeys(COLUMNS.names) | {"path": path, "stem": posixpath.splitext(posixpath.basename(path))[0]}
        try:
            with store.open_input_file(path) as file:
                h = riff.read_header(file, size)
                if not self._fits(h.duration):
                    return None
                row |= {"rate": h.rate, "channels": h.channels, "bits": h.bits, "n_samples": h.n_samples, "duration": h.duration}
                if "signal" in self.names:
                    file.seek(h.start)
                    x = riff.samples(h, file.read(h.n_bytes))
                    row["signal"] = (resample_one(x, h.rate, self.rate) if self.rate else x).astype(np.float32)
        except (riff.NotWav, OSError) as e:
            bounded = any(v is not None for v in (self.low, self.high, self.strict_low, self.strict_high))
            return None if bounded and row["duration"] is None else row | {"error": f"{type(e).__name__}: {e}"}
        return row

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.folder)
        rows, held = [], 0
        for path, size in partition.found:
            if row := self._row(store, path, size):
                rows.append(row)
                held += 256 + (0 if row["signal"] is None else row["signal"].nbytes)
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"rate": pa.int32(), "channels": pa.int32(), "bits": pa.int32(), "n_samples": pa.int64(), "duration": pa.float64(), "signal": pa.list_(pa.float32())}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in self.names], self.names)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class WavWriter(DataSourceArrowWriter):
    """Rows (name string, signal array<float or double>) as 16-bit mono files; a null signal writes none. Of rows
    with one name, one stays. Option: rate (16000)."""

    def __init__(self, schema: T.StructType, options: Mapping[str, str], overwrite: bool):
        if {"name", "signal"} - set(schema.names):
            raise ValueError("WAV files are written from the columns name and signal")
        self.folder, self.rate, self.overwrite = options["path"], int(options.get("rate", 16_000)), overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _open(self.folder)
        own, names = f"{path}/{self.job}/{uuid.uuid4().hex}", {}
        store.create_dir(own)
        for b in iterator:
            given, signals = b.column("name").to_pylist(), b.column("signal")
            there = [False] * len(given) if self.overwrite else [i.type != pafs.FileType.NotFound for i in store.get_file_info([f"{path}/{n}" for n in given])]
            for n, done, x in zip(given, there, signals):
                if done or n in names or not x.is_valid:
                    continue
                with store.open_output_stream(f"{own}/{n}") as out:
                    out.write(riff.encode(x.values.cast(pa.float64()).to_numpy(zero_copy_only=False), self.rate))
                names[n] = None
        return Written(own, list(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _open(self.folder)
        if self.overwrite:
            keep = {n for m in messages if m for n in m.names}
            old = store.get_file_info(pafs.FileSelector(path, allow_not_found=True))
            for i in old:
                if i.is_file and i.base_name.endswith(".wav") and i.base_name not in keep:
                    store.delete_file(i.path)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: [store.move(f"{m.folder}/{n}", f"{path}/{n}") for n in m.names], [m for m in messages if m]))
        self._clean(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*_open(self.folder))

    def _clean(self, store: pafs.FileSystem, path: str) -> None:
        if store.get_file_info(f"{path}/{self.job}").type != pafs.FileType.NotFound:
            store.delete_dir(f"{path}/{self.job}")


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> T.StructType:
        return COLUMNS

    def reader(self, schema: T.StructType) -> WavReader:
        return WavReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WavWriter:
        return WavWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes format("wav") known to a session, which hands filters to such sources from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(WavSource)
