"""Shared helpers of the training-data operators: scratch tables, tokens, window hashes."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that a Python worker gets at once: whole texts are long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """Adds a row number that tells repeated rows apart. Numbers differ from one reading to the
    next, so the table has to be stored with them before anything reads it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def free_name(df: DataFrame, name: str) -> str:
    """That name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


class Scratch:
    """Intermediate tables in the shared folder that the session names in spark.checkpoint.dir.
    Where that is unset a local session gets a folder of its own; a cluster gets an error, as
    its executors share no temporary folder. Cuts lineage, survives lost executors, and drops
    what later steps no longer read. Results read what is left, so it stays until clear()."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.gettempdir()}/jamolake-scratch"
        self.spark, self.base = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def store(self, df: DataFrame, batch_rows: int = BATCH_ROWS, compression: str | None = None) -> DataFrame:
        """Writes df, frees its shuffle files, and returns the stored table. Python workers get
        batch_rows rows at once."""
        path = f"{self.base}/{self.n}"
        self.n += 1
        with shuffles_freed(self.spark, batch_rows):
            df.write.parquet(path, compression=compression)
        out = self.spark.read.parquet(path)
        out._scratch_path = path
        return out

    def numbered(self, df: DataFrame, name: str = "rid") -> DataFrame:
        """df stored with a row number."""
        return self.store(with_row_id(df, name), compression="zstd")

    def drop(self, *dfs: DataFrame) -> None:
        """Deletes stored tables that nothing reads any more."""
        for df in dfs:
            self._delete(df._scratch_path)

    def clear(self) -> None:
        """Deletes all stored tables; for callers that have written what was made of them."""
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession, batch_rows: int = BATCH_ROWS):
    """Within it, a query's shuffle files go when the query ends, and Python workers get at most
    batch_rows rows at once."""
    before = {k: spark.conf.get(k) for k in (_CLEANUP, _BATCH)}
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_BATCH, str(min(batch_rows, int(before[_BATCH]) or batch_rows)))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_bytes(b: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about that many bytes of a text column each; a longer text stands alone."""
    sizes = pc.binary_length(b.column(column).cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield b.slice(at, to - at)
        at = to


# --- tokens and hashes inside tasks (numpy and Arrow) -----------------------------------------

def tokenize(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words [^\\x20\\x09-\\x0D]+ of a column of texts: (offsets of each text, word numbers, the
    distinct words). Null texts have no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.offset:  # ascii_lower misreads slices of large strings
        texts = pa.concat_arrays([texts])
    assert texts.offset == 0
    texts = texts.cast(pa.large_string()).fill_null("")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().dictionary_encode()
    words, ids = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    if blank >= 0:  # pieces before a leading or after a trailing space
        keep = ids != blank
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        ids = ids[keep]
    return bounds, ids, words


def word_keys(words: pa.Array) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit name of the pair (a, b); not symmetric."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b + np.uint64(0x7F4A7C15F39CC060)) * np.uint64(0xC2B2AE3D27D4EB4F))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return x


def ahead(a: np.ndarray, k: int) -> np.ndarray:
    """a[i + k] at i; zeros at the end."""
    out = np.zeros_like(a)
    if k < len(a):
        out[: len(a) - k] = a[k:]
    return out


def windows(keys: np.ndarray, width: int) -> np.ndarray:
    """Names of the windows of that many keys starting at each place, by doubling: a window of
    twice the length is the pair of its halves, any other length the pair of two that overlap.
    Places whose window would leave the text have meaningless names."""
    h, have = keys, 1
    while have * 2 <= width:
        h, have = mix(h, ahead(h, have)), have * 2
    return h if have == width else mix(h, ahead(h, width - have))


def room(bounds: np.ndarray) -> np.ndarray:
    """Words from each place to the end of its text."""
    lens = np.diff(bounds)
    return np.repeat(bounds[1:], lens) - np.arange(bounds[0], bounds[-1])
