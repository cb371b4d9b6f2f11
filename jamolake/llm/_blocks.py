"""Counting keys over the whole corpus, a block of documents at a time.

Documents are stored in blocks of a few megabytes. Each block sends its distinct 64-bit keys
once, sorted and packed, to the parts of the key space; a part sees all blocks' keys together and
answers each block with a packed array in the order it was asked. A key that a third of all rows
hold is thus sent once a block, not once a row, and no row count decides the size of a part.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

#: Text bytes in a block (a longer text is a block of its own), and keys meant for a part.
BLOCK_BYTES, PART_KEYS = 4 << 20, 2_000_000
DATA = "block long, n_docs long, n_bytes long, data binary"
PACKED = "part long, block long, payload binary"


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


def open_block(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_all()


def store_blocks(docs: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stores the columns of docs (one of them text) in blocks of consecutive rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            sizes = np.array(pa.compute.binary_length(b.column("text").cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) + 32
            ends = np.cumsum(sizes)
            at = 0
            while at < b.num_rows:
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + block_bytes, "right")))
                piece = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([pa.array([task + n]), pa.array([to - at]), pa.array([int(ends[to - 1] - done)]), pa.array([_ipc(piece)], pa.binary())], ["block", "n_docs", "n_bytes", "data"])
                at, n = to, n + 1

    return scratch.store(docs.mapInArrow(run, DATA))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, byte by byte of their elements, so that the high bytes of small numbers vanish."""
    out = [struct.pack("<q", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [a.dtype.str.encode().ljust(8), struct.pack("<q", len(a)), a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    (n,), at, out = struct.unpack_from("<q", data), 8, []
    for _ in range(n):
        kind = np.dtype(data[at : at + 8].decode().strip())
        (size,) = struct.unpack_from("<q", data, at + 8)
        end = at + 16 + size * kind.itemsize
        out.append(np.frombuffer(data, np.uint8, size * kind.itemsize, at + 16).reshape(kind.itemsize, size).T.copy().view(kind).reshape(size))
        at = end
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, and keys of them."""
    return np.diff(keys, prepend=keys[:1] * 0)


def to_parts(block: int, parts: int, offset: int, keys: np.ndarray, *more: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows of PACKED for a block's sorted distinct uint64 keys and what goes with each."""
    if not len(keys):
        return []
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(keys)]])
    return [(offset + int(part[a]), block, pack(steps(keys[a:b]), *(m[a:b] for m in more))) for a, b in zip(cuts[:-1], cuts[1:])]


def packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["part", "block", "payload"])


def ask(blocks: DataFrame, keys: Callable[[int, pa.Table], list[tuple[int, int, bytes]]]) -> DataFrame:
    """PACKED rows of every block: keys(block, rows of the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data")):
                yield packed_batch(keys(block, open_block(data.as_py())))

    return blocks.select("block", "data").mapInArrow(run, PACKED)


def answer(asked: DataFrame, reply: Callable[[int, list[np.ndarray], list[list[np.ndarray]]], tuple[list[bytes], list[tuple[int, bytes]]]]) -> DataFrame:
    """PACKED rows back to the blocks. reply(part, keys of each block, what goes with them)
    returns a payload for each block, in order, and further (block, payload) rows, for totals
    under negative block numbers."""

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        blocks = group.column("block").to_pylist()
        opened = [unpack(p.as_py()) for p in group.column("payload")]
        back, extra = reply(part, [np.cumsum(o[0], dtype=np.uint64) for o in opened], [o[1:] for o in opened])
        return pa.Table.from_batches([packed_batch([(part, b, p) for b, p in [*zip(blocks, back), *extra]])])

    return asked.groupBy("part").applyInArrow(run, PACKED)


def together(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, number of each given key, where each block's keys end)."""
    u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return u, inverse, np.cumsum([len(k) for k in keys])


def with_answers(blocks: DataFrame, answers: DataFrame, run: Callable[[int, pa.Table, list[tuple[int, bytes]]], pa.Table], schema: str) -> DataFrame:
    """Each block with its answers, (part, payload) in order of part."""

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        got = sorted(zip(right.column("part").to_pylist(), right.column("payload").to_pylist()))
        out = [run(b, open_block(d.as_py()), got) for b, d in zip(left.column("block").to_pylist(), left.column("data"))]
        return pa.concat_tables(out) if out else run(-1, None, [])

    return blocks.select("block", "data").groupBy("block").cogroup(answers.where(F.col("block") >= 0).groupBy("block")).applyInArrow(joined, schema)


def parts_for(n_keys: float) -> int:
    return max(1, int(-(-n_keys // PART_KEYS)))
