"""Texts of an Arrow batch as one array of code points, for what is done letter by letter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that are worked on together; a longer text stands alone.
LETTERS = 1_000_000


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > LETTERS:
            yield texts[at:i]
            at, size = i, 0
        size += len(t or "")
    yield texts[at:]


def _array(codes: np.ndarray, ends: np.ndarray, null: np.ndarray) -> pa.Array:
    """Strings of code points that end at these places."""
    size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])].astype(np.int32)
    text = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
    valid = np.packbits(~null, bitorder="little").tobytes()
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text), pa.py_buffer(valid), -1)


def letterwise(change: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]):
    """A UDF from text to text by a function of all code points of some texts, their places in their own text and
    the numbers of their texts: it returns the new code points in order and how many stand for each old one.
    Null stays null."""

    @F.arrow_udf(T.StringType())
    def run(text: pa.Array) -> pa.Array:
        out = []
        for some in _slices(text.to_pylist()):
            n = np.array([len(t or "") for t in some], dtype=np.int64)
            codes = np.frombuffer("".join(t or "" for t in some).encode("utf-32-le"), "<u4").astype(np.int64)
            ends = np.cumsum(n)
            row = np.repeat(np.arange(len(some)), n)
            new, times = change(codes, np.arange(len(codes)) - np.repeat(ends - n, n), row)
            out.append(_array(new, np.concatenate([[0], np.cumsum(times)])[ends], np.array([t is None for t in some], dtype=bool)))
        return pa.concat_arrays(out)

    return run
