"""Providers: functions from texts to texts (pronunciations, transcripts) that are opened in workers and may
fail, with a second one to fall back on."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A provider takes texts and returns as many; opening gives one (a model is loaded there).
Provider = Callable[[list[str]], list[str | None]]
BATCH_BYTES = 1 << 20
_OPENED: dict[str, Provider | Exception] = {}
_MOST_OPENED = 4


def _opened(key: str, open_provider: Callable[[], Provider]) -> Provider | Exception:
    """The provider as this worker opened it first, or why it could not; tasks that come to the same worker
    later find it open."""
    if key not in _OPENED:
        while len(_OPENED) >= _MOST_OPENED:
            _OPENED.pop(next(iter(_OPENED)))
        try:
            _OPENED[key] = open_provider()
        except Exception as e:  # any provider may fail in any way; the row says how
            _OPENED[key] = e
    return _OPENED[key]


def _tried(provider: Provider | Exception, texts: list[str]) -> list[tuple[str | None, str | None]]:
    """(result, error) of each text. A batch that fails is halved until the texts that fail stand alone."""
    if isinstance(provider, Exception):
        return [(None, f"{type(provider).__name__}: {provider}")] * len(texts)
    try:
        out = provider(texts)
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} results of {len(texts)} texts")
        return [(x, None) for x in out]
    except Exception as e:
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return _tried(provider, texts[:half]) + _tried(provider, texts[half:])


def provide(rows: DataFrame, text: str, first: Callable[[], Provider], second: Callable[[], Provider] | None = None, out: str = "label", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """rows with `out`, `provider` (1 or 2, null where neither gave a result) and `error` (the last provider's, null if
    one gave a result; a provider's null result is a result). Null texts are not asked for and get
    nulls. Texts go to a provider in batches of about that many bytes; a longer text goes alone. Columns of
    rows with the new names are replaced."""
    keys, new = [uuid.uuid4().hex for _ in range(2)], [out, "provider", "error"]
    kept = [c for c in rows.columns if c not in new]
    source = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("_asked"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def answers(texts: list[str]) -> list[tuple[str | None, int | None, str | None]]:
        got = [(x, None if e else 1, e) for x, e in _tried(_opened(keys[0], first), texts)]
        failed = [i for i, (_, _, e) in enumerate(got) if e]
        if failed and second:
            for i, (x, e) in zip(failed, _tried(_opened(keys[1], second), [texts[i] for i in failed])):
                got[i] = (x, None if e else 2, e)
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(len(kept))), 0).to_numpy(zero_copy_only=False)), 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + batch_bytes, "right")))
                piece, at = b.slice(at, to - at), to
                texts = piece.column(len(kept)).to_pylist()
                asked = iter(answers([t for t in texts if t is not None]))
                cols = list(zip(*((None, None, None) if t is None else next(asked) for t in texts)))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], [*kept, *new])

    return source.mapInArrow(run, f"{schema}, `{out}` string, provider int, error string")
