"""Signals: resampling, log-mel features and silent ends, over many signals of an Arrow batch at once.

Built-in functions have neither a Fourier transform nor a convolution, so these are Arrow UDFs around
numpy. Null signals give null, null samples count as 0, empty signals give empty results.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_RATE = 16_000
#: Zero crossings of the low-pass filter on each side and its Kaiser window's shape: 73 dB.
ZEROS, BETA = 12, 7.0
#: Numbers that are worked on at once.
CELLS = 2_000_000


def _signals(column: pa.Array) -> list[np.ndarray | None]:
    """A list column as arrays of doubles; no sample becomes a Python object."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    flat = np.nan_to_num(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)) if column.flatten().null_count else column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return [flat[e - s : e] if ok else None for ok, s, e in zip(valid, sizes, ends)]


def _lists(rows: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    sizes = np.array([0 if r is None else len(r) for r in rows], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = pa.array(np.concatenate([np.zeros(0), *(r for r in rows if r is not None)]), pa.float64()).cast(kind)
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([r is None for r in rows], pa.bool_()))


# --- resampling -----------------------------------------------------------------------------------

@functools.lru_cache(maxsize=64)
def phases(up: int, down: int, zeros: int = ZEROS, beta: float = BETA) -> tuple[np.ndarray, int]:
    """(filter taps by phase, in order of samples; half length): a Kaiser-windowed sinc that passes what both
    rates can hold, cut into the phases that an output sample can have between two input samples."""
    m = max(up, down)
    half = zeros * m
    k = np.arange(-half, half + 1)
    h = np.sinc(k / m) * np.i0(beta * np.sqrt(1 - (k / half) ** 2))
    h *= up / h.sum()
    width = 2 * half // up + 1
    table = np.zeros((up, width))
    for p in range(up):  # output at t = q * up + p meets inputs n with |t - n * up| <= half
        first = -((half - p) // up)
        n = first + np.arange(width)
        at = p - n * up + half
        good = (at >= 0) & (at <= 2 * half)
        table[p, good] = h[at[good]]
    return table, half


def resample_one(x: np.ndarray, source: int, target: int, zeros: int = ZEROS, beta: float = BETA) -> np.ndarray:
    """A signal at another rate: ceil(n * target / source) samples."""
    g = math.gcd(source, target)
    up, down = target // g, source // g
    if up == down or not len(x):
        return x
    table, half = phases(up, down, zeros, beta)
    n_out, width = -(-len(x) * up // down), table.shape[1]
    edge = half // up + 1
    padded = np.concatenate([np.zeros(edge), x, np.zeros(edge + width)])
    out = np.empty(n_out)
    step = max(1, CELLS // width)
    for at in range(0, n_out, step):
        t = np.arange(at, min(at + step, n_out), dtype=np.int64) * down
        first = t // up - (half - t % up) // up + edge
        out[at : at + len(t)] = np.einsum("ij,ij->i", np.lib.stride_tricks.sliding_window_view(padded, width)[first], table[t % up])
    return out


def _resampled(kind: T.DataType, arrow: pa.DataType, target: int, zeros: int, beta: float):
    @F.arrow_udf(T.ArrayType(kind))
    def run(signal: pa.Array, rate: pa.Array) -> pa.Array:
        return _lists([None if x is None or r is None or r <= 0 else resample_one(x, r, target, zeros, beta) for x, r in zip(_signals(signal), rate.to_pylist())], arrow)

    return run


def resample(signal: Column, rate: Column, target: int = SAMPLE_RATE, zeros: int = ZEROS, beta: float = BETA, double: bool = False) -> Column:
    """Signals of any whole rates (samples a second) at the target rate, by polyphase windowed-sinc filters: what
    the lower of both rates cannot hold is filtered out and does not fold back. A rate that is null or not
    positive gives null."""
    return _resampled(*((T.DoubleType(), pa.float64()) if double else (T.FloatType(), pa.float32())), target, zeros, beta)(signal, rate.cast("int"))


# --- log-mel features -----------------------------------------------------------------------------

def _mel(hz):
    """The mel scale that is linear up to 1000 Hz and logarithmic beyond."""
    hz = np.asarray(hz, dtype=float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1) / 1000) / np.log(6.4))


def _hz(mel):
    mel = np.asarray(mel, dtype=float)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@functools.lru_cache(maxsize=16)
def mel_bank(rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    """(mel, frequency): triangles of equal area between places that are even on the mel scale."""
    edges = _hz(np.linspace(0, float(_mel(rate / 2)), n_mels + 2))
    f = np.arange(n_fft // 2 + 1) * rate / n_fft
    rise, fall = (f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel_many(x: np.ndarray, rate: int = SAMPLE_RATE, n_fft: int = 400, hop: int = 160, n_mels: int = 80) -> np.ndarray:
    """(signal, mel, frame) of signals of one length (signal, sample). Frames are centred, ends reflected, and a
    periodic Hann window is used; log10 of mel power is cut off 8 below the signal's greatest and scaled by
    (v + 4) / 4."""
    k, n = x.shape
    frames = n // hop
    if not frames:
        return np.zeros((k, n_mels, 0))
    padded = np.pad(x, ((0, 0), (n_fft // 2, n_fft // 2)), mode="reflect")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    cut = np.lib.stride_tricks.sliding_window_view(padded, n_fft, axis=1)[:, : frames * hop : hop]
    bank, out = mel_bank(rate, n_fft, n_mels), np.empty((k, n_mels, frames))
    step = max(1, CELLS // n_fft)
    for i in range(k):
        for at in range(0, frames, step):
            power = np.abs(np.fft.rfft(cut[i, at : at + step] * window, axis=1)) ** 2
            out[i, :, at : at + step] = bank @ power.T
    out = np.log10(np.maximum(out, 1e-10))
    return (np.maximum(out, out.max(axis=(1, 2), keepdims=True) - 8) + 4) / 4


def _mels(kind: T.DataType, arrow: pa.DataType, samples: int | None, rate: int, n_fft: int, hop: int, n_mels: int):
    @F.arrow_udf(T.ArrayType(T.ArrayType(kind)))
    def run(signal: pa.Array) -> pa.Array:
        given = _signals(signal)
        if samples is not None:
            given = [None if x is None else np.pad(x[:samples], (0, max(0, samples - len(x)))) for x in given]
        out: list = [None] * len(given)
        lengths = np.array([-1 if x is None else len(x) for x in given])
        for n in np.unique(lengths[lengths >= 0]).tolist():
            rows = np.flatnonzero(lengths == n)
            for at in range(0, len(rows), step := max(1, CELLS // max(1, n))):
                some = rows[at : at + step]
                for r, m in zip(some, log_mel_many(np.stack([given[r] for r in some]), rate, n_fft, hop, n_mels)):
                    out[r] = m
        inner = _lists([row for m in out if m is not None for row in m], arrow)
        offsets = np.concatenate([[0], np.cumsum([0 if m is None else n_mels for m in out])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), inner, mask=pa.array([m is None for m in out], pa.bool_()))

    return run


def log_mel(signal: Column, seconds: float | None = 30.0, rate: int = SAMPLE_RATE, n_fft: int = 400, hop: int = 160, n_mels: int = 80, double: bool = False) -> Column:
    """Log-mel features of each signal, array of n_mels arrays of frames. Signals are cut or filled with silence
    to that many seconds first (80 times 3000 by default); None leaves their length."""
    samples = None if seconds is None else int(seconds * rate)
    return _mels(*((T.DoubleType(), pa.float64()) if double else (T.FloatType(), pa.float32())), samples, rate, n_fft, hop, n_mels)(signal)


def _once(value: Column, f) -> Column:
    """f(value), with value computed once a row and not wherever f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def unit_variance(signal: Column) -> Column:
    """Less its mean, over its standard deviation (1e-7 is added to the variance)."""
    total = lambda f: F.aggregate(signal, F.lit(0.0), lambda a, v: a + f(v.cast("double"))) / F.size(signal)
    scaled = lambda m: _once(F.sqrt(total(lambda v: (v - m) * (v - m)) + 1e-7), lambda s: F.transform(signal, lambda v: (v.cast("double") - m) / s))
    return F.when(F.size(signal) > 0, _once(total(lambda v: v), scaled)).when(F.size(signal) == 0, F.array().cast("array<double>"))


# --- silent ends ----------------------------------------------------------------------------------

def loud_span(x: np.ndarray, below: float, frame: int, hop: int) -> tuple[int, int]:
    """(first, end) sample between the first and the last frame within `below` decibels of the loudest; frames
    are centred at multiples of hop, with silence outside. (0, 0) for a silent signal."""
    if not len(x):
        return 0, 0
    power = np.concatenate([[0.0], np.cumsum(x * x)])
    at = np.arange(0, len(x) + 1, hop) - frame // 2
    level = power[np.clip(at + frame, 0, len(x))] - power[np.clip(at, 0, len(x))]
    loud = np.flatnonzero(level > level.max() * 10 ** (-below / 10)) if level.max() > 0 else []
    return (int(loud[0]) * hop, min(len(x), (int(loud[-1]) + 1) * hop)) if len(loud) else (0, 0)


def trim_silence(signal: Column, below: float = 25.0, frame: int = 2048, hop: int = 512, least: int = int(0.3 * SAMPLE_RATE)) -> Column:
    """Without the ends that lie that many decibels below the loudest frame; as it is if fewer than least samples
    would stay."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(signals: pa.Array) -> pa.Array:
        out = []
        for x in _signals(signals):
            a, b = loud_span(x, below, frame, hop) if x is not None else (0, 0)
            out.append(x if x is None or b - a < least else x[a:b])
        return _lists(out, pa.float32())

    return run(signal)
