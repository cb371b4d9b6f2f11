"""WAV files: headers and samples, parsed chunk by chunk."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

# Format codes of the file format.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


class NotWav(ValueError):
    """Not a WAV file, or not of a kind that is read."""


@dataclass
class Header:
    kind: int
    channels: int
    rate: int
    bits: int
    start: int
    n_bytes: int

    @property
    def n_samples(self) -> int:
        """Of each channel."""
        return self.n_bytes // (self.channels * self.bits // 8)

    @property
    def duration(self) -> float:
        return self.n_samples / self.rate


def read_header(file, size: int) -> Header:
    """The header of an open file of that many bytes; no samples are read. Chunks other than the format and the
    data are skipped; a data chunk that says more than is there ends with the file."""
    if size < 12 or (head := file.read(12))[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise NotWav("no RIFF/WAVE header")
    at, form = 12, None
    while at + 8 <= size:
        file.seek(at)
        name, n = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            raw = file.read(min(n, 40))
            if len(raw) < 16:
                raise NotWav("short format chunk")
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw)
            if kind == EXTENSIBLE and len(raw) >= 26:
                (kind,) = struct.unpack_from("<H", raw, 24)
            form = (kind, channels, rate, bits)
        elif name == b"data":
            if form is None:
                raise NotWav("data before format")
            kind, channels, rate, bits = form
            if not channels or not rate or (kind, bits) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}:
                raise NotWav(f"format {kind} with {bits} bits, {channels} channels, rate {rate}")
            return Header(kind, channels, rate, bits, at + 8, min(n, size - at - 8))
        at += 8 + n + n % 2
    raise NotWav("no data chunk")


def samples(h: Header, data: bytes) -> np.ndarray:
    """Mean of all channels as doubles, whole numbers scaled to [-1, 1)."""
    width = h.bits // 8
    data = data[: len(data) // (width * h.channels) * width * h.channels]
    if h.kind == FLOAT:
        x = np.frombuffer(data, f"<f{width}").astype(float)
    elif h.bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif h.bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    else:
        x = np.frombuffer(data, f"<i{width}") / 2.0 ** (h.bits - 1)
    return x.reshape(-1, h.channels).mean(axis=1)


def encode(x: np.ndarray, rate: int) -> bytes:
    """A 16-bit mono file; samples are clipped to [-1, 1] and rounded half to even."""
    data = np.rint(np.clip(np.nan_to_num(x), -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, PCM, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data
