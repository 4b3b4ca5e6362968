"""Arrays of numbers as compressed pieces, to travel as one value of a row."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed piece, byte by byte of their numbers; of rising 64-bit names the differences."""
    parts = [np.array([len(a) for a in arrays], dtype=np.int64).tobytes()]
    for a in arrays:
        a = np.diff(a, prepend=np.uint64(0)) if a.dtype == np.uint64 else a
        parts.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)).tolist(), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        width = np.dtype(kind).itemsize
        a = np.ascontiguousarray(np.frombuffer(raw[at : at + n * width], np.uint8).reshape(width, n).T).view(kind).ravel()
        out.append(np.cumsum(a, dtype=np.uint64) if kind is np.uint64 else a)
        at += n * width
    return out
