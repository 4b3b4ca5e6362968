"""Words of whole texts as numpy arrays, for use inside Arrow-batched tasks.

A word is a maximal run of bytes other than space and 0x09-0x0D. A word's name is the 128-bit
BLAKE2 of its bytes, as two numbers; it depends on the content alone, so every task gives equal
words equal names without any exchange. Ranges of words are polynomials over their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}
#: Names of words that a worker has seen, and how many, of how many bytes, it keeps.
_NAMES: dict[bytes, bytes] = {}
_KEPT_WORDS, _KEPT_BYTES = 200_000, 16 << 20

#: Bytes of text that are worked on at once; arrays take about 40 times as much.
CHUNK_BYTES = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = have = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end] for many ranges at once, by prefix sums."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:], dtype=np.uint64)
    back = powers(pow(base, -1, 1 << 64), n + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of some texts: bytes `buf`, word bounds `start` and `end`, and `first`,
    where first[k]:first[k+1] are the words of text k."""

    def __init__(self, texts: list[bytes]):
        self.raw = b" ".join(texts) + b" "
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        space = _SPACE[self.buf]
        before = np.empty_like(space)
        before[0], before[1:] = True, space[:-1]
        self.start = np.flatnonzero(before & ~space)
        self.end = np.flatnonzero(space & ~before)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, bounds)

    def __len__(self) -> int:
        return len(self.start)

    def names(self) -> np.ndarray:
        """Two numbers for each word, its 128-bit name."""
        words = self.raw.split()
        new = set(words).difference(_NAMES)
        for w in new:
            _NAMES[w] = hashlib.blake2b(w, digest_size=16).digest()
        out = np.frombuffer(b"".join(map(_NAMES.__getitem__, words)), dtype=np.uint64).reshape(-1, 2)
        if len(_NAMES) > _KEPT_WORDS or sum(map(len, new)) > _KEPT_BYTES:
            _NAMES.clear()
        return out

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts a batch between rows so that each part holds about `limit` bytes of text, or a single row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    at = size = 0
    for k, n in enumerate(sizes):
        if k > at and size + n > limit:
            part = batch.slice(at, k - at)
            yield part, texts_of(part.column(text))
            at, size = k, 0
        size += n + 1
    if at < len(sizes):
        part = batch.slice(at)
        yield part, texts_of(part.column(text))
