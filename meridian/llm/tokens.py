"""Texts as arrays: bytes, words, their hashes, and batches of bounded size.

Hashes that stand for content are polynomials modulo the prime 2**31 - 1, in two
streams with bases of their own: two different sequences of n tokens agree in both
with a probability of about (n / 2**31)**2, whatever their structure (a polynomial
modulo 2**64 has texts that agree for every base; it is used for sampling only).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SEPARATORS, trim

U = np.uint64
#: Tokens hashed at a time.
CHUNK = 1 << 16
#: Longest sequence that one array of prefix sums can hold.
LONGEST = 1 << 18
PRIME = U((1 << 31) - 1)
_SHIFT = U(31)
_rng = np.random.RandomState(20240229)
#: Token values of bytes: 64 bits for sampling, and one below the prime for each stream.
BYTES = np.frombuffer(_rng.bytes(256 * 8), dtype=np.uint64)
_STREAMS = tuple(_rng.randint(1, (1 << 31) - 1, 256).astype(np.uint64) for _ in range(2))
_BASES = (1_203_956_871, 1_886_027_399)
_SAMPLING = 0x9E3779B97F4A7C15
_SEPARATOR = np.isin(np.arange(256), list(SEPARATORS))
_kept: dict = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0x9FB21C651E98DF25)
    h ^= h >> U(32)
    return h


def folded(x: np.ndarray) -> np.ndarray:
    """A smaller number that is equal modulo the prime; below 2**32 for x below 2**62."""
    return (x & PRIME) + (x >> _SHIFT)


def powers(base: int, prime: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for the positions of a chunk, modulo the prime."""
    if base not in _kept:
        out = []
        for b in (base, pow(base, -1, prime)):
            p = np.ones(1, dtype=np.uint64)
            while len(p) < LONGEST:
                q = folded(folded(p * U(pow(b, len(p), prime))))
                p = np.concatenate([p, np.where(q >= PRIME, q - PRIME, q)])
            out.append(p)
        _kept[base] = tuple(out)
    return _kept[base]


def sampling_powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers modulo 2**64 of the base for sampling, and of its inverse."""
    if "sampling" not in _kept:
        out = []
        for b in (_SAMPLING, pow(_SAMPLING, -1, 1 << 64)):
            p = np.ones(1, dtype=np.uint64)
            while len(p) < LONGEST:
                p = np.concatenate([p, p * U(pow(b, len(p), 1 << 64))])
            out.append(p)
        _kept["sampling"] = tuple(out)
    return _kept["sampling"]


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k tokens, for sampling: equal runs agree, different ones may."""
    up, down = sampling_powers()
    sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(tokens * up[: len(tokens)], out=sums[1:])
    n = max(0, len(tokens) - k + 1)
    return mix((sums[k : k + n] - sums[:n]) * down[:n])


class Sums:
    """Hashes of any ranges of a token sequence, by prefix sums of two streams."""

    def __init__(self, streams: tuple[np.ndarray, np.ndarray]):
        self.parts = []
        for tokens, base in zip(streams, _BASES, strict=True):
            up, down = powers(base, int(PRIME))
            sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
            np.cumsum(folded(tokens * up[: len(tokens)]), out=sums[1:])
            self.parts.append((sums, down))

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        out = None
        for sums, down in self.parts:
            h = folded(folded(folded(sums[end] - sums[start]) * down[start]))
            h = np.where(h >= PRIME, h - PRIME, h)
            out = h if out is None else (out << _SHIFT) | h
        return mix(out)


def byte_streams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _STREAMS[0][data], _STREAMS[1][data]


def word_streams(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two token values below the prime from 64-bit word hashes."""
    a, b = hashes >> U(33), hashes & PRIME
    return np.minimum(a, PRIME - U(1)), np.minimum(b, PRIME - U(1))


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data``, and word offsets of the texts between ``bounds``."""
    inside = ~_SEPARATOR[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    before[edges] = False
    after[(bounds[1:] - 1)[bounds[1:] > bounds[:-1]]] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts and ends in ``data``, and word offsets of the texts between ``bounds``."""
    starts, ends, offsets = word_bounds(data, bounds)
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # by chunks of bytes
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        if hi - lo > LONGEST:  # one enormous word
            hashes[at] = U(int.from_bytes(hashlib.blake2b(data[lo:hi].tobytes(), digest_size=8).digest(), "little"))
        else:
            hashes[at:stop] = Sums(byte_streams(data[lo:hi])).of(starts[at:stop] - lo, ends[at:stop] - lo)
        at = stop
    return hashes, starts, ends, offsets


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, and the bounds of its values (null: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, doc numbers, bounds within, place of the first token) of pieces of bounded size.

    A long text comes in pieces that overlap by ``length - 1``: every window lies in one.
    """
    d, n = 0, len(bounds) - 1
    while d < n:
        if bounds[d + 1] - bounds[d] > CHUNK:
            for at in range(int(bounds[d]), int(bounds[d + 1]) - length + 1, CHUNK):
                end = min(int(bounds[d + 1]), at + CHUNK + length - 1)
                yield at, end, np.array([d]), np.array([0, end - at]), np.array([at - int(bounds[d])])
            d += 1
            continue
        stop = max(d + 1, int(np.searchsorted(bounds, bounds[d] + CHUNK, "right")) - 1)
        at = int(bounds[d])
        yield at, int(bounds[stop]), np.arange(d, stop), bounds[d : stop + 1] - at, np.zeros(stop - d, dtype=np.int64)
        d = stop


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows and, but for one long row, bytes of text."""
    for b in batches:
        held = np.zeros(b.num_rows, dtype=np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                held += np.asarray(pc.binary_length(c).fill_null(0))
        upto, at = np.cumsum(held), 0
        while at < b.num_rows:
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right"))
            end = min(max(end, at + 1), at + rows)
            yield b.slice(at, end - at)
            at = end
        trim()


def packed(text: bytes | None) -> bytes | None:
    """A text compressed for the shuffles that must carry it."""
    return None if text is None else len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unpack(blob: bytes | None) -> bytes | None:
    return None if blob is None else pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def unpacked(column: pa.Array) -> pa.Array:
    return pa.array([unpack(x) for x in column.to_pylist()], pa.large_binary())
