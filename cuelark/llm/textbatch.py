"""NumPy views of Arrow text columns: bytes, words, word hashes, shingles.

Everything works on the UTF-8 bytes of whole texts; a null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 19
#: Powers that a worker keeps from piece to piece.
HELD_POWERS = 1 << 20
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and the odd base of the word polynomial.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
SHINGLE_FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)

#: Words of the contracts: runs of anything but \x20 and \x09-\x0D.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Words without punctuation: ASCII letters, digits and every non-ASCII byte.
NOT_WORD = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: np.uint64, held: list[np.ndarray], n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; what is held grows by doubling, and a longer text's powers are not kept."""
    p = held[0]
    while len(p) < n:
        p = np.concatenate([p, p * U64(pow(int(base), len(p), 1 << 64))])
    if len(p) <= HELD_POWERS:
        held[0] = p
    return p[:n]


_up, _down = [np.ones(1, np.uint64)], [np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text begins (one more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, begins, data = column.buffers()
    begins = np.frombuffer(begins, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[begins[0] : begins[-1]], begins - begins[0]


def pieces(begins: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts [i, j) of about ``most`` bytes each."""
    i, n = 0, len(begins) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(begins, begins[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, begins: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (one more than texts)."""
    inside = ~between[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = begins[(begins > 0) & (begins < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, begins)


class Stretches:
    """Hashes of stretches of bytes, all from one running sum."""

    def __init__(self, data: np.ndarray):
        value = BYTE_VALUE[data]
        value *= _powers(BASE, _up, len(data))
        self.total = np.empty(len(data) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(value, out=self.total[1:])
        self.down = _powers(BASE_INVERSE, _down, len(data))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each stretch."""
        if not len(starts):
            return np.empty(0, np.uint64)
        h = (self.total[ends] - self.total[starts]) * self.down[starts]
        return mixed(h + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Stretches(data).hashes(starts, ends)


def hashed_words(column, between: np.ndarray = BLANKS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, first word of each text) for runs of texts; A-Z count as a-z."""
    data, begins = flat(column)
    for i, j in pieces(begins):
        part, at = LOWER[data[begins[i] : begins[j]]], begins[i : j + 1] - begins[i]
        starts, ends, first = words(part, at, between)
        yield i, word_hashes(part, starts, ends), first


def shingle_sets(column, k: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles.

    A text of fewer words counts as one shingle, one without words has none.
    """
    for _, h, first in hashed_words(column):
        n = max(0, len(h) - k + 1)
        run = np.zeros(n, np.uint64)
        for j in range(k):
            run += h[j : j + n] * SHINGLE_FACTORS[j]
        run = mixed(run)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                yield np.unique(run[a : b - k + 1])
            elif b > a:
                yield mixed((h[a:b] * SHINGLE_FACTORS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.full(1, b - a, np.uint64))
            else:
                yield np.empty(0, np.uint64)
