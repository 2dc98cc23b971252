"""Vectorised byte-level text primitives shared by the operators of this subpackage.

All functions work on whole Arrow batches through numpy: a chunk of rows is one
``uint8`` buffer plus row offsets, words are (start, end) pairs in it, and a word's
identity is a 64-bit polynomial hash. Both word classes used here are decided by
ASCII alone, so bytes of multi-byte UTF-8 sequences (>= 0x80) are simply word bytes.

Two different words share a hash with probability about 2**-64 (words are short).
Nulls are empty texts. A text longer than a chunk is a chunk of its own; hashing
runs in blocks, so its temporary arrays stay at about ``BLOCK`` elements.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
BLOCK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: digits, letters and everything that isn't ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: everything but ASCII white space
SOLID = np.ones(256, bool)
SOLID[9:14] = SOLID[32] = False

_rng = np.random.RandomState(20240229)
_BYTE = (_rng.randint(0, 1 << 32, 256).astype(np.uint64) << np.uint64(32)) | _rng.randint(0, 1 << 32, 256).astype(np.uint64) | np.uint64(1)
_LOW_BYTE = _BYTE[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, 5 mod 8: full order of the multiplicative group
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for name, base in (("p", _BASE), ("i", _INVERSE)):
            a = np.ones(BLOCK + 1, np.uint64)
            a[1:] = np.uint64(base)
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and row offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), off


def chunks(col: pa.Array, limit: int = CHUNK):
    """Yields (first row, past last row, bytes, offsets from 0) with at most ``limit`` bytes, or one row."""
    data, off = binary(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, inside: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all maximal runs of ``inside`` bytes that stay in a row, and each row's first word index (one entry more than rows)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    isw = inside[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    edge = ~isw
    starts = isw.copy()
    starts[1:] &= edge[:-1] | first[1:-1]
    ends = isw
    ends[:-1] &= edge[1:] | first[1:-1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, off)


def hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words; A-Z counts as a-z if ``lower``."""
    out = np.empty(len(s), np.uint64)
    table, (p, inv) = _LOW_BYTE if lower else _BYTE, _tables()
    i, n = 0, len(s)
    while i < n:
        j = int(np.searchsorted(e, s[i] + BLOCK, "right"))
        if j <= i:  # one word longer than a block
            word = (LOWER[buf[s[i] : e[i]]] if lower else buf[s[i] : e[i]]).tobytes()
            out[i] = np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), np.uint64)[0]
            i += 1
            continue
        a, b = s[i:j] - s[i], e[i:j] - s[i]
        v = table[buf[s[i] : e[j - 1]]]
        v *= p[: len(v)]
        c = np.empty(len(v) + 1, np.uint64)
        c[0] = 0
        np.cumsum(v, out=c[1:])
        out[i:j] = mix((c[b] - c[a]) * inv[a])
        i = j
    return out


def hash_word(word: str | bytes, lower: bool = True) -> int:
    """The hash that hashes() gives this word."""
    b = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(hashes(b, np.array([0]), np.array([len(b)]), lower)[0])


class HashCache:
    """A direct-mapped cache from word hashes to rows of value arrays; bounded, a colliding word evicts."""

    def __init__(self, bits: int = 20):
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.slots = 1 << bits

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and where they hold the hash."""
        slot = (h >> self.shift).astype(np.int64)
        return slot, self.keys[slot] == h
