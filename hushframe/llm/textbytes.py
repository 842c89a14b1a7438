"""Vectorised word hashing over whole batches of texts.

A batch of texts is joined into one byte buffer (texts are kept apart by a byte
that is never part of a word), and words are found by a 256-entry byte class
table.  Every class used here is defined on ASCII, so a byte table is exact on
UTF-8: bytes of 0x80 and above belong to multi-byte characters.

A word's hash is a polynomial over random 64-bit values of its bytes, taken from
one running sum over the buffer, so that no Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

#: glibc keeps what is freed; other C libraries have no such call.
_libc = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for uint64 values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the largest n asked for."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def byte_class(members: bytes | range | None = None, *, but: bytes = b"") -> np.ndarray:
    """A table that is true for the given bytes, or for all except ``but``."""
    table = np.zeros(256, dtype=bool)
    if members is not None:
        table[list(members)] = True
    else:
        table[:] = True
        table[list(but)] = False
    return table


#: Words between ASCII white space: [^\x20\x09-\x0D]+
SPACED = byte_class(but=b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words of letters and digits: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = byte_class(bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
SAME_CASE = np.arange(256, dtype=np.uint8)
LOWER = SAME_CASE.copy()
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """The words of a batch, in text order; text i has words first[i] to first[i+1]-1."""

    buf: np.ndarray  #: all bytes; text i lies at text_start[i] to text_end[i]
    text_start: np.ndarray
    text_end: np.ndarray
    hash: np.ndarray  #: uint64
    start: np.ndarray  #: byte positions in buf
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


class RangeHash:
    """Hashes of any byte ranges of a buffer, from one pass over it; another ``salt`` gives independent ones."""

    def __init__(self, buf: np.ndarray, fold: np.ndarray = SAME_CASE, salt: int = 0):
        values = (mix(_BYTE_VALUES + np.uint64(salt)) if salt else _BYTE_VALUES)[fold][buf]
        values *= powers(_BASE, len(buf))
        self.sums = np.empty(len(buf) + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum(values, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(_INVERSE, len(self.sums))[start])


def words(texts: list[bytes], members: np.ndarray = SPACED, fold: np.ndarray = SAME_CASE, gap: bytes = b"\n", ranges: list | None = None) -> Words:
    """Find and hash the words of each text: runs of bytes of one class, where class 0 (or false) is no word.

    ``ranges``: gets the RangeHash, for further hashes.  ``gap`` must end with a byte of class 0.
    """
    # A gap before the first text too: what looks back from a text sees the same in any batch.
    buf = np.frombuffer(gap.join((b"", *texts, b"")), dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text_start = np.cumsum(lengths + len(gap)) - lengths
    kind = members[buf].view(np.int8)
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = edge[kind[edge] != 0]
    end = edge[kind[edge - 1] != 0]
    hashes = RangeHash(buf, fold)
    if ranges is not None:
        ranges.append(hashes)
    first = np.append(np.searchsorted(start, text_start), len(start))
    return Words(buf, text_start, text_start + lengths, hashes.of(start, end), start, end, first)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows within texts, and the index of each window's first word."""
    n = len(w.hash)
    if n < k:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    rolled = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        rolled *= np.uint64(_BASE)
        rolled += w.hash[j : n - k + 1 + j]
    last = np.repeat(w.first[1:], w.counts)[: n - k + 1]
    at = np.flatnonzero(np.arange(k, n + 1) <= last)
    return mix(rolled[at]), at


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of the list of about ``most`` bytes; a longer text is alone in its slice."""
    at = size = 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > most:
            yield slice(at, i)
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield slice(at, len(texts))


def as_bytes(column) -> list[bytes]:
    """A text column of an Arrow batch as bytes; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def per_text(flags: np.ndarray, w: Words) -> np.ndarray:
    """Sums of a per-word array over each text."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[w.first[1:]] - total[w.first[:-1]]


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def releasing(run):
    """A function over a task's batches that gives freed memory back at its end: a worker lives on beside its executor."""

    @wraps(run)
    def inner(batches):
        yield from run(batches)
        give_back()

    return inner
