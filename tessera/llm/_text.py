"""Vectorised text kernels: words, fingerprints and shingles of whole Arrow batches.

Fingerprints are 64-bit. A span's fingerprint is the polynomial
``sum(T[c_i] * B**i) mod 2**64`` with random 64-bit symbols ``T``, taken from
prefix sums, then mixed; two different spans meet with probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
WINDOW = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _INV = _powers(BASE, WINDOW + 1), _powers(BASE_INVERSE, WINDOW + 1)


def word_bytes(separators: bytes) -> np.ndarray:
    """Table over byte values: does it belong to a word?"""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = word_bytes(b" \t\n\x0b\x0c\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing
ALNUM = word_bytes(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets in them; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    is_word = inside[data]
    before = np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    after = np.empty_like(is_word)
    after[-1], after[:-1] = False, is_word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of ``symbols[i] * BASE**i`` and the inverse powers up to there."""
    n = len(symbols)
    pw, inv = (_POW, _INV) if n <= WINDOW else (_powers(BASE, n + 1), _powers(BASE_INVERSE, n + 1))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(symbols * pw[:n], out=sums[1:])
    return sums, inv


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of spans in order that don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + WINDOW, side="right")))
        s0 = starts[i]
        sums, inv = prefix_sums(BYTE_SYMBOLS[data[s0 : ends[j - 1]]])
        s, e = starts[i:j] - s0, ends[i:j] - s0
        out[i:j] = (sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of k consecutive items, by start; len - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = mix(out + hashes[i : i + n])
        out *= BASE
    return mix(out)


def shingle_sets(texts: pa.Array, k: int, inside: np.ndarray = SPACED) -> Iterator[np.ndarray]:
    """Each row's sorted distinct fingerprints of k lower-cased words; a shorter text gives one for all of it."""
    data, offsets = buffers(texts)
    data = lower(data)
    starts, ends, first = word_spans(data, offsets, inside)
    hashes = span_hashes(data, starts, ends)
    grams = chain(hashes, k)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield chain(hashes[a:b], int(b - a)) ^ _U(b - a)
        else:
            yield np.zeros(0, np.uint64)


def pieces(batch: pa.RecordBatch, most: int = 1 << 22, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``most`` bytes of text; no row is cut."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0))
    at = np.concatenate([[0], np.cumsum(sizes)])
    i, n = 0, len(sizes)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
