"""Vectorised text kernel shared by the corpus operators.

Arrow hands a Python worker a column of UTF-8 text as one byte buffer plus
offsets.  Everything here works on that buffer with numpy: no per-row Python
strings are made.  A batch is cut into slices of whole documents of about
``max_bytes`` each, so a worker's memory depends on the slice (or on the one
longest document), never on the batch or the partition.

Hashes are 64-bit.  The hash of a word of up to ``BLOCK`` bytes is a polynomial
over random byte codes, taken from prefix sums modulo 2**64 and then mixed.
Modulo a power of two, long strings over two letters can be built whose
polynomials are equal whatever the base; so a longer word is the sum of its
blocks' hashes, each mixed with its place before they are added.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Bytes of a word under one polynomial. Two strings of 64 bytes differ in more powers of two than a sum modulo 2**64 forgets.
BLOCK = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; the input array is overwritten."""
    h ^= h >> U64(31)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    return h


@functools.lru_cache(None)
def byte_codes(lower: bool) -> np.ndarray:
    """A random odd 64-bit code for each byte; A-Z coded as a-z if lower."""
    codes = mix(np.arange(1, 257, dtype=U64) * U64(_BASE)) | U64(1)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


#: Powers for slices of up to so many bytes are kept; for a longer text they are made for it alone.
_KEPT = 1 << 21
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) > n:
        return _powers[0][: n + 1], _powers[1][: n + 1]
    size = n + 1 if n >= _KEPT else min(_KEPT, max(n + n // 4, 1 << 16)) + 1
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, b, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if n < _KEPT:
        _powers = (out[0], out[1])
    return out[0][: n + 1], out[1][: n + 1]


def freed(work):
    """``work`` as a task's function that gives memory back to the machine when it ends; workers outlive their tasks."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def trim() -> None:
    global _powers
    _powers = (np.ones(1, U64), np.ones(1, U64))
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@functools.lru_cache(None)
def word_table(kind: str) -> np.ndarray:
    """True for bytes inside a word. "space": all but 20, 09-0D; "alnum": 0-9, A-Z, a-z, 80-FF."""
    t = np.zeros(256, bool)
    if kind == "space":
        t[:] = True
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


class Slice:
    """Whole documents lo..hi-1 of a batch: their bytes and, from 0, their byte offsets."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offs: np.ndarray):
        self.lo, self.hi, self.data, self.offs = lo, hi, data, offs

    @property
    def n_docs(self) -> int:
        return self.hi - self.lo

    def words(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of words, and the index of each document's first word (with one more at the end)."""
        inside = word_table(kind)[self.data]
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n_docs + 1, np.int64)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        firsts = self.offs[:-1]
        before[firsts[firsts < n]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        lasts = self.offs[1:] - 1
        after[lasts[lasts >= 0]] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offs)

    def prefix_sums(self, lower: bool) -> np.ndarray:
        n = len(self.data)
        c = np.zeros(n + 1, U64)
        v = byte_codes(lower)[self.data]
        v *= powers(n)[0][:n]
        np.cumsum(v, out=c[1:])
        return c

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        c, inverse = self.prefix_sums(lower), powers(len(self.data))[1]
        h = mix((c[ends] - c[starts]) * inverse[starts])
        long = np.flatnonzero(ends - starts > BLOCK)
        if len(long):
            a, b = starts[long], ends[long]
            blocks = -(-(b - a) // BLOCK)
            first = np.cumsum(blocks) - blocks
            k = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
            lo = np.repeat(a, blocks) + k * BLOCK
            hi = np.minimum(lo + BLOCK, np.repeat(b, blocks))
            own = mix((c[hi] - c[lo]) * inverse[lo])
            own = mix(own + (k + 1).astype(U64) * U64(_BASE))
            h[long] = mix(np.add.reduceat(own, first) + (b - a).astype(U64))
        return h


def text_slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[Slice]:
    """Nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        yield Slice(lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


_SHINGLE = [pow(0xA24BAED4963EE407, j + 1, 1 << 64) for j in range(64)]


def shingle_hashes(h: np.ndarray, woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside a document: hash, index of the first word, index of the document's first window (one more at the end)."""
    n = len(h)
    per_doc = np.maximum(np.diff(woffs) - k + 1, 0)
    first = np.zeros(len(woffs), np.int64)
    np.cumsum(per_doc, out=first[1:])
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64), first
    s = h[: n - k + 1] * U64(_SHINGLE[0])
    for j in range(1, k):
        s += h[j : n - k + 1 + j] * U64(_SHINGLE[j])
    at = np.arange(int(first[-1]), dtype=np.int64)
    at += np.repeat(woffs[:-1] - first[:-1], per_doc)
    return mix(s[at]), at, first


def rows(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(x)) for x in names]
