"""Vectorised word kernels over UTF-8 bytes.

A word is ``[^\\x20\\x09-\\x0D]+``. All separators are ASCII, so words can be cut
on the bytes of many texts at once, without decoding them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  #: texts are worked on in slices of about this many bytes
HASH_BYTES = 1 << 17  #: bytes hashed at once; bounds the tables of powers, also for longer words
U = np.uint64

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse mod 2**64 for i < n, kept per process."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        up = np.full(size, base, U)
        up[0] = 1
        down = np.full(size, pow(base, -1, 1 << 64), U)
        down[0] = 1
        have = _POWERS[base] = (np.cumprod(up, dtype=U), np.cumprod(down, dtype=U))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (n + 1 offsets). Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about `size` bytes; a longer text comes alone."""
    raw, at = text_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Words:
    """Words of a slice: byte positions `start`, `end`, and `first`, the index of each text's first word (n + 1)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, separator: np.ndarray = SEPARATOR):
        self.raw, self.at = raw, at
        n = len(raw)
        sep = separator[raw]
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        edge = sep.copy()
        opens, closes = ~sep, ~sep
        if n:
            opens[1:] &= edge[:-1] | cut[1:n]
            closes[:-1] &= edge[1:] | cut[1:n]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts())

    def hashes(self, lower: bool = False, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self), U)
        up, down = powers(base, HASH_BYTES + 1)
        size = self.end - self.start
        i = 0
        while i < len(self):
            a = self.start[i]
            j = int(np.searchsorted(self.end, a + HASH_BYTES, "right"))
            if j <= i:
                out[i] = self._long(self.raw[a : self.end[i]], lower, up, base)
                i += 1
                continue
            part = self.raw[a : self.end[j - 1]]
            part = (LOWER[part] if lower else part).astype(U) + U(1)
            part *= up[: len(part)]
            total = np.zeros(len(part) + 1, U)
            np.cumsum(part, out=total[1:])
            s, e = self.start[i:j] - a, self.end[i:j] - a
            out[i:j] = (total[e] - total[s]) * down[s]
            i = j
        out += size.astype(U) * U(0xD6E8FEB86659FD93)
        return mix(out)

    @staticmethod
    def _long(raw: np.ndarray, lower: bool, up: np.ndarray, base: int) -> int:
        """The sum that hashes() makes, for a word of more than HASH_BYTES."""
        out = 0
        for k in range(0, len(raw), HASH_BYTES):
            part = raw[k : k + HASH_BYTES]
            part = ((LOWER[part] if lower else part).astype(U) + U(1)) * up[: len(part)]
            out += int(part.sum(dtype=U)) * pow(base, k, 1 << 64)
        return out % (1 << 64)

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The (kept) words, each followed by one space, and where each begins (n + 1)."""
        start, end = (self.start, self.end) if keep is None else (self.start[keep], self.end[keep])
        size = end - start + 1
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        if not len(size):
            return np.zeros(0, np.uint8), at
        index = np.repeat((start - at[:-1]).astype(np.int64), size)
        index += np.arange(at[-1])
        last = at[1:] - 1
        index[last] = 0
        out = self.raw[index]
        out[last] = 0x20
        return out, at


def windows(h: np.ndarray, n: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of each run of n consecutive items (len - n + 1; empty if there are fewer)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = h[:m].copy()
    for j in range(1, n):
        out *= U(base)
        out += h[j : j + m]
    return mix(out)


def whole(first: np.ndarray, n: int) -> np.ndarray:
    """Which of the runs of n consecutive words lie in one text; first: see Words."""
    total = int(first[-1])
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return left[:m] >= n


def sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of x[first[i]:first[i + 1]] for each i; counts, if x is a mask."""
    total = np.zeros(len(x) + 1, np.int64 if x.dtype == bool else x.dtype)
    np.cumsum(x, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def by_row(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """The order that sorts by row, then h."""
    order = np.argsort(h, kind="stable")
    return order[np.argsort(row[order].astype(np.uint16 if rows < 1 << 16 else np.int64), kind="stable")]


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def batches(column: str):
    """Iterator over record batches -> (rows as a RecordBatch slice, bytes, offsets)."""

    def cut(stream):
        for batch in stream:
            texts = batch.column(column)
            for i, j, raw, at in slices(texts):
                yield batch.slice(i, j - i), raw, at
            del batch, texts
        give_back()

    return cut


def give_back() -> None:
    """Returns freed memory to the system at the end of a task; Python workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
