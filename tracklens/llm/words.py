"""Vectorised words, word hashes and word windows over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is what
the pattern ``[^\\x20\\x09-\\x0D]+`` finds in UTF-8 text. Nothing here builds
Python strings: a slice of documents is one byte buffer and word borders are
masks. A word of up to LONG bytes is hashed in blocks of 8 bytes by a chain of
bijections, a longer one by xxHash; a window's hash is a tree of such mixes
over its words. No step is linear in the bytes, so texts with structure (one
letter repeated, Thue-Morse words) collide no more often than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
SLICE_BYTES = 1 << 18
LONG = 64
_LEFT, _RIGHT = U64(0x9FB21C651E98DF25), U64(0xC2B2AE3D27D4EB4F)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _splitmix(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes, in this order."""
    with np.errstate(over="ignore"):
        return mix(a * _LEFT + (b ^ (b >> U64(29))) * _RIGHT)


class Hasher:
    """Two seeds give two independent 64-bit hashes of the same words; lower: A-Z count as a-z."""

    def __init__(self, seed: int, lower: bool):
        self.seed, self.lower = int(_splitmix(1, seed)[0]), lower


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A hash of data[start:end] for each pair, the length included."""
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place
    with np.errstate(over="ignore"):
        h = mix(size.astype(U64) * _LEFT + U64(seed))
        rest = np.arange(len(size))
        for at in range(0, LONG, 8):
            left = size[rest] - at
            if at:
                rest, left = rest[left > 0], left[left > 0]
            if not len(rest):
                break
            block = eight[start[rest] + at] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(8) * np.clip(8 - left, 0, 7).astype(U64)))
            h[rest] = mix(h[rest] ^ block) if at else mix(h ^ block)
    raw = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]], seed)
    return h


@dataclass
class Words:
    """Words of consecutive documents; ``first[d]:first[d + 1]`` are those of document d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    at: int
    off: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, h: Hasher) -> np.ndarray:
        return hash_ranges(_FOLD[self.data] if h.lower else self.data, self.start, self.end, h.seed)

    def windows(self, hashes: np.ndarray, k: int, h: Hasher, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of all k-word windows within documents, by position.

        short: a document with 1 to k-1 words gives one window, all its words.
        """
        n = self.counts
        i = np.arange(len(hashes))
        keep = i + k <= np.repeat(self.first[1:], n)
        whole = _windows(hashes, k)
        out = whole[keep[: len(whole)]]
        i = i[keep]
        if short and ((n > 0) & (n < k)).any():
            few = np.flatnonzero((n > 0) & (n < k))
            own = np.zeros(len(few), U64)
            for size in range(1, k):
                at = self.first[few[n[few] == size]]
                x = mix(hashes[at] + U64(size))
                for j in range(1, size):
                    x = join(x, hashes[at + j])
                own[n[few] == size] = x
            i = np.concatenate([i, self.first[few]])
            order = np.argsort(i, kind="stable")
            return np.concatenate([out, own])[order], i[order]
        return out, i

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def joined(self) -> bytes:
        """All words, one space between."""
        size = self.end - self.start
        to = np.cumsum(size + 1) - size - 1
        out = np.full(int(size.sum()) + len(size), 32, np.uint8)
        at = np.repeat(self.start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[np.repeat(to - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = self.data[at]
        return out[:-1].tobytes()

    def document(self, d: int) -> bytes:
        return self.data[self.off[d] : self.off[d + 1]].tobytes()


def _windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive hashes: those of 1, 2, 4, ... are joined by the binary digits of k."""
    if len(h) < k:
        return np.zeros(0, U64)
    out, done, size = None, 0, 1
    while True:
        if k & size:
            out = h if out is None else join(out[: len(h) - done], h[done:])
            done += size
        if 2 * size > k:
            return out
        h, size = join(h[: len(h) - size], h[size:]), 2 * size


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of whole documents, about ``size`` bytes of text at a time; null counts as empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    at = 0
    for c in chunks:
        if not len(c):
            continue
        c = c.fill_null("")
        c = c if pa.types.is_large_string(c.type) else c.cast(pa.large_string())
        off = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        raw = c.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(c):
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            yield _split(data[off[i] : off[j]], off[i : j + 1] - off[i], at + i)
            i = j
        at += len(c)


def _split(data: np.ndarray, off: np.ndarray, at: int) -> Words:
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, off), at, off)


def lower_ascii(text: bytes) -> bytes:
    """A-Z become a-z; every other byte stays (this is what bytes.lower does)."""
    return text.lower()
