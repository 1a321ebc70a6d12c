"""Operator 8: removal of word windows that an earlier document has, by a count-min prefilter.

A window is ``k`` consecutive words of one document. A word goes if a window
that covers it starts in a document with a smaller id too; windows are judged
on the input.

Documents are dealt into groups of a few MB of text by a hash of the row, so
copies spread. Pass 1: each group makes a sparse count-min sketch of its
windows, DEPTH rows of about WIDTH cells for each window of the whole input; a
count of 2 stands for more than one document. Sketches are merged by ranges of cells, and each group
learns which of its cells count 2 or more. Counts are never underestimated,
so a window whose cells don't all count 2 is in one document only. Pass 2
groups exactly, by the 64-bit hash and a 64-bit BLAKE2b digest of the words, only the windows that
are estimated repeated: a group sends each once, with the smallest id in it,
and gets back whether another group has a smaller one. Pass 3 removes words.
A window that a third of all documents share is thus one entry a group.

All messages are packed arrays, so the exchanged bytes are about 3 a window;
the text itself is shuffled once and its exchange is reused by all passes. There are as many
ranges as groups, so a range holds about as many cells as a group has windows at any input; messages get
shorter instead, and are at most as many as there are cells.

Null texts have no words. Documents with a null id neither lose words nor
make others lose any. Rows that repeat an id count as one document. Texts of any length are
handled whole. Columns of the input named n_words, n_removed or kept_text are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracklens.llm.packed import pack, pack_bits, runs, unpack, unpack_bits
from tracklens.llm.spark import grouped
from tracklens.llm.words import U64, Hasher, Words, mix, slices

WINDOW = 13
DEPTH, WIDTH = 2, 4
_HASH = Hasher(101, False)


class Scan:
    """Words and windows of one group, in order of position."""

    def __init__(self, t: pa.Table, k: int):
        self.slices: list[Words] = list(slices(t.column("text")))
        ids = t.column("id")
        self.valid = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        h, start, doc, words = [], [], [], 0
        for s in self.slices:
            own, at = s.windows(s.hashes(_HASH), k, _HASH)
            d = s.doc[at] + s.at
            keep = self.valid[d]
            h.append(own[keep])
            start.append(at[keep] + words)
            doc.append(d[keep])
            words += len(s.start)
        self.words, self.k = words, k
        empty = np.zeros(0, np.int64)
        self.h, self.start, self.doc = (np.concatenate(x) if x else empty.astype(t_) for x, t_ in ((h, U64), (start, np.int64), (doc, np.int64)))

    def digests(self, w: np.ndarray) -> np.ndarray:
        """BLAKE2b of the words of windows, one space between."""
        raw = b" ".join([s.joined() for s in self.slices if len(s.start)])
        size = np.concatenate([s.end - s.start for s in self.slices] or [np.zeros(0, np.int64)]) + 1
        end = np.concatenate([[0], np.cumsum(size)])
        spans = zip(end[self.start[w]].tolist(), (end[self.start[w] + self.k] - 1).tolist(), strict=True)
        return np.frombuffer(b"".join([hashlib.blake2b(raw[i:j], digest_size=8).digest() for i, j in spans]), U64)


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(h ^ U64(0xA5A5A5A5 * (row + 1))) >> U64(64 - bits)


def _shards(sorted_values: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Borders of n equal ranges of bits-bit values."""
    edges = [-(-(i << bits) // n) for i in range(n + 1)]
    edges[-1] = (1 << bits) - 1
    at = np.searchsorted(sorted_values, np.array(edges, dtype=U64))
    at[-1] = len(sorted_values)
    return at


class Sketch:
    """The sparse count-min sketch of a group: for each row its cells in order, and how windows map to them."""

    def __init__(self, scan: Scan, bits: int):
        self.order = np.argsort(scan.h)
        h = scan.h[self.order]
        self.at, self.run = runs(h)
        self.rows = []
        for row in range(DEPTH):
            c = _cells(h[self.at], row, bits)
            o = np.argsort(c)
            c = c[o]
            first, cell = runs(c)
            self.rows.append((o, first, cell, c[first]))

    def many(self, scan: Scan) -> list[np.ndarray]:
        """For each row, which cells the group has more than one document in."""
        if not len(self.at):
            return [np.zeros(0, bool)] * DEPTH
        ids = scan.ids[scan.doc[self.order]]
        count = 1 + (np.minimum.reduceat(ids, self.at) < np.maximum.reduceat(ids, self.at))
        return [np.add.reduceat(count[o], first) > 1 for o, first, _, _ in self.rows]

    def repeated(self, heavy: list[np.ndarray]) -> np.ndarray:
        """The windows, in order of hash, all of whose cells count 2 or more."""
        keep = np.ones(len(self.at), bool)
        for (o, _, cell, cells), h in zip(self.rows, heavy, strict=True):
            if len(h) != len(cells):
                raise RuntimeError("replies don't fit the sketch of this group")
            keep[o] &= h[cell]
        return self.order[keep[self.run]]


def _table(rows: list[tuple], kind: int) -> pa.Table:
    """Messages (g, kind, shard, body, more)."""
    return pa.table({"g": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([kind] * len(rows), pa.int32()), "shard": pa.array([r[1] for r in rows], pa.int32()), "body": pa.array([r[2] for r in rows], pa.binary()), "more": pa.array([r[3] for r in rows], pa.binary())})


MESSAGE = "g int, kind int, shard int, body binary, more binary"


def _messages(t: pa.Table) -> list[tuple]:
    return sorted(zip(*(t.column(c).to_pylist() for c in ("g", "kind", "shard", "body", "more")), strict=True), key=lambda r: r[:3])


def _repeated(scan: Scan, replies: list[tuple], bits: int) -> np.ndarray:
    """Windows that are estimated to be in more than one document, in order of hash."""
    bodies: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
    for _, kind, shard, body, _ in replies:
        if kind == 1:
            bodies[shard % DEPTH].append(unpack_bits(body))
    return Sketch(scan, bits).repeated([np.concatenate(x) if x else np.zeros(0, bool) for x in bodies])


def _candidates(scan: Scan, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """(windows in order of hash and digest, hash, digest, run of each, smallest id of each run)."""
    h, h2 = scan.h[w], scan.digests(w)
    if ((h[1:] == h[:-1]) & (h2[1:] != h2[:-1])).any():
        o = np.lexsort((h2, h))
        w, h, h2 = w[o], h[o], h2[o]
    at, run = runs(h, h2)
    ids = scan.ids[scan.doc[w]]
    return w, h[at], h2[at], run, np.minimum.reduceat(ids, at) if len(at) else ids


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, digest: bool = False, **limits: int) -> DataFrame:
    """All columns of docs, and n_words, n_removed, kept_text (kept words, one space between; null where nothing was removed).

    digest: kept_sha256 of the kept words of every document instead of the text columns.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text")
    others = [c for c in docs.columns if c not in (id_col, text_col) and not digest]
    groups, n, total = grouped(docs, id_col, text_col, rest=others, **limits)
    windows = max(1, total // 5)
    bits = min(56, max(16, (WIDTH * windows).bit_length()))
    shards = n

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        rows, scan = [], Scan(t, k)
        sketch = Sketch(scan, bits)
        for row, ((_, _, _, cells), many) in enumerate(zip(sketch.rows, sketch.many(scan), strict=True)):
            at = _shards(cells, bits, shards)
            rows += [(key[0].as_py(), s * DEPTH + row, pack(cells[i:j], True), pack_bits(many[i:j])) for s, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if i < j]
        return _table(rows, 0)

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        got = _messages(t)
        cells = [unpack(r[3], True) for r in got]
        count = np.concatenate([1 + unpack_bits(r[4]) for r in got])
        every = np.concatenate(cells)
        o = np.argsort(every, kind="stable")
        first, run = runs(every[o])
        heavy = np.empty(len(every), bool)
        heavy[o] = (np.add.reduceat(count[o], first) > 1)[run]
        ends = np.cumsum([len(c) for c in cells])
        return _table([(r[0], r[2], pack_bits(heavy[e - len(c) : e]), None) for r, c, e in zip(got, cells, ends, strict=True)], 1)

    def ask_exact(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _table([], 2)
        scan = Scan(t, k)
        _, h, h2, _, low = _candidates(scan, _repeated(scan, _messages(replies), bits))
        at = _shards(h, 64, shards)
        spans = [(s, i, j) for s, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if i < j]
        return _table([(key[0].as_py(), s, pack(h[i:j], True), pack(h2[i:j])) for s, i, j in spans], 2).append_column("low", pa.array([pack(low[i:j]) for _, i, j in spans], pa.binary()))

    def merge_exact(key: tuple, t: pa.Table) -> pa.Table:
        got = sorted(zip(*(t.column(c).to_pylist() for c in ("g", "shard", "body", "more", "low")), strict=True), key=lambda r: r[:2])
        h = [unpack(r[2], True) for r in got]
        h2 = np.concatenate([unpack(r[3]) for r in got])
        low = np.concatenate([unpack(r[4]).view(np.int64) for r in got])
        every = np.concatenate(h)
        o = np.lexsort((h2, every))
        first, run = runs(every[o], h2[o])
        smaller = np.empty(len(every), bool)
        smaller[o] = np.minimum.reduceat(low[o], first)[run] < low[o]
        ends = np.cumsum([len(c) for c in h])
        return _table([(r[0], r[1], pack_bits(smaller[e - len(c) : e]), None) for r, c, e in zip(got, h, ends, strict=True)], 3)

    def remove(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({c: pa.array([], f) for c, f in zip(out_names, arrow_out, strict=True)})
        scan, got = Scan(t, k), _messages(replies)
        w, h, _, run, low = _candidates(scan, _repeated(scan, got, bits))
        bodies = [unpack_bits(r[3]) for r in got if r[1] == 3]
        smaller = np.concatenate(bodies) if bodies else np.zeros(0, bool)
        if len(smaller) != len(h):
            raise RuntimeError("replies don't fit the windows of this group")
        gone = w[smaller[run] | (low[run] < scan.ids[scan.doc[w]])] if len(w) else w
        cover = np.zeros(scan.words + 1, np.int32)
        np.add.at(cover, scan.start[gone], 1)
        np.add.at(cover, scan.start[gone] + k, -1)
        covered = np.cumsum(cover[:-1]) > 0
        n_words, n_removed, kept, base = [], [], [], 0
        for s in scan.slices:
            for d in range(len(s.first) - 1):
                i, j = int(s.first[d]), int(s.first[d + 1])
                c = covered[base + i : base + j]
                n_words.append(j - i)
                n_removed.append(lost := int(c.sum()))
                left = None
                if lost:
                    left = b" ".join([s.text(x) for x in i + np.flatnonzero(~c)])
                elif digest:
                    left = b" ".join(s.document(d).split())
                kept.append(left)
            base += len(s.start)
        counts = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        if digest:
            cols = [t.column("id"), *counts, pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        else:
            cols = [t.column("id"), t.column("text"), *counts, pa.array([x if x is None else x.decode("utf-8", "replace") for x in kept], pa.string())]
        return pa.table(dict(zip(out_names, [*cols, *([t.column("rest")] if others else [])], strict=True)))

    fields = [("id", "long"), *([] if digest else [("text", "string")]), ("n_words", "long"), ("n_removed", "long"), ("kept_sha256" if digest else "kept_text", "string")]
    fields += [("rest", groups.schema["rest"].dataType.simpleString())] if others else []
    out_names, ddl = [c for c, _ in fields], ", ".join(f"{c} {x}" for c, x in fields)
    arrow_out = to_arrow_schema(StructType.fromDDL(ddl)).types

    heavy = groups.groupBy("g").applyInArrow(ask, MESSAGE).groupBy("shard").applyInArrow(merge, MESSAGE)
    exact = groups.groupBy("g").cogroup(heavy.groupBy("g")).applyInArrow(ask_exact, MESSAGE + ", low binary").groupBy("shard").applyInArrow(merge_exact, MESSAGE)
    out = groups.groupBy("g").cogroup(heavy.unionByName(exact).groupBy("g")).applyInArrow(remove, ddl)
    if digest:
        return out.withColumnRenamed("id", id_col)
    return out.select(*[F.col("id").alias(id_col) if c == id_col else F.col("text").alias(text_col) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns], "n_words", "n_removed", "kept_text")

