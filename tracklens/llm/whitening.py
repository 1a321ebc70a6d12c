"""Operator 11: whitening of vectors by a tall-and-skinny QR (TSQR), without forming their covariance.

Entries c become x = floor(64 * c) + 1000000. The fit list is every distinct x once; its sums are exact integers. A task
centres its rows by them, x - S/n from the exact n*x - S, and keeps one triangle R of all its rows: that of [R; next rows].
Triangles are merged in a tree, FAN at a time. The singular values and right vectors of the last one are those of
all centred rows; every row is projected on these vectors and scaled.

A row is left out if its vector is null or empty or holds a null or non-finite entry. Vectors of different lengths are
fitted apart, each length with its own n, S and components. Components without variance (a singular value of at most RANK
times the largest) can't be scaled and have no rows, so a length with one distinct vector gives none. Repeated rows
and null ids keep their rows. Where 64 * c is beyond 2**62 it is held there; a deviation beyond 64 bits is null. Other columns aren't read.

The driver gets one fit for each length of vector, of length squared doubles, and refuses more than FIT_BYTES
of them in all. Nothing that it gets grows with the number of rows.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.llm.spark import scratch

COMPONENTS = 16
FAN = 8
RANK = 1e-13
BLOCK = 1 << 19  # entries that are centred at once
FIT_BYTES = 256 << 20
LIMIT = 2**62


@dataclass(frozen=True)
class Fit:
    """Of the vectors of one length: how many, exact sums, unit vectors as columns, their variances, the trace, the check."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact; objects where 64 bits don't hold it."""
        return deviations(x, self.n, self.sums)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return centred(self.deviations(x), self.n) @ (self.vectors / np.sqrt(self.values))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums), default=0)
    kind = np.int64 if top < LIMIT else object
    return x.astype(kind) * n - np.array(sums, kind)


def centred(d: np.ndarray, n: int) -> np.ndarray:
    return (d / n).astype(np.float64)


def quantised(c: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(64.0 * c), -float(LIMIT), float(LIMIT)).astype(np.int64) + 1_000_000


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, values as rows) of the vectors of a list column that are without nulls, for each length but 0."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, start = column.flatten(), np.cumsum(size) - size
    for d in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == d)
        cells = flat if len(at) == len(size) else flat.take(pa.array((start[at][:, None] + np.arange(d)).ravel()))
        whole = cells.is_valid().to_numpy(zero_copy_only=False).reshape(-1, d).all(axis=1)
        yield d, at[whole], cells.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, d)[whole]


def finite(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """by_length of the x of a column of vectors, without vectors that hold non-finite entries."""
    for d, at, c in by_length(column):
        c = c.astype(np.float64)
        ok = np.isfinite(c).all(axis=1)
        yield d, at[ok], quantised(c[ok])


def arrays(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(rows.ravel(), kind))


def fit_list(vectors: DataFrame, vec_col: str) -> DataFrame:
    """x of every vector that counts, each once, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, x in finite(b.column(0)):
                if len(x):
                    yield pa.RecordBatch.from_arrays([arrays(x, pa.int64())], names=["x"])

    out = scratch(vectors.sparkSession, "fit-list")
    vectors.select(vec_col).mapInArrow(run, "x array<long>").distinct().write.parquet(out)
    return vectors.sparkSession.read.parquet(out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for b in batches:
        for d, _, x in by_length(b.column(0)):
            for i in range(0, len(x), max(1, BLOCK // d)):
                yield d, x[i : i + max(1, BLOCK // d)]


def _summed(fit: DataFrame, kind: str, values: Callable[[int, np.ndarray], list]) -> dict[int, tuple[int, list]]:
    """By length: rows, and the sums of the values of all blocks of rows; added up in tasks first, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for d, x in _blocks(batches):
            new = [len(x), *values(d, x)]
            sums[d] = [a + b for a, b in zip(sums[d], new, strict=True)] if d in sums else new
        for d, s in sums.items():
            cell = [decimal.Decimal(v) for v in s[1:]] if kind.startswith("decimal") else s[1:]
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([s[0]], pa.int64()), pa.array([cell], pa.list_(pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64()))], names=["d", "n", "s"])

    parts = fit.mapInArrow(run, f"d int, n long, s array<{kind}>")
    sums = parts.select("d", "n", F.posexplode("s").alias("k", "v")).groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    out: dict[int, tuple[int, list]] = {}
    for r in sums.orderBy("d", "k").toLocalIterator():
        out.setdefault(r.d, (r.n, []))[1].append(r.v)
    return out


def _exact(_: int, x: np.ndarray) -> list[int]:
    high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
    return [(h << 32) + w for h, w in zip(high, low, strict=True)]


def _triangle(*rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack(rows), mode="r")


def triangles(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """R of all centred rows of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for d, x in _blocks(batches):
            n, s = sums[d]
            c = centred(deviations(x, n, s), n)
            held[d] = _triangle(held[d], c) if d in held else _triangle(c)
        node = TaskContext.get().partitionId()
        for d, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([node], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["d", "node", "r"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = _triangle(*[np.frombuffer(x).reshape(-1, key[0]) for x in rows["r"]])
        return pd.DataFrame({"d": [key[0]], "node": [key[1]], "r": [r.tobytes()]})

    schema, out = T.StructType.fromDDL("d int, node long, r binary"), scratch(fit.sparkSession, "triangles")
    fit.mapInArrow(run, schema).write.parquet(out)
    left = fit.sparkSession.read.parquet(out)
    nodes = (left.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > 1:
        left = left.groupBy("d", F.floor(F.col("node") / FAN).alias("node")).applyInPandas(merge, schema)
        nodes = -(-nodes // FAN)
    return {r.d: np.frombuffer(bytes(r.r)).reshape(-1, r.d) for r in left.toLocalIterator()}


def fits(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of vector."""
    fit = fit_list(vectors, vec_col)
    need = fit.select(F.size("x").cast("long").alias("d")).distinct().agg(F.sum(F.col("d") * F.col("d") * 8)).first()[0] or 0
    if need > FIT_BYTES:
        raise ValueError(f"the fits of these lengths of vectors take {need} bytes, more than {FIT_BYTES}")
    sums = {d: (n, [int(v) for v in s]) for d, (n, s) in _summed(fit, "decimal(38,0)", _exact).items()}
    found: dict[int, Fit] = {}
    for d, r in triangles(fit, sums).items():
        n, s = sums[d]
        _, sigma, right = np.linalg.svd(r, full_matrices=False)
        k = int((sigma[:components] > RANK * sigma[0]).sum()) if sigma.size and sigma[0] > 0 else 0
        found[d] = Fit(n, s, right[:k].T.copy(), sigma[:k] ** 2 / n, float((sigma**2).sum() / n), 0.0)

    def moments(d: int, x: np.ndarray) -> list[float]:
        w = found[d].whiten(x)
        return [*w.sum(axis=0).tolist(), *(w.T @ w).ravel().tolist()]

    for d, (n, m) in _summed(fit, "double", moments).items():
        k = len(found[d].values)
        mean, square = np.array(m[:k]) / n, np.array(m[k:]).reshape(k, k) / n
        off = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
        found[d] = Fit(n, found[d].sums, found[d].vectors, found[d].values, found[d].trace, off)
    return found


def whiten(vectors: DataFrame, found: dict[int, Fit], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened array, explained array, identity_error) of every vector that counts."""
    rows = vectors.select(id_col, vec_col)
    kinds = [("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64())), ("identity_error", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in finite(b.column(1)):
                f = found[d] if len(at) else None
                for i in range(0, len(at), max(1, BLOCK // d)):
                    own = x[i : i + max(1, BLOCK // d)]
                    dev, w = f.deviations(own), f.whiten(own)
                    wide = dev.dtype == object or d * int(np.abs(dev).max(initial=0)) ** 2 >= LIMIT
                    far = [v if v < 2**63 else None for v in (dev.astype(object) ** 2).sum(axis=1).tolist()] if wide else (dev * dev).sum(axis=1)
                    share = np.tile(f.values / f.trace, (len(own), 1)) if len(f.values) else np.zeros((len(own), 0))
                    columns = [b.column(0).take(pa.array(at[i : i + len(own)])), pa.array([f.n] * len(own), pa.int64()), pa.array(far, pa.int64()), arrays(w, pa.float64()), arrays(share, pa.float64()), pa.array([f.identity_error] * len(own), pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_col, *[k for k, _ in kinds]])

    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), *T.StructType.fromDDL("n long, deviation long, whitened array<double>, explained array<double>, identity_error double").fields])
    return rows.mapInArrow(run, schema)


def components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each vector that counts and component from 1: (id, component, n, deviation, whitened, explained, identity_error)."""
    w = whiten(vectors, fits(vectors, vec_col, most), id_col, vec_col)
    w = w.select(id_col, "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return w.select(id_col, (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
