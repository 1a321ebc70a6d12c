"""Operator 3: embedding near-dedup by collision-counting projections.

Vectors of length 1 are projected on PROJECTIONS random directions, rounded to
an eighth of the window's half-width. A pair collides in a projection if it lies in a window around each other's value
(the window is centred on the query), and pairs with at least ``least`` collisions are verified by the cosine in
double precision. The number of collisions that a pair at the threshold reaches with probability
COUNT_RECALL follows from the binomial distribution; closer pairs reach it more often.

One projection tells too little: a window of it holds about a third of all unrelated vectors, so counting over the whole
table would be quadratic. Vectors are therefore dealt T times into cells, by ``bits`` sign bits of further
projections, and the projections are sorted and searched inside the cells. T is such that a pair at the threshold shares some cell and
passes the count with probability RECALL. The bits grow with the number of vectors, so cells keep about CELL vectors.

1. Count: (cell, id, rounded projections) is dealt out, a byte a projection. In a cell every projection is
   sorted, windows are found by binary search, collisions are counted by pair, and the members that have a pair to verify are told.
2. Verify: the vectors of these members alone are dealt out by cell, where the pairs that pass the count, and no others, are
   compared. A pair is handled in the first table in which it shares a cell; tasks emit sums of links and the edges of a spanning forest, never lists of pairs.

Equal vectors are one class and are compared once, weighted by their number.
Cells are dealt to tasks in blocks of at most BLOCK vectors, and every pair of
blocks of a cell is a task of its own, so no task holds a large cell.
Vectors of each length are compared among themselves.

Vectors that are null, zero, or hold null or
non-finite components link with nothing. Ids are unique in the intended
table; rows with a repeated id are each compared, and summed under the id. Null ids link with nothing. Extra columns,
labels included, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.llm.packed import forest, runs
from tracklens.llm.spark import components, cut

RECALL, COUNT_RECALL, PROJECTIONS, CELL, BLOCK, TILE = 0.998, 0.9998, 64, 192, 1024, 256
SPREAD, STEPS = 1.2, 8  # half-width of a window, in standard deviations of the difference of a pair at the threshold, and in rounded values
BROADCAST_CELLS = 500_000


@dataclass(frozen=True)
class Plan:
    dim: int
    bits: int
    tables: int
    least: int
    half: float
    cosine: float

    @classmethod
    def calibrate(cls, n: int, dim: int, cosine: float) -> Plan:
        bits = min(62, max(1, round(math.log2(max(n, 2) / CELL))))
        hit = math.erf(SPREAD / math.sqrt(2))
        below, least = 0.0, 0
        while below + (p := math.comb(PROJECTIONS, least) * hit**least * (1 - hit) ** (PROJECTIONS - least)) <= 1 - COUNT_RECALL:
            below, least = below + p, least + 1
        found = (1 - math.acos(cosine) / math.pi) ** bits * (1 - below)
        tables = math.ceil(math.log(1 - RECALL) / math.log(1 - found)) if found < 1 else 1
        return cls(dim, bits, tables, max(1, least), SPREAD * math.sqrt(2 - 2 * cosine), cosine)

    def values(self, unit: np.ndarray) -> np.ndarray:
        """Rounded projections of unit vectors. The directions come from a fixed seed."""
        rng = np.random.default_rng(20240229)
        return np.clip(np.floor(unit @ rng.standard_normal((self.dim, PROJECTIONS)) * (STEPS / self.half)), -128, 127).astype(np.int8)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table."""
        rng = np.random.default_rng(20240301)
        cell = np.zeros((len(unit), self.tables), np.int64)
        for _ in range(self.bits):
            cell = cell * 2 + (unit @ rng.standard_normal((self.dim, self.tables)) >= 0)
        return cell


def _units(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    """Vectors of length 1, in double precision, from the packed components as they came."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many windows each pair of rows of a and b shares: every projection is sorted, and windows are searched in it."""
    count = np.zeros(len(a) * len(b), np.int64)
    for x, y in zip(a.T.astype(np.int16), b.T.astype(np.int16), strict=True):
        order = np.argsort(y, kind="stable")
        low, high = np.searchsorted(y[order], x - STEPS, "left"), np.searchsorted(y[order], x + STEPS, "right")
        size = high - low
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        count += np.bincount(np.repeat(np.arange(len(x)) * len(y), size) + order[at], minlength=len(count))
    return count.reshape(len(a), len(b))


def to_verify(a: np.ndarray, b: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a and of b (of a alone, if None) have a pair with enough collisions."""
    inside = b is None
    b = a if inside else b
    one, two = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for i in range(0, len(a), TILE):
        for j in range(i if inside else 0, len(b), TILE):
            if one[i : i + TILE].all() and two[j : j + TILE].all():
                continue
            met = collisions(a[i : i + TILE], b[j : j + TILE]) >= least
            if inside and i == j:
                np.fill_diagonal(met, False)
            one[i : i + TILE] |= met.any(1)
            two[j : j + TILE] |= met.any(0)
            if inside:
                one |= two
                two |= one
    return one, two


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with the same row of b; both have length 1."""
    return np.einsum("ij,ij->i", a, b)


def _links(plan: Plan, table: int, a: tuple, b: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (i, j) of two blocks of a cell, or of one with itself, that share no cell in an earlier table.

    Collisions are counted first, a tile at a time; only pairs that pass the count are compared.
    """
    (ua, ca, va), (ub, cb, vb) = a, a if b is None else b
    out = [(np.zeros(0, np.int64),) * 2]
    for s in range(0, len(ua), TILE):
        for t in range(s if b is None else 0, len(ub), TILE):
            met = collisions(va[s : s + TILE], vb[t : t + TILE]) >= plan.least
            i, j = np.nonzero(np.triu(met, 1) if b is None and s == t else met)
            i, j = i + s, j + t
            for before in range(table):
                keep = ca[i, before] != cb[j, before]
                i, j = i[keep], j[keep]
            keep = cosines(ua[i], ub[j]) >= plan.cosine
            out.append((i[keep], j[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocked(df: DataFrame, counts: DataFrame, *more: str) -> DataFrame:
    """df (t, cell, rep, ...) by pairs of blocks of its cells, in order of them; counts (t, cell) has a row for each row of df."""
    large = counts.groupBy(F.col("t").alias("ct"), F.col("cell").alias("cc")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    large = cut(large)
    large = F.broadcast(large) if large.count() <= BROADCAST_CELLS else large
    d = df.join(large, (F.col("t") == F.col("ct")) & (F.col("cell") == F.col("cc")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    d = d.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("t", "cell", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "rep", *more)
    return d.repartition("t", "cell", "bi", "bj").sortWithinPartitions("t", "cell", "bi", "bj")


def _by_cell(batches: Iterator[pa.RecordBatch], work: Callable[[tuple, pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    held, last = [], None
    for b in batches:
        keys = [b.column(k).to_numpy() for k in range(4)]
        at, _ = runs(*keys)
        for i, j in zip(at, [*at[1:], b.num_rows], strict=True):
            key = tuple(int(k[i]) for k in keys)
            if key != last and held:
                if (out := work(last, pa.Table.from_batches(held))) is not None:
                    yield out
                held = []
            last = key
            held.append(b.slice(i, j - i))
    if held and (out := work(last, pa.Table.from_batches(held))) is not None:
        yield out


def _of_length(good: DataFrame, dim: int, n: int, kind: type, cosine: float) -> DataFrame:
    """(uid, n_links, component_id) of the usable vectors (id, v) of one length."""
    plan = Plan.calibrate(n, dim, cosine)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(-1, dim).astype(kind)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "unit"])

    unit = cut(good.where(F.size("v") == dim).mapInArrow(packed, "id long, unit binary").withColumn("class", F.sha2("unit", 256)))
    reps = cut(unit.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit")))

    def deal(counts: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _units(b.column(1), dim, kind)
                    cell = plan.cells(x)
                    body = [] if counts else [b.column(0), pa.array([r.tobytes() for r in plan.values(x)], pa.binary())]
                    for t in range(plan.tables):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), t, np.int32)), pa.array(cell[:, t]), *body], names=["t", "cell", *([] if counts else ["rep", "values"])])

        return run

    own = reps.select("rep", "unit")
    dealt = _blocked(own.mapInArrow(deal(False), "t int, cell long, rep long, values binary"), own.mapInArrow(deal(True), "t int, cell long"), "values")

    def count(key: tuple, table: pa.Table) -> pa.RecordBatch | None:
        t, cell, bi, bj = key
        own, rep = table.column("own").to_numpy(), table.column("rep")
        x = np.frombuffer(b"".join(table.column("values").to_pylist()), np.int8).reshape(-1, PROJECTIONS)
        if bi == bj:
            some = to_verify(x, None, plan.least)[0]
        else:
            some = np.zeros(len(x), bool)
            some[own == bi], some[own == bj] = to_verify(x[own == bi], x[own == bj], plan.least)
        if not some.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), t, np.int32)), pa.array(np.full(int(some.sum()), cell)), pa.array(rep.to_numpy()[some])], names=["t", "cell", "rep"])

    marked = cut(dealt.mapInArrow(lambda batches: _by_cell(batches, count), "t int, cell long, rep long").distinct())
    about = reps.select(F.col("rep").alias("r0"), "copies", "unit")
    chosen = _blocked(marked.join(about, F.col("rep") == F.col("r0")), marked, "copies", "unit")

    def verify(key: tuple, table: pa.Table) -> pa.RecordBatch | None:
        t, _, bi, bj = key
        own, rep, copies = (table.column(c).to_numpy() for c in ("own", "rep", "copies"))
        x = _units(table.column("unit").combine_chunks(), dim, kind)
        side = lambda i: (x[i], plan.cells(x[i]), plan.values(x[i]))
        first, second = (np.arange(len(x)),) * 2 if bi == bj else (np.flatnonzero(own == bi), np.flatnonzero(own == bj))
        if not len(first) or not len(second):
            return None
        i, j = _links(plan, t, side(first), None if bi == bj else side(second))
        if not len(i):
            return None
        i, j = first[i], second[j]
        links = np.zeros(len(x), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        to = np.full(len(x), -1, np.int64)
        order = np.argsort(rep, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        for a, r in forest(len(x), rank[i], rank[j]):
            to[order[a]] = rep[order[r]]
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(np.where(to[some] < 0, rep[some], to[some]))], names=["rep", "links", "root"])

    found = cut(chosen.mapInArrow(lambda batches: _by_cell(batches, verify), "rep long, links long, root long").groupBy("rep", "root").agg(F.sum("links").alias("links")))
    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy(F.col("rep").alias("r1")).agg(F.sum("links").alias("links"))
    of_class = reps.select("class", "rep", "copies").join(sums, F.col("rep") == F.col("r1"), "left").join(linked, F.col("rep") == F.col("id"), "left")
    of_class = of_class.select(F.col("class").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    return unit.select(F.col("id").alias("uid"), "class").join(of_class, F.col("class") == F.col("c")).select("uid", "n_links", "component_id")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable, v).alias("v"))
    good = rows.where("v is not null")
    kind = np.float32 if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else np.float64
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy("d").collect()  # a row for each length of a vector
    parts = [_of_length(good, r.d, r.c, kind, cosine) for r in lengths]
    if not parts:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    members = reduce(DataFrame.union, parts).groupBy("uid").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("id").join(members, F.col("id") == F.col("uid"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
