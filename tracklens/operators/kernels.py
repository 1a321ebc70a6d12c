"""Kernel ridge regression on all training rows, tile by tile of the Gram matrix."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions.numbers import finite
from tracklens.lineage import shared_dir
from tracklens.operators.order import ranked
from tracklens.sources.ranges import store_of

BINS = 65536  # that a range of distances is cut into
FEW = 4096  # distances that the driver takes to sort
SAMPLE = 2048  # rows whose pairs tell where a median may be
CACHE_BYTES = 64 << 20  # of a model that a worker keeps


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a and each of b, by the Gram identity; never negative."""
    out = (-2 * a) @ b.T
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1)[None, :]
    return np.maximum(out, 0.0, out=out)


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(-1, dim)


FINE = 8e-4  # of a residual is left by steps in single precision, which could hardly leave less than 1e-5
STRIP = 256  # rows of a tile whose distances are held at once
Place = tuple[str, int]  # file and length of the vectors of a block
Work = Callable[[str, int, int, Place, Place], Iterable[tuple]]


@lru_cache(3)
def _block(uri: str, dim: int) -> np.ndarray:
    store, path = store_of(uri)
    return _matrix(pq.read_table(path, columns=["x"], filesystem=store).column("x")[0].as_py(), dim)


def _pairs(i: int, j: int, left: Place, right: Place) -> Iterator[np.ndarray]:
    """Squared distances of a tile by strips, each pair once and no row with itself."""
    a, c = _block(*left), _block(*right)
    for s in range(0, len(a), STRIP):
        d = squared_distances(a[s : s + STRIP], c)
        yield d[np.arange(s, s + len(d))[:, None] < np.arange(d.shape[1])[None]] if i == j else d


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the rows i of a and j of b, from their differences: equal rows are at 0."""
    out, few = np.empty(len(i)), max(1, (1 << 20) // max(1, a.shape[1]))
    for s in range(0, len(i), few):
        d = a[i[s : s + few]]
        d -= b[j[s : s + few]]
        out[s : s + few] = np.einsum("ij,ij->i", d, d)
    return out


def _within(i: int, j: int, left: Place, right: Place, ranges: list[tuple[float, float]]) -> Iterator[tuple[int, int, np.ndarray, float]]:
    """(range, how many pairs are below it, squared distances in it, a bound of all) of each strip of a tile and range [low, high), each pair once.

    Single precision tells the pairs that are outside by more than its error can be; the others are computed exactly.
    """
    a, c = _block(*left), _block(*right)
    centre = a.mean(0)
    x, z = a - centre, c - centre
    own, other = (x * x).sum(1)[:, None], (z * z).sum(1)[:, None]
    top = float(np.sqrt(own.max()) + np.sqrt(other.max())) ** 2
    kind = np.float32 if 1e-30 < top < 1e30 else np.float64
    slack = (a.shape[1] + 8) * float(np.finfo(kind).eps) * top
    x, z = np.hstack([-2 * x, own, np.ones_like(own)]).astype(kind), np.hstack([z, np.ones_like(other), other]).astype(kind)
    for s in range(0, len(a), STRIP):
        d = x[s : s + STRIP] @ z.T
        if i == j:
            d[np.arange(s, s + len(d))[:, None] >= np.arange(d.shape[1])[None]] = np.nan
        for at, (low, high) in enumerate(ranges):
            m, n = np.divmod(np.flatnonzero((d >= low - slack) & (d < high + slack)), d.shape[1])
            own = _exact(a, c, m + s, n)
            yield at, int(np.count_nonzero(d < low - slack) + np.count_nonzero(own < low)), own[(own >= low) & (own < high)], top + slack


def _scaled(x: np.ndarray, centre: np.ndarray, width: float, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """(a, c) with a @ c.T of two blocks the exponents of the kernel between them."""
    x = (x - centre) / width
    half, one = -(x * x).sum(1)[:, None] / 2, np.ones((len(x), 1))
    return np.hstack([x, half, one]).astype(kind), np.hstack([x, one, half]).astype(kind)


@lru_cache(4)
def _scaled_block(uri: str, dim: int, centre: bytes, width: float, kind: type) -> tuple[np.ndarray, np.ndarray]:
    return _scaled(_block(uri, dim), np.frombuffer(centre), width, kind)


def _kernel(a: np.ndarray, c: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows of a, kernel of them and all of c) by strips; of _scaled rows."""
    for s in range(0, len(a), STRIP):
        k = a[s : s + STRIP] @ c.T
        if k.dtype == np.float64:
            np.minimum(k, 0, out=k)
        yield slice(s, s + len(k)), np.exp(k, out=k)


def _sum(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """(b, q): the sum of the vectors q of a b."""
    return pd.DataFrame({"b": [key[0]], "q": [np.sum([np.frombuffer(q) for q in part["q"]], axis=0).tobytes()]})


class Tiles:
    """All pairs of the rows of each group, as pairs of blocks of ``tile`` rows.

    Rows (``v``, and with it ``extra`` as doubles) are ranked by hash in their group and packed into blocks, a file each in the shared folder. A tile is two
    places: its task reads two blocks by place and holds distances for STRIP rows of it, so no pass over the pairs shuffles or writes vectors, and memory
    doesn't grow with the rows. The driver holds the list of blocks, so groups should be few. Rows of a group are taken as different, whatever their ids are.
    """

    def __init__(self, rows: DataFrame, group: str | None = None, extra: str | None = None, tile: int = 4096):
        self.spark, self.tile = rows.sparkSession, tile
        self.folder = f"{shared_dir(self.spark)}/kernel-{uuid.uuid4().hex}"
        grp = (F.col(group).cast("string") if group else F.lit("")).alias("g")
        rows = rows.select(grp, "v", (F.col(extra) if extra else F.lit(0.0)).alias("y")).where("g is not null")
        rows = ranked(rows.withColumn("_h", F.xxhash64("v", "y")), ["g"] if group else [], ["_h"], "_n").drop("_h")

        def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("_n")
            x = np.stack(part["v"].to_list()).astype(float)
            return pd.DataFrame({"g": [key[0]], "b": [int(key[1])], "n": [len(x)], "dim": [x.shape[1]], "x": [x.tobytes()], "y": [part["y"].to_numpy(float).tobytes()]})

        packed = rows.withColumn("_b", F.floor((F.col("_n") - 1) / tile)).groupBy("g", "_b").applyInPandas(pack, "g string, b int, n long, dim int, x binary, y binary")
        packed.write.option("maxRecordsPerFile", 1).parquet(f"{self.folder}/blocks")
        self.packed = self.spark.read.parquet(f"{self.folder}/blocks")
        self.sizes, self.files, self.dims = {}, {}, {}
        for r in self.packed.select("g", "b", "n", "dim", F.col("_metadata.file_path").alias("file")).collect():  # a row a block
            self.files[r.g, r.b], self.sizes[r.g], self.dims[r.g] = r.file, self.sizes.get(r.g, 0) + r.n, r.dim
        self.blocks = {g: 1 + max(b for h, b in self.files if h == g) for g in self.sizes}

    def each(self, work: Work, ddl: str, types: list[pa.DataType], finish: Callable[[], Iterator[tuple]] | None = None, tiles: list[tuple[str, int, int]] | None = None) -> DataFrame:
        """What work tells of each tile, (group, i, j, block i, block j) with i <= j, or of the tiles given, whose j need be no block; finish tells the rest of a task.

        Of a tile on the diagonal each pair is there twice, and each row with itself.
        """
        tiles = self.all() if tiles is None else tiles
        files, dims, names = self.files, self.dims, [x.split()[0] for x in ddl.split(", ")]
        parts = max(1, min(len(tiles), 4 * self.spark.sparkContext.defaultParallelism))
        shared = self.spark.sparkContext.broadcast((tiles, files, dims))

        def out(got: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate(types)], names=names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tiles, files, dims = shared.value
            for part in batches:
                for k in part.column(0).to_pylist():
                    g, i, j = tiles[k]
                    got = list(work(g, i, j, (files[g, i], dims[g]), (files.get((g, j), ""), dims[g])))
                    if got:
                        yield out(got)
            if finish is not None and (got := list(finish())):
                yield out(got)

        return self.spark.range(0, len(tiles), 1, parts).mapInArrow(run, ddl)

    def all(self, groups: set[str] | None = None) -> list[tuple[str, int, int]]:
        return [(g, i, j) for g, n in sorted(self.blocks.items()) if groups is None or g in groups for i in range(n) for j in range(i, n)]

    def medians(self) -> dict[str, float]:
        """By group, the median distance of all pairs, exactly: the range that holds the middle is cut into BINS until few values are in it. 0 without pairs.

        It begins with a range that the pairs of SAMPLE rows make likely; where the middle turns out to be beside it, the part of all values on that side is next.
        """
        pairs = {g: n * (n - 1) // 2 for g, n in self.sizes.items()}
        ranks = {g: sorted({(p - 1) // 2, p // 2}) for g, p in pairs.items() if p}
        start = {g: (0.0, np.inf) for g in ranks} | self._likely([g for g in ranks if pairs[g] > FEW])
        open_ = {(g, k): [*start[g], 0, pairs[g]] for g, own in ranks.items() for k in own}  # (group, rank) to [low, high), how many are below and in it
        told: dict[tuple[str, int], float] = {}  # squares
        tops: dict[str, float] = {}
        while open_:
            few, cut = self._cut(open_, pairs)
            for (g, k), s in list(open_.items()):
                if s[3] <= FEW:
                    told[g, k] = float(few[g, *s][k - s[2]])
                    del open_[g, k]
                    continue
                *open_[g, k], top = cut[g, k]
                low, high, _, held = open_[g, k]
                if held > FEW and high - low <= max(1e-13 * high, 1e-26 * tops.setdefault(g, top)):
                    told[g, k] = (low + high) / 2 if low else 0.0
                    del open_[g, k]
        return dict.fromkeys(self.sizes, 0.0) | {g: sum(float(np.sqrt(told[g, k])) for k in own) / len(own) for g, own in ranks.items()}

    def _cut(self, open_: dict[tuple[str, int], list], pairs: dict[str, int]) -> tuple[dict[tuple, np.ndarray], dict[tuple[str, int], tuple]]:
        """One pass: the sorted values of ranges that hold few, and by (group, rank) the bin of a range that holds it, with a bound of all values of the group."""
        ranges = sorted({(g, *s) for (g, _), s in open_.items()})
        asked = [[k for (g, k), s in open_.items() if (g, *s) == r] for r in ranges]
        found: dict[int, list] = {}

        def count(g: str, i: int, j: int, left: Place, right: Place) -> Iterator[tuple]:
            own = [(at, *r[1:]) for at, r in enumerate(ranges) if r[0] == g]
            for k, less, x, most in _within(i, j, left, right, [r[1:3] for r in own]):
                at, low, high, _, held = own[k]
                if held > FEW:
                    below, top, n = found.get(at) or (0, 0.0, np.zeros(BINS, np.int64))
                    n += np.bincount(np.searchsorted(_edges(low, high), x, "right") - 1, minlength=BINS)
                    found[at] = [below + less, max(top, most), n]
                elif x.size:
                    yield at, 0, 0.0, b"", x.tobytes()

        def rest() -> Iterator[tuple]:
            for at, (below, top, n) in found.items():
                b = np.flatnonzero(n)
                yield at, below, top, b.tobytes(), n[b].tobytes()

        def narrow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            at = int(key[0])
            g, low, high, _, held = ranges[at]
            if held <= FEW:
                return pd.DataFrame({"at": [at], "k": [-1], "low": [0.0], "high": [0.0], "below": [0], "held": [0], "top": [0.0], "d": [b"".join(part["d"])]})
            n, below, top, edges = np.zeros(BINS, np.int64), int(part["below"].sum()), float(part["top"].max()), _edges(low, high)
            for b, own in zip(part["b"], part["d"], strict=True):
                n[np.frombuffer(b, np.int64)] += np.frombuffer(own, np.int64)
            ends, rows = below + np.cumsum(n), []
            for k in asked[at]:
                b = int(np.searchsorted(ends, k, "right"))
                if k < below:
                    rows.append((at, k, 0.0, low, 0, below, top, None))
                elif b == BINS:
                    rows.append((at, k, high, max(top, np.nextafter(high, np.inf)), int(ends[-1]), int(pairs[g] - ends[-1]), top, None))
                else:
                    rows.append((at, k, edges[b], edges[b + 1], int(ends[b] - n[b]), int(n[b]), top, None))
            return pd.DataFrame(rows, columns=["at", "k", "low", "high", "below", "held", "top", "d"])

        got = self.each(count, "at int, below long, top double, b binary, d binary", [pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary()], rest, self.all({r[0] for r in ranges}))
        few, cut = {}, {}
        for r in got.groupBy("at").applyInPandas(narrow, "at int, k long, low double, high double, below long, held long, top double, d binary").collect():  # a row a rank, or FEW values
            if r.k < 0:
                few[ranges[r["at"]]] = np.sort(np.frombuffer(bytes(r.d)))
            else:
                cut[ranges[r["at"]][0], r.k] = (r.low, r.high, r.below, r.held, r.top)
        return few, cut

    def _likely(self, groups: list[str]) -> dict[str, tuple[float, float]]:
        """By group, a range of squares that should hold the median: six standard errors of its rank, by the pairs of the first SAMPLE rows (they are ranked by hash)."""

        def sample(g: str, i: int, j: int, left: Place, right: Place) -> Iterator[tuple]:
            x = _block(*left)[:SAMPLE]
            own = _exact(x, x, *np.triu_indices(len(x), 1))
            n, share = len(x), (squared_distances(x, x) < np.median(own)).mean(1)
            off = 6 * np.sqrt(4 * max(0.0, np.var(share) - 0.25 / n) / n + 0.5 / n**2)  # of a U-statistic
            low, high = np.quantile(own, [max(0.0, 0.5 - off), min(1.0, 0.5 + off)])
            yield g, float(low), float(np.nextafter(high, np.inf))

        told = self.each(sample, "g string, low double, high double", [pa.string(), pa.float64(), pa.float64()], tiles=[(g, 0, 0) for g in groups]) if groups else None
        return {r.g: (r.low, r.high) for r in told.collect()} if groups else {}


@lru_cache(8)
def _edges(low: float, high: float) -> np.ndarray:
    return np.linspace(low, high, BINS + 1)


def kernel_means(df: DataFrame, group: str, vector: str, tile: int = 4096) -> DataFrame:
    """(group as text, kernel_mean, width, pairs): by group the median distance of all pairs, and the mean of exp(-d^2 / (2 width^2)) over them.

    Null vectors and groups don't count; groups without a pair have no row. Vectors of a group that differ in length are an error.
    """
    tiles = Tiles(df.select(F.col(group).alias("_g"), F.transform(vector, lambda c: c.cast("double")).alias("v")).where("v is not null"), "_g", tile=tile)
    width = tiles.medians()

    def sums(g: str, i: int, j: int, left: Place, right: Place) -> Iterator[tuple]:
        total, n, h = 0.0, 0, width[g]
        for d in _pairs(i, j, left, right):
            with np.errstate(divide="ignore", invalid="ignore"):
                total, n = total + float(np.exp(d / np.float64(-2 * h * h)).sum()), n + d.size
        yield g, total, n, h

    told = tiles.each(sums, "g string, total double, n long, h double", [pa.string(), pa.float64(), pa.int64(), pa.float64()])
    told = told.groupBy("g").agg(F.sum("total").alias("total"), F.sum("n").alias("pairs"), F.max("h").alias("width")).where("pairs > 0")
    return told.select(F.col("g").alias(group), (F.col("total") / F.col("pairs")).alias("kernel_mean"), "width", "pairs")


class KernelRidge:
    """RBF kernel ridge: weights w of (K + alpha I) w = y - mean(y), K = exp(-d^2 / (2 width^2)).

    The Gram matrix is never held, nor written: training rows are Tiles, and the matrix times a vector is a sum over tiles. The system is solved by conjugate
    gradients, preconditioned by the Nystroem approximation from ``landmarks`` rows, so their number hardly grows with the rows. Beyond a tile of rows they run on
    kernel values of single precision; the residual is of double precision always, and steps go on from it until it is within ``tolerance`` (in double precision
    where single doesn't do). The driver holds the vectors of the method, 8 bytes a training row, which is what ``most`` bounds, and matrices of
    landmarks * landmarks. Rows and the fitted model stay in the shared folder.

    The width is the median distance of all pairs unless given (1 where that is 0), found exactly by counts in ever
    narrower ranges. Rows without a finite target or with a vector that isn't finite are left out; vectors of different lengths are an error.
    """

    def __init__(self, alpha: float = 1.0, width: float | None = None, most: int = 1_000_000, tile: int = 4096, tolerance: float = 1e-9, rounds: int = 1000, landmarks: int = 3072):
        if alpha <= 0:
            raise ValueError("alpha must be positive")
        self.alpha, self.width, self.most, self.tile, self.tolerance, self.rounds, self.landmarks = alpha, width, most, tile, tolerance, rounds, min(landmarks, tile)

    def fit(self, train: DataFrame, vector: str, target: str) -> KernelRidge:
        v, y = F.transform(vector, lambda c: c.cast("double")), F.col(target).cast("double")
        rows = train.select(v.alias("v"), y.alias("y")).where(finite(F.col("y")) & F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(finite(c), F.lit(False))))
        n, low, high = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
        if not n or n > self.most:
            raise ValueError(f"kernel ridge is for 1 to {self.most} rows, not {n}")
        if low != high:
            raise ValueError("vectors differ in length")
        self.tiles, self.n = Tiles(rows, extra="y", tile=self.tile), n
        if self.width is None:
            self.width = self.tiles.medians()[""] or 1.0
        packed = self.tiles.packed
        told = np.concatenate([np.frombuffer(bytes(r.y)) for r in packed.select("b", "y").orderBy("b").toLocalIterator()])
        self.mean = float(told.mean())
        first = _matrix(bytes(packed.where("b = 0").first().x), low)  # a block
        self.centre = first.mean(0).tobytes()
        weights = self._solve(told - self.mean, self._nystroem(first) if np.ptp(told) else np.copy)
        self.path = f"{self.tiles.folder}/model"
        tile = self.tile

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                own = [weights[b * tile : (b + 1) * tile].tobytes() for b in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.binary())], names=["b", "x", "w"])

        packed.select("b", "x").mapInArrow(weigh, "b int, x binary, w binary").write.parquet(self.path)
        return self

    def _times(self, p: np.ndarray, single: bool = False) -> np.ndarray:
        """(K + alpha I) p, with kernel values of single precision where asked for."""
        tile, centre, width, kind = self.tile, self.centre, self.width, np.float32 if single else np.float64
        shared, sums = self.tiles.spark.sparkContext.broadcast(p), {}

        def work(g: str, i: int, j: int, left: Place, right: Place, sums: dict = sums) -> Iterable[tuple]:
            a, c = _scaled_block(*left, centre, width, kind)[0], _scaled_block(*right, centre, width, kind)[1]
            u, v = shared.value[i * tile : (i + 1) * tile].astype(kind), shared.value[j * tile : (j + 1) * tile].astype(kind)
            q, other = sums.setdefault(i, np.zeros(len(a))), sums.setdefault(j, np.zeros(len(c)))
            for to in (slice(s, s + 4 * STRIP) for s in range(0, len(c), 4 * STRIP)):  # what a core's cache holds
                for at, k in _kernel(a, c[to]):
                    q[at] += k @ v[to]
                    if i != j:
                        other[to] += u[at] @ k
            return ()

        def rest(sums: dict = sums) -> Iterator[tuple]:
            yield from ((b, q.tobytes()) for b, q in sums.items())

        out = np.empty(self.n)
        for r in self.tiles.each(work, "b int, q binary", [pa.int32(), pa.binary()], rest).groupBy("b").applyInPandas(_sum, "b int, q binary").collect():  # 8 bytes a row
            out[r.b * tile : (r.b + 1) * tile] = np.frombuffer(bytes(r.q))
        shared.unpersist()
        return out + self.alpha * p

    def _nystroem(self, first: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """r to about (K + alpha I)^-1 r: with C the kernel of all rows and the landmarks, W that of the landmarks, (C W^-1 C' + alpha I)^-1 r.

        That is (r - C (alpha W + C'C)^-1 C' r) / alpha. C is made anew, block by block, wherever it is used.
        """
        tile, centre, width, alpha, sc = self.tile, self.centre, self.width, self.alpha, self.tiles.spark.sparkContext
        marks = _scaled(first[: self.landmarks], np.frombuffer(centre), width)
        m, blocks = len(marks[0]), range(self.tiles.blocks[""])
        if m == self.n:
            inverse = np.linalg.inv(np.concatenate([k for _, k in _kernel(*marks)]) + alpha * np.eye(m))
            return lambda r: inverse @ r
        shared, own, wide, held = sc.broadcast(marks[1]), [("", i, i) for i in blocks], -(-m // 8), {}

        def gram(g: str, i: int, s: int, left: Place, _: Place, held: dict = held) -> Iterable[tuple]:
            x = _scaled_block(*left, centre, width, np.float64)[0]
            for at in range(0, len(x), 4 * STRIP):
                c = np.concatenate([k for _, k in _kernel(x[at : at + 4 * STRIP], shared.value[s:])])
                held[s] = held.get(s, 0) + c[:, :wide].T @ c
            return ()

        def slices(held: dict = held) -> Iterator[tuple]:
            yield from ((s, rows.tobytes()) for s, rows in held.items())

        inner = np.zeros((m, m))  # alpha W + C'C, by slices of its upper triangle
        parts = self.tiles.each(gram, "b int, q binary", [pa.int32(), pa.binary()], slices, [("", i, s) for s in range(0, m, wide) for i in blocks])
        for r in parts.groupBy("b").applyInPandas(_sum, "b int, q binary").toLocalIterator():
            rows = np.frombuffer(bytes(r.q)).reshape(-1, m - r.b)
            inner[r.b : r.b + wide, r.b :], inner[r.b :, r.b : r.b + wide] = rows, rows.T
        for at, k in _kernel(*marks):
            inner[at] += alpha * k
        inner[np.diag_indices(m)] += 1e-12 * np.linalg.norm(inner)  # landmarks that are (nearly) equal
        inner = np.linalg.inv(inner)

        def near(r: np.ndarray) -> np.ndarray:
            given, sums = sc.broadcast(r), []

            def down(g: str, i: int, j: int, left: Place, right: Place, sums: list = sums) -> Iterable[tuple]:
                part = given.value[i * tile : (i + 1) * tile]
                sums.extend(part[at] @ k for at, k in _kernel(_scaled_block(*left, centre, width, np.float64)[0], shared.value))
                sums[:] = [np.sum(sums, axis=0)]
                return ()

            def told(sums: list = sums) -> Iterator[tuple]:
                yield from ((0, s.tobytes()) for s in sums)

            s = np.zeros(m)
            for row in self.tiles.each(down, "b int, q binary", [pa.int32(), pa.binary()], told, own).collect():  # 8 bytes a landmark and task
                s += np.frombuffer(bytes(row.q))
            u = sc.broadcast(inner @ s)

            def up(g: str, i: int, j: int, left: Place, right: Place) -> Iterator[tuple]:
                yield i, np.concatenate([k @ u.value for _, k in _kernel(_scaled_block(*left, centre, width, np.float64)[0], shared.value)]).tobytes()

            out = r.copy()
            for row in self.tiles.each(up, "b int, q binary", [pa.int32(), pa.binary()], tiles=own).collect():  # 8 bytes a row
                out[row.b * tile : (row.b + 1) * tile] -= np.frombuffer(bytes(row.q))
            given.unpersist()
            u.unpersist()
            return out / alpha

        return near

    def _solve(self, y: np.ndarray, near: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """w with |y - (K + alpha I) w| <= tolerance * |y|; the residual is computed, not carried along."""
        w, r, size = np.zeros(len(y)), y, float(np.linalg.norm(y))
        goal, self.steps = self.tolerance * size, 0
        ways = [(near, True)] * (self.n > self.tile) + [(near, False), (np.copy, False)]
        while size > goal:
            _, single = ways[0]
            d = self._steps(r, max(goal / 2, FINE * size) if single else goal / 2, *ways[0])
            left = r - self._times(d)
            now, before = float(np.linalg.norm(left)), size
            if now < size:
                w, r, size = w + d, left, now
            if not now <= max(0.1 * before, goal):
                if len(ways) == 1:  # double precision ends here
                    break
                del ways[0]
        return w

    def _steps(self, r: np.ndarray, goal: float, near: Callable[[np.ndarray], np.ndarray], single: bool) -> np.ndarray:
        """Conjugate gradients for (K + alpha I) d = r, until the residual carried along is within goal, or near or single turn out not to do."""
        d, z, most = np.zeros(len(r)), near(r), np.inf if near is np.copy else self.steps + 100
        p, have = z, float(r @ z)
        while np.linalg.norm(r) > goal and self.steps < most:
            if self.steps == self.rounds:
                raise RuntimeError(f"kernel ridge did not settle in {self.rounds} steps")
            q = self._times(p, single)
            self.steps += 1
            step = have / float(p @ q)
            if not 0 < step < np.inf:
                break
            d, left = d + step * p, r - step * q
            if np.linalg.norm(left) <= goal:
                break
            z = near(left)
            r, p, have = left, z + float(z @ (left - r)) / have * p, float(left @ z)
        return d

    def predict(self, df: DataFrame, vector: str, name: str = "prediction", low: float | None = None, high: float | None = None) -> DataFrame:
        """df with the prediction, between low and high where given. Tasks read the model from the shared folder, a file of it at a time; null vectors give null."""
        path, width, mean, centre = self.path, self.width, self.mean, np.frombuffer(self.centre)
        edges = (-np.inf if low is None else low, np.inf if high is None else high)

        @F.pandas_udf("double")
        def f(v: pd.Series) -> pd.Series:
            out = pd.Series(np.nan, index=v.index, dtype=object).where(v.notna(), None)
            known = v[v.notna()]
            if len(known):
                x = _scaled(np.stack(known.to_list()).astype(float), centre, width)[0]
                got = np.zeros(len(x))
                for rows, weights in model(path):
                    c, w = _scaled(_matrix(rows, len(centre)), centre, width)[1], np.frombuffer(weights)
                    for at, k in _kernel(x, c):
                        got[at] += k @ w
                out[known.index] = np.clip(mean + got, *edges)
            return out.astype(float) if len(known) == len(v) else out

        if self.n > self.tile:  # each row costs a pass over the model, so rows are dealt out
            df = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
        return df.withColumn(name, f(vector))


def model(path: str) -> Iterable[tuple[bytes, bytes]]:
    """(rows, weights) of the blocks of a fitted model; a small one is read once by each worker, a large one file by file each time."""
    store, at = store_of(path)
    files = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".parquet"))
    names = tuple(name for name, _ in files)
    return _held(path, names) if sum(size for _, size in files) <= CACHE_BYTES else _blocks(path, names)


def _blocks(path: str, names: tuple[str, ...]) -> Iterator[tuple[bytes, bytes]]:
    store, _ = store_of(path)
    for name in names:
        t = pq.read_table(name, columns=["x", "w"], filesystem=store)
        yield from zip(t.column("x").to_pylist(), t.column("w").to_pylist(), strict=True)


@lru_cache(1)
def _held(path: str, names: tuple[str, ...]) -> list[tuple[bytes, bytes]]:
    return list(_blocks(path, names))
