"""The nearest other by the mean gap of values in shared cells, without all pairs of a cell.

Rows (day, slot, who, value) of two sides meet where day and slot agree; a pair's gap is the mean of |value - value| over all rows in which
it meets. The mean is not below the least of them, so a pair as near as reach has two rows of a slot within reach. That makes the search
local: each slot of a day is cut in ranges of values, of about RANGE rows, and a range is searched in one task. There the exact gaps to the nearest NEAR rows on both sides bound
the gap of the second nearest other, then all rows within that bound are tried. Where it goes beyond the range, the search is repeated in all
ranges that it reaches. Others with equal rows on a day are one class, of which the two with the smallest ids matter (one may be the row's own id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.lineage import cut

RANGE, RANGES, NEAR = 4096, 256, 16
CELLS = 1 << 22  # differences that are held at once
SLACK = 2e-6  # ranks are by gaps of six decimals


class _Rows:
    """Profiles, lists of (slot, value) in this order, as flat arrays."""

    def __init__(self, t: pa.Table) -> None:
        p = t.column("p").combine_chunks()
        flat = p.flatten()
        self.slot, self.value = flat.field("slot").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(len(p)), p.value_lengths().to_numpy(zero_copy_only=False))
        self.n = len(p)

    def spans(self, slots: np.ndarray) -> np.ndarray:
        """Where the rows of each profile and slot begin, and the end of the last one."""
        at = self.owner * len(slots) + np.searchsorted(slots, self.slot)
        return np.concatenate([[0], np.cumsum(np.bincount(at, minlength=self.n * len(slots)))])

    def inside(self, slot: int, low: float, high: float) -> np.ndarray:
        return np.flatnonzero((self.slot == slot) & np.isfinite(self.value) & (self.value >= low) & (self.value < high))


class _Gaps:
    """Mean gaps of pairs (i, j) of profiles of two sides."""

    def __init__(self, a: _Rows, b: _Rows) -> None:
        self.a, self.b = a, b
        slots = np.union1d(a.slot, b.slot)
        self.slots, self.begin = len(slots), (a.spans(slots), b.spans(slots))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        k = np.arange(self.slots)
        x, y = i[:, None] * self.slots + k, j[:, None] * self.slots + k
        na, nb = self.begin[0][x + 1] - self.begin[0][x], self.begin[1][y + 1] - self.begin[1][y]
        each = na * nb
        if len(i) > 1 and each.sum() > CELLS:
            h = len(i) // 2
            return np.concatenate([self.of(i[:h], j[:h]), self.of(i[h:], j[h:])])
        cell = np.flatnonzero(each)
        many = each.ravel()[cell]
        at = np.repeat(cell, many)
        place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        wide = nb.ravel()[at]
        with np.errstate(invalid="ignore"):
            d = np.abs(self.a.value[self.begin[0][x].ravel()[at] + place // wide] - self.b.value[self.begin[1][y].ravel()[at] + place % wide])
        return np.bincount(at // self.slots, d, len(i)) / each.sum(1)


def _least_two(owner: np.ndarray, gap: np.ndarray, twice: np.ndarray, n: int, most: np.ndarray) -> np.ndarray:
    """By owner: its second smallest gap (one that stands twice counts twice), at most most."""
    owner, gap = np.concatenate([owner, owner[twice]]), np.concatenate([gap, gap[twice]])
    o = np.lexsort((gap, owner))
    owner, gap = owner[o], gap[o]
    second = np.flatnonzero((owner[1:] == owner[:-1]) & np.concatenate([[True], owner[1:-1] != owner[:-2]])) + 1 if len(owner) > 1 else np.zeros(0, int)
    out = most.copy()
    out[owner[second]] = np.fmin(out[owner[second]], gap[second])
    return out


def _pairs(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.unique(i * n + j)
    return k // n, k % n


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for all places first <= place < last of each row."""
    many = np.maximum(last - first, 0)
    row = np.repeat(np.arange(len(many)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]


def _search(slot: int, a: pa.Table, b: pa.Table, limit: float) -> pa.Table:
    """(a, b, gap) of others that may be the two nearest, and (a, null, reach) where the range is too small to tell."""
    out: tuple[list, list, list] = ([], [], [])
    if len(a):
        given = a.column("reach").to_numpy(zero_copy_only=False).astype(float)  # not null: search so far, whatever the range
        ids, low, high = a.column("a").to_numpy(), a.column("low")[0].as_py(), a.column("high")[0].as_py()
        x, most = _Rows(a), np.where(np.isnan(given), limit, given)
        mine = x.inside(slot, *((-np.inf, np.inf) if (~np.isnan(given)).any() else (low, high)))
        if len(b):
            y = _Rows(b)
            gaps, one = _Gaps(x, y), b.column("b").to_numpy()
            two = b.column("b2").to_numpy(zero_copy_only=False).astype(float)
            there = y.inside(slot, low, high)
            there = there[np.argsort(y.value[there], kind="stable")]
            at = np.searchsorted(y.value[there], x.value[mine])
            row, place = _spread(np.maximum(at - NEAR, 0), np.minimum(at + NEAR, len(there)))
            i, j = _pairs(x.owner[mine][row], y.owner[there[place]], y.n)
            g = gaps.of(i, j)
            known = ~np.isnan(g)
            most = _least_two(i[known], g[known], ~np.isnan(two[j[known]]), x.n, most)
            reach = most[x.owner[mine]] + SLACK
            first, last = np.searchsorted(y.value[there], x.value[mine] - reach), np.searchsorted(y.value[there], x.value[mine] + reach, "right")
            ends = np.flatnonzero(np.concatenate([x.owner[mine][1:] != x.owner[mine][:-1], [True]])) + 1 if len(mine) else np.zeros(0, int)
            total, begin = np.concatenate([[0], np.cumsum(np.maximum(last - first, 0))]), 0
            while begin < len(mine):  # whole profiles, about CELLS pairs at once
                fits = ends[(ends > begin) & (total[ends] - total[begin] <= CELLS)]
                end = fits[-1] if len(fits) else ends[ends > begin][0]
                row, place = _spread(first[begin:end], last[begin:end])
                i, j = _pairs(x.owner[mine][begin:end][row], y.owner[there[place]], y.n)
                g = gaps.of(i, j)
                ok = g <= most[i] + SLACK
                i, j, g = i[ok], j[ok], g[ok]
                near = _least_two(i, g, ~np.isnan(two[j]), x.n, most)
                ok = g <= near[i] + SLACK
                i, j, g = i[ok], j[ok], g[ok]
                more = ~np.isnan(two[j])
                i, who, g = np.concatenate([i, i[more]]), np.concatenate([one[j], b.column("b2").take(pa.array(j[more])).to_numpy().astype(np.int64)]), np.concatenate([g, g[more]])
                o = np.lexsort((who, g, i))
                i, who, g = i[o], who[o], g[o]
                third = np.zeros(len(i), bool)
                third[2:] = (i[2:] == i[:-2]) & (g[2:] == g[:-2])  # of equal gaps the two smallest ids
                for k, v in enumerate((ids[i], who, g)):
                    out[k].append(v[~third])
                begin = end
        v = x.value[mine]
        short = np.isnan(given[x.owner[mine]]) & ((v - most[x.owner[mine]] - SLACK < low) | (v + most[x.owner[mine]] + SLACK >= high))
        open_ = np.unique(x.owner[mine][short])
    else:
        open_, ids, most = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
    cat = lambda k, t: np.concatenate(out[k]) if out[k] else np.zeros(0, t)
    who = pa.chunked_array([pa.array(cat(1, np.int64), pa.int64()), pa.nulls(len(open_), pa.int64())])
    return pa.table({"a": pa.array(np.concatenate([cat(0, np.int64), ids[open_]]), pa.int64()), "b": who, "gap": pa.array(np.concatenate([cat(2, float), most[open_]]), pa.float64())})


def _profiles(df: DataFrame, day: str, slot: str, who: str, value: str) -> DataFrame:
    """(day, who, p): the rows of each day and id as one list; rows with a null have no gap to any."""
    d = df.select(F.col(day).cast("long").alias("day"), F.col(who).cast("long").alias("who"), F.struct(F.col(slot).cast("long").alias("slot"), F.col(value).cast("double").alias("value")).alias("s"))
    return d.where("day is not null and who is not null and s.slot is not null and s.value is not null").groupBy("day", "who").agg(F.sort_array(F.collect_list("s")).alias("p"))


def _range(borders: Column, value: Column) -> Column:
    return F.size(F.filter(borders, lambda x: x <= value))


def nearest(a: DataFrame, b: DataFrame, day: str, slot: str, who: str, value: str, limit: float) -> DataFrame:
    """(day, who, nearest, gap): for each day and id of a the id of b other than itself with the smallest mean gap, of at most limit, by six decimals and then id.

    Both frames have the columns day, slot, who (integers) and value (double). An id's rows of one day travel as one list.
    """
    mine, other = cut(_profiles(a, day, slot, who, value)), _profiles(b, day, slot, who, value)
    classes = mine.groupBy("day", "p").agg(F.min("who").alias("a"))
    other = other.withColumn("place", F.row_number().over(Window.partitionBy("day", "p").orderBy("who"))).where("place <= 2")
    other = cut(other.groupBy("day", "p").agg(F.min("who").alias("b"), F.max(F.when(F.col("place") == 2, F.col("who"))).alias("b2")))
    classes = cut(classes)
    rows = classes.select("day", F.inline("p")).union(other.select("day", F.inline("p"))).where(~F.isnan("value") & (F.abs("value") < float("inf")))
    cells = rows.groupBy("day", "slot").agg(F.count("*").alias("n"), F.percentile_approx("value", [k / RANGES for k in range(1, RANGES)], 10_000).alias("q"))
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGE * RANGES) / F.col("n")))
    cells = cut(cells.withColumn("step", step).select("day", "slot", F.expr("array_distinct(filter(q, (x, i) -> (i + 1) % step = 0))").alias("borders")))

    def placed(df: DataFrame, *ids: str, reach: bool = False) -> DataFrame:
        """Each profile once for each slot and range that one of its rows, or its reach, falls in."""
        d = df if reach else df.select("day", *ids, "p", F.explode(F.array_distinct(F.transform("p", lambda s: s["slot"]))).alias("slot"))
        d = d.join(cells, ["day", "slot"])
        in_slot = F.filter("p", lambda s: (s["slot"] == F.col("slot")) & ~F.isnan(s["value"]) & (F.abs(s["value"]) < float("inf")))
        less = F.col("reach") + SLACK if reach else F.lit(0.0)
        k = F.flatten(F.transform(in_slot, lambda s: F.sequence(_range(F.col("borders"), s["value"] - less), _range(F.col("borders"), s["value"] + less))))
        d = d.withColumn("k", F.explode(F.array_distinct(k)))
        edge = lambda c, else_: F.coalesce(F.get("borders", c), F.lit(else_))
        d = d.withColumns({"low": edge(F.col("k") - 1, float("-inf")), "high": edge(F.col("k"), float("inf"))})
        return d.select("day", "slot", "k", *ids, "p", *(["low", "high", (F.col("reach") if reach else F.lit(None).cast("double")).alias("reach")] if ids[0] == "a" else []))

    def searched(x: DataFrame) -> DataFrame:
        def run(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
            got = _search(key[1].as_py(), x, y, limit)
            return pa.table({"day": pa.array([key[0].as_py()] * len(got), pa.int64()), "slot": pa.array([key[1].as_py()] * len(got), pa.int64()), **{c: got.column(c) for c in got.column_names}})

        keys = ["day", "slot", "k"]
        return x.groupBy(*keys).cogroup(placed(other, "b", "b2").groupBy(*keys)).applyInArrow(run, "day long, slot long, a long, b long, gap double")

    found = cut(searched(placed(classes, "a")))
    wide = found.where("b is null").groupBy("day", "slot", "a").agg(F.max("gap").alias("reach"))
    if not wide.isEmpty():
        found = found.union(searched(placed(wide.join(classes, ["day", "a"]), "a", reach=True)))
    best = found.where(F.col("b").isNotNull() & (F.col("gap") <= limit)).groupBy("day", "a", "b").agg(F.min("gap").alias("gap"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("day", "a").orderBy(F.round("gap", 6), "b"))).where("place <= 2")
    best = best.groupBy("day", "a").agg(F.sort_array(F.collect_list(F.struct("place", "b", "gap"))).alias("two"))
    named = classes.join(best, ["day", "a"]).select("day", "p", "two")
    out = mine.join(named, ["day", "p"]).withColumn("x", F.get(F.filter("two", lambda s: s["b"] != F.col("who")), 0)).where("x is not null")
    return out.select(F.col("day"), F.col("who"), F.col("x.b").alias("nearest"), F.col("x.gap").alias("gap"))
