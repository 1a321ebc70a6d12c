"""The nearest other by mean gaps against all pairs: copies, ties, several slots, nulls, values that aren't finite, ranges of a few rows."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tracklens.operators import nearest as m

DDL = "day long, slot long, who long, value double"


def brute(a, b, limit):
    rows = defaultdict(lambda: defaultdict(list))
    for side, r in ((0, a), (1, b)):
        for day, slot, who, value in r:
            if None not in (day, slot, who, value):
                rows[day, side, who][slot].append(value)
    out = {}
    for (day, side, who), mine in rows.items():
        if side:
            continue
        best = []
        for (d, s, other), theirs in rows.items():
            if s and d == day and other != who and set(mine) & set(theirs):
                g = [abs(x - y) for k in set(mine) & set(theirs) for x in mine[k] for y in theirs[k]]
                if sum(g) / len(g) <= limit:
                    best.append((round(sum(g) / len(g), 6), other))
        if best:
            out[day, who] = min(best)[::-1]
    return out


def made(rng, n, who):
    rows = [(rng.randrange(3), rng.randrange(3), who(rng), float(rng.choice([0, 0, rng.randrange(40), rng.randrange(400)]))) for _ in range(n)]
    return rows + [(d, s, w + 1000, v) for d, s, w, v in rows[: n // 2]] + [(None, 1, 1, 1.0), (1, None, 1, 1.0), (1, 1, None, 1.0), (1, 1, 5, None), (0, 1, 7, math.nan), (0, 2, 8, math.inf), (7, 0, who(rng), 3.0)]


@pytest.mark.parametrize("size, limit", [(4096, 50.0), (8, 50.0), (8, 1.0)])
def test_equals_all_pairs(spark, monkeypatch, size, limit):
    monkeypatch.setattr(m, "RANGE", size)
    rng = random.Random(size)
    a, b = made(rng, 160, lambda r: r.randrange(90)), made(rng, 160, lambda r: r.randrange(50, 140))
    got = m.nearest(spark.createDataFrame(a, DDL), spark.createDataFrame(b, DDL), "day", "slot", "who", "value", limit).collect()
    want = brute(a, b, limit)
    assert {(r.day, r.who): (r.nearest, pytest.approx(r.gap, abs=1e-6)) for r in got} == want and len(got) == len(want)


def test_empty(spark):
    x = spark.createDataFrame([(1, 1, 1, 1.0)], DDL)
    assert m.nearest(x, x, "day", "slot", "who", "value", 9.0).count() == 0
    assert m.nearest(x, x.limit(0), "day", "slot", "who", "value", 9.0).count() == 0


def test_pairs_that_are_compared_follow_the_rows(monkeypatch):
    """5,000 on each side in one cell were 25 million pairs when a cell was joined with itself."""
    rng, tried = np.random.default_rng(3), []
    of = m._Gaps.of
    monkeypatch.setattr(m._Gaps, "of", lambda self, i, j: tried.append(len(i)) or of(self, i, j))
    profile = lambda v: pa.array([[{"slot": 0, "value": x}] for x in v], pa.list_(pa.struct([("slot", pa.int64()), ("value", pa.float64())])))
    x, y = rng.exponential(50, 5000).round(4), rng.exponential(50, 5000).round(4)
    ids = np.arange(5000)
    a = pa.table({"a": ids, "p": profile(x), "low": np.full(5000, -np.inf), "high": np.full(5000, np.inf), "reach": pa.nulls(5000, pa.float64())})
    b = pa.table({"b": ids + 5000, "b2": pa.nulls(5000, pa.int64()), "p": profile(y)})
    got = m._search(0, a, b, 120.0).to_pandas().dropna()
    best = got.sort_values(["gap", "b"]).groupby("a").gap.first()
    gap = np.abs(x[:, None] - y[None, :]).min(1)
    near = gap <= 120
    assert np.allclose(best.reindex(ids[near]), gap[near]) and sum(tried) < 40 * 2 * 5000
