"""Lanes, neighbours, pulses and models on small cases."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.operators import models, scenes, vectors


def test_right_border_is_turned_round(spark):
    f = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    tables = {
        "node": f([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 0.0), (4, 1.0, 1.0)], "id long, lat double, lon double"),
        "way_node": f([(10, 0, 1), (10, 1, 2), (11, 0, 4), (11, 1, 3)], "way long, ord int, node long"),
        "member": f([(9, 0, "left", 10), (9, 1, "right", 11), (9, 2, "sign", 12)], "relation long, ord int, role string, ref long"),
    }
    got = [(r.side, r.ord, r.lon) for r in scenes.lanes(tables).orderBy("side", "ord").collect()]
    assert got == [("left", 0, 0.0), ("left", 1, 1.0), ("right", 0, 0.0), ("right", 1, 1.0)]


def test_slots(spark):
    s = spark.createDataFrame([("s", 1, 0.0, 0.0, 0.0, 0.0, "car"), ("s", 2, 3.0, 0.0, 0.0, 0.0, "car"), ("s", 3, -3.0, 0.0, 1.0, 0.0, "car"), ("s", 4, 9.0, 0.0, 0.0, 0.0, "walker")], "scene string, id int, x double, y double, vx double, vy double, kind string")
    p = scenes.others(s, "scene", "id", ["x", "y", "vx", "vy", "kind"])
    got = scenes.selected(p, "scene", "id", F.col("other_kind") == "walker", 2).where("id = 1").orderBy("slot").collect()
    assert [r.other for r in got] == [4, 3]
    assert scenes.anchors(p, "scene", "id", F.col("other_kind") == "walker", 1).first().id == 2


def test_pulse_edges_do_not_drift(spark):
    s = spark.createDataFrame([(0.3, 0.3, 1.0)], "a double, w double, h double")
    assert [r.step for r in scenes.pulse(s, "a", "w", "h", 10, 0.1).where("action > 0").orderBy("step").collect()] == [3, 4, 5]


def test_kernel_ridge_equals_its_definition(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=30)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(30)], "i int, v array<double>, y double")
    got = {r.i: r.prediction for r in models.KernelRidge(alpha=0.7, width=1.3).fit(df.where("i < 20"), "v", "y").predict(df, "v").collect()}
    k = np.array([[math.exp(-sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) / (2 * 1.3**2)) for q in x[:20]] for p in x])
    w = np.linalg.inv(k[:20] + 0.7 * np.eye(20)) @ (y[:20] - y[:20].mean())
    assert [got[i] for i in range(30)] == pytest.approx((y[:20].mean() + k @ w).tolist())


def test_kernel_ridge_in_tiles_equals_its_definition(spark):
    """Several blocks, a width from the data, rows that don't count, and the residual of the system itself."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(400, 5)), rng.normal(size=400)
    x[7] = x[3]
    rows = [(i, x[i].tolist(), float(y[i])) for i in range(400)] + [(500, None, 1.0), (501, x[0].tolist(), None), (502, [float("nan")] * 5, 1.0)]
    df = spark.createDataFrame(rows, "i int, v array<double>, y double").repartition(5)
    m = models.KernelRidge(alpha=0.3, tile=64).fit(df, "v", "y")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert m.n == 400 and m.width == pytest.approx(np.median(d[np.triu_indices(400, 1)]), rel=1e-9)
    k = np.exp(-(d**2) / (2 * m.width**2))
    w = np.linalg.solve(k + 0.3 * np.eye(400), y - y.mean())
    got = {r.i: r.p for r in m.predict(df, "v", "p").collect()}
    assert [got[i] for i in range(400)] == pytest.approx((y.mean() + k @ w).tolist(), rel=1e-6, abs=1e-7) and got[500] is None
    from tracklens.operators import kernels

    streamed = list(kernels._blocks(m.path, tuple(sorted(str(f) for f in Path(m.path.removeprefix("file://")).glob("*.parquet")))))
    assert sorted(streamed) == sorted(kernels.model(m.path)) and len(streamed) == 7
    clipped = [r.p for r in m.predict(df.where("i < 400"), "v", "p", low=-0.1, high=0.1).collect()]
    assert min(clipped) == -0.1 and max(clipped) == 0.1
    same = models.KernelRidge(alpha=1.0, tile=3).fit(spark.createDataFrame([([1.0], 2.0)] * 7, "v array<double>, y double"), "v", "y")
    assert same.width == 1.0 and same.steps == 0
    with pytest.raises(ValueError, match="length"):
        models.KernelRidge().fit(spark.createDataFrame([([1.0], 2.0), ([1.0, 2.0], 2.0)], "v array<double>, y double"), "v", "y")
    with pytest.raises(ValueError, match="rows"):
        models.KernelRidge().fit(df.limit(0), "v", "y")


def test_kernel_ridge_takes_few_passes_over_all_pairs(spark, monkeypatch):
    """Five blocks: steps don't grow with the condition of the system, and the median takes two passes. Where single precision can't tell distances, double does."""
    from tracklens.operators import kernels

    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(200, 4)), rng.normal(size=200)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(200)], "i int, v array<double>, y double").coalesce(2)
    passes, kinds = [], []
    each, times = kernels.Tiles.each, kernels.KernelRidge._times
    monkeypatch.setattr(kernels.Tiles, "each", lambda self, *a, **b: passes.append(a[1]) or each(self, *a, **b))
    monkeypatch.setattr(kernels.KernelRidge, "_times", lambda self, p, *single: kinds.append(any(single)) or times(self, p, *single))
    m = models.KernelRidge(alpha=0.5, tile=40).fit(df, "v", "y")
    assert len(kinds) <= 20 and kinds.count(False) <= 4 and kinds[-1] is False
    assert len(passes) - len([x for x in passes if "q binary" in x]) == 3  # a sample and two passes
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert m.width == pytest.approx(np.median(d[np.triu_indices(200, 1)]), rel=1e-12)
    k = np.exp(-(d**2) / (2 * m.width**2))
    want = y.mean() + k @ np.linalg.solve(k + 0.5 * np.eye(200), y - y.mean())
    got = {r.i: r.p for r in m.predict(df, "v", "p").collect()}
    assert [got[i] for i in range(200)] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-7)

    x = x[:12] + np.where(np.arange(12) % 2, 3e3, -3e3)[:, None]
    kinds.clear()
    far = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(12)], "i int, v array<double>, y double")
    m = models.KernelRidge(alpha=1.0, width=1.5, tile=5, landmarks=3).fit(far, "v", "y")
    assert kinds.count(False) > 4
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 1.5**2))
    want = y[:12].mean() + k @ np.linalg.solve(k + 1.0 * np.eye(12), y[:12] - y[:12].mean())
    got = {r.i: r.p for r in m.predict(far, "v", "p").collect()}
    assert [got[i] for i in range(12)] == pytest.approx(want.tolist(), abs=1e-5)


@pytest.mark.parametrize("likely", [None, (0.0, 1e-3), (50.0, 50.5), (1.0, 1.0 + 1e-9)])
def test_median_is_exact_wherever_it_is_looked_for(spark, monkeypatch, likely):
    """A misleading sample costs passes, not the result; equal rows are at distance 0, so their median is."""
    from tracklens.operators import kernels

    rng = np.random.default_rng(9)
    x, same = rng.normal(size=(120, 3)), np.repeat([[0.1, 0.2, 0.7]], 120, axis=0)
    same[:20] = rng.normal(size=(20, 3))
    rows = [(g, [float(c) for c in v]) for g, own in (("a", x), ("b", same), ("c", x[:1]), ("d", x[:5])) for v in own]
    tiles = kernels.Tiles(spark.createDataFrame(rows, "g string, v array<double>"), "g", tile=50)
    if likely:
        monkeypatch.setattr(kernels.Tiles, "_likely", lambda self, groups: dict.fromkeys(groups, likely))
    got = tiles.medians()
    want = {g: np.median(np.linalg.norm(own[:, None] - own[None], axis=2)[np.triu_indices(len(own), 1)]) for g, own in (("a", x), ("d", x[:5]))}
    assert got == pytest.approx(want | {"b": 0.0, "c": 0.0}, rel=1e-12, abs=0)


def test_median_distances_with_many_ties(spark):
    x = [[float(i % 3)] for i in range(300)]
    m = models.KernelRidge(alpha=1.0, tile=50).fit(spark.createDataFrame([(v, 1.0) for v in x], "v array<double>, y double"), "v", "y")
    d = [abs(a[0] - b[0]) for i, a in enumerate(x) for b in x[:i]]
    assert m.width == pytest.approx(float(np.median(d)), rel=1e-9)


def test_codebooks_by_spread_starts_and_reseeding(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [50, 0], [0, 50], [50, 50]])
    rows = [(i, "many" if i % 10 else "few", (centres[i % 4] + rng.normal(size=2)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, s string, v array<double>")
    book = sorted((r.c for r in vectors.kmeans(df, "v", 4, 4, "seed", "i", balance="s", batch=30).collect()), key=lambda c: (round(c[1] / 50), c[0]))
    assert np.allclose(book, [[0, 0], [50, 0], [0, 50], [50, 50]], atol=2)
    whole = vectors.kmeans(df, "v", 4, 1, "seed", "i").collect()
    near = np.argmin(((np.array([r[2] for r in rows])[:, None] - np.array([r.c for r in whole])[None]) ** 2).sum(2), 1)
    assert all(np.allclose(whole[t].c, np.mean([r[2] for r, n in zip(rows, near, strict=True) if n == t], axis=0), atol=1e-6) for t in range(4))
    few = spark.createDataFrame([(i, "s", [float(i % 2), 0.0]) for i in range(9)], "i int, s string, v array<double>")
    assert sorted(r.c for r in vectors.kmeans(few, "v", 5, 2, "seed", "i").collect()) == [[0.0, 0.0], [1.0, 0.0]]
    assert vectors.kmeans(few.limit(0), "v", 5, 2, "seed", "i").count() == 0


def test_spread_in_tiles_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [("a", i, rng.normal(size=3).tolist()) for i in range(90)] + [("b", 1, [0.0] * 3), ("b", 2, [0.1, 0.0, 0.0]), ("one", 1, [1.0] * 3), (None, 1, [0.0] * 3), (None, 2, [3.0, 4.0, 0.0]), ("b", 3, None)]
    df = spark.createDataFrame(rows, "g string, k long, v array<double>")
    want = {}
    for g in ("a", "b", None):
        x = np.array([v for h, _, v in rows if h == g and v is not None])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(len(x), 1)]
        want[g] = (d.mean(), len(d), int((d < 0.5).sum()))
    for tile in (1024, 17):
        got = {r.g: (r.diversity, r.pairs, r.close_pairs) for r in vectors.spread(df, "g", "k", "v", 0.5, tile=tile).collect()}
        assert got.keys() == want.keys() and all(got[g] == (pytest.approx(want[g][0]), *want[g][1:]) for g in want)
    assert vectors.spread(df.limit(0), "g", "k", "v", 0.5).count() == 0


def test_pairs_of_a_group_are_never_written(spark):
    """By tiles far smaller than a group: the exact median and mean of all pairs, from blocks that hold each vector once."""
    from tracklens.operators import kernels

    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3))
    df = spark.createDataFrame([(i % 2, [float(c) for c in x[i]]) for i in range(90)] + [(0, None), (7, [1.0, 2.0, 3.0])], "k int, v array<double>")
    got = {r.k: r for r in kernels.kernel_means(df, "k", "v", tile=16).collect()}
    assert sorted(got) == ["0", "1"]
    for k in (0, 1):
        d = np.linalg.norm(x[k::2, None] - x[None, k::2], axis=2)[np.triu_indices(45, 1)]
        assert np.allclose([got[str(k)].width, got[str(k)].kernel_mean], [np.median(d), np.exp(-d * d / (2 * np.median(d) ** 2)).mean()], rtol=1e-12) and got[str(k)].pairs == 990
    tiles = kernels.Tiles(df.where("v is not null"), "k", tile=16)
    assert tiles.packed.agg(F.sum("n"), F.count("*")).first() == (91, 7)


def test_pairs_by_classes_in_blocks(spark):
    """Equal vectors are compared once, and a group of one key is dealt out in several tasks."""
    rows = [(g, 100 * g + i, [float(i % 3), float(g)]) for g in (1, 2) for i in range(30)] + [(1, 500, [9.0, 9.0])]
    d = spark.createDataFrame(rows, "g int, k long, v array<double>")
    pairs = vectors.class_pairs(d, "g", "k", "v", block=8)
    want = {(g, a, b): math.sqrt(sum((p - q) ** 2 for p, q in zip(v, w)) / 2) for g, a, v in rows for h, b, w in rows if g == h and a < b}
    assert {(r.g, r.a, r.b): r.rms for r in pairs.collect()} == want and pairs.count() == len(want)
