"""Hashing, numbers, vectors, inference and contracts on small cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklens.functions import hashing as h
from tracklens.functions import numbers as n
from tracklens.operators import aggregates, classify, contracts, inference, models, ranking, sampling, sets
from tracklens.operators import vectors as v


def one(spark, c):
    return spark.range(1).select(c.alias("r")).first().r


def test_split_is_the_hash_range(spark):
    ids = [f"LOC_{i}" for i in range(120)]
    d = spark.createDataFrame([(" Src ", i) for i in ids], "s string, g string").select("g", h.split_of("s", "g").alias("r"))
    for r in d.collect():
        top = int.from_bytes(hashlib.sha256(f"src\x1f{r.g}".encode()).digest()[:8], "big") * 10 >> 64
        assert r.r == ("train" if top < 8 else "val" if top == 8 else "test")
    share = d.where("r = 'train'").count() / 120
    assert 0.65 < share < 0.95


def test_draw_is_in_range(spark):
    d = spark.range(500).select(h.draw(F.lit(7), "s", F.col("id")).alias("r"))
    assert {r.r for r in d.collect()} == set(range(7))


def test_missing_values(spark):
    d = spark.createDataFrame([("1.5",), ("",), ("x",), ("NaN",), (None,)], "t string")
    assert [r.r for r in d.select(n.to_double("t").alias("r")).collect()] == [1.5, None, None, None, None]
    d = spark.createDataFrame([("True",), ("no",), ("",), (None,)], "t string")
    assert [r.r for r in d.select(n.tri_state("t").alias("r")).collect()] == [True, False, None, None]


def test_angles_and_frames(spark):
    assert one(spark, n.wrap_angle(F.lit(math.pi))) == pytest.approx(-math.pi)
    u, w = n.into_frame(F.lit(3.0), F.lit(4.0), F.lit(1.0), F.lit(1.0), F.lit(0.7))
    x, y = n.out_of_frame(u, w, F.lit(1.0), F.lit(1.0), F.lit(0.7))
    assert (one(spark, x), one(spark, y)) == pytest.approx((3.0, 4.0))


def test_projection(spark):
    e, north = n.utm(F.lit(0.0), F.lit(3.0))
    assert (one(spark, e), one(spark, north)) == pytest.approx((500000.0, 0.0), abs=1e-6)
    e, north = n.utm(F.lit(50.0), F.lit(5.0))
    assert (one(spark, e), one(spark, north)) == pytest.approx((643329.1, 5540547.4), abs=1.0)


def test_two_level_mean(spark):
    d = spark.createDataFrame([("s", "a", 1.0), ("s", "a", 3.0), ("s", "b", 5.0), ("s", "b", float("nan"))], "o string, g string, x double")
    r = aggregates.two_level_mean(d, ["o"], "g", "x").first()
    assert (r.mean_of_means, r.pooled, r.groups) == (3.5, 3.0, 2)


def test_auc_with_ties(spark):
    d = spark.createDataFrame([("k", 1, 2.0), ("k", 0, 1.0), ("k", 1, 1.0), ("k", 0, 0.0)], "k string, y int, x double")
    assert inference.auc(d, ["k"], "y", "x").first().auc == 0.875


def test_threshold(spark):
    d = spark.createDataFrame([("k", int(x > 4), float(x)) for x in range(10)], "k string, y int, x double")
    r = inference.best_threshold(d, ["k"], "y", "x").first()
    assert (r.threshold, r.above, r.score) == (4.5, True, 1.0)


def test_ridge(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 2))
    y = 3 + x @ [2, -1]
    d = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    w = inference.ridge(d, ["a", "b"], "y", 1e-9)
    assert (w["intercept"], w["a"], w["b"]) == pytest.approx((3, 2, -1))
    assert inference.ridge_alpha(d, d, ["a", "b"], "y", [1e-9, 10.0])[0] == 1e-9


def test_boxes(spark):
    box = lambda x, y, yaw: (F.lit(x), F.lit(y), F.lit(yaw), F.lit(4.0), F.lit(2.0))
    assert one(spark, v.clearance(*box(0.0, 0.0, 0.0), *box(5.0, 0.0, 0.0))) == pytest.approx(1.0)
    assert one(spark, v.clearance(*box(0.0, 0.0, 0.0), *box(3.0, 0.0, 0.0))) < 0
    see = lambda bx, by: one(spark, v.blocks_view(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(bx), F.lit(by), F.lit(2.0), F.lit(2.0)))
    assert see(5.0, 0.0) and see(5.0, 1.0) and not see(5.0, 1.5) and not see(12.0, 0.0)


def test_resample(spark):
    d = spark.createDataFrame([("p", 0, 0.0, 0.0), ("p", 1, 3.0, 0.0), ("p", 2, 3.0, 3.0)], "k string, o int, x double, y double")
    got = [(r.x, r.y) for r in v.resample(d, ["k"], "o", 5).orderBy("point").collect()]
    np.testing.assert_allclose(got, [(0, 0), (1.5, 0), (3, 0), (3, 1.5), (3, 3)])


def test_kmeans_finds_two_groups(spark):
    rows = [(i, [float(i % 2) * 10 + i * 0.01, 1.0]) for i in range(20)]
    c = v.kmeans(spark.createDataFrame(rows, "id long, v array<double>"), "v", 2, 6, "s", "id").collect()
    assert sorted(round(r.c[0]) for r in c) == [0, 10]


def test_farthest_first(spark):
    rows = [(1, i, [float(x)], float(x == 0)) for i, x in enumerate([0, 1, 9, 10, 5])]
    got = ranking.farthest_first(spark.createDataFrame(rows, "g int, id long, v array<double>, s double"), "g", "id", "v", 3, "s")
    assert [r.id for r in got.orderBy("round").collect()] == [0, 3, 4]


def test_contracts(spark):
    d = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, x int")
    bad = contracts.violations(d, ["id"], {"positive": F.col("x") > 0})
    assert sorted(r.id for r in bad.collect()) == [2, 3]
    with pytest.raises(ValueError, match="positive"):
        contracts.check(d, ["id"], {"positive": F.col("x") > 0})
    r = sets.partition_report(d, d.where("id < 3"), d.where("id >= 3"), "id").first()
    assert (r.total, r.kept, r.removed, r.disjoint, r.whole) == (3, 2, 1, True, True)
    assert not sets.partition_report(d, d, d.where("id = 1"), "id").first().disjoint


def test_names(spark):
    assert classify.resolve_columns(["Time (s)", "Speed"], {"speed": ["velocity"], "t": ["time(s)"]}) == {"speed": "Speed", "t": "Time (s)"}
    with pytest.raises(KeyError):
        classify.resolve_columns(["a"], {"speed": []})
    lines = spark.createDataFrame([("r", i, t) for i, t in enumerate(["a=1", "a=2", "", "b=x=y", "note"])], "k string, i int, t string")
    assert [(r.section, r.name, r.value) for r in classify.sections(lines, "k", "i", "t").orderBy("section").collect()] == [(0, "a", "1"), (1, "b", "x=y")]


def test_samples_do_not_depend_on_input_order(spark):
    d = spark.createDataFrame([(i, f"g{i % 3}") for i in range(90)], "id long, g string")
    take = lambda x: {r.id for r in sampling.quota(x, ["g"], 5, "s", "id").collect()}
    assert take(d) == take(d.orderBy(F.desc("id")).repartition(7))
    rungs = {r.id: r.rung for r in sampling.scale_ladder(d, "s", "id", [10, 40]).collect()}
    assert sum(x == 10 for x in rungs.values()) == 10 and sum(x is not None for x in rungs.values()) == 40
    assert sampling.evenly(d, ["g"], ["id"], 4).count() == 12


def test_lookup_and_mappings(spark):
    d = spark.createDataFrame([("a", {"CAN_4": "speed", "x": "CAN_7", "y": ""})], "k string, m map<string,string>")
    dim = spark.createDataFrame([("a", "train")], "k string, split string")
    assert classify.lookup(d, "k", dim, "split").first().split == "train"
    with pytest.raises(Exception, match="unknown k: a"):
        classify.lookup(d, "k", dim.where("k = 'b'"), "split").collect()
    assert sorted((r.name, r.channel) for r in classify.mappings(d, "k", "m", "CAN_([0-9]+)").collect()) == [("CAN_4", "4"), ("x", "7")]


def test_kernel_ridge(spark):
    rows = [([i / 10], float(np.sin(i / 10))) for i in range(40)]
    d = spark.createDataFrame(rows, "v array<double>, y double")
    m = models.KernelRidge(alpha=1e-6, width=0.5).fit(d, "v", "y")
    assert max(abs(r.prediction - r.y) for r in m.predict(d, "v").collect()) < 1e-3
    with pytest.raises(ValueError, match="1 to 3 rows"):
        models.KernelRidge(most=3).fit(d, "v", "y")
    book = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "token int, c array<double>")
    assert models.reuse_codebook(book, 2, 1) is book
    with pytest.raises(ValueError, match="not 3"):
        models.reuse_codebook(book, 3, 1)


def test_ranks_in_groups(spark):
    from tracklens.operators.order import ranked

    rng = random.Random(4)
    rows = [(g, rng.choice([1.0, 1.0, 5.0, rng.random() * 100, None]), i) for g in ("a", "b", None) for i in range(200)] + [("c", 3.0, 0)]
    df = spark.createDataFrame(rows, "g string, x double, i int").withColumn("_n", F.lit("clash"))
    got = {(r.g, r.i): r.k for r in ranked(df, ["g"], ["x", "i"], "k", parts=7).collect()}
    down = {(r.g, r.i): r["rank"] for r in ranked(df, ["g"], [F.desc("x"), "i"]).collect()}
    assert len(got) == len(down) == len(rows)
    for g in ("a", "b", "c", None):
        own = [(x is not None, x or 0, i) for h, x, i in rows if h == g]
        assert all(got[g, i] == k + 1 for k, (_, _, i) in enumerate(sorted(own)))
        assert all(down[g, i] == k + 1 for k, (_, _, i) in enumerate(sorted(own, key=lambda r: (not r[0], -r[1], r[2]))))
    assert ranked(df.limit(0), ["g"], ["x"]).count() == ranked(df.limit(0), [], ["x"]).count() == 0


def test_far_frequent_values_and_hot_groups_are_dealt_out(spark):
    """One far value, a value that a third of all rows have, and a group with nearly all rows: no part holds over 4 times the median."""
    from tracklens.operators.order import in_ranges, ranked

    d = spark.range(200_000).select("id", F.when(F.col("id") == 7, 1e12).when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 200_000).alias("x"), F.when(F.col("id") < 50, "small").otherwise("hot").alias("g"))
    for group in ([], ["g"]):
        keys = [F.col(c) for c in (*group, "x", "id")]
        sizes = sorted(n for (n,) in in_ranges(d, keys, 16).groupBy(F.spark_partition_id()).count().select("count").collect())
        assert sum(sizes) == 200_000 and len(sizes) >= 15 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        r = ranked(d, group, ["x", "id"], "k", parts=16)
        w = Window.partitionBy(*group).orderBy("x", "id")
        assert r.withColumn("want", F.row_number().over(w)).where("k <> want").count() == 0


def test_outcomes_and_screen_classes(spark):
    from tracklens.operators import classify as c

    rows = [(-0.1, 3.0), (0.4, None), (0.4, 40.0), (1.5, None), (9.0, None), (None, None), (-3.0, 2.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "n double, s double").select(c.contact_outcome(F.col("n"), F.col("s"), 0.5, 0.8, 15, 2.0)).collect()]
    assert got == ["contact_and_stopped", "passed", "passed", "near", "clear", None, "passed"]
    rows = [(True, 70.0, 0.0, 1, "x", True), (True, 0.0, 0.0, None, "x_no_force", False), (True, 0.0, 0.0, None, "x_no_force", True), (False, 70.0, 0.0, 9, "x", True), (False, 70.0, 0.0, 2, "x", True), (False, 0.0, 80.0, None, "x", True), (False, 0.0, 95.0, None, "x", True), (False, 0.0, 0.0, None, "x", True)]
    d = spark.createDataFrame(rows, "q boolean, w double, b double, f int, s string, j boolean")
    got = [r[0] for r in d.select(c.screen_class(F.col("q"), F.col("w"), F.col("b"), F.col("f"), F.col("s"), F.col("j"), 60, 4, 90)).collect()]
    assert got == ["command_against_status", "signature_without_force", "x_no_force", "joined_in_window", "commanded_window", "light_touch_before", "large_pulse_before", "x"]


def test_boosted_trees_beat_the_mean(spark):
    from tracklens.operators.models import boosted_baseline

    rng = random.Random(5)
    rows = [(a, b, 3 * a + b * b, float(a > 0.5), i % 4 == 0) for i in range(400) for a, b in [(rng.random(), rng.random())]]
    r = boosted_baseline(spark.createDataFrame(rows, "a double, b double, y double, l double, t boolean"), ["a", "b"], "y", "l", "t").first()
    assert r.model_error < 0.4 * r.mean_error and r.auc > 0.95
    held = [(y, x) for _, _, y, x, t in rows if t]
    mean = sum(y for *_, y, _, t in rows if not t) / sum(not t for *_, t in rows)
    assert r.mean_error == pytest.approx(sum(abs(y - mean) for y, _ in held) / len(held))
    pooled = {k: (v.error, v.rows) for k, v in r.residual_errors.items()}
    assert {k: n for k, (_, n) in pooled.items()} == {k: sum(x == k for _, x in held) for k in (0.0, 1.0)} and sum(e * n for e, n in pooled.values()) / len(held) == pytest.approx(r.model_error)
    one = boosted_baseline(spark.createDataFrame([(*x[:3], 1.0, x[4]) for x in rows], "a double, b double, y double, l double, t boolean"), ["a", "b"], "y", "l", "t").first()
    assert one.auc is None and list(one.residual_errors) == [1.0]


def test_boosting_reads_equal_features_once(spark, monkeypatch):
    """Training gets a row for each of 20 features (and label), not 2,000 rows; its errors are those of trees on all rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from tracklens.operators.models import boosted_baseline

    rng, seen, fit = random.Random(6), [], GBTRegressor.fit
    rows = [(float(i % 5), float(i % 4), rng.random() + i % 5, float(rng.random() > 0.5), i % 7 == 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, y double, l double, t boolean")
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, d: seen.append(d.count()) or fit(self, d))
    r = boosted_baseline(df, ["a", "b"], "y", "l", "t").first()
    assert seen == [20]
    d = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df)
    told = fit(GBTRegressor(featuresCol="x", labelCol="y", maxIter=15, maxDepth=3, seed=7), d.where("not t")).transform(d.where("t")).collect()
    assert r.model_error == pytest.approx(sum(abs(x.prediction - x.y) for x in told) / len(told), rel=1e-6)


def test_checksums_of_blocks():
    from tracklens.sources.records import BLOCK, POLYNOMIAL, crc32c

    def slow(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (POLYNOMIAL if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rng = random.Random(1)
    for n in (0, 1, 9, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 5):
        data = rng.randbytes(n)
        assert crc32c(data) == slow(data)


@pytest.mark.parametrize("block", [None, 1, 3, 100])
def test_pairs_in_blocks(spark, block):
    df = spark.createDataFrame([("x", i) for i in range(17)] + [("y", i) for i in range(4)] + [("z", 0)], "g string, k int")
    got = [(r.g, r.a, r.b) for r in v.pairs(df, "g", "k", [], block=block).collect()]
    assert sorted(got) == [(g, a, b) for g, n in (("x", 17), ("y", 4)) for a in range(n) for b in range(a + 1, n)]
    with pytest.raises(Exception, match="more than 10"):
        v.pairs(df, "g", "k", [], block=block, most=10).collect()
