"""Medoids against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from tracklens.operators import medoids


def slow(rows):
    out = {}
    for g in {r[0] for r in rows}:
        own = [(k, np.array(v, float)) for h, k, v in rows if h == g and v is not None]
        if own:
            sums = [(round(sum(float(np.linalg.norm(x - y)) for _, y in own), 6), k) for k, x in own]
            out[g] = min(sums)[::-1]
    return out


def test_medoids_equal_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [("a", i, rng.normal(size=3).tolist()) for i in range(150)] + [("b", i, [float(i % 2), 0.0, 0.0]) for i in range(40)] + [("one", 7, [1.0, 2.0, 3.0]), ("none", 1, None), (None, 5, [0.0] * 3), (None, 6, [1.0] * 3)]
    rows += [("c", i, (rng.normal(scale=0.01, size=3) + 10 * (i % 4)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k long, v array<double>").repartition(5).withColumn("low", F.lit("clash"))
    for part in (4096, 16):
        monkeypatch.setattr(medoids, "PART", part)
        monkeypatch.setattr(medoids, "FIRST", 8)
        got = medoids.medoid(df, "g", "k", "v").collect()
        assert {r.g: (r.k, r.total) for r in got} == slow(rows)
    assert medoids.medoid(df.limit(0), "g", "k", "v").count() == 0


def test_clustered_groups_need_few_sums(spark):
    """30,000 members, beyond the bound of pair joins: fewer than a tenth of all sums are computed, and none is smaller."""
    rng = np.random.default_rng(6)
    centres = rng.normal(scale=20, size=(12, 4))
    x = (centres[rng.integers(0, 12, 30_000)] + rng.normal(scale=0.3, size=(30_000, 4))).astype(float)
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "g int, k int, v array<double>").repartition(8)
    r = medoids.medoid(df, "g", "k", "v").first()
    some = np.concatenate([[r.k], rng.integers(0, 30_000, 300)])
    sums = np.array([np.linalg.norm(x - x[i], axis=1).sum() for i in some])
    assert r.evaluated < 3000 and sums.argmin() == 0 and abs(sums[0] - r.total) < 1e-4
