"""Operator 11 against eigenvectors of the covariance in wide arithmetic."""

import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklens.llm import whitening
from tracklens.llm.queries import op11_embedding_whitening

ROWS = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, most=16):
    """(vec_id, component) to the lists of (n, deviation, |whitened|, explained), for each length of vector."""
    out = {}
    kept = [(i, [math.floor(Fraction(float(np.float32(c))) * 64) + 1000000 for c in v]) for i, v, *_ in rows if usable(v)]
    for d in {len(x) for _, x in kept}:
        own = [(i, x) for i, x in kept if len(x) == d]
        fit = sorted({tuple(x) for _, x in own})
        n, s = len(fit), [sum(x[k] for x in fit) for k in range(d)]
        dev = [[n * a - b for a, b in zip(x, s, strict=True)] for x in fit]
        v = np.array([[float(Fraction(sum(r[i] * r[j] for r in dev), n**3)) for j in range(d)] for i in range(d)])
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        for i, x in own:
            far = [n * a - b for a, b in zip(x, s, strict=True)]
            for k in range(min(most, d)):
                if e[k] > 1e-20 * max(e[0], 1e-300) and e[0] > 0:
                    out.setdefault((i, k + 1), []).append((n, sum(a * a for a in far), abs(float(np.array(far, float) / n @ u[:, k])) / math.sqrt(e[k]), e[k] / np.trace(v)))
    return out


def check(got, want):
    seen = {}
    for r in got:
        assert r.identity_error < 1e-8
        seen.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, abs(r.whitened), r.explained))
    assert seen.keys() == want.keys()
    for k, rows in want.items():
        for a, b in zip(sorted(seen[k]), sorted(rows), strict=True):
            assert a[:2] == b[:2]
            assert a[2:] == pytest.approx(b[2:], rel=1e-8, abs=1e-8), k


def spread(rng, n, d=6):
    return [[rng.gauss(0, 1 + k) + (3 if k == 2 else 0) for k in range(d)] for _ in range(n)]


def table(rng):
    rows = [(i, v, 1) for i, v in enumerate(spread(rng, 150))]
    rows += [(200 + i, rows[3][1], 1) for i in range(60)] + [rows[5], rows[5]]
    rows += [(300, None, 1), (301, [], 1), (302, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (303, [float("nan")] * 6, 1), (304, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], 1)]
    rows += [(400 + i, v, None) for i, v in enumerate(spread(rng, 40, 3))] + [(500, [1.0], 1), (501, [1.001], 1), (None, rows[7][1], 1)]
    rng.shuffle(rows)
    return rows


def test_against_the_covariance(spark):
    rows = table(random.Random(4))
    df = spark.createDataFrame(rows, ROWS).repartition(19).withColumn("n", F.lit("clash")).withColumn("whitened", F.lit("clash"))
    got = whitening.components(df).collect()
    check(got, brute(rows))
    assert not any(r.vec_id in (300, 301, 302, 303, 304, 500, 501) for r in got)
    whitened = np.array([[r.whitened] for r in got if r.vec_id == 500])
    assert whitened.size == 0  # floor(64 c) is one value: no variance
    signs = {}
    for r in got:
        signs.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r.whitened)
    assert all(max(x) - min(x) < 1e-12 for by in signs.values() for x in by.values())


def test_tree_of_triangles_does_not_depend_on_its_shape(spark, monkeypatch):
    rows = [(i, v, 1) for i, v in enumerate(spread(random.Random(8), 400, 4))]
    df = spark.createDataFrame(rows, ROWS)
    want = brute(rows)
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 40)
    check(whitening.components(df.repartition(23)).collect(), want)
    check(whitening.components(df.coalesce(1)).collect(), want)


def test_rank_deficient_vectors_have_fewer_components(spark):
    rng = random.Random(2)
    rows = [(i, [a, a, b, 1.0], 0) for i, (a, b) in enumerate((float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(50))]
    got = whitening.components(spark.createDataFrame(rows, ROWS)).collect()
    assert {r.component for r in got} == {1, 2}
    assert max(r.identity_error for r in got) < 1e-8 and sum({r.component: r.explained for r in got}.values()) == pytest.approx(1)


def test_empty_single_and_huge(spark):
    assert whitening.components(spark.createDataFrame([], ROWS)).count() == 0
    assert whitening.components(spark.createDataFrame([(1, [1.0, 2.0], 0)], ROWS)).count() == 0
    wide = [(i, [3e38 * (-1) ** i, float(i), 1e30], 0) for i in range(6)]
    got = whitening.components(spark.createDataFrame(wide, ROWS)).collect()
    assert {r.deviation for r in got} == {None} and all(math.isfinite(r.whitened) for r in got)


def test_too_many_lengths_are_refused(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FIT_BYTES", 100)
    with pytest.raises(ValueError, match="lengths"):
        whitening.components(spark.createDataFrame([(1, [1.0] * 4, 0)], ROWS))


def test_exact_sums_and_deviations():
    x = np.array([[2**62, -(2**62) + 5], [2**62 - 1, 7]], np.int64)
    assert whitening._exact(2, x) == [2**63 - 1, -(2**62) + 12]
    assert whitening.deviations(x, 3, [1, 2]).tolist() == [[3 * 2**62 - 1, -3 * 2**62 + 13], [3 * 2**62 - 4, 19]]
    assert whitening.quantised(np.array([-0.001, 0.0, 0.0156, 1.0])).tolist() == [999999, 1000000, 1000000, 1000064]
    lists = list(whitening.by_length(pa.array([[1.0, 2.0], None, [3.0], [None, 1.0], [], [5.0, 6.0]])))
    assert [(d, at.tolist(), v.tolist()) for d, at, v in lists] == [(1, [2], [[3.0]]), (2, [0, 5], [[1.0, 2.0], [5.0, 6.0]])]


def test_query_over_the_table(spark):
    data = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got = op11_embedding_whitening(spark, data)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(got.collect(), brute(rows))
