"""Segmentation, detection and windows on hand-made series."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.operators import series as s


def track(spark, times, values=None, key="a"):
    rows = [(key, i, float(t), float(values[i] if values else t)) for i, t in enumerate(times)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "k string, i long, t double, x double").repartition(3)


def column(df, c="r"):
    return [r[c] for r in df.orderBy("k", "i").collect()]


def test_gap_makes_two_segments(spark):
    times = [100, 200, 300, 400, 500, 1500, 1600, 1700, 1800, 1900]
    assert column(s.gap_segments(track(spark, times), "k", "i", "t"), "segment") == [0] * 5 + [1] * 5


def test_clock_reset_is_seen_in_input_order(spark):
    assert column(s.gap_segments(track(spark, [0, 1, 2, 3, 0, 1, 2]), "k", "i", "t"), "segment") == [0] * 4 + [1] * 3


def test_single_rows_are_no_segment(spark):
    assert column(s.gap_segments(track(spark, [0, 1, 2, 50]), "k", "i", "t"), "segment") == [0, 0, 0]


def test_gradient_of_microseconds_is_exact(spark):
    """Steps of a clock in microseconds since 1970 aren't rounded to what a double of seconds holds; equal times are no error."""
    t = [1_704_067_200_000_001, 1_704_067_200_000_002, 1_704_067_200_000_004, 1_704_067_200_000_004]
    got = column(track(spark, t, [1.0, 2.0, 4.0, 5.0]).withColumn("r", s.gradient("x", "t", "k", "i", unit=1e6)))
    np.testing.assert_array_equal(got, [1e6, 1e6, np.inf, np.inf])


def test_gradient_is_that_of_numpy(spark):
    t, x = [0, 1, 1.5, 4, 4.2, 7], [3, 1, 4, 1, 5, 9]
    got = column(track(spark, t, x).withColumn("r", s.gradient("x", "t", "k", "i")))
    np.testing.assert_allclose(got, np.gradient(np.array(x, float), np.array(t)))


@pytest.mark.parametrize("width", [1, 2, 4, 5, 9])
def test_moving_average_repeats_edges(spark, width):
    x = [1, 5, 2, 8, 3, 9, 4]
    want = np.convolve(np.pad(np.array(x, float), (width // 2, width - 1 - width // 2), mode="edge"), np.ones(width) / width, "valid")
    got = column(track(spark, range(len(x)), x).withColumn("r", s.moving_average("x", width, "k", "i")))
    np.testing.assert_allclose(got, want)


def test_start_high(spark):
    d = track(spark, range(5), [1, 1, 0, 1, 1])
    on = F.col("x") > 0
    assert column(d.withColumn("r", s.rising(on, "k", "i", False))) == [False, False, False, True, False]
    assert column(d.withColumn("r", s.rising(on, "k", "i", True))) == [True, False, False, True, False]


def test_event_starts_do_not_overlap(spark):
    d = track(spark, range(9), [1, 1, 1, 1, 1, 0, 1, 1, 0])
    assert column(s.event_starts(d, "k", "i", F.col("x") > 0, 2), "i") == [0, 2, 6]


def test_fill_never_looks_ahead(spark):
    d = track(spark, range(4), [0, 2, 0, 3]).withColumn("v", F.when(F.col("x") > 0, F.col("x")))
    assert column(d.withColumn("r", s.forward_fill("v", "k", "i"))) == [None, 2, 2, 3]


def test_as_of_goes_stale(spark):
    d = s.as_of(track(spark, [0, 1, 5], [7, 0, 0]), "k", "i", "t", F.col("x") > 0, ["x"], 2.0)
    assert column(d, "last_x") == [7, 7, None]


def test_unwrap_is_that_of_numpy(spark):
    a = [0.0, 3.0, -3.0, -1.0, 2.9, -2.9, 6.5]
    d = track(spark, range(7), a).withColumn("q", s.turns("x", "k", "i"))
    got = column(d.withColumn("r", F.col("x") + F.sum("q").over(s.until_now(s.by("k", "i")))))
    np.testing.assert_allclose(got, np.unwrap(a))


def test_chain_and_windows(spark):
    d = track(spark, range(8), [1, 1, 0, 1, 1, 1, 1, 1])
    assert column(d.withColumn("r", s.chain_valid(F.col("x") > 0, "k", "i"))) == [True, True] + [False] * 6
    assert column(s.fixed_windows(d, "k", "i", 4, F.col("x") > 0), "i") == [4, 5, 6, 7]
    assert column(s.sliding_anchors(d, "k", "i", 1, 2, 1, F.col("x") > 0), "i") == [4, 5]
    assert [r.asDict() for r in s.contiguous_runs(d.where("x > 0"), "k", "i", 3).collect()] == [{"k": "a", "first": 3, "last": 7, "length": 5}]


@pytest.mark.parametrize(("n", "rate"), [(4, 0.9), (3000, 0.5), (900, 0.05)])
def test_reverse_sum(spark, n, rate):
    """Long series too, where rate**n is 0 in double precision."""
    x = [float(i % 7) - 2 for i in range(n)]
    want, run = [], 0.0
    for v in reversed(x):
        run = v + rate * run
        want.append(run)
    got = column(s.discounted_ahead(track(spark, range(n), x), "x", "i", rate, "k", "r"))
    np.testing.assert_allclose(got, want[::-1], rtol=1e-9)
