"""Operators on ordered series: each takes a frame, a key, a total order and column names.

All are window expressions partitioned by the key, so a frame already
partitioned by the key is not shuffled again, and several of them in a row
share one sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracklens.functions.numbers import col, over

Names = str | Sequence[str]


def _list(x: Names) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def by(key: Names, order: Names) -> WindowSpec:
    return Window.partitionBy(*_list(key)).orderBy(*_list(order))


def whole(key: Names) -> WindowSpec:
    return Window.partitionBy(*_list(key))


def until_now(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def gap_segments(df: DataFrame, key: Names, order: Names, t: str, factor: float = 1.5, least_rows: int = 2) -> DataFrame:
    """Adds segment: a new one begins where the step is not positive or above factor times the key's median positive step."""
    w = by(key, order)
    df = df.withColumn("dt", F.col(t) - F.lag(t).over(w))
    df = df.withColumn("typical", F.percentile(F.when(F.col("dt") > 0, F.col("dt")), 0.5).over(whole(key)))
    new = F.when(F.col("dt").isNull(), 0).when((F.col("dt") <= 0) | (F.col("dt") > factor * F.col("typical")), 1).otherwise(0)
    df = df.withColumn("segment", F.sum(new).over(until_now(w)))
    return df.withColumn("_n", F.count("*").over(whole([*_list(key), "segment"]))).where(F.col("_n") >= least_rows).drop("_n", "typical")


def contiguous_runs(df: DataFrame, key: Names, index: str, least: int = 3) -> DataFrame:
    """(key, first, last, length) of runs of consecutive indexes."""
    island = F.col(index) - F.row_number().over(by(key, index))
    runs = df.select(*_list(key), index).distinct().withColumn("_island", island).groupBy(*_list(key), "_island")
    return runs.agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_island")


def forward_fill(x: str | Column, key: Names, order: Names) -> Column:
    return F.last(col(x), ignorenulls=True).over(until_now(by(key, order)))


def gradient(x: str, t: str, key: Names, order: Names, unit: float = 1.0) -> Column:
    """Second-order central difference on an uneven clock, one-sided at both ends; unit: what one of the clock's units has of those told.

    Steps are taken on the clock as it is, so on whole numbers they are exact; a step of zero makes an infinite slope, or NaN.
    """
    w = by(key, order)
    back, ahead = (F.col(t) - F.lag(t).over(w)).cast("double") / unit, (F.lead(t).over(w) - F.col(t)).cast("double") / unit
    dx, dn = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    return F.when(back.isNull() & ahead.isNull(), F.lit(None).cast("double")).when(back.isNull(), over(dn, ahead)).when(ahead.isNull(), over(dx, back)).otherwise(over(over(dn, ahead) * back + over(dx, back) * ahead, back + ahead))


def moving_average(x: str, width: int, key: Names, order: Names) -> Column:
    """Mean of a centred window of width rows in which the edge values repeat beyond the ends."""
    w = by(key, order)
    before, after = width // 2, width - 1 - width // 2
    at, n = F.row_number().over(w), F.count("*").over(whole(key))
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.greatest(F.lit(0), before - at + 1) * F.first(x).over(full)
    tail = F.greatest(F.lit(0), at + after - n) * F.last(x).over(full)
    return (F.sum(x).over(w.rowsBetween(-before, after)) + head + tail) / width


def sustained(flag: Column, n: int, key: Names, order: Names) -> Column:
    """Whether n rows from here on are all true."""
    f = F.when(flag, 1).otherwise(0)
    return F.sum(f).over(by(key, order).rowsBetween(0, n - 1)) == n


def rising(flag: Column, key: Names, order: Names, start_counts: bool) -> Column:
    """Whether the flag turns true here; start_counts: a series that begins true rises at its first row."""
    before = F.lag(flag).over(by(key, order))
    return flag & ~F.coalesce(before, F.lit(not start_counts))


def event_starts(df: DataFrame, key: Names, order: Names, flag: Column, n: int) -> DataFrame:
    """Rows where n true rows begin, not overlapping inside one run of true rows."""
    keys = _list(key)
    df = df.withColumn("_flag", flag)
    df = df.withColumn("_run", F.sum(F.when(F.col("_flag"), 0).otherwise(1)).over(until_now(by(keys, order)))).where("_flag")
    df = df.withColumn("_at", F.row_number().over(by([*keys, "_run"], order)) - 1).withColumn("_size", F.count("*").over(whole([*keys, "_run"])))
    return df.where((F.col("_at") % n == 0) & (F.col("_at") + n <= F.col("_size"))).drop("_flag", "_run", "_at", "_size")


def fixed_windows(df: DataFrame, key: Names, order: Names, size: int, good: Column) -> DataFrame:
    """Rows of full, non-overlapping windows of size rows in which all are good; adds window."""
    df = df.withColumn("window", F.floor((F.row_number().over(by(key, order)) - 1) / size))
    w = whole([*_list(key), "window"])
    df = df.withColumn("_ok", (F.count("*").over(w) == size) & F.min(F.when(good, 1).otherwise(0)).over(w).cast("boolean"))
    return df.where("_ok").drop("_ok")


def sliding_anchors(df: DataFrame, key: Names, frame: str, before: int, after: int, stride: int, valid: Column) -> DataFrame:
    """Rows on a stride of frames with a complete, valid past and future."""
    w = by(key, frame).rowsBetween(-before, after)
    return df.withColumn("_full", F.sum(F.when(valid, 1).otherwise(0)).over(w)).where((F.col("_full") == before + after + 1) & (F.col(frame) % stride == 0)).drop("_full")


def chain_valid(valid: Column, key: Names, order: Names) -> Column:
    """True until the first invalid row, false from it on."""
    return F.min(F.when(valid, 1).otherwise(0)).over(until_now(by(key, order))) == 1


def turns(a: str, key: Names, order: Names) -> Column:
    """Whole turns to take off the step from the row before, so that it is at most half a turn; its running sum unwraps the angle."""
    d = F.col(a) - F.lag(a).over(by(key, order))
    return F.coalesce(-F.lit(2 * math.pi) * F.bround(d / (2 * math.pi)), F.lit(0.0))


def until_first_success(df: DataFrame, key: Names, order: Names, success: Column, budget: int | None = None) -> DataFrame:
    """Rows up to the first success, that row included, and at most budget rows; adds attempt."""
    w = by(key, order)
    done = F.coalesce(F.sum(F.when(success, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("attempt", F.row_number().over(w)).withColumn("_done", done).where("_done = 0").drop("_done")
    return df if budget is None else df.where(F.col("attempt") <= budget)


def discounted_ahead(df: DataFrame, delta: str, step: str, rate: float, key: Names, name: str) -> DataFrame:
    """Adds name: the sum over k >= 0 of rate**k * delta at k steps ahead; step counts a key's rows without gaps, 0 < rate < 1.

    Suffix sums are rescaled inside blocks of steps so long that rate**block is about 1e-120, and a row adds what the two
    blocks ahead are worth; all beyond is below what doubles hold. So series may be of any length.
    """
    keys, block = _list(key), max(1, int(-276 / math.log(rate)))
    power = lambda n: F.pow(F.lit(rate), n)
    d = df.withColumn("_b", F.floor(F.col(step) / block)).withColumn("_o", F.col(step) - F.col("_b") * block)
    d = d.withColumn("_local", F.sum(F.col(delta) * power(F.col("_o"))).over(by([*keys, "_b"], step).rowsBetween(0, Window.unboundedFollowing)) / power(F.col("_o")))
    heads = d.groupBy(*keys, "_b").agg(F.min_by(F.col("_local") * power(F.col("_o")), step).alias("_head"))  # worth at the start of the block
    for k in (1, 2):
        d = d.join(heads.select(*keys, (F.col("_b") - k).alias("_b"), F.col("_head").alias(f"_next{k}")), [*keys, "_b"], "left")
    ahead = F.coalesce("_next1", F.lit(0.0)) + power(F.lit(block)) * F.coalesce("_next2", F.lit(0.0))
    return d.withColumn(name, F.col("_local") + power(block - F.col("_o")) * ahead).drop("_b", "_o", "_local", "_next1", "_next2")


def as_of(df: DataFrame, key: Names, order: Names, t: str, seen: Column, values: Sequence[str], stale: float) -> DataFrame:
    """Adds last_<value> of the latest seen row at or before each row, null where it is older than stale, and age."""
    w = until_now(by(key, order))
    df = df.withColumn("age", F.col(t) - F.last(F.when(seen, F.col(t)), ignorenulls=True).over(w))
    fresh = F.col("age") <= stale
    return df.withColumns({f"last_{v}": F.when(fresh, F.last(F.when(seen, F.col(v)), ignorenulls=True).over(w)) for v in values})
