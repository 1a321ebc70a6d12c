"""Exact places in an order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.lineage import cut

_IN_PART = 33  # bits that monotonically_increasing_id gives to the place inside a partition


def in_ranges(df: DataFrame, keys: Sequence[Column], parts: int) -> DataFrame:
    """df dealt out by ranges of the keys, whose borders Spark samples, and sorted inside each."""
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """df with the rank (1, 2, ...) of each row of its group, in an order of all rows of the group.

    Rows are dealt out by ranges of (group, order), whose borders Spark takes from a sample of all keys, so a far value, a frequent value
    or a hot group makes no task larger than others: ties of the first keys are split by those that follow. A row's rank is its place in its part, less
    the place where its group begins there, and the rows that the group has in parts before. The order should be
    total; equal rows are ranked in any order. The rows are written once to the shared folder, so that places stay as they are: df should be narrow.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(f"`{g}`") for g in group], *[F.col(f"`{k}`") if isinstance(k, str) else k for k in order]]
    d = cut(in_ranges(df, keys, n).withColumn("_at", F.monotonically_increasing_id()))
    d = d.withColumn("_part", F.shiftright("_at", _IN_PART))
    own = [F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(group)]
    sizes = d.groupBy(*own, F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[f"_g{i}" for i in range(len(group))], "_p", "_first", before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}"))
    placed = d.join(sizes if group else F.broadcast(sizes), same)  # without groups there is a row a part
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_at") - F.col("_first") + 1 + F.col("_before")).alias(name))
