"""Set operations and comparisons of whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def partition_report(every: DataFrame, kept: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """One row: sizes, and whether kept and removed are disjoint and make up the whole."""
    tags = [x.select(F.col(key).alias("k"), *[F.lit(int(i == j)).alias(c) for j, c in enumerate(("a", "k1", "k2"))]) for i, x in enumerate((every, kept, removed))]
    t = reduce(DataFrame.union, tags).groupBy("k").agg(*[F.sum(c).alias(c) for c in ("a", "k1", "k2")])
    return t.agg(F.sum("a").alias("total"), F.sum("k1").alias("kept"), F.sum("k2").alias("removed"), F.bool_and((F.col("k1") == 0) | (F.col("k2") == 0)).alias("disjoint"), F.bool_and(F.col("a") == F.col("k1") + F.col("k2")).alias("whole"))


def leaf_diff(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """(key, path, left, right) where two tables differ, field by field; null equals null."""
    wide = lambda d, side: d.select(key, *[F.col(f).cast("string").alias(f) for f in fields if f not in ignore]).unpivot([key], [f for f in fields if f not in ignore], "path", side)
    j = wide(a, "left").join(wide(b, "right"), [key, "path"], "full_outer")
    return j.where(~F.col("left").eqNullSafe(F.col("right")))


def leaves(schema: StructType, prefix: str = "") -> list[str]:
    """Dotted paths of all fields of a schema that are no structs."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += leaves(f.dataType, f"{path}.") if isinstance(f.dataType, StructType) else [path]
    return out


def nested_diff(a: DataFrame, b: DataFrame, key: str, ignore: Sequence[str] = ()) -> DataFrame:
    """leaf_diff of all leaves of nested tables; paths in ignore, and all below them, are left out."""
    skipped = lambda p: any(p == i or p.startswith(f"{i}.") for i in (*ignore, key))
    paths = sorted(p for p in {*leaves(a.schema), *leaves(b.schema)} if not skipped(p))

    def wide(d: DataFrame, side: str) -> DataFrame:
        have = set(leaves(d.schema))
        cells = F.array(*[F.struct(F.lit(p).alias("path"), (F.col(p).cast("string") if p in have else F.lit(None).cast("string")).alias("x")) for p in paths])
        return d.select(key, F.explode(cells).alias("c")).select(key, "c.path", F.col("c.x").alias(side))

    j = wide(a, "left").join(wide(b, "right"), [key, "path"], "full_outer")
    return j.where(~F.col("left").eqNullSafe(F.col("right")))
