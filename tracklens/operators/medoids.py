"""Exact medoids of groups of any size, without all pairs.

The members of a group are put to their nearest of a few pivots. For clusters with means m and sizes n the sum of n * |x - m| is never
above the sum of distances from x to all members, and never falls short of it by more than the members' own distances to
their means. So members whose lower bound is above the least upper bound can't be medoids; of the others, those with
the smallest bounds get their exact sums first, and the best sum found rules out the rest. Groups are worked on in parts of PART rows, so a hot
one is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracklens.lineage import cut

PIVOTS, PART, FIRST = 32, 4096, 32
DIGITS = 6


def _stack(t: pa.Table, column: str) -> np.ndarray:
    return t.column(column).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a and each of b, a slab of b at a time; by differences, so near vectors keep their digits."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 22) // max(a.size, 1))
    for j in range(0, len(b), step):
        d = a[:, None] - b[None, j : j + step]
        out[:, j : j + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def medoid(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, key, total, evaluated): the member with the smallest summed distance to the others of its group, rounded to DIGITS; of
    equal sums the smallest key. evaluated: how many members had their sums computed. Rows with a null vector don't count."""
    of = df.schema[group].dataType
    v = df.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.transform(vector, lambda c: c.cast("double")).alias("v"))
    sizes = cut(v.groupBy("g").agg(F.count("*").alias("n")))
    v = v.join(sizes.withColumnRenamed("g", "g0"), F.col("g").eqNullSafe(F.col("g0"))).drop("g0")
    v = cut(v.withColumn("part", F.pmod(F.xxhash64("k", "v"), F.ceil(F.col("n") / PART)).cast("int")))
    parts = v.select("g", "part").distinct()

    def each_part(rows: DataFrame, few: DataFrame, work: Callable[[pa.Table, pa.Table], dict], ddl: str) -> DataFrame:
        """work on the members of each part and the few rows of its group."""
        dealt = few.join(parts.withColumnRenamed("g", "g0"), F.col("g").eqNullSafe(F.col("g0"))).drop("g0")
        dealt = dealt.toDF(*[f"{c}_" for c in dealt.columns])  # names of its own, since both come from the same rows
        schema = T.StructType([T.StructField("g", of), *T.StructType.fromDDL(ddl).fields])
        arrow = to_arrow_schema(schema)

        def run(own: pa.Table, others: pa.Table) -> pa.Table:
            some = own.num_rows and others.num_rows
            return pa.table(work(own, others.rename_columns([c[:-1] for c in others.column_names])), schema=arrow) if some else arrow.empty_table()

        return rows.groupBy("g", "part").cogroup(dealt.groupBy("g_", "part_")).applyInArrow(run, schema)

    by_hash = Window.partitionBy("g").orderBy(F.xxhash64("v"), "k")
    pivots = v.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= PIVOTS).select("g", "v")

    def assign(rows: pa.Table, few: pa.Table) -> dict:
        x, p = _stack(rows, "v"), _stack(few, "v")
        near = _distances(x, p[np.lexsort(p.T[::-1])]).argmin(1)  # pivots in the same order in every part
        have = np.unique(near)
        return {"g": [rows["g"][0].as_py()] * len(have), "c": have, "n": [int((near == c).sum()) for c in have], "s": [x[near == c].sum(0) for c in have]}

    told = each_part(v, pivots, assign, "c int, n long, s array<double>").select("g", "c", "n", F.posexplode("s").alias("at", "x"))
    means = told.groupBy("g", "c", "at").agg((F.sum("x") / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    means = cut(means.groupBy("g", "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("m"), F.max("n").alias("n")))

    def bound(rows: pa.Table, few: pa.Table) -> dict:
        d = _distances(_stack(rows, "v"), _stack(few, "m"))
        return {"g": rows["g"], "k": rows["k"], "v": rows["v"], "low": d @ few["n"].to_numpy().astype(float), "own": d.min(1)}

    kind = df.schema[key].dataType.simpleString()
    bounded = cut(each_part(v, means, bound, f"k {kind}, v array<double>, low double, own double"))
    best = bounded.groupBy(F.col("g").alias("g0")).agg((F.min("low") + F.sum("own")).alias("best"))
    slack = F.lit(10.0**-DIGITS) + F.abs("best") * 1e-9  # rounding, of sums and of bounds
    left = cut(bounded.drop("own").join(best, F.col("g").eqNullSafe(F.col("g0"))).where(F.col("low") <= F.col("best") + slack).drop("g0", "best"))
    found, size = None, FIRST
    while not left.isEmpty():
        w = Window.partitionBy("g").orderBy("low", "k")
        ranked = left.withColumn("r", F.row_number().over(w))
        now = cut(ranked.where(F.col("r") <= size).select("g", F.col("k").alias("ck"), F.col("v").alias("cv"), "low"))

        def sums(rows: pa.Table, few: pa.Table) -> dict:
            return {"g": few["g"], "k": few["ck"], "total": _distances(_stack(few, "cv"), _stack(rows, "v")).sum(1)}

        exact = each_part(v, now, sums, f"k {kind}, total double").groupBy("g", "k").agg(F.sum("total").alias("total"))
        found = cut(exact if found is None else found.unionByName(exact))
        best = found.groupBy(F.col("g").alias("g0")).agg(F.min("total").alias("best"))
        rest = ranked.where(F.col("r") > size).drop("r").join(best, F.col("g").eqNullSafe(F.col("g0")))
        left = cut(rest.where(F.col("low") <= F.col("best") + slack).drop("g0", "best"))
        size *= 2
    if found is None:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(group, of), T.StructField(key, df.schema[key].dataType), *T.StructType.fromDDL("total double, evaluated long").fields]))
    first = F.min(F.struct(F.round("total", DIGITS).alias("total"), F.col("k"))).alias("m")
    return found.groupBy("g").agg(first, F.count("*").alias("evaluated")).select(F.col("g").alias(group), F.col("m.k").alias(key), F.col("m.total").alias("total"), "evaluated")
