"""Rankings, top-k and diversity-aware selection; ties always end on an identifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.lineage import cut


def ranked(df: DataFrame, group: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def top_share(df: DataFrame, group: Sequence[str], order: Sequence, share: float, least: int) -> DataFrame:
    """The best share of each group, at least `least` rows."""
    df = ranked(df, group, order).withColumn("_n", F.count("*").over(Window.partitionBy(*group)))
    return df.where(F.col("rank") <= F.greatest(F.lit(least), F.ceil(F.col("_n") * share))).drop("_n")


def diverse_queue(df: DataFrame, breadth: str, depth: str, score: str, key: str, limit: int) -> DataFrame:
    """First the best row of each breadth value, then of each (breadth, depth), then by score; at most limit rows (a top-k report)."""
    order = [F.desc(score), key]
    df = ranked(ranked(df, [breadth], order, "_b"), [breadth, depth], order, "_d")
    tier = F.when(F.col("_b") == 1, 0).when(F.col("_d") == 1, 1).otherwise(2)
    return df.withColumn("tier", tier).drop("_b", "_d").orderBy("tier", *order).limit(limit)


def nucleus(df: DataFrame, group: Sequence[str], p: str, key: str, mass: float) -> DataFrame:
    """The most probable rows until mass is reached; the first always stays."""
    w = Window.partitionBy(*group).orderBy(F.desc(p), key)
    before = F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(p)
    return df.withColumn("_before", before).withColumn("rank", F.row_number().over(w)).where((F.col("_before") < mass) | (F.col("rank") == 1)).drop("_before")


def farthest_first(df: DataFrame, group: str, key: str, vector: str, k: int, score: str) -> DataFrame:
    """Greedy max-min choice of k rows a group, beginning with the best score: (group, key, round).

    k rounds of an aggregate and a join; each round's distances are to one
    chosen row a group, so no pairs of rows are made. Every round is cut, or plans would double with each.
    """
    pool = df.select(group, key, F.col(vector).alias("_v"), F.col(score).alias("_s"))
    best = lambda x, o: x.groupBy(group).agg(F.max_by(F.struct(key, "_v"), o).alias("c"))
    chosen = best(pool, F.struct("_s", -F.col(key)))
    pool = pool.withColumn("_near", F.lit(float("inf")))
    out = chosen.select(group, F.col(f"c.{key}").alias(key), F.lit(1).alias("round"))
    for r in range(2, k + 1):
        last = chosen.select(group, F.col(f"c.{key}").alias("_k"), F.col("c._v").alias("_c"))
        gap = F.aggregate(F.zip_with("_v", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
        pool = cut(pool.join(last, group).where(F.col(key) != F.col("_k")).withColumn("_near", F.least("_near", gap)).drop("_k", "_c"))
        chosen = best(pool, F.struct("_near", -F.col(key)))
        out = out.union(chosen.select(group, F.col(f"c.{key}").alias(key), F.lit(r).alias("round")))
    return out


def elite_update(df: DataFrame, group: Sequence[str], order: Sequence, x: str, old_mean: Column, old_sd: Column, share: float = 0.25, keep: float = 0.3, floor: float = 0.1) -> DataFrame:
    """Mean and deviation blended from the old ones and those of the best share."""
    top = top_share(df, group, order, share, 2)
    return top.groupBy(*group).agg((keep * old_mean + (1 - keep) * F.avg(x)).alias("mean"), F.greatest(F.lit(floor), keep * old_sd + (1 - keep) * F.stddev_pop(x)).alias("sd"))
