"""Two-level means, strata, contingency tables, robust scales and other aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.numbers import clean, col


def share(flag: Column) -> Column:
    """Mean of a flag; null rows don't count."""
    return F.avg(flag.cast("int"))


def two_level_mean(df: DataFrame, outer: Sequence[str], group: str, value: str) -> DataFrame:
    """mean_of_means (each group once) beside pooled (each row once), by outer keys. NaN is skipped."""
    g = df.groupBy(*outer, group).agg(F.avg(clean(value)).alias("m"), F.sum(clean(value)).alias("s"), F.count(clean(value)).alias("c"))
    return g.groupBy(*outer).agg(F.avg("m").alias("mean_of_means"), (F.sum("s") / F.sum("c")).alias("pooled"), F.count("m").alias("groups"))


def counts_by(df: DataFrame, *sets: Sequence[str]) -> DataFrame:
    """Counts for several sets of keys in one pass (GROUPING SETS); a key that a set leaves out is null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence, item: str) -> DataFrame:
    """For each row key, distinct items and rows by column value (zero where there are none)."""
    out = []
    for v in values:
        hit = F.col(column) == v
        out += [F.count_distinct(F.when(hit, F.col(item))).alias(f"{v}_items"), F.count_if(hit).alias(f"{v}_rows")]
    return df.groupBy(row).agg(*out)


def cross_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts for all pairs of values, zero where there is none. The grid is made from both sets of values, not from rows."""
    grid = df.groupBy(a).agg(F.lit(1).alias("_k")).join(df.groupBy(b).agg(F.lit(1).alias("_k")), "_k").drop("_k")
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return grid.join(n, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def describe(x: str | Column, digits: int = 4) -> dict[str, Column]:
    """n, min, p05, median, p95, max, mean and sample deviation of the finite values, rounded half to even."""
    v = clean(x)
    stats = {"n": F.count(v), "low": F.min(v), "p05": F.percentile(v, 0.05), "median": F.percentile(v, 0.5), "p95": F.percentile(v, 0.95), "high": F.max(v), "mean": F.avg(v), "sd": F.stddev_samp(v)}
    return {k: c if k == "n" else F.bround(c, digits) for k, c in stats.items()}


def envelope(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """min, median and max of each field, one row a field."""
    long = df.unpivot(list(keys), list(fields), "field", "x")
    return long.groupBy(*keys, "field").agg(F.min("x").alias("low"), F.percentile("x", 0.5).alias("median"), F.max("x").alias("high"))


def robust_scale(df: DataFrame, key: str, x: str, floor: float) -> DataFrame:
    """centre and scale = max(floor, 1.4826 MAD) by key and for ALL."""
    both = df.select(F.explode(F.array(F.col(key).cast("string"), F.lit("ALL"))).alias(key), F.col(x).alias("x"))
    centre = both.groupBy(key).agg(F.percentile("x", 0.5).alias("centre"))
    dev = both.join(centre, key).groupBy(key).agg(F.first("centre").alias("centre"), F.percentile(F.abs(F.col("x") - F.col("centre")), 0.5).alias("mad"))
    return dev.select(key, "centre", F.greatest(F.lit(floor), F.lit(1.4826) * F.col("mad")).alias("scale"))


def leave_one_out_range(df: DataFrame, key: Sequence[str], row: str, x: str) -> DataFrame:
    """For each row the range of the others of its key: the extreme, or the runner-up where the row is the extreme itself."""
    w = Window.partitionBy(*key)
    up, down = F.row_number().over(w.orderBy(F.asc(x), row)), F.row_number().over(w.orderBy(F.desc(x), row))
    r = df.withColumns({"_u": up, "_d": down})
    top = r.groupBy(*key).agg(*[F.max(F.when(F.col(c) == k, F.col(x))).alias(f"_{c}{k}") for c in ("_u", "_d") for k in (1, 2)])
    r = r.join(top, list(key))
    return r.select(*key, row, F.when(F.col("_u") == 1, F.col("__u2")).otherwise(F.col("__u1")).alias("low"), F.when(F.col("_d") == 1, F.col("__d2")).otherwise(F.col("__d1")).alias("high"))


def upper_median(x: str | Column) -> Column:
    """sorted(x)[n // 2]: of an even number the upper of the two in the middle."""
    a = F.sort_array(F.collect_list(col(x)))
    return F.get(a, F.floor(F.size(a) / 2).cast("int"))


def reasons(df: DataFrame, column: str) -> DataFrame:
    """How often each entry of an array column occurs."""
    return df.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def first_reason(rules: Mapping[str, Column], otherwise: str) -> Column:
    out = None
    for name, test in rules.items():
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


def entropy_report(counts: DataFrame, n: str, vocabulary: int) -> DataFrame:
    """occupied, top_share and normalised entropy of counts."""
    c = counts.where(F.col(n) > 0).agg(F.count("*").alias("occupied"), F.max(n).alias("top"), F.sum(n).alias("total"), F.sum(F.col(n) * F.ln(F.col(n).cast("double"))).alias("nl"))
    return c.select("occupied", (F.col("top") / F.col("total")).alias("top_share"), ((F.ln(F.col("total").cast("double")) - F.col("nl") / F.col("total")) / F.ln(F.lit(float(vocabulary)))).alias("entropy"))
