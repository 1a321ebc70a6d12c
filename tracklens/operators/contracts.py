"""Data contracts: rules whose violations are rows, and one-row reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(key, rule) for each row and rule that doesn't hold; a rule that is null doesn't hold. One scan for all rules."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*key, F.explode(broken).alias("rule"))


def check(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """df, unchanged, if no rule is broken; else ValueError with some broken ones."""
    bad = violations(df, key, rules).limit(5).collect()
    if bad:
        raise ValueError(f"contract broken: {', '.join(str(r.asDict()) for r in bad)}")
    return df


def uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, nulls, unique."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"))
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return g.agg(F.sum("n").alias("rows_"), F.count("*").alias("keys"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("nulls"), (F.max("n") == 1).alias("is_unique"))


def one_version(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, versions, consistent): whether all rows of a key agree on the fields."""
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*fields)).alias("versions")).withColumn("consistent", F.col("versions") == 1)


def complete(df: DataFrame, keys: Sequence[str], expected: Mapping[str, Column], least_rows: int) -> DataFrame:
    """(keys, rows_, complete): enough rows, and all expected equalities hold in each."""
    ok = F.lit(True)
    for test in expected.values():
        ok = ok & F.coalesce(test, F.lit(False))
    return df.groupBy(*keys).agg(F.count("*").alias("rows_"), (F.bool_and(ok) & (F.count("*") >= least_rows)).alias("complete"))


def replay_differences(a: DataFrame, b: DataFrame, key: Sequence[str], fields: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys where the two runs differ by more than the tolerance, or only one has a row."""
    j = a.select(*key, *[F.col(f).alias(f"{f}_a") for f in fields], F.lit(1).alias("_a")).join(b.select(*key, *[F.col(f).alias(f"{f}_b") for f in fields], F.lit(1).alias("_b")), list(key), "full_outer")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for f in fields:
        same = same & F.coalesce(F.abs(F.col(f"{f}_a") - F.col(f"{f}_b")) <= tolerance, F.col(f"{f}_a").isNull() & F.col(f"{f}_b").isNull())
    return j.where(~same).select(*key)


def hash_check(actual: DataFrame, expected: DataFrame, key: str, sha: str) -> DataFrame:
    """(key, state): same, changed, missing or unexpected."""
    j = actual.select(key, F.col(sha).alias("_a")).join(expected.select(key, F.col(sha).alias("_e")), key, "full_outer")
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_a") == F.col("_e"), "same").otherwise("changed")
    return j.select(key, state.alias("state"))


def disjoint_windows(a_start, a_end, b_start, b_end, margin: float) -> Column:
    return (F.col(a_end) + margin < F.col(b_start)) | (F.col(b_end) + margin < F.col(a_start))


def provenance(manifest: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state) of every key of either side: same, changed, missing (not there any more) or unlisted."""
    j = manifest.select(key, F.col(digest).alias("_m")).join(actual.select(key, F.col(digest).alias("_a")), key, "full_outer")
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_m").isNull(), "unlisted").when(F.col("_m") == F.col("_a"), "same").otherwise("changed")
    return j.select(key, state.alias("state"))
