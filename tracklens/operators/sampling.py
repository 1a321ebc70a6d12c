"""Deterministic splits, samples, quotas and deduplication. None of them collects; order by hash replaces random state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.hashing import draw, salted_order
from tracklens.operators.order import ranked


def dedup_by_content(df: DataFrame, content: Column, order: Sequence[str], name: str) -> DataFrame:
    """Adds sha and duplicate_of: null for the first row of a content, else the first row's name."""
    df = df.withColumn("sha", F.sha2(content, 256))
    w = Window.partitionBy("sha").orderBy(*order)
    first = F.first(name).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("duplicate_of", F.when(F.row_number().over(w) > 1, first))


def quota(df: DataFrame, group: Sequence[str], cap: Column | int, salt: str, key: str) -> DataFrame:
    """At most cap rows a group, those with the smallest salted hashes: a bounded reservoir that any engine can repeat."""
    w = Window.partitionBy(*group).orderBy(salted_order(salt, key), key)
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= cap)


def scale_ladder(df: DataFrame, salt: str, key: str, steps: Sequence[int], broadcast_rows: int = 1_000_000) -> DataFrame:
    """Adds rung: the smallest step whose nested sample holds the row, or null.

    A top-k: each task keeps its max(steps) smallest hashes, and only those that
    remain of all are ranked. key is unique.
    """
    most = max(steps)
    top = df.select(key, salted_order(salt, key).alias("_o")).orderBy("_o", key).limit(most)
    rank = F.row_number().over(Window.orderBy("_o", key))  # of at most max(steps) rows
    rung = F.coalesce(*[F.when(rank <= n, F.lit(n)) for n in sorted(steps)])
    top = top.select(F.col(key).alias("_key"), rung.alias("rung"))
    return df.join(F.broadcast(top) if most <= broadcast_rows else top, F.col(key) == F.col("_key"), "left").drop("_key")


def evenly(df: DataFrame, group: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """limit rows a group, evenly spaced in order (positions rounded half to even, repeats once). Groups may be hot; df should be narrow."""
    d = ranked(df, group, order, "_i")
    sizes = df.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg((F.count("*") - 1).alias("_last"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda k: F.bround(k * F.col("_last") / F.lit(max(limit - 1, 1))).cast("bigint"))
    sizes = sizes.withColumn("_step", F.explode(F.when(F.col("_last") < limit, F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).otherwise(F.array_distinct(steps))))
    same = F.col("_i") - 1 == F.col("_step")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return d.join(sizes, same).select(df.columns)


def round_robin(df: DataFrame, group: str, order: Sequence[str], k: int) -> DataFrame:
    """k rows, one of each group in turn; a top-k, so only k rows a task move."""
    df = df.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return df.where(F.col("round") <= k).orderBy("round", group).limit(k)


def leaking(df: DataFrame, group: Sequence[str], split: str) -> DataFrame:
    """Groups that are in more than one split."""
    return df.groupBy(*group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def quarantine(df: DataFrame, group: Sequence[str], split: str) -> DataFrame:
    return df.join(leaking(df, group, split), list(group), "left_anti")


def batches(df: DataFrame, source: str, key: str, seed: int, size: int) -> DataFrame:
    """Adds place and batch of each row in its source's shuffled stream for one pass."""
    d = ranked(df.withColumn("_h", salted_order(str(seed), key)), [source], ["_h", key], "place").drop("_h")
    return d.withColumn("place", F.col("place") - 1).withColumn("batch", F.floor(F.col("place") / size))


def folds(key: Column, k: int, salt: str = "fold") -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(k))


def stream(df: DataFrame, source: str, key: str, seed: int, passes: int, size: int, buckets: int = 64) -> DataFrame:
    """Every row of every pass over its source: pass, place (over all passes) and batch.

    A pass has an order of its own, by a hash of (seed, pass, key). Places are ranks over hash buckets, so no
    task sorts a whole source. A stream is resumed by ``place >= state``; exposure() counts what was shown.
    """
    d = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    h = salted_order(str(seed), F.concat_ws("|", F.col("pass").cast("string"), F.col(key).cast("string")))
    d = d.withColumn("_h", h).withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("bigint") * buckets / 65536))
    sizes = d.groupBy(source, "pass", "_b").agg(F.count("*").alias("_n"))
    before = sizes.select(source, "pass", "_b", (F.sum("_n").over(Window.partitionBy(source).orderBy("pass", "_b")) - F.col("_n")).alias("_before"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(source, "pass", "_b").orderBy("_h", key)) - 1)
    d = d.join(before, [source, "pass", "_b"]).withColumn("place", F.col("_r") + F.col("_before"))
    return d.withColumn("batch", F.floor(F.col("place") / size)).drop("_h", "_b", "_n", "_before", "_r")


def exposure(shown: DataFrame, source: str, key: str) -> DataFrame:
    """(source, shown, distinct, most): rows shown, different ones, and how often the most frequent one was."""
    return shown.groupBy(source, key).agg(F.count("*").alias("_n")).groupBy(source).agg(F.sum("_n").alias("shown"), F.count("*").alias("distinct_"), F.max("_n").alias("most"))


def row_pointers(df: DataFrame, order: Sequence[str], rows: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds shard and row: where a sample would stand if shards of at most ``rows`` samples were filled in order. Pointers of files that are
    written come from sources.units.pointers."""
    return ranked(df, by, order, "_p").withColumn("_p", F.col("_p") - 1).withColumns({"shard": F.floor(F.col("_p") / rows), "row": F.col("_p") % rows}).drop("_p")


def scenarios(conditions: DataFrame, key: str, seed: str, most_tries: int = 8) -> DataFrame:
    """(key, speed, gap, delay, limit): parameters of every condition by hashed draws; those that no braking can save are drawn anew.

    Try k of a condition depends on (seed, key, k); the first that fits is taken, else the last.
    """
    u = lambda name: draw(F.lit(1_000_000), seed, name, F.col(key), F.col("_k")) / 1e6
    t = conditions.select(key, F.explode(F.sequence(F.lit(0), F.lit(most_tries - 1))).alias("_k"))
    t = t.select(key, "_k", (5 + 15 * u("speed")).alias("speed"), (10 + 50 * u("gap")).alias("gap"), (0.1 + 0.4 * u("delay")).alias("delay"), (3 + 6 * u("limit")).alias("limit"))
    fits = F.col("speed") * F.col("delay") + F.col("speed") * F.col("speed") / (2 * F.col("limit")) < F.col("gap")
    return t.groupBy(key).agg(F.max_by(F.struct("speed", "gap", "delay", "limit"), F.when(fits, 1000 - F.col("_k")).otherwise(F.col("_k"))).alias("_s")).select(key, "_s.*")
