"""Corpora with quotas by group, from no more files than they need, and corpora of padded sequences of solved conditions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.lineage import cut


def quotas(groups: int, budget: int, shares: dict[str, tuple[int, int]]) -> dict[str, int]:
    """The most examples of each kind in a group: its share of an equal part of the budget, at least 1."""
    each = max(1, budget // max(groups, 1))
    return {kind: max(1, each * num // den) for kind, (num, den) in shares.items()}


def quota_corpus(files: DataFrame, read: Callable[[list[str]], DataFrame], budget: int, shares: dict[str, tuple[int, int]], first: int = 1) -> tuple[DataFrame, DataFrame]:
    """(examples, files that were read): of each group and kind the first distinct examples up to its quota, in order of (ord, place).

    files are (file, grp, ord); read gives the examples (ord, grp, kind, place, key, ...) of some files, of which only kinds in shares count; of
    examples of a group and kind with equal keys the first counts. Files are read in rounds: those next in order of every group with a quota that
    isn't full, ``first`` of each in the first round and twice as many in each round after. A group whose quotas are full is read no
    further, so the examples are those that reading all files would give. The names of a round's files go through the driver,
    as those of any scan; examples don't.
    """
    spark = files.sparkSession
    todo = cut(files.select("file", "grp", "ord", F.row_number().over(Window.partitionBy("grp").orderBy("ord", "file")).alias("_n")))
    caps = quotas(todo.select("grp").distinct().count(), budget, shares)
    cap = F.create_map(*[x for k, n in caps.items() for x in (F.lit(k), F.lit(n))])[F.col("kind")]
    taken, seen, upto, step = None, None, 0, first
    wanted = todo
    while True:
        now = cut(wanted.where((F.col("_n") > upto) & (F.col("_n") <= upto + step)).select("file", "grp", "ord"))
        names = [r.file for r in now.select("file").distinct().orderBy("file").collect()]
        if not names:
            break
        seen = now if seen is None else seen.unionByName(now)
        got = read(names).where(F.col("kind").isin(*caps))
        every = got if taken is None else taken.unionByName(got)
        once = every.withColumn("_k", F.row_number().over(Window.partitionBy("grp", "kind", "key").orderBy("ord", "place"))).where("_k = 1").drop("_k")
        place = F.row_number().over(Window.partitionBy("grp", "kind").orderBy("ord", "place"))
        taken = cut(once.withColumn("_k", place).withColumn("_cap", cap).where(F.col("_k") <= F.col("_cap")).drop("_k", "_cap"))
        full = taken.groupBy("grp", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= cap).groupBy("grp").agg(F.count("*").alias("kinds")).where(F.col("kinds") == len(caps))
        wanted, upto, step = todo.join(full.select("grp"), "grp", "left_anti"), upto + step, step * 2
    if taken is None:
        raise ValueError("no files to read")
    return taken, seen


def sequence_corpus(solutions: DataFrame, train: DataFrame, dev: DataFrame, keys: Sequence[str], fingerprint: str, eligible: Column, sequence: str, index: str) -> DataFrame:
    """(keys, split, steps, target, mask): sequences of eligible solutions of training conditions, padded to the longest with zeros.

    Every fifth condition by index validates. ValueError if a fingerprint is in both condition sets, a key repeats among training
    conditions, an eligible solution has no training condition, or no solution is eligible.
    """
    leak = train.select(fingerprint).intersect(dev.select(fingerprint)).count()
    if leak:
        raise ValueError(f"{leak} conditions are in both sets")
    if not train.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("a training condition's key repeats")
    good = cut(solutions.where(eligible).select(*keys, index, F.col(sequence).alias("_s")))
    lost = good.join(train, list(keys), "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no training condition for {[lost[0][k] for k in keys]}")
    longest = good.agg(F.max(F.size("_s"))).first()[0]
    if longest is None:
        raise ValueError("no eligible solution")
    pad = F.lit(longest) - F.size("_s")
    split = F.when(F.col(index) % 5 == 0, "val").otherwise("train")
    return good.select(*keys, split.alias("split"), F.size("_s").alias("steps"), F.concat(F.transform("_s", lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), pad)).alias("target"), F.concat(F.array_repeat(F.lit(True), F.size("_s")), F.array_repeat(F.lit(False), pad)).alias("mask"))
