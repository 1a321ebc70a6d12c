"""Resampling and rank statistics that any engine can repeat.

Resampling draws indexes by hashing (seed, round, draw), so results do not
depend on partitioning and confidence intervals can be checked elsewhere. Data are first
reduced to clusters; only clusters are fanned out by rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.hashing import draw
from tracklens.operators.order import ranked


def _interval(rounds: DataFrame, keys: Sequence[str], x: Column) -> list[Column]:
    return [F.percentile(x, 0.025).alias("low"), F.percentile(x, 0.975).alias("high")]


def cluster_bootstrap(clusters: DataFrame, keys: Sequence[str], cluster: str, num: str, den: str, rounds: int, seed: str) -> DataFrame:
    """Point and 95 % interval of sum(num) / sum(den), resampling clusters; (keys, point, low, high, clusters).

    clusters has one row a cluster. Each round draws as many clusters as there are, by rank.
    """
    w = Window.partitionBy(*keys)
    c = clusters.withColumn("_i", F.row_number().over(w.orderBy(cluster)) - 1).withColumn("_n", F.count("*").over(w))
    fan = c.select(*keys, "_n", F.col("_i").alias("_slot"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    fan = fan.withColumn("_i", draw("_n", seed, F.col("round"), F.col("_slot"))).groupBy(*keys, "round", "_i").agg(F.count("*").alias("_m"))
    per = fan.join(c.select(*keys, "_i", num, den), [*keys, "_i"]).groupBy(*keys, "round").agg((F.sum(F.col("_m") * F.col(num)) / F.sum(F.col("_m") * F.col(den))).alias("_x"))
    ci = per.groupBy(*keys).agg(*_interval(per, keys, F.col("_x")))
    point = clusters.groupBy(*keys).agg((F.sum(num) / F.sum(den)).alias("point"), F.count("*").alias("clusters"))
    return point.join(ci, list(keys)) if keys else point.join(ci)


def two_way_bootstrap(cells: DataFrame, a: str, b: str, x: str, rounds: int, seed: str) -> DataFrame:
    """Point and interval of the mean of x over a complete a-by-b grid, resampling both sides: (point, low, high).

    Clusters of a side are numbered by ranked(), so no task sees all of them.
    """
    out = cells
    for side in (a, b):
        u = ranked(cells.select(side).distinct(), [], [side], "_i").withColumn("_i", F.col("_i") - 1)
        u = u.join(F.broadcast(u.agg(F.count("*").alias("_n"))))
        fan = u.select("_n", F.col("_i").alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
        fan = fan.withColumn("_i", draw("_n", f"{seed}{side}", F.col("round"), F.col("_s"))).groupBy("round", "_i").agg(F.count("*").alias(f"_w_{side}"))
        fan = fan.join(u.select(side, "_i"), "_i").drop("_i")
        out = out.join(fan, [side] if "round" not in out.columns else [side, "round"])
    weight = F.col(f"_w_{a}") * F.col(f"_w_{b}")
    per = out.groupBy("round").agg((F.sum(weight * F.col(x)) / F.sum(weight)).alias("_x"))
    return cells.agg(F.avg(x).alias("point")).join(per.agg(*_interval(per, [], F.col("_x"))))


def permutation_test(pairs: DataFrame, key: str, x: str, y: str, rounds: int, seed: str) -> DataFrame:
    """observed = mean of x * y, p = (1 + rounds at least as large) / (rounds + 1), y permuted by order of hash.

    Places come from ranked(), so no task sorts all rows of a round.
    """
    base = ranked(pairs.select(key, x, y), [], [key], "_i")
    fan = base.select(F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"), "_i", x, y)
    fan = fan.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), "round", "_i")))
    fan = ranked(fan, ["round"], ["_h", "_i"], "_j")
    per = fan.select("round", "_i", x).join(fan.select("round", F.col("_j").alias("_i"), y), ["round", "_i"]).groupBy("round").agg(F.avg(F.col(x) * F.col(y)).alias("_s"))
    seen = pairs.agg(F.avg(F.col(x) * F.col(y)).alias("observed"))
    return seen.join(per).groupBy("observed").agg(((1 + F.count_if(F.col("_s") >= F.col("observed") - 1e-12)) / (F.count("*") + 1)).alias("p"))


def auc(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks, from counts by distinct score: (keys, auc, positives, negatives)."""
    c = df.groupBy(*keys, score).agg(F.sum(F.col(label).cast("bigint")).alias("_p"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(score)
    before = F.sum("_n").over(w) - F.col("_n")
    c = c.withColumn("_r", F.col("_p") * (before + (F.col("_n") + 1) / 2))
    g = c.groupBy(*keys).agg(F.sum("_r").alias("_r"), F.sum("_p").alias("positives"), (F.sum("_n") - F.sum("_p")).alias("negatives"))
    return g.withColumn("auc", (F.col("_r") - F.col("positives") * (F.col("positives") + 1) / 2) / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0))).drop("_r")


def balanced(label: Column, guess: Column) -> dict[str, Column]:
    sens, spec = F.avg(F.when(label, guess.cast("int"))), F.avg(F.when(~label, (~guess).cast("int")))
    return {"sensitivity": sens, "specificity": spec, "balanced_accuracy": (sens + spec) / 2}


def best_threshold(df: DataFrame, keys: Sequence[str], label: str, x: str) -> DataFrame:
    """(keys, threshold, above, score): the midpoint of neighbouring values and side with the best balanced accuracy.

    Prefix sums over distinct values, no pairs of rows. Ties: nearest to the median value, then the lower threshold, then above.
    """
    return _threshold(df.groupBy(*keys, x).agg(F.sum(F.col(label).cast("bigint")).alias("_p"), F.count("*").alias("_n")), keys, x)


def _threshold(v: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """best_threshold from (keys, x, _p, _n): positives and rows of each distinct value."""
    med = v.groupBy(*keys).agg(F.percentile(x, 0.5, F.col("_n")).alias("_med"))
    w, all_ = Window.partitionBy(*keys).orderBy(x), Window.partitionBy(*keys)
    v = v.withColumns({"_P": F.sum("_p").over(all_), "_N": F.sum("_n").over(all_), "_mid": (F.col(x) + F.lead(x).over(w)) / 2, "_lp": F.sum("_p").over(w), "_ln": F.sum("_n").over(w)})
    v = v.where("_mid is not null and _P > 0 and _P < _N")
    v = v.join(med, list(keys)) if keys else v.join(med)
    low = (F.col("_lp") / F.col("_P") + (F.col("_N") - F.col("_P") - (F.col("_ln") - F.col("_lp"))) / (F.col("_N") - F.col("_P"))) / 2
    both = v.withColumn("_o", F.explode(F.array(F.struct((1 - low).alias("score"), F.lit(True).alias("above")), F.struct(low.alias("score"), F.lit(False).alias("above")))))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("_o.score", 9)), F.round(F.abs(F.col("_mid") - F.col("_med")), 9), "_mid", F.desc("_o.above"))
    return both.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*keys, F.col("_mid").alias("threshold"), "_o.above", "_o.score")


def leave_one_group_out(df: DataFrame, group: str, label: str, x: str, most: int = 1000) -> DataFrame:
    """(group, rows, right): each group judged by the threshold fitted on the others.

    A fold's training rows are all rows less its own, so folds come from counts by distinct value: those of all
    rows, for each fold, less the group's. There are at most ``most`` groups, else ValueError; groups may be hot.
    """
    own = df.groupBy(group, x).agg(F.sum(F.col(label).cast("bigint")).alias("_gp"), F.count("*").alias("_gn"))
    folds = df.agg(F.sort_array(F.collect_set(group)).alias("f")).first().f
    if len(folds) > most:
        raise ValueError(f"{len(folds)} groups are more than {most}")
    total = own.groupBy(x).agg(F.sum("_gp").alias("_tp"), F.sum("_gn").alias("_tn")).withColumn("fold", F.explode(F.lit(folds) if folds else F.array().cast("array<string>")))
    total = total.join(own.select(F.col(group).alias("_g"), F.col(x).alias("_x"), "_gp", "_gn"), (F.col("fold") == F.col("_g")) & (F.col(x) == F.col("_x")), "left")
    rest = total.select("fold", x, (F.col("_tp") - F.coalesce("_gp", F.lit(0))).alias("_p"), (F.col("_tn") - F.coalesce("_gn", F.lit(0))).alias("_n")).where("_n > 0")
    j = df.join(F.broadcast(_threshold(rest, ["fold"], x)), F.col(group) == F.col("fold"))  # a row for each fold
    guess = F.when(F.col("above"), F.col(x) > F.col("threshold")).otherwise(F.col(x) <= F.col("threshold"))
    return j.groupBy(group).agg(F.count("*").alias("rows"), F.count_if(guess == (F.col(label) == 1)).alias("right"))


def variance_parts(df: DataFrame, group: str, x: str) -> DataFrame:
    """within, between and icc of x by group."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.sum(F.col(x) * F.col(x)).alias("q"))
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    t = g.agg(F.sum(F.col("q") - F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("mm"), grand.alias("gm"))
    within, between = F.col("ss") / F.col("n"), F.col("mm") / F.col("n") - F.col("gm") * F.col("gm")
    return t.select(within.alias("within"), between.alias("between"), (between / (within + between)).alias("icc"))


def variance_variants(df: DataFrame, group: str, x: str) -> DataFrame:
    """within and between with every group of equal weight, and their roots (spread inside a group, of the groups' means)."""
    g = df.groupBy(group).agg(F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    return g.agg(F.avg("v").alias("within"), F.var_pop("m").alias("between"), F.sqrt(F.avg("v")).alias("rms_within"), F.stddev_pop("m").alias("rms_between"))


def ridge(df: DataFrame, features: Sequence[str], target: str, alpha: float) -> dict[str, float]:
    """Weights and intercept of ridge regression: the Gram matrix is one aggregate, the small system is solved on the driver."""
    import numpy as np

    xs = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    row = df.agg(*[F.sum(xs[i] * xs[j]) for i, j in pairs], *[F.sum(x * F.col(target)) for x in xs]).first()
    g, v = np.zeros((len(xs),) * 2), np.array(row[len(pairs) :], float)
    for (i, j), value in zip(pairs, row, strict=False):
        g[i, j] = g[j, i] = value
    w = np.linalg.solve(g + alpha * np.diag([0.0, *[1.0] * len(features)]), v)
    return dict(zip(["intercept", *features], w.tolist(), strict=True))


def ridge_alpha(train: DataFrame, valid: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float]) -> tuple[float, dict[str, float]]:
    """The alpha with the smallest mean squared error on valid, and its weights."""
    fits = {a: ridge(train, features, target, a) for a in alphas}
    line = lambda w: F.lit(w["intercept"]) + sum((F.col(f) * F.lit(w[f]) for f in features), F.lit(0.0))
    errors = valid.agg(*[F.avg((F.col(target) - line(w)) ** 2) for w in fits.values()]).first()
    best = min(zip(errors, fits, strict=True))[1]
    return best, fits[best]
