"""Vector and trajectory operators: errors, nearest centroids, k-means steps, diversity, oriented boxes, visibility."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.functions.hashing import draw

from tracklens.functions.numbers import col, into_frame


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def steps(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, step, x, y): a flat vector read as x, y pairs."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(vector) / 2).cast("int") - 1), lambda i: F.struct(i.alias("step"), F.get(vector, 2 * i).cast("double").alias("x"), F.get(vector, 2 * i + 1).cast("double").alias("y")))
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.step", "_p.x", "_p.y")


def displacement(df: DataFrame, keys: Sequence[str], gap: Column, valid: Column, step: str, last: int) -> DataFrame:
    """ade over valid steps and fde at the last step, null where that isn't valid."""
    return df.groupBy(*keys).agg((F.sum(F.when(valid, gap)) / F.sum(F.when(valid, 1))).alias("ade"), F.max(F.when((F.col(step) == last) & valid, gap)).alias("fde"))


def best_of(df: DataFrame, keys: Sequence[str], value: str, candidate: str) -> DataFrame:
    """The first candidate with the smallest value of each key."""
    return df.groupBy(*keys).agg(F.min(F.struct(value, candidate)).alias("_b")).select(*keys, f"_b.{value}", f"_b.{candidate}")


def nearest_centroid(df: DataFrame, vector: str, centroids: DataFrame, most: int = 4096) -> DataFrame:
    """Adds token and d2: the first of the nearest centroids (token, c). A codebook has at most `most` rows; they travel as one array."""
    n = centroids.count()
    if n > most:
        raise ValueError(f"a codebook of {n} rows is larger than {most}")
    book = centroids.agg(F.sort_array(F.collect_list(F.struct("token", "c"))).alias("_book"))
    best = F.array_min(F.transform("_book", lambda k: F.struct(squared_distance(vector, k["c"]).alias("d2"), k["token"].alias("token"))))
    return df.join(F.broadcast(book)).withColumn("_b", best).select(*df.columns, "_b.token", "_b.d2")


def lloyd_step(df: DataFrame, vector: str, centroids: DataFrame) -> DataFrame:
    """(token, k, x, n): the mean of each component over the vectors nearest to a centroid; empty centroids keep their place."""
    got = nearest_centroid(df, vector, centroids).select("token", F.posexplode(vector).alias("k", "x")).groupBy("token", "k").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    old = centroids.select("token", F.posexplode("c").alias("k", "old"))
    return old.join(got, ["token", "k"], "left").select("token", "k", F.coalesce("x", F.col("old").cast("double")).alias("x"), F.coalesce("n", F.lit(0)).alias("n"))


def kmeans(df: DataFrame, vector: str, k: int, rounds: int, seed: str, key: str, balance: str | None = None, batch: int | None = None) -> DataFrame:
    """Centroids (token, c) by k-means++ and mini-batches; each round is cut to k rows.

    The first centroid is the row with the smallest hash. Each next one is drawn with a probability
    in proportion to the squared distance to the nearest centroid: the row with the smallest -ln(u) / d2
    wins, u from a hash, so a draw is one aggregate. A round moves every
    centroid towards the mean of the rows of its batch, by their share of all rows it has had; one without
    rows is set anew on the row of the batch that is farthest from its centroid. The batch of a
    round has the ``batch`` rows with the smallest hashes for each value of balance (all rows if batch is None).
    """
    more = [balance] if balance else []
    v = df.select(key, *more, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    spark = df.sparkSession
    book = lambda c: spark.createDataFrame(list(enumerate(c)), "token int, c array<double>")
    centroids = [r.v for r in v.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), key).limit(1).collect()]
    while centroids and len(centroids) < k:
        u = (draw(F.lit(1_000_000), seed, "init", str(len(centroids)), F.col(key)) + 0.5) / 1e6
        r = nearest_centroid(v, "v", book(centroids)).where("d2 > 0").withColumn("_e", -F.log(u) / F.col("d2")).agg(F.min_by("v", F.struct("_e", key)).alias("v")).first()
        if r.v is None:
            break  # fewer different rows than k
        centroids.append(r.v)
    had = [0] * len(centroids)
    for r in range(rounds if centroids else 0):
        part = v
        if batch is not None:
            order = F.sha2(F.concat_ws("|", F.lit(seed), F.lit(str(r)), F.col(key).cast("string")), 256)
            part = v.withColumn("_k", F.row_number().over(Window.partitionBy(*more or [F.lit(0)]).orderBy(order, key))).where(F.col("_k") <= batch).drop("_k")
        near = nearest_centroid(part, "v", book(centroids))
        sums = near.select("token", F.posexplode("v").alias("k", "x")).groupBy("token", "k").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
        got = {g.token: g for g in sums.groupBy("token").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("c"), F.max("n").alias("n")).collect()}  # at most k rows
        empty = [t for t in range(len(centroids)) if t not in got]
        far = [x.v for x in near.orderBy(F.desc("d2"), key).limit(len(empty)).collect()] if empty else []
        for t in range(len(centroids)):
            if t in got:
                had[t] += got[t].n
                share = got[t].n / had[t]
                centroids[t] = [a + share * (b - a) for a, b in zip(centroids[t], got[t].c, strict=True)]
        for t, x in zip(empty, far, strict=False):
            centroids[t], had[t] = x, 0
    return book(centroids)


def decode(df: DataFrame, keys: Sequence[str], order: str, dx: str, dy: str) -> DataFrame:
    """Positions from steps: running sums."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"x": F.sum(dx).over(w), "y": F.sum(dy).over(w)})


def pairs(df: DataFrame, group: str, key: str, columns: Sequence[str], block: int | None = None, most: int = 20_000) -> DataFrame:
    """Unordered pairs inside groups that a contract keeps small (candidates of a scene, heads of a model): (group, a, b, <c>_a, <c>_b).

    A group of more than ``most`` rows is an error when the rows are computed. block: groups are dealt into blocks of so
    many rows and every pair of blocks is joined on its own, so a few large groups are many tasks' work.
    """
    n = F.count("*").over(Window.partitionBy(group))
    d = df.withColumn("_n", n).where(F.when(F.col("_n") > most, F.raise_error(F.concat(F.lit(f"a group of more than {most} rows: "), F.col("_n").cast("string"))).cast("boolean")).otherwise(True))
    on = [group]
    if block is not None:
        blocks = F.ceil(F.col("_n") / block)
        d = d.withColumn("_own", F.pmod(F.xxhash64(key), blocks)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        d = d.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
        on += ["_i", "_j"]
    own = ["_own"] if block is not None else []
    side = lambda s: d.select(*on, *[F.col(c).alias(f"{c}{s}") for c in own], F.col(key).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    p = side("a").join(side("b"), on).where("a < b")
    if block is not None:
        p = p.where("_owna <> _ownb or _i = _j").drop("_i", "_j", "_owna", "_ownb")
    return p


def class_pairs(df: DataFrame, group: str, key: str, vector: str, block: int = 512) -> DataFrame:
    """(group, a, b, rms) of all unordered pairs a < b of a group: the root mean square of the differences of their vectors.

    Equal vectors are a class, and each two classes of a group are compared once. Pairs of members are joined without vectors, in pairs of blocks of about
    ``block`` rows, so a large group is many tasks' work; its rows are still the square of its size. Null groups pair with nothing.
    """
    d = df.where(F.col(group).isNotNull()).select(group, key, F.col(vector).alias("_v"))
    classes = d.groupBy(group, "_v").agg(F.xxhash64("_v").alias("_c"), F.min(key).alias("_least"), F.count("*").alias("_size"))
    named = classes.select(group, "_v", F.struct("_c", "_least").alias("_k"))
    side = lambda s: named.select(group, F.col("_k").alias(f"_k{s}"), F.col("_v").alias(f"_v{s}"))
    rms = F.sqrt(squared_distance("_va", "_vb") / F.size("_va"))
    gaps = side("a").join(side("b"), group).select(group, "_ka", "_kb", rms.alias("rms"))
    blocks = classes.groupBy(group).agg(F.ceil(F.sum("_size") / block).alias("_blocks"))
    named = named.select(F.col(group).alias("_g"), F.col("_v").alias("_w"), "_k")
    m = d.join(named, (F.col(group) == F.col("_g")) & (F.col("_v") == F.col("_w"))).select(group, key, "_k").join(blocks, group)
    m = m.withColumn("_own", F.pmod(F.xxhash64(key), "_blocks"))
    left = m.select(group, F.col(key).alias("a"), F.col("_k").alias("_ka"), F.col("_own").alias("_i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_j"))
    right = m.select(group, F.col(key).alias("b"), F.col("_k").alias("_kb"), F.col("_own").alias("_j"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_i"))
    tiles = left.join(right.hint("shuffle_hash"), [group, "_i", "_j"]).where("a < b")
    return tiles.join(gaps, [group, "_ka", "_kb"]).select(group, "a", "b", "rms")


def spread(df: DataFrame, group: str, key: str, vector: str, close: float, tile: int = 1024) -> DataFrame:
    """(group, diversity, pairs, close_pairs): the mean distance of all unordered pairs of a group and how many are nearer than close.

    Groups are dealt into blocks of about ``tile`` rows, and every pair of blocks is a task's matrix of distances, of which sums alone are
    told; no pair is a row, so groups may be large. Null vectors don't count; groups with fewer than two have no row.
    """
    d = df.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.transform(vector, lambda c: c.cast("double")).alias("v"))
    sizes = d.groupBy(F.col("g").alias("g0")).agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    d = d.join(sizes, F.col("g").eqNullSafe(F.col("g0"))).withColumn("own", F.pmod(F.xxhash64("k", "v"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "v")

    def sums(t: pa.Table) -> pa.Table:
        own, x = t.column("own").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        a, b = (x, x) if i == j else (x[own == i], x[own == j])
        total, pairs, near = 0.0, 0, 0
        for s in range(0, len(a), 16):  # 8 MB of differences of 64 components
            e = a[s : s + 16, None] - b[None]
            r = np.sqrt(np.einsum("ijk,ijk->ij", e, e))
            r = r[np.arange(s, min(len(a), s + 16))[:, None] < np.arange(len(b))[None]] if i == j else r.ravel()
            total, pairs, near = total + float(r.sum()), pairs + len(r), near + int((r < close).sum())
        return pa.table({"g": t.column("g")[:1], "total": [total], "pairs": [pairs], "near": [near]})

    kind = T.StructType([T.StructField("g", df.schema[group].dataType), *T.StructType.fromDDL("total double, pairs long, near long").fields])
    told = d.groupBy("g", "i", "j").applyInArrow(sums, kind).groupBy("g").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"), F.sum("near").alias("close_pairs"))
    return told.where("pairs > 0").select(F.col("g").alias(group), (F.col("total") / F.col("pairs")).alias("diversity"), "pairs", "close_pairs")


def clearance(cx, cy, c_yaw, c_len, c_wid, ox, oy, o_yaw, o_len, o_wid) -> Column:
    """Separation of two oriented boxes along their four axes; negative where they overlap."""
    dx, dy = col(ox) - col(cx), col(oy) - col(cy)
    out = []
    for yaw in (col(c_yaw), col(o_yaw)):
        for ux, uy in ((F.cos(yaw), F.sin(yaw)), (-F.sin(yaw), F.cos(yaw))):
            reach = F.lit(0.0)
            for y, length, width in ((col(c_yaw), col(c_len), col(c_wid)), (col(o_yaw), col(o_len), col(o_wid))):
                reach = reach + length / 2 * F.abs(F.cos(y) * ux + F.sin(y) * uy) + width / 2 * F.abs(F.cos(y) * uy - F.sin(y) * ux)
            out.append(F.abs(dx * ux + dy * uy) - reach)
    return F.greatest(*out)


def clearance_circle(cx, cy, yaw, length, width, ox, oy, radius) -> Column:
    """Separation of an oriented box and a circle: distance of the centre to the box less the radius; negative where they overlap."""
    u, v = into_frame(ox, oy, cx, cy, yaw)
    du, dv = F.abs(u) - col(length) / 2, F.abs(v) - col(width) / 2
    outside = F.hypot(F.greatest(du, F.lit(0.0)), F.greatest(dv, F.lit(0.0)))
    return outside + F.least(F.greatest(du, dv), F.lit(0.0)) - col(radius)


def blocks_view(x1, y1, x2, y2, bx, by, length, width, inflate: float = 0.0, closed: bool = True) -> Column:
    """Whether an axis-aligned box around (bx, by) meets the segment from 1 to 2: the slab test."""
    t_low, t_high, parallel_out = [], [], F.lit(False)
    for a, b, c, size in ((x1, x2, bx, length), (y1, y2, by, width)):
        d, half = col(b) - col(a), col(size) / 2 + inflate
        lo, hi = (col(c) - half - col(a)) / F.nullif(d, F.lit(0.0)), (col(c) + half - col(a)) / F.nullif(d, F.lit(0.0))
        t_low.append(F.coalesce(F.least(lo, hi), F.lit(float("-inf"))))
        t_high.append(F.coalesce(F.greatest(lo, hi), F.lit(float("inf"))))
        parallel_out = parallel_out | ((d == 0) & (F.abs(col(a) - col(c)) > half))
    enter, leave = F.greatest(F.lit(0.0), *t_low), F.least(F.lit(1.0), *t_high)
    return ~parallel_out & ((enter <= leave) if closed else (enter < leave))


def resample(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """(keys, point, x, y): n points evenly spaced along each polyline, linear between its points."""
    w = Window.partitionBy(*keys).orderBy(order)
    gap = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)), F.lit(0.0))
    d = df.withColumn("_g", gap).withColumn("_s", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumns({"_s2": F.lead("_s").over(w), "_x2": F.lead("x").over(w), "_y2": F.lead("y").over(w), "_all": F.max("_s").over(Window.partitionBy(*keys))})
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("k"), (k * F.col("_all") / (n - 1)).alias("t")))
    here = F.filter(at, lambda p: (p["t"] >= F.col("_s")) & ((p["t"] < F.col("_s2")) | (F.col("_s2").isNull() & (p["t"] >= F.col("_s")))))
    d = d.withColumn("_p", F.explode(here))
    f = F.coalesce((F.col("_p.t") - F.col("_s")) / F.nullif(F.col("_s2") - F.col("_s"), F.lit(0.0)), F.lit(0.0))
    return d.select(*keys, F.col("_p.k").alias("point"), (F.col("x") + f * (F.coalesce("_x2", "x") - F.col("x"))).alias("x"), (F.col("y") + f * (F.coalesce("_y2", "y") - F.col("y"))).alias("y"))
