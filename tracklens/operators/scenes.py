"""Scene assembly: neighbours, anchors, map features, lanes and masked histories as joins and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.numbers import into_frame, norm, out_of_frame
from tracklens.operators.vectors import nearest_centroid


def others(states: DataFrame, scene: str, track: str, columns: Sequence[str]) -> DataFrame:
    """Each row of a scene beside the other tracks of the scene: columns, and other_<column>."""
    o = states.select(F.col(scene).alias("_s"), F.col(track).alias("other"), *[F.col(c).alias(f"other_{c}") for c in columns])
    return states.join(o, (F.col(scene) == F.col("_s")) & (F.col(track) != F.col("other"))).drop("_s")


def distance() -> Column:
    return norm(F.col("other_x") - F.col("x"), F.col("other_y") - F.col("y"))


def closing_speed() -> Column:
    """Speed at which the other comes nearer; positive while closing in."""
    dx, dy = F.col("other_x") - F.col("x"), F.col("other_y") - F.col("y")
    return -(dx * (F.col("other_vx") - F.col("vx")) + dy * (F.col("other_vy") - F.col("vy"))) / F.nullif(distance(), F.lit(0.0))


def selected(pairs: DataFrame, scene: str, anchor: str, required: Column, k: int) -> DataFrame:
    """The k others of each anchor: required first, then near, then closing in fast, then by id; adds slot."""
    w = Window.partitionBy(scene, anchor).orderBy(F.when(required, 0).otherwise(1), F.round(distance(), 9), F.desc(F.round(closing_speed(), 9)), "other")
    return pairs.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= k)


def anchors(pairs: DataFrame, scene: str, track: str, kind: Column, k: int) -> DataFrame:
    """(scene, track, rank): tracks by the nearest other of a kind, then by the nearest of the rest; k a scene."""
    far = F.lit(float("inf"))
    g = pairs.groupBy(scene, track).agg(F.coalesce(F.min(F.when(kind, distance())), far).alias("near"), F.coalesce(F.min(F.when(~kind, distance())), far).alias("rest"))
    w = Window.partitionBy(scene).orderBy("near", "rest", track)
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(scene, track, "rank")


def near_features(anchor: DataFrame, points: DataFrame, scene: str, feature: str, kind: str, radius: float, k: int) -> DataFrame:
    """(scene, feature, kind, nearest, slot): map features within a radius of the scene's anchor, the k nearest."""
    p = points.select(F.col(scene).alias("_s"), feature, kind, F.col("x").alias("other_x"), F.col("y").alias("other_y"))
    d = anchor.join(p, F.col(scene) == F.col("_s")).groupBy(scene, feature, kind).agg(F.round(F.min(distance()), 9).alias("nearest")).where(F.col("nearest") <= radius)
    w = Window.partitionBy(scene).orderBy("nearest", kind, feature)
    return d.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= k)


def local_states(states: DataFrame, anchor: DataFrame, scene: str) -> DataFrame:
    """states with u, v, turned into the frame of the scene's anchor (scene, ax, ay, yaw)."""
    j = states.join(anchor.select(F.col(scene).alias("_s"), "ax", "ay", "yaw"), F.col(scene) == F.col("_s")).drop("_s")
    u, v = into_frame("x", "y", "ax", "ay", "yaw")
    return j.withColumns({"u": u, "v": v})


def masked_history(history: DataFrame, visible: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """History in which what isn't visible is 0, and seen tells which it was."""
    j = history.join(visible.select(*keys, F.lit(True).alias("seen")).distinct(), list(keys), "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return j.withColumns({c: F.when(F.col("seen"), F.col(c)).otherwise(F.lit(0.0)) for c in values})


def lanes(map_tables: dict[str, DataFrame]) -> DataFrame:
    """(relation, side, ord, lat, lon): left and right borders of lane relations as points; a right border that runs against the left is turned round."""
    border = map_tables["member"].where("role in ('left', 'right')").select("relation", F.col("role").alias("side"), F.col("ref").alias("way"))
    p = border.join(map_tables["way_node"], "way").join(map_tables["node"], F.col("node") == F.col("id")).select("relation", "side", "ord", "lat", "lon")
    end = lambda s, f: f(F.when(F.col("side") == s, F.struct("lat", "lon")), F.when(F.col("side") == s, F.col("ord")))
    e = p.groupBy("relation").agg(end("left", F.min_by).alias("l0"), end("left", F.max_by).alias("l1"), end("right", F.min_by).alias("r0"), end("right", F.max_by).alias("r1"), F.max(F.when(F.col("side") == "right", F.col("ord"))).alias("last"))
    gap = lambda a, b: norm(F.col(f"{a}.lat") - F.col(f"{b}.lat"), F.col(f"{a}.lon") - F.col(f"{b}.lon"))
    flip = gap("l0", "r1") + gap("l1", "r0") < gap("l0", "r0") + gap("l1", "r1")
    j = p.join(e.select("relation", flip.alias("flip"), "last"), "relation")
    return j.select("relation", "side", F.when((F.col("side") == "right") & F.col("flip"), F.col("last") - F.col("ord")).otherwise(F.col("ord")).alias("ord"), "lat", "lon")


def curvature(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Direction of each step along a polyline and its turn per length, from unwrapped directions."""
    w = Window.partitionBy(*keys).orderBy(order)
    dx, dy = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    d = df.withColumns({"direction": F.atan2(dy, dx), "length": F.sqrt(dx * dx + dy * dy)})
    turn = F.col("direction") - F.lag("direction").over(w)
    turn = turn - 2 * 3.141592653589793 * F.bround(turn / (2 * 3.141592653589793))
    return d.withColumn("curvature", turn / F.nullif((F.col("length") + F.lag("length").over(w)) / 2, F.lit(0.0)))


def pulse(df: DataFrame, start: str, width: str, height: str, steps: int, dt: float) -> DataFrame:
    """The action of a pulse at each step: height from start for width seconds, else 0. Times are step * dt, so edges don't drift."""
    s = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    t = F.col("step") * dt
    return s.withColumn("action", F.when((t >= F.col(start) - 1e-9) & (t < F.col(start) + F.col(width) - 1e-9), F.col(height)).otherwise(F.lit(0.0)))


def conversion_audit(samples: DataFrame, book: DataFrame, group: str, split: str, vector: str, yaw: str, tolerance: float = 1e-9) -> DataFrame:
    """(group, samples, round_trip, splits, leaks, token, share): what a conversion to anchor frames must keep, from one pass over the samples.

    The points of a sample (x, y pairs of the flat vector) go into the frame at its first point turned by yaw and back; round_trip tells
    whether all of a group come back within the tolerance. A group in more than one split leaks. Samples are labelled with the nearest
    centroid of book (token, c); token is the most frequent of a group (the smallest on ties) and share its part of the group.
    """
    at = lambda i: F.get(vector, i).cast("double")

    def back(i: Column) -> Column:
        x, y = at(2 * i), at(2 * i + 1)
        u, w = into_frame(x, y, at(F.lit(0)), at(F.lit(1)), yaw)
        bx, by = out_of_frame(u, w, at(F.lit(0)), at(F.lit(1)), yaw)
        return F.greatest(F.abs(bx - x), F.abs(by - y))

    worst = F.array_max(F.transform(F.sequence(F.lit(0), F.floor(F.size(vector) / 2).cast("int") - 1), back))
    s = nearest_centroid(samples.withColumn("_worst", worst), vector, book)
    by = s.groupBy(group, "token").agg(F.count("*").alias("_n"), F.max("_worst").alias("_worst"), F.collect_set(split).alias("_splits"))  # a set of split names
    out = by.groupBy(group).agg(F.sum("_n").alias("samples"), (F.max("_worst") <= tolerance).alias("round_trip"), F.size(F.array_distinct(F.flatten(F.collect_list("_splits")))).alias("splits"), F.min(F.struct((-F.col("_n")).alias("n"), "token")).alias("_m"))
    return out.select(group, "samples", "round_trip", "splits", (F.col("splits") > 1).alias("leaks"), F.col("_m.token").alias("token"), (-F.col("_m.n") / F.col("samples")).alias("share"))
