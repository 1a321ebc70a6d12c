"""Scenes, models and gates on the driver tables: ten vectors are a scene, their components states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklens.operators import feasible, models
from tracklens.operators import inference as x
from tracklens.operators import scenes as sc
from tracklens.operators import vectors as v
from tracklens.plans.base import Book, table

BOOK = Book()
_S = "WITH s AS (SELECT vec_id, label, vec_id // 10 AS scene, embedding[1]::DOUBLE * 40 AS x, embedding[2]::DOUBLE * 40 AS y, embedding[3]::DOUBLE * 5 AS vx, embedding[4]::DOUBLE * 5 AS vy FROM embeddings), p AS (SELECT a.scene, a.vec_id, b.vec_id AS other, b.label AS olabel, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d, -((b.x - a.x) * (b.vx - a.vx) + (b.y - a.y) * (b.vy - a.vy)) / nullif(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 0) AS c FROM s a JOIN s b ON a.scene = b.scene AND a.vec_id <> b.vec_id) "
_P = "WITH s AS (SELECT vec_id, k AS step, embedding[2 * k + 1]::DOUBLE AS x, embedding[2 * k + 2]::DOUBLE AS y FROM embeddings, range(32) t(k)) "


def states(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 10).alias("scene"), *[(F.get(e, i).cast("double") * k).alias(n) for i, (n, k) in enumerate((("x", 40), ("y", 40), ("vx", 5), ("vy", 5)))])


def pairs(spark, d):
    return sc.others(states(spark, d), "scene", "vec_id", ["x", "y", "vx", "vy", "label"])


@BOOK.add(_S + "SELECT scene, vec_id, other, row_number() OVER (PARTITION BY scene, vec_id ORDER BY CASE WHEN olabel = 0 THEN 0 ELSE 1 END, round(d, 9), round(c, 9) DESC, other) AS slot FROM p QUALIFY slot <= 4")
def q_agent_slots(spark, d):
    return sc.selected(pairs(spark, d), "scene", "vec_id", F.col("other_label") == 0, 4).select("scene", "vec_id", "other", F.col("slot").cast("bigint").alias("slot"))


@BOOK.add(_S + ", g AS (SELECT scene, vec_id, coalesce(min(CASE WHEN olabel = 1 THEN d END), 'inf'::DOUBLE) AS near, coalesce(min(CASE WHEN olabel <> 1 THEN d END), 'inf'::DOUBLE) AS rest FROM p GROUP BY ALL) SELECT scene, vec_id, row_number() OVER (PARTITION BY scene ORDER BY near, rest, vec_id) AS rank FROM g QUALIFY rank <= 3")
def q_anchor_rank(spark, d):
    a = sc.anchors(pairs(spark, d), "scene", "vec_id", F.col("other_label") == 1, 3)
    return a.select("scene", "vec_id", F.col("rank").cast("bigint").alias("rank"))


@BOOK.add(_S + ", a AS (SELECT scene, arg_min(x, vec_id) AS ax, arg_min(y, vec_id) AS ay FROM s GROUP BY scene), f AS (SELECT s.scene, s.label, round(min(sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay))), 9) AS nearest FROM s JOIN a USING (scene) GROUP BY ALL) SELECT scene, label AS feature, round(nearest, 6) AS nearest, row_number() OVER (PARTITION BY scene ORDER BY nearest, label) AS slot FROM f WHERE nearest <= 9 QUALIFY slot <= 3")
def q_map_features(spark, d):
    s = states(spark, d)
    anchor = s.groupBy("scene").agg(F.min_by("x", "vec_id").alias("x"), F.min_by("y", "vec_id").alias("y"))
    f = sc.near_features(anchor, s.withColumn("kind", F.lit("k")), "scene", "label", "kind", 9.0, 3)
    return f.select("scene", F.col("label").alias("feature"), F.round("nearest", 6).alias("nearest"), F.col("slot").cast("bigint").alias("slot"))


@BOOK.add(_S + ", a AS (SELECT scene, arg_min(x, vec_id) AS ax, arg_min(y, vec_id) AS ay, arg_min(atan2(vy, vx), vec_id) AS yaw FROM s GROUP BY scene) SELECT s.scene, vec_id, round((x - ax) * cos(yaw) + (y - ay) * sin(yaw), 6) + 0 AS u, round((y - ay) * cos(yaw) - (x - ax) * sin(yaw), 6) + 0 AS v FROM s JOIN a USING (scene)")
def q_scene_frame(spark, d):
    s = states(spark, d)
    anchor = s.groupBy("scene").agg(F.min_by("x", "vec_id").alias("ax"), F.min_by("y", "vec_id").alias("ay"), F.min_by(F.atan2("vy", "vx"), "vec_id").alias("yaw"))
    return sc.local_states(s, anchor, "scene").select("scene", "vec_id", (F.round("u", 6) + 0).alias("u"), (F.round("v", 6) + 0).alias("v"))


@BOOK.add(_P + "SELECT vec_id, step, x > 0 AS seen, CASE WHEN x > 0 THEN x ELSE 0 END AS x, CASE WHEN x > 0 THEN y ELSE 0 END AS y FROM s")
def q_masked_history(spark, d):
    s = v.steps(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), ["vec_id"], "v")
    return sc.masked_history(s, s.where("x > 0"), ["vec_id", "step"], ["x", "y"]).select("vec_id", F.col("step").cast("bigint").alias("step"), "seen", "x", "y")


@BOOK.add(_P + """, g AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS g FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY step)), c AS (SELECT *, sum(g) OVER (PARTITION BY vec_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS q FROM g), n AS (SELECT *, lead(q) OVER w AS q2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, max(q) OVER (PARTITION BY vec_id) AS total FROM c WINDOW w AS (PARTITION BY vec_id ORDER BY step))
SELECT vec_id, k AS point, round(x + coalesce((k * total / 4 - q) / nullif(q2 - q, 0), 0) * (coalesce(x2, x) - x), 6) AS x, round(y + coalesce((k * total / 4 - q) / nullif(q2 - q, 0), 0) * (coalesce(y2, y) - y), 6) AS y FROM n, range(5) t(k) WHERE k * total / 4 >= q AND (k * total / 4 < q2 OR q2 IS NULL)""")
def q_resample(spark, d):
    s = v.steps(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), ["vec_id"], "v")
    return v.resample(s, ["vec_id"], "step", 5).select("vec_id", F.col("point").cast("bigint").alias("point"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@BOOK.add(_P + ", l AS (SELECT *, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS a, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS n FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY step)), t AS (SELECT *, a - lag(a) OVER w AS d, lag(n) OVER w AS pn FROM l WINDOW w AS (PARTITION BY vec_id ORDER BY step)) SELECT vec_id, round(avg(abs((d - 2 * pi() * round_even(d / (2 * pi()), 0)) / nullif((n + pn) / 2, 0))), 4) AS mean_curvature FROM t GROUP BY vec_id")
def q_curvature(spark, d):
    s = v.steps(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), ["vec_id"], "v")
    return sc.curvature(s, ["vec_id"], "step").groupBy("vec_id").agg(F.round(F.avg(F.abs("curvature")), 4).alias("mean_curvature"))


_PULSE = "WITH a AS (SELECT s_suppkey, s_nationkey, k AS step, CASE WHEN k * 0.1 >= (s_suppkey % 5) * 0.5 - 1e-9 AND k * 0.1 < (s_suppkey % 5) * 0.5 + 1.5 - 1e-9 THEN s_nationkey / 10 ELSE 0 END AS action FROM supplier, range(80) t(k)) "


def pulses(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", ((F.col("s_suppkey") % 5) * 0.5).alias("start"), F.lit(1.5).alias("width"), (F.col("s_nationkey") / 10).alias("height"))
    return sc.pulse(s, "start", "width", "height", 80, 0.1)


@BOOK.add(_PULSE + "SELECT s_suppkey, round(sum(action), 6) AS total, count(*) FILTER (action > 0) AS active FROM a GROUP BY s_suppkey")
def q_pulse_actions(spark, d):
    return pulses(spark, d).groupBy("s_suppkey").agg(F.round(F.sum("action"), 6).alias("total"), F.count_if(F.col("action") > 0).alias("active"))


@BOOK.add(_PULSE + "SELECT x.s_nationkey, x.s_suppkey AS a, y.s_suppkey AS b, round(sqrt(avg((x.action - y.action) * (x.action - y.action))), 6) AS rms, sqrt(avg((x.action - y.action) * (x.action - y.action))) < 1e-9 AS same FROM a x JOIN a y ON x.s_nationkey = y.s_nationkey AND x.step = y.step AND x.s_suppkey < y.s_suppkey GROUP BY ALL")
def q_action_rms(spark, d):
    a = pulses(spark, d).groupBy("s_nationkey", "s_suppkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "action"))), lambda s: s["action"]).alias("v"))
    return v.class_pairs(a, "s_nationkey", "s_suppkey", "v").select("s_nationkey", "a", "b", F.round("rms", 6).alias("rms"), (F.col("rms") < 1e-9).alias("same"))


@BOOK.add("WITH m AS (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my FROM part), s AS (SELECT sum((p_size - mx) * (p_retailprice - my)) / (sum((p_size - mx) * (p_size - mx)) + 100) AS w, any_value(mx) AS mx, any_value(my) AS my FROM part, m) SELECT 'intercept' AS name, round(my - w * mx, 4) AS weight FROM s UNION ALL SELECT 'p_size', round(w, 4) FROM s")
def q_ridge(spark, d):
    w = x.ridge(table(spark, d, "part"), ["p_size"], "p_retailprice", 100.0)
    return spark.createDataFrame([(k, round(c, 4)) for k, c in w.items()], "name string, weight double")


@BOOK.add("WITH f AS (SELECT avg(p_retailprice) AS m FROM part WHERE p_partkey % 5 <> 0) SELECT p_brand, round(avg((p_retailprice - m) * (p_retailprice - m)), 4) AS mse, round(stddev_pop(p_retailprice), 4) AS sd FROM part, f WHERE p_partkey % 5 = 0 GROUP BY p_brand")
def q_prediction_metrics(spark, d):
    p = table(spark, d, "part")
    m = p.where("p_partkey % 5 <> 0").agg(F.avg("p_retailprice").alias("m"))
    j = p.where("p_partkey % 5 = 0").join(F.broadcast(m))
    e = F.col("p_retailprice") - F.col("m")
    return j.groupBy("p_brand").agg(F.round(F.avg(e * e), 4).alias("mse"), F.round(F.stddev_pop("p_retailprice"), 4).alias("sd"))


@BOOK.add("SELECT l_linestatus, avg((l_returnflag = 'R')::INT) > 0.2 AS covers, count(*) > 100 AS enough, max(l_discount) <= 0.1 AS bounded, avg((l_returnflag = 'R')::INT) > 0.2 AND count(*) > 100 AND max(l_discount) <= 0.1 AS passes FROM lineitem GROUP BY l_linestatus")
def q_gates(spark, d):
    gates = {"covers": F.avg((F.col("l_returnflag") == "R").cast("int")) > 0.2, "enough": F.count("*") > 100, "bounded": F.max("l_discount") <= 0.1}
    g = table(spark, d, "lineitem").groupBy("l_linestatus").agg(*[c.alias(k) for k, c in gates.items()])
    return g.withColumn("passes", F.forall(F.array(*gates), lambda ok: ok))


@BOOK.add("SELECT source, lang, sort_list AS ids, len(sort_list) AS n FROM (SELECT source, lang, list_sort(list(doc_id)) AS sort_list FROM documents GROUP BY ALL)")
def q_file_families(spark, d):
    g = table(spark, d, "documents").groupBy("source", "lang").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return g.withColumn("n", F.size("ids").cast("bigint"))


@BOOK.add("SELECT DISTINCT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY'")
def q_class_overlap(spark, d):
    c = table(spark, d, "customer")
    return c.where("c_mktsegment = 'BUILDING'").select("c_nationkey").intersect(c.where("c_mktsegment = 'MACHINERY'").select("c_nationkey"))


@BOOK.add("WITH q AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, source, rn, row_number() OVER (PARTITION BY lang ORDER BY rn, source) AS place FROM q WHERE rn <= 3")
def q_interleaved_files(spark, d):
    q = table(spark, d, "documents").withColumn("rn", F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))).where("rn <= 3")
    return q.select("doc_id", "source", F.col("rn").cast("bigint").alias("rn"), F.row_number().over(Window.partitionBy("lang").orderBy("rn", "source")).cast("bigint").alias("place"))


@BOOK.add()
def q_kmeans_codebook(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return v.kmeans(e, "v", 8, 3, "codebook", "vec_id", balance="label", batch=2000)


@BOOK.add("WITH f AS (SELECT vec_id, list_transform(range(0, 64), lambda k: CASE WHEN embedding[k + 1] > 0 THEN embedding[k + 1]::DOUBLE ELSE 0 END) AS a, list_transform(range(0, 64), lambda k: (embedding[k + 1] > 0)::INT::DOUBLE) AS m FROM embeddings) SELECT vec_id, list_concat(a, m) AS features FROM f")
def q_flat_features(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.withColumn("m", F.transform("v", lambda x_: x_ > 0)).select("vec_id", models.flat_features(["v"], "m").alias("features"))


@BOOK.add()
def q_kernel_ridge(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    m = models.KernelRidge(alpha=0.5).fit(e.where("vec_id % 5 <> 0"), "v", "label")
    p = m.predict(e.where("vec_id % 5 = 0"), "v")
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("label"))), 4).alias("mae"))


@BOOK.add()
def q_projected_trajectories(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    s = v.steps(e, ["vec_id"], "v").select("vec_id", F.col("step").cast("bigint").alias("step"), "x", "y")
    return feasible.project_trajectories(s, "vec_id", "step", feasible.Limits(0.1, 3.0, 20.0, 200.0))
