"""Ordered-series queries on events: a user is a track, ts the clock, value the channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklens.functions.numbers import half_away, micros
from tracklens.operators import series as s
from tracklens.plans.base import Book, table

BOOK = Book()
ORDER = ["t", "event_id"]
_E = "WITH e AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) "


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("t", micros("ts"))


def numbered(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.withColumn("i", F.row_number().over(s.by("user_id", ORDER)).cast("bigint"))


_SEG = _E + """, d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS dt FROM e),
m AS (SELECT user_id, quantile_cont(dt, 0.5) AS typical FROM d WHERE dt > 0 GROUP BY user_id),
g AS (SELECT d.*, sum(CASE WHEN dt <= 0 OR dt > 1.5 * typical THEN 1 ELSE 0 END) OVER (PARTITION BY d.user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS segment FROM d LEFT JOIN m ON d.user_id = m.user_id),
k AS (SELECT user_id, segment, count(*) AS n, max(t) - min(t) AS dur FROM g GROUP BY ALL HAVING count(*) >= 2) """


@BOOK.add(_SEG + "SELECT user_id, count(*) AS n_segments, sum(n)::BIGINT AS n_rows, sum(dur)::BIGINT AS duration_us, max(n) AS longest FROM k GROUP BY user_id")
def q_gap_segments(spark, d):
    e = s.gap_segments(events(spark, d), "user_id", ORDER, "t")
    seg = e.groupBy("user_id", "segment").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("dur"))
    return seg.groupBy("user_id").agg(F.count("*").alias("n_segments"), F.sum("n").alias("n_rows"), F.sum("dur").alias("duration_us"), F.max("n").alias("longest"))


@BOOK.add(_E + """, f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY i) < 3600000000 THEN 0 ELSE 1 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, min(ts) AS started, count(*) AS n_events FROM g GROUP BY user_id, session""")
def q_session_windows(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n_events"))
    return e.select("user_id", F.col("session_window.start").alias("started"), "n_events")


@BOOK.add("""WITH a AS (SELECT DISTINCT conv_id, turn FROM conversations), b AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM a)
SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS length FROM b GROUP BY conv_id, k HAVING count(*) >= 3""")
def q_contiguous_runs(spark, d):
    return s.contiguous_runs(table(spark, d, "conversations"), "conv_id", "turn")


@BOOK.add(_E + "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS last_purchase FROM e")
def q_ffill(spark, d):
    return events(spark, d).select("event_id", s.forward_fill(F.when(F.col("event_type") == "purchase", F.col("value")), "user_id", ORDER).alias("last_purchase"))


@BOOK.add(_E + """, w AS (SELECT event_id, value - lag(value) OVER o AS dx, lead(value) OVER o - value AS dn, (t - lag(t) OVER o) / 1e6 AS b, (lead(t) OVER o - t) / 1e6 AS a FROM e WINDOW o AS (PARTITION BY user_id ORDER BY i))
SELECT event_id, round(CASE WHEN b IS NULL AND a IS NULL THEN NULL WHEN b IS NULL THEN dn / a WHEN a IS NULL THEN dx / b ELSE (dn / a * b + dx / b * a) / (a + b) END, 6) AS slope FROM w""")
def q_gradient(spark, d):
    e = events(spark, d).withColumn("slope", s.gradient("value", "t", "user_id", ORDER, unit=1e6))
    return e.select("event_id", half_away("slope", 6).alias("slope"))


@BOOK.add(_E + """, w AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER u AS f, last_value(value) OVER u AS l, sum(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM e
WINDOW u AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT event_id, round((s + greatest(0, 3 - i) * f + greatest(0, i + 2 - n) * l) / 5, 4) AS smooth FROM w""")
def q_moving_avg_edgepad(spark, d):
    return events(spark, d).select("event_id", F.round(s.moving_average("value", 5, "user_id", ORDER), 4).alias("smooth"))


@BOOK.add(_E + """, w AS (SELECT *, sum((value > 20)::INT) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS k FROM e)
SELECT user_id, min(i) AS first_at FROM w WHERE k = 3 GROUP BY user_id""")
def q_sustained_first(spark, d):
    e = numbered(spark, d).withColumn("_s", s.sustained(F.col("value") > 20, 3, "user_id", "i"))
    return e.where("_s").groupBy("user_id").agg(F.min("i").alias("first_at"))


@BOOK.add(_E + """, w AS (SELECT *, value > 50 AS f, lag(value > 50) OVER (PARTITION BY user_id ORDER BY i) AS p FROM e)
SELECT user_id, min(CASE WHEN f AND NOT coalesce(p, true) THEN i END) AS first_rise, min(CASE WHEN f AND NOT coalesce(p, false) THEN i END) AS first_true FROM w GROUP BY user_id""")
def q_rising_edges(spark, d):
    f = F.col("value") > 50
    e = numbered(spark, d).withColumns({"a": s.rising(f, "user_id", "i", False), "b": s.rising(f, "user_id", "i", True)})
    return e.groupBy("user_id").agg(F.min(F.when(F.col("a"), F.col("i"))).alias("first_rise"), F.min(F.when(F.col("b"), F.col("i"))).alias("first_true"))


@BOOK.add(_E + """, w AS (SELECT *, value > 50 AND NOT coalesce(lag(value > 50) OVER (PARTITION BY user_id ORDER BY i), false) AS r FROM e)
SELECT user_id, sum(r::INT)::BIGINT AS pulses FROM w GROUP BY user_id""")
def q_pulse_count(spark, d):
    e = numbered(spark, d).withColumn("r", s.rising(F.col("value") > 50, "user_id", "i", True))
    return e.groupBy("user_id").agg(F.sum(F.col("r").cast("int")).alias("pulses"))


_EVENT = _E + """, z AS (SELECT *, sum((value <= 10)::INT) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM e),
y AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY user_id, run) AS size FROM z WHERE value > 10),
st AS (SELECT user_id, i FROM y WHERE pos % 3 = 0 AND pos + 3 <= size),
c AS (SELECT st.user_id, st.i, max(b.value) - min(b.value) AS drop_ FROM st JOIN e b ON b.user_id = st.user_id AND b.i BETWEEN st.i AND st.i + 9 GROUP BY ALL),
best AS (SELECT user_id, i AS onset, drop_ FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY drop_ DESC, i) = 1),
bk AS (SELECT best.user_id, best.onset, best.drop_, coalesce(max(b.i) + 1, 1) AS start FROM best LEFT JOIN e b ON b.user_id = best.user_id AND b.i < best.onset AND b.value <= 5 GROUP BY ALL),
ev AS (SELECT bk.user_id, bk.onset, bk.drop_, bk.start, coalesce(min(b.i), bk.onset + 14) AS stop FROM bk LEFT JOIN e b ON b.user_id = bk.user_id AND b.i BETWEEN bk.onset AND bk.onset + 14 AND b.value < 1 GROUP BY bk.user_id, bk.onset, bk.drop_, bk.start) """


def event_windows(e: DataFrame) -> DataFrame:
    """(user_id, onset, drop_, start, stop): the sustained start with the largest drop ahead, extended back to the last low value."""
    ahead = s.by("user_id", "i").rowsBetween(0, 9)
    e = e.withColumns({
        "drop_": F.max("value").over(ahead) - F.min("value").over(ahead),
        "low": F.last(F.when(F.col("value") <= 5, F.col("i")), ignorenulls=True).over(s.by("user_id", "i").rowsBetween(Window.unboundedPreceding, -1)),
        "stop": F.first(F.when(F.col("value") < 1, F.col("i")), ignorenulls=True).over(s.by("user_id", "i").rowsBetween(0, 14)),
    })
    c = s.event_starts(e, "user_id", "i", F.col("value") > 10, 3).withColumn("r", F.row_number().over(s.by("user_id", [F.desc("drop_"), "i"]))).where("r = 1")
    return c.select("user_id", F.col("i").alias("onset"), "drop_", (F.coalesce("low", F.lit(0)) + 1).alias("start"), F.coalesce("stop", F.col("i") + 14).alias("stop"))


@BOOK.add(_EVENT + "SELECT user_id, onset, round(drop_, 4) AS drop_, start, stop FROM ev")
def q_event_window(spark, d):
    return event_windows(numbered(spark, d)).withColumn("drop_", F.round("drop_", 4))


@BOOK.add(_EVENT + """, j AS (SELECT ev.*, b.value, b.i FROM ev JOIN e b ON b.user_id = ev.user_id AND b.i BETWEEN ev.onset - 10 AND ev.stop),
m AS (SELECT user_id, quantile_cont(value, 0.5) AS base FROM j WHERE i < onset GROUP BY user_id)
SELECT j.user_id, round(any_value(m.base), 6) AS baseline, count(*) FILTER (j.i >= onset) AS n, round(max(CASE WHEN j.i >= onset THEN abs(value - base) END), 6) AS peak, round(min(CASE WHEN j.i >= onset THEN value END), 6) AS low FROM j LEFT JOIN m USING (user_id) GROUP BY j.user_id""")
def q_event_features(spark, d):
    e = numbered(spark, d)
    w = event_windows(e)
    j = e.select("user_id", "i", "value").join(w, "user_id").where("i between onset - 10 and stop")
    j = j.withColumn("base", F.percentile(F.when(F.col("i") < F.col("onset"), F.col("value")), 0.5).over(s.whole("user_id")))
    inside = F.col("i") >= F.col("onset")
    return j.groupBy("user_id").agg(F.round(F.max("base"), 6).alias("baseline"), F.count_if(inside).alias("n"), F.round(F.max(F.when(inside, F.abs(F.col("value") - F.col("base")))), 6).alias("peak"), F.round(F.min(F.when(inside, F.col("value"))), 6).alias("low"))


@BOOK.add(_E + """, w AS (SELECT *, lead(value) OVER o AS v2, (lead(t) OVER o - t) / 1e6 AS dt FROM e WINDOW o AS (PARTITION BY user_id ORDER BY i)),
a AS (SELECT user_id, sum((value + v2) / 2 * dt) AS distance, arg_min(value, i) AS v0, arg_max(value, i) AS v1, arg_min(i, value * 1e6 + i * 1e-3) AS low_at FROM w GROUP BY user_id)
SELECT user_id, round(distance, 3) AS distance, round((v0 * v0 - v1 * v1) / (2 * distance), 9) AS equivalent, low_at FROM a""")
def q_trapezoid_equiv(spark, d):
    e, w = numbered(spark, d), s.by("user_id", "i")
    e = e.withColumns({"v2": F.lead("value").over(w), "dt": (F.lead("t").over(w) - F.col("t")) / 1e6})
    a = e.groupBy("user_id").agg(F.sum((F.col("value") + F.col("v2")) / 2 * F.col("dt")).alias("distance"), F.min_by("value", "i").alias("v0"), F.max_by("value", "i").alias("v1"), F.min_by("i", F.struct("value", "i")).alias("low_at"))
    return a.select("user_id", F.round("distance", 3).alias("distance"), F.round((F.col("v0") * F.col("v0") - F.col("v1") * F.col("v1")) / (2 * F.col("distance")), 9).alias("equivalent"), "low_at")


_T0 = _E + """, f AS (SELECT *, event_type = 'signup' AND NOT coalesce(lag(event_type = 'signup') OVER o, true) AS edge, value < 3 AND lag(value) OVER o >= 3 AS crossing FROM e WINDOW o AS (PARTITION BY user_id ORDER BY i)),
p AS (SELECT user_id, min(CASE WHEN edge THEN i END) AS a, min(CASE WHEN crossing THEN i END) AS b, min(CASE WHEN event_type = 'purchase' THEN i END) AS c, count(*) AS n FROM f GROUP BY user_id),
t0 AS (SELECT user_id, n, coalesce(a, b, c) AS t0, CASE WHEN a IS NOT NULL THEN 'edge' WHEN b IS NOT NULL THEN 'crossing' WHEN c IS NOT NULL THEN 'motion' ELSE 'none' END AS method FROM p) """


def located(e: DataFrame) -> DataFrame:
    """(user_id, n, t0, method): the first of three kinds of onset, by priority."""
    e = e.withColumn("edge", s.rising(F.col("event_type") == "signup", "user_id", "i", False)).withColumn("crossing", (F.col("value") < 3) & (F.lag("value").over(s.by("user_id", "i")) >= 3))
    first = lambda c: F.min(F.when(c, F.col("i")))
    p = e.groupBy("user_id").agg(first(F.col("edge")).alias("a"), first(F.col("crossing")).alias("b"), first(F.col("event_type") == "purchase").alias("c"), F.count("*").alias("n"))
    method = F.when(F.col("a").isNotNull(), "edge").when(F.col("b").isNotNull(), "crossing").when(F.col("c").isNotNull(), "motion").otherwise("none")
    return p.select("user_id", "n", F.coalesce("a", "b", "c").alias("t0"), method.alias("method"))


@BOOK.add(_T0 + "SELECT user_id, t0, method FROM t0")
def q_priority_t0(spark, d):
    return located(numbered(spark, d)).select("user_id", "t0", "method")


_END = _T0 + """, h AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS hold FROM e),
en AS (SELECT t0.user_id, t0.t0, t0.method, least(coalesce(min(CASE WHEN hold < 10 THEN h.i END), t0.n), coalesce(min(CASE WHEN event_type = 'error' THEN h.i END), t0.n), t0.t0 + 15, t0.n) AS stop FROM t0 JOIN h ON h.user_id = t0.user_id AND h.i >= t0.t0 GROUP BY t0.user_id, t0.t0, t0.method, t0.n) """


def ended(e: DataFrame) -> DataFrame:
    """(user_id, t0, method, stop): the earliest of a held low, an error, 15 rows on and the last row."""
    h = e.withColumn("hold", F.max("value").over(s.by("user_id", "i").rowsBetween(0, 2)))
    j = h.join(located(e), "user_id").where("i >= t0")
    first = lambda c: F.coalesce(F.min(F.when(c, F.col("i"))), F.first("n"))
    return j.groupBy("user_id", "t0", "method").agg(F.least(first(F.col("hold") < 10), first(F.col("event_type") == "error"), F.first("t0") + 15, F.first("n")).alias("stop"))


@BOOK.add(_END + "SELECT user_id, t0, method, stop FROM en")
def q_event_end(spark, d):
    return ended(numbered(spark, d))


@BOOK.add(_END + """, l AS (SELECT *, lag(value) OVER o AS pv, lead(value, 2) OVER o AS nv FROM e WINDOW o AS (PARTITION BY user_id ORDER BY i))
SELECT en.user_id, coalesce(bool_or(l.event_type = 'error'), false) AS e1, coalesce(bool_or(value < 2), false) AS e2, coalesce(bool_or(pv - value > 100 AND nv < value), false) AS e3,
coalesce(bool_or(l.event_type = 'error'), false) OR (coalesce(bool_or(value < 2), false) AND coalesce(bool_or(pv - value > 100 AND nv < value), false)) AS hit
FROM en JOIN l ON l.user_id = en.user_id AND l.i BETWEEN en.t0 AND en.stop GROUP BY en.user_id""")
def q_adjudicate(spark, d):
    e, w = numbered(spark, d), s.by("user_id", "i")
    e2 = e.withColumns({"pv": F.lag("value").over(w), "nv": F.lead("value", 2).over(w)})
    j = e2.join(ended(e), "user_id").where("i between t0 and stop")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    j = j.groupBy("user_id").agg(any_(F.col("event_type") == "error").alias("e1"), any_(F.col("value") < 2).alias("e2"), any_((F.col("pv") - F.col("value") > 100) & (F.col("nv") < F.col("value"))).alias("e3"))
    return j.withColumn("hit", F.col("e1") | (F.col("e2") & F.col("e3")))


@BOOK.add(_END + "SELECT en.user_id, min(value) AS low, arg_min(e.i, value * 1e6 + e.i * 1e-3) - en.t0 AS low_after FROM en JOIN e ON e.user_id = en.user_id AND e.i BETWEEN en.t0 AND en.stop AND value > 0 GROUP BY en.user_id, en.t0")
def q_guarded_min(spark, d):
    e = numbered(spark, d)
    j = e.join(ended(e), "user_id").where("i between t0 and stop and value > 0")
    return j.groupBy("user_id").agg(F.min("value").alias("low"), (F.min_by("i", F.struct("value", "i")) - F.first("t0")).alias("low_after"))


@BOOK.add(_END + """, w AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS med FROM e)
SELECT en.user_id, min(CASE WHEN med > 30 THEN w.i END) - en.t0 AS response FROM en JOIN w ON w.user_id = en.user_id AND w.i BETWEEN en.t0 AND en.stop GROUP BY en.user_id, en.t0""")
def q_response_time(spark, d):
    e = numbered(spark, d)
    m = e.withColumn("med", F.percentile("value", 0.5).over(s.by("user_id", "i").rowsBetween(0, 9)))
    return m.join(ended(e), "user_id").where("i between t0 and stop").groupBy("user_id").agg((F.min(F.when(F.col("med") > 30, F.col("i"))) - F.first("t0")).alias("response"))


@BOOK.add(_END + """SELECT en.user_id, en.method, en.t0, en.stop, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, (count(*) < 3 OR en.method = 'none') AS needs_review
FROM en JOIN e ON e.user_id = en.user_id AND e.i BETWEEN en.t0 AND en.stop GROUP BY en.user_id, en.method, en.t0, en.stop""")
def q_label_rows(spark, d):
    e = numbered(spark, d)
    j = e.join(ended(e), "user_id").where("i between t0 and stop").groupBy("user_id", "method", "t0", "stop")
    j = j.agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))
    return j.withColumn("needs_review", (F.col("n") < 3) | (F.col("method") == "none"))


@BOOK.add(_E + """, b AS (SELECT user_id, quantile_cont(value, 0.5) AS base FROM e WHERE i <= 10 GROUP BY user_id)
SELECT event_type, round(max(abs(value)), 6) AS max_abs, round(max(abs(value - base)), 6) AS max_delta, count(*) AS n FROM e JOIN b USING (user_id) GROUP BY event_type""")
def q_channel_activity(spark, d):
    e = numbered(spark, d).withColumn("base", F.percentile(F.when(F.col("i") <= 10, F.col("value")), 0.5).over(s.whole("user_id")))
    return e.groupBy("event_type").agg(F.round(F.max(F.abs("value")), 6).alias("max_abs"), F.round(F.max(F.abs(F.col("value") - F.col("base"))), 6).alias("max_delta"), F.count("*").alias("n"))


@BOOK.add(_T0 + """SELECT e.user_id, min(CASE WHEN e.i >= t0 AND value > 50 THEN e.i - t0 END) AS first_active, t0 - max(CASE WHEN e.i < t0 AND value > 50 THEN e.i END) AS since_last, round(avg(CASE WHEN e.i BETWEEN t0 AND t0 + 9 THEN (value > 50)::INT END), 6) AS active_share
FROM e JOIN t0 USING (user_id) WHERE t0 IS NOT NULL GROUP BY e.user_id, t0""")
def q_activity_bands(spark, d):
    e = numbered(spark, d)
    j = e.join(located(e).where("t0 is not null"), "user_id")
    on, rel = F.col("value") > 50, F.col("i") - F.col("t0")
    return j.groupBy("user_id").agg(F.min(F.when((rel >= 0) & on, rel)).alias("first_active"), (-F.max(F.when((rel < 0) & on, rel))).alias("since_last"), F.round(F.avg(F.when(rel.between(0, 9), on.cast("int"))), 6).alias("active_share"))


@BOOK.add(_E + """, w AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY i) AS r FROM e), m AS (SELECT user_id, quantile_cont(r, 0.5) AS off FROM w WHERE abs(r) > 1 GROUP BY user_id)
SELECT user_id, round(sqrt(avg((r - off) * (r - off))), 6) AS rmse, round(quantile_cont(abs(r - off), 0.95), 6) AS p95, round(max(abs(r - off)), 6) AS worst FROM w JOIN m USING (user_id) WHERE abs(r) > 1 GROUP BY user_id""")
def q_tracking_residual(spark, d):
    e = numbered(spark, d)
    e = e.withColumn("r", F.col("value") - F.lag("value").over(s.by("user_id", "i"))).where(F.abs("r") > 1)
    e = e.withColumn("x", F.col("r") - F.percentile("r", 0.5).over(s.whole("user_id")))
    return e.groupBy("user_id").agg(F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 6).alias("rmse"), F.round(F.percentile(F.abs("x"), 0.95), 6).alias("p95"), F.round(F.max(F.abs("x")), 6).alias("worst"))


@BOOK.add(_E + """, p AS (SELECT user_id, event_id, t FROM e WHERE event_type = 'purchase')
SELECT p.event_id, min(e.value) AS low, min(CASE WHEN e.value < 5 THEN e.t - p.t END) AS first_crossing FROM p JOIN e ON e.user_id = p.user_id AND e.t BETWEEN p.t - 7200000000 AND p.t + 7200000000 GROUP BY p.event_id""")
def q_min_around(spark, d):
    around = Window.partitionBy("user_id").orderBy("t").rangeBetween(-7_200_000_000, 7_200_000_000)
    e = events(spark, d).withColumns({"low": F.min("value").over(around), "cross": F.min(F.when(F.col("value") < 5, F.col("t"))).over(around)})
    return e.where("event_type = 'purchase'").select("event_id", "low", (F.col("cross") - F.col("t")).alias("first_crossing"))


@BOOK.add(_E + """, w AS (SELECT *, (i - 1) // 8 AS win FROM e), k AS (SELECT user_id, win FROM w GROUP BY ALL HAVING count(*) = 8 AND bool_and(value < 150))
SELECT w.user_id, w.win AS "window", round(avg(value), 6) AS mean_value, count(*) AS n FROM w JOIN k ON w.user_id = k.user_id AND w.win = k.win GROUP BY ALL""")
def q_fixed_windows(spark, d):
    e = s.fixed_windows(numbered(spark, d), "user_id", "i", 8, F.col("value") < 150)
    return e.groupBy("user_id", "window").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n"))


@BOOK.add(_E + ", w AS (SELECT *, sum((value < 250)::INT) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND 20 FOLLOWING) AS k FROM e) SELECT user_id, i FROM w WHERE k = 31 AND i % 10 = 0")
def q_sliding_windows(spark, d):
    return s.sliding_anchors(numbered(spark, d), "user_id", "i", 10, 20, 10, F.col("value") < 250).select("user_id", "i")


@BOOK.add(_E + """, w AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY i) AS dv FROM e)
SELECT user_id, (i - 1) // 5 AS chunk, count(*) AS n, coalesce(bool_and(abs(dv) < 100), false) AS valid, round(sum(dv), 6) AS moved FROM w GROUP BY ALL""")
def q_chunks(spark, d):
    e = numbered(spark, d)
    e = e.withColumns({"dv": F.col("value") - F.lag("value").over(s.by("user_id", "i")), "chunk": F.floor((F.col("i") - 1) / 5)})
    return e.groupBy("user_id", "chunk").agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.abs("dv") < 100), F.lit(False)).alias("valid"), F.round(F.sum("dv"), 6).alias("moved"))


@BOOK.add(_E + ", w AS (SELECT *, min((value < 150)::INT) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, sum(k)::BIGINT AS valid_prefix FROM w GROUP BY user_id")
def q_chain_validity(spark, d):
    e = numbered(spark, d).withColumn("ok", s.chain_valid(F.col("value") < 150, "user_id", "i"))
    return e.groupBy("user_id").agg(F.sum(F.col("ok").cast("bigint")).alias("valid_prefix"))


_KIN = _E + """, a AS (SELECT *, (value - lag(value) OVER o) / greatest((t - lag(t) OVER o) / 60e6, 1) AS v FROM e WINDOW o AS (PARTITION BY user_id ORDER BY i)),
b AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id ORDER BY i) AS acc FROM a), c AS (SELECT *, acc - lag(acc) OVER (PARTITION BY user_id ORDER BY i) AS jerk FROM b) """


def kinematics(e: DataFrame, key="user_id") -> DataFrame:
    """Adds v, acc and jerk: stacked differences, null where a row they span is missing."""
    w = s.by(key, "i")
    e = e.withColumn("v", (F.col("value") - F.lag("value").over(w)) / F.greatest((F.col("t") - F.lag("t").over(w)) / 60e6, F.lit(1.0)))
    e = e.withColumn("acc", F.col("v") - F.lag("v").over(w))
    return e.withColumn("jerk", F.col("acc") - F.lag("acc").over(w))


@BOOK.add(_KIN + "SELECT user_id, coalesce(bool_or(abs(v) > 5), false) AS fast, coalesce(bool_or(abs(acc) > 8), false) AS hard, coalesce(bool_or(abs(jerk) > 12), false) AS jerky, round(max(abs(jerk)), 6) AS worst_jerk FROM c GROUP BY user_id")
def q_kinematics(spark, d):
    k = kinematics(numbered(spark, d))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return k.groupBy("user_id").agg(any_(F.abs("v") > 5).alias("fast"), any_(F.abs("acc") > 8).alias("hard"), any_(F.abs("jerk") > 12).alias("jerky"), F.round(F.max(F.abs("jerk")), 6).alias("worst_jerk"))


@BOOK.add(_E + """, w AS (SELECT *, (i - 1) // 10 AS chunk FROM e), x AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id, chunk ORDER BY i) AS dv, value - lag(value) OVER (PARTITION BY user_id ORDER BY i) AS any_dv FROM w)
SELECT user_id, round(avg(CASE WHEN dv IS NOT NULL THEN (abs(dv) > 50)::INT END), 6) AS inside_rate, round(avg(CASE WHEN dv IS NULL THEN abs(any_dv) END), 6) AS boundary_jump, count(*) FILTER (dv IS NULL AND any_dv IS NOT NULL) AS boundaries FROM x GROUP BY user_id""")
def q_kinematics_boundary(spark, d):
    e = numbered(spark, d).withColumn("chunk", F.floor((F.col("i") - 1) / 10))
    e = e.withColumns({"dv": F.col("value") - F.lag("value").over(s.by(["user_id", "chunk"], "i")), "any_dv": F.col("value") - F.lag("value").over(s.by("user_id", "i"))})
    edge = F.col("dv").isNull()
    return e.groupBy("user_id").agg(F.round(F.avg(F.when(~edge, (F.abs("dv") > 50).cast("int"))), 6).alias("inside_rate"), F.round(F.avg(F.when(edge, F.abs("any_dv"))), 6).alias("boundary_jump"), F.count_if(edge & F.col("any_dv").isNotNull()).alias("boundaries"))


@BOOK.add(_KIN + """SELECT event_type, count(v) AS steps, round(avg((abs(v) > 2)::INT), 6) AS step_rate, round(quantile_cont(CASE WHEN abs(v) > 2 THEN abs(v) - 2 END, 0.5), 6) AS exceed_median, round(quantile_cont(CASE WHEN abs(v) > 2 THEN abs(v) - 2 END, 0.95), 6) AS exceed_p95 FROM c GROUP BY event_type""")
def q_kinematic_rates(spark, d):
    k, a = kinematics(numbered(spark, d)), F.abs("v")
    over = F.when(a > 2, a - 2)
    return k.groupBy("event_type").agg(F.count("v").alias("steps"), F.round(F.avg((a > 2).cast("int")), 6).alias("step_rate"), F.round(F.percentile(over, 0.5), 6).alias("exceed_median"), F.round(F.percentile(over, 0.95), 6).alias("exceed_p95"))


@BOOK.add(_E + """, an AS (SELECT user_id, 0 AS step, 0.0 AS x FROM e WHERE i = 1 UNION ALL SELECT user_id, i, value FROM e), d AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY user_id ORDER BY step)) AS dv FROM an),
r AS (SELECT user_id, bool_or(dv > 150) AS big, bool_or(dv < 0.5) AS still, min(CASE WHEN dv > 150 OR dv < 0.5 THEN step END) AS first_bad FROM d GROUP BY user_id)
SELECT user_id, concat_ws(',', CASE WHEN big THEN 'jump' END, CASE WHEN still THEN 'still' END) AS reasons, NOT (big OR still) AS valid, first_bad FROM r""")
def q_anchored_validity(spark, d):
    e = numbered(spark, d)
    rows = e.where("i = 1").select("user_id", F.lit(0).cast("bigint").alias("step"), F.lit(0.0).alias("x")).unionByName(e.select("user_id", F.col("i").alias("step"), F.col("value").alias("x")))
    rows = rows.withColumn("dv", F.abs(F.col("x") - F.lag("x").over(s.by("user_id", "step"))))
    big, still = F.col("dv") > 150, F.col("dv") < 0.5
    r = rows.groupBy("user_id").agg(F.bool_or(big).alias("big"), F.bool_or(still).alias("still"), F.min(F.when(big | still, F.col("step"))).alias("first_bad"))
    reasons = F.array_compact(F.array(F.when(F.col("big"), F.lit("jump")), F.when(F.col("still"), F.lit("still"))))
    return r.select("user_id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("valid"), "first_bad")


@BOOK.add(_KIN + "SELECT event_id, round(v, 6) AS implied, CASE WHEN abs(v) > 60 THEN 'certain' WHEN value < 10 THEN 'mismatch' ELSE 'watch' END AS kind FROM c WHERE abs(v) > 40")
def q_outlier_scan(spark, d):
    k = kinematics(numbered(spark, d)).where(F.abs("v") > 40)
    return k.select("event_id", F.round("v", 6).alias("implied"), F.when(F.abs("v") > 60, "certain").when(F.col("value") < 10, "mismatch").otherwise("watch").alias("kind"))


@BOOK.add(_E + "SELECT user_id, arg_max(value, i) FILTER (event_type = 'view') AS last_value, max(i) FILTER (event_type = 'view') AS last_at FROM e GROUP BY user_id")
def q_last_valid(spark, d):
    v = F.when(F.col("event_type") == "view", F.col("i"))
    return numbered(spark, d).groupBy("user_id").agg(F.max_by("value", v).alias("last_value"), F.max(v).alias("last_at"))


@BOOK.add(_E + """, r AS (SELECT user_id, i, value / 97 + 0.9 * coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY i), 0) / 89 - value / 83 AS delta FROM e)
SELECT a.user_id, a.i, round(sum(b.delta * pow(0.855, b.i - a.i)), 9) AS advantage FROM r a JOIN r b ON a.user_id = b.user_id AND b.i >= a.i GROUP BY ALL""")
def q_reverse_discount(spark, d):
    e, w = numbered(spark, d), s.by("user_id", "i")
    e = e.withColumn("delta", F.col("value") / 97 + 0.9 * F.coalesce(F.lead("value").over(w), F.lit(0.0)) / 89 - F.col("value") / 83)
    return s.discounted_ahead(e, "delta", "i", 0.855, "user_id", "advantage").select("user_id", "i", F.round("advantage", 9).alias("advantage"))


@BOOK.add(_E + """SELECT user_id, min(CASE WHEN event_type = 'click' THEN t END) - min(CASE WHEN event_type = 'view' THEN t END) AS view_to_click, min(CASE WHEN event_type = 'purchase' THEN t END) - min(CASE WHEN event_type = 'click' THEN t END) AS click_to_purchase FROM e GROUP BY user_id""")
def q_staged_delays(spark, d):
    at = lambda k: F.min(F.when(F.col("event_type") == k, F.col("t")))
    return events(spark, d).groupBy("user_id").agg((at("click") - at("view")).alias("view_to_click"), (at("purchase") - at("click")).alias("click_to_purchase"))


@BOOK.add("SELECT event_id, ts - INTERVAL 350 MILLISECOND AS earliest, ts - INTERVAL 250 MILLISECOND AS likely, ts - INTERVAL 150 MILLISECOND AS latest FROM events WHERE event_type = 'purchase'")
def q_request_interval(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.select("event_id", *[(F.col("ts") - F.expr(f"INTERVAL '0.{ms}' SECOND")).alias(n) for ms, n in ((350, "earliest"), (250, "likely"), (150, "latest"))])


@BOOK.add(_E + ", th(x) AS (VALUES (20), (50), (100)), w AS (SELECT e.*, x, sum((value > x)::INT) OVER (PARTITION BY user_id, x ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS k FROM e, th) SELECT x AS threshold, count(DISTINCT user_id) AS users, round(avg(f), 6) AS mean_first FROM (SELECT x, user_id, min(i) AS f FROM w WHERE k = 2 GROUP BY ALL) GROUP BY x")
def q_threshold_sensitivity(spark, d):
    e = numbered(spark, d).withColumn("x", F.explode(F.array(F.lit(20), F.lit(50), F.lit(100))))
    e = e.withColumn("k", s.sustained(F.col("value") > F.col("x"), 2, ["user_id", "x"], "i")).where("k").groupBy("x", "user_id").agg(F.min("i").alias("f"))
    return e.groupBy(F.col("x").alias("threshold")).agg(F.count_distinct("user_id").alias("users"), F.round(F.avg("f"), 6).alias("mean_first"))


@BOOK.add(_E + """, v AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN t END IGNORE NULLS) OVER o AS vt, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER o AS vv FROM e WINDOW o AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT event_id, t - vt AS age, CASE WHEN t - vt <= 86400000000 THEN vv END AS last_value FROM v""")
def q_asof(spark, d):
    e = s.as_of(events(spark, d), "user_id", ORDER, "t", F.col("event_type") == "view", ["value"], 86_400_000_000)
    return e.select("event_id", "age", "last_value")


@BOOK.add(_E + """, a AS (SELECT *, atan2(value - lag(value) OVER o, (t - lag(t) OVER o) / 60e6) AS h FROM e WINDOW o AS (PARTITION BY user_id ORDER BY i)), b AS (SELECT *, coalesce(-2 * pi() * round_even((h * 2 - lag(h * 2) OVER o) / (2 * pi()), 0), 0) AS k FROM a WHERE h IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY i))
SELECT event_id, round(h * 2 + sum(k) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM b""")
def q_unwrap(spark, d):
    e, w = numbered(spark, d), s.by("user_id", "i")
    e = e.withColumn("h", 2 * F.atan2(F.col("value") - F.lag("value").over(w), (F.col("t") - F.lag("t").over(w)) / 60e6)).where("h is not null")
    e = e.withColumn("k", s.turns("h", "user_id", "i"))
    return e.select("event_id", F.round(F.col("h") + F.sum("k").over(s.until_now(w)), 6).alias("unwrapped"))
