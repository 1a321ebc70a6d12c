"""Splits, samples, aggregates, rankings and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklens.functions import hashing as hs
from tracklens.operators import aggregates as a
from tracklens.operators import ranking as r
from tracklens.operators import sampling as sm
from tracklens.operators import sets
from tracklens.plans.base import Book, table

BOOK = Book()
_TOP = "('0x' || substr(sha256({}), 1, 16))::UBIGINT::HUGEINT"
_BUCKET = f"(({_TOP}) * {{}}) // 18446744073709551616::HUGEINT"
_SPLIT = _BUCKET.format("lower(trim(source)) || chr(31) || doc_id::VARCHAR", 10)
_ATT = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS attempt FROM lineitem) """


def attempts(spark, d):
    """lineitem as attempts at a condition (the order): numbered, R means success, linestatus is the method."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return table(spark, d, "lineitem").withColumn("attempt", F.row_number().over(w).cast("bigint"))


@BOOK.add(f"SELECT doc_id, CASE WHEN {_SPLIT} < 8 THEN 'train' WHEN {_SPLIT} = 8 THEN 'val' ELSE 'test' END AS split, CASE WHEN {_BUCKET.format(chr(39) + 'ladder' + chr(39) + ' || doc_id::VARCHAR', 100)} < 90 THEN 'train' ELSE 'val' END AS salted FROM documents")
def q_hash_split(spark, d):
    return table(spark, d, "documents").select("doc_id", hs.split_of("source", "doc_id").alias("split"), hs.salted_split("ladder", "doc_id").alias("salted"))


@BOOK.add("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('v1|' || doc_id::VARCHAR), doc_id) AS k FROM documents) SELECT doc_id, CASE WHEN k <= 10 THEN 10 WHEN k <= 100 THEN 100 WHEN k <= 500 THEN 500 END AS rung FROM o")
def q_scale_ladder(spark, d):
    return sm.scale_ladder(table(spark, d, "documents").select("doc_id"), "v1", "doc_id", [10, 100, 500])


@BOOK.add("WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY sha) AS first FROM h) SELECT doc_id, sha, CASE WHEN doc_id <> first THEN first END AS duplicate_of FROM f")
def q_content_dedup(spark, d):
    return sm.dedup_by_content(table(spark, d, "documents").select("doc_id", "text"), F.col("text"), ["doc_id"], "doc_id").select("doc_id", "sha", "duplicate_of")


@BOOK.add("SELECT min(event_id) AS event_id, user_id, event_type, round(value / 10)::BIGINT AS bin FROM events GROUP BY user_id, event_type, round(value / 10)")
def q_window_fingerprints(spark, d):
    e = table(spark, d, "events").withColumn("bin", F.round(F.col("value") / 10).cast("bigint"))
    return e.groupBy("user_id", "event_type", "bin").agg(F.min("event_id").alias("event_id"))


@BOOK.add("WITH q AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('q|' || doc_id::VARCHAR), doc_id) AS pick FROM documents) SELECT doc_id, lang, source, pick FROM q WHERE pick <= CASE WHEN lang = 'en' THEN 3 ELSE 2 END")
def q_group_quota(spark, d):
    return sm.quota(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], F.when(F.col("lang") == "en", 3).otherwise(2), "q", "doc_id")


@BOOK.add("WITH q AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('r7|' || doc_id::VARCHAR), doc_id) AS pick FROM documents) SELECT doc_id, lang, pick FROM q WHERE pick <= 20")
def q_reservoir(spark, d):
    return sm.quota(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], 20, "r7", "doc_id")


@BOOK.add(f"WITH s AS (SELECT source, lang, {_BUCKET.format('doc_id::VARCHAR', 2)} AS b FROM documents) SELECT source, lang, count(DISTINCT b) AS splits FROM s GROUP BY ALL HAVING count(DISTINCT b) > 1")
def q_leak_groups(spark, d):
    docs = table(spark, d, "documents").withColumn("b", hs.sha_bucket(F.col("doc_id").cast("string"), 2))
    return sm.leaking(docs, ["source", "lang"], "b")


@BOOK.add("WITH t AS (SELECT doc_id, sha256(text) AS sha, doc_id % 5 = 0 AS held FROM documents) SELECT count(*) AS overlap FROM (SELECT sha FROM t WHERE held INTERSECT SELECT sha FROM t WHERE NOT held)")
def q_fingerprint_overlap(spark, d):
    t = table(spark, d, "documents").select(F.sha2("text", 256).alias("sha"), (F.col("doc_id") % 5 == 0).alias("held"))
    return t.where("held").select("sha").intersect(t.where("not held").select("sha")).agg(F.count("*").alias("overlap"))


@BOOK.add("""WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang FROM n WHERE n <= 7 OR i IN (SELECT round_even(k * (n.n - 1) / 6, 0)::BIGINT FROM range(7) t(k))""")
def q_even_sample(spark, d):
    return sm.evenly(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 7)


@BOOK.add("WITH n AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS round FROM part) SELECT p_partkey, p_brand, round FROM n ORDER BY round, p_brand LIMIT 40")
def q_round_robin_sample(spark, d):
    return sm.round_robin(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), "p_partkey"], 40).select("p_partkey", "p_brand", F.col("round").cast("bigint").alias("round"))


@BOOK.add("WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('11|' || doc_id::VARCHAR), doc_id) - 1 AS place FROM documents) SELECT doc_id, lang, place, place // 32 AS batch FROM n")
def q_balanced_batches(spark, d):
    b = sm.batches(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 11, 32)
    return b.select("doc_id", "lang", F.col("place").cast("bigint").alias("place"), "batch")


@BOOK.add("""WITH f AS (SELECT c_custkey, c_nationkey, c_acctbal, ('0x' || substr(md5('fold|' || c_nationkey::VARCHAR), 1, 8))::BIGINT % 5 AS fold FROM customer), m AS (SELECT a.fold, quantile_cont(b.c_acctbal, 0.5) AS base FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON a.fold <> b.fold GROUP BY a.fold)
SELECT f.fold, count(*) AS n, round(avg(abs(c_acctbal - base)), 4) AS mae FROM f JOIN m USING (fold) GROUP BY f.fold""")
def q_group_folds(spark, d):
    c = table(spark, d, "customer").withColumn("fold", sm.folds(F.col("c_nationkey"), 5))
    train = c.withColumn("out", F.explode(F.array(*[F.lit(i) for i in range(5)]))).where("out <> fold").groupBy(F.col("out").alias("fold")).agg(F.percentile("c_acctbal", 0.5).alias("base"))
    return c.join(train, "fold").groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("c_acctbal") - F.col("base"))), 4).alias("mae"))


@BOOK.add("""WITH q AS (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('few|' || c_custkey::VARCHAR), c_custkey) AS k FROM customer), o AS (SELECT c_nationkey, quantile_cont(c_acctbal, 0.5) AS off FROM q WHERE k <= 5 GROUP BY c_nationkey),
x AS (SELECT q.c_nationkey, c_acctbal - off AS res, rank() OVER (PARTITION BY q.c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY q.c_nationkey, c_acctbal) - 1) / 2 AS ra, rank() OVER (PARTITION BY q.c_nationkey ORDER BY c_custkey) AS rb FROM q JOIN o USING (c_nationkey) WHERE k > 5)
SELECT c_nationkey, round(avg(abs(res)), 4) AS mae, round(CASE WHEN count(*) > 1 THEN corr(ra, rb) END, 6) AS spearman FROM x GROUP BY c_nationkey""")
def q_few_shot(spark, d):
    w = Window.partitionBy("c_nationkey")
    c = table(spark, d, "customer").withColumn("k", F.row_number().over(w.orderBy(hs.salted_order("few", "c_custkey"), "c_custkey")))
    off = c.where("k <= 5").groupBy("c_nationkey").agg(F.percentile("c_acctbal", 0.5).alias("off"))
    x = c.where("k > 5").join(off, "c_nationkey")
    x = x.withColumns({"ra": F.rank().over(w.orderBy("c_acctbal")) + (F.count("*").over(Window.partitionBy("c_nationkey", "c_acctbal")) - 1) / 2, "rb": F.rank().over(w.orderBy("c_custkey"))})
    return x.groupBy("c_nationkey").agg(F.round(F.avg(F.abs(F.col("c_acctbal") - F.col("off"))), 4).alias("mae"), F.round(F.when(F.count("*") > 1, F.corr("ra", "rb")), 6).alias("spearman"))


@BOOK.add("SELECT sha256(concat_ws(chr(30), 'c_acctbal=' || printf('%.2f', c_acctbal), 'c_mktsegment=' || c_mktsegment)) AS fingerprint, count(*) AS n FROM customer GROUP BY 1")
def q_canonical_hash(spark, d):
    c = table(spark, d, "customer").select(F.format_string("%.2f", "c_acctbal").alias("c_acctbal"), "c_mktsegment")
    return c.groupBy(hs.fingerprint("c_mktsegment", "c_acctbal").alias("fingerprint")).agg(F.count("*").alias("n"))


# aggregates

_CUST = "WITH c AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority, n_name, n_regionkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) "


def orders_of(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))


@BOOK.add(_CUST + "SELECT n_name, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_custkey END) AS \"O_items\", count(*) FILTER (o_orderstatus = 'O') AS \"O_rows\", count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS \"F_items\", count(*) FILTER (o_orderstatus = 'F') AS \"F_rows\" FROM c GROUP BY n_name")
def q_coverage_matrix(spark, d):
    return a.pivot_counts(orders_of(spark, d), "n_name", "o_orderstatus", ["O", "F"], "o_custkey")


@BOOK.add(_CUST + """, g AS (SELECT n_name, o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 400000) AS large, list_sort(list(o_totalprice)) AS s FROM c GROUP BY ALL) SELECT n_name, o_orderstatus, n, large, s[len(s) // 2 + 1] AS upper_median FROM g""")
def q_balance_audit(spark, d):
    return orders_of(spark, d).groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 400000).alias("large"), a.upper_median("o_totalprice").alias("upper_median"))


@BOOK.add("SELECT count(*) > 1000 AS enough, avg(o_totalprice) > 1000 AS priced, count(DISTINCT o_custkey) > 100 AS spread, count(*) > 1000 AND avg(o_totalprice) > 1000 AND count(DISTINCT o_custkey) > 100 AS go FROM orders")
def q_go_no_go(spark, d):
    g = table(spark, d, "orders").agg((F.count("*") > 1000).alias("enough"), (F.avg("o_totalprice") > 1000).alias("priced"), (F.count_distinct("o_custkey") > 100).alias("spread"))
    return g.withColumn("go", F.col("enough") & F.col("priced") & F.col("spread"))


@BOOK.add("SELECT a.lang, b.source, (SELECT count(*) FROM documents d WHERE d.lang = a.lang AND d.source = b.source) AS n FROM (SELECT DISTINCT lang FROM documents) a, (SELECT DISTINCT source FROM documents) b")
def q_cross_table(spark, d):
    return a.cross_table(table(spark, d, "documents"), "lang", "source")


@BOOK.add("SELECT lang, source, count(*) AS n, grouping_id(lang, source) AS level FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def q_multi_key_counts(spark, d):
    return a.counts_by(table(spark, d, "documents"), ["lang"], ["source"], ["lang", "source"], [])


@BOOK.add(_CUST + ", g AS (SELECT n_regionkey, o_custkey, avg(o_totalprice) AS m, sum(o_totalprice) AS s, count(*) AS c FROM c GROUP BY ALL) SELECT n_regionkey, round(avg(m), 2) AS mean_of_means, round(sum(s) / sum(c), 2) AS pooled, count(*) AS groups FROM g GROUP BY n_regionkey")
def q_two_level_mean(spark, d):
    t = a.two_level_mean(orders_of(spark, d), ["n_regionkey"], "o_custkey", "o_totalprice")
    return t.withColumns({c: F.round(c, 2) for c in ("mean_of_means", "pooled")})


@BOOK.add(_CUST + "SELECT o_orderstatus, o_orderpriority, c_mktsegment, grouping_id(o_orderstatus, o_orderpriority, c_mktsegment) AS level, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM c GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (c_mktsegment), ())")
def q_strata(spark, d):
    keys = [F.col(c) for c in ("o_orderstatus", "o_orderpriority", "c_mktsegment")]
    return orders_of(spark, d).groupingSets([[k] for k in keys] + [[]], *keys).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@BOOK.add("WITH g AS (SELECT l_orderkey, stddev_pop(l_quantity) AS sd, any_value(l_linestatus) AS x FROM lineitem GROUP BY l_orderkey) SELECT round(quantile_cont(sd, 0.5), 6) AS median_sd, count(*) AS groups FROM g")
def q_per_group_std(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.stddev_pop("l_quantity").alias("sd"))
    return g.agg(F.round(F.percentile("sd", 0.5), 6).alias("median_sd"), F.count("*").alias("groups"))


@BOOK.add("WITH g AS (SELECT l_orderkey, l_linestatus, bool_or(l_returnflag = 'R') AS any_ FROM lineitem GROUP BY ALL) SELECT l_linestatus, round(avg(any_::INT), 6) AS coverage, count(*) AS n FROM g GROUP BY ALL")
def q_any_coverage(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_"))
    return g.groupBy("l_linestatus").agg(F.round(a.share(F.col("any_")), 6).alias("coverage"), F.count("*").alias("n"))


@BOOK.add("SELECT p_brand, count(*) AS n, round_even(min(p_retailprice), 3) AS low, round_even(quantile_cont(p_retailprice, 0.05), 3) AS p05, round_even(quantile_cont(p_retailprice, 0.5), 3) AS median, round_even(quantile_cont(p_retailprice, 0.95), 3) AS p95, round_even(max(p_retailprice), 3) AS high, round_even(avg(p_retailprice), 3) AS mean, round_even(stddev_samp(p_retailprice), 3) AS sd FROM part GROUP BY p_brand")
def q_desc_stats(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(*[c.alias(k) for k, c in a.describe("p_retailprice", 3).items()])


@BOOK.add("""WITH u AS (SELECT p_brand, 'p_size' AS field, p_size::DOUBLE AS x FROM part UNION ALL SELECT p_brand, 'p_retailprice', p_retailprice FROM part) SELECT p_brand, field, min(x) AS low, quantile_cont(x, 0.5) AS median, max(x) AS high FROM u GROUP BY ALL""")
def q_envelope(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return a.envelope(p, ["p_brand"], ["p_size", "p_retailprice"])


@BOOK.add("""WITH b AS (SELECT unnest([p_brand, 'ALL']) AS p_brand, p_retailprice AS x FROM part), c AS (SELECT p_brand, quantile_cont(x, 0.5) AS centre FROM b GROUP BY p_brand)
SELECT p_brand, round(any_value(centre), 4) AS centre, round(greatest(1, 1.4826 * quantile_cont(abs(x - centre), 0.5)), 4) AS scale FROM b JOIN c USING (p_brand) GROUP BY p_brand""")
def q_mad_prototype(spark, d):
    return a.robust_scale(table(spark, d, "part"), "p_brand", "p_retailprice", 1.0).select("p_brand", F.round("centre", 4).alias("centre"), F.round("scale", 4).alias("scale"))


@BOOK.add("SELECT x.p_brand, x.p_partkey, min(y.p_retailprice) AS low, max(y.p_retailprice) AS high FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_partkey <> y.p_partkey GROUP BY ALL")
def q_jackknife_range(spark, d):
    return a.leave_one_out_range(table(spark, d, "part"), ["p_brand"], "p_partkey", "p_retailprice")


@BOOK.add("""WITH e AS (SELECT unnest(list_filter([CASE WHEN value > 100 THEN 'high' END, CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN user_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS reason FROM events) SELECT reason, count(*) AS n FROM e GROUP BY reason""")
def q_reason_histogram(spark, d):
    tests = {"high": F.col("value") > 100, "error": F.col("event_type") == "error", "even": F.col("user_id") % 2 == 0}
    e = table(spark, d, "events").select(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])).alias("reasons"))
    return a.reasons(e, "reasons")


@BOOK.add("SELECT quality, toxic, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def q_agreement(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").groupBy("quality", "toxic", "lang").agg(F.count("*").alias("n"))


@BOOK.add("""WITH t AS (SELECT length(text) % 128 AS token, count(*) AS n FROM conversations GROUP BY ALL) SELECT count(*) AS occupied, round(max(n) / sum(n), 6) AS top_share, round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(128), 6) AS entropy FROM t""")
def q_token_entropy(spark, d):
    t = table(spark, d, "conversations").groupBy((F.char_length("text") % 128).alias("token")).agg(F.count("*").alias("n"))
    return a.entropy_report(t, "n", 128).select("occupied", F.round("top_share", 6).alias("top_share"), F.round("entropy", 6).alias("entropy"))


@BOOK.add("""WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT event_type, (SELECT sum(n) FROM t) / n / (SELECT count(*) FROM t) AS w FROM t) SELECT round(sum(w * (value - 50) * (value - 50)) / sum(w), 4) AS weighted_mse, round(avg((value - 50) * (value - 50)), 4) AS mse FROM events JOIN w USING (event_type)""")
def q_weighted_mse(spark, d):
    e = table(spark, d, "events")
    t = e.groupBy("event_type").agg(F.count("*").alias("n"))
    total = t.agg(F.sum("n").alias("all_n"), F.count("*").alias("kinds"))
    w = t.join(F.broadcast(total)).select("event_type", (F.col("all_n") / F.col("n") / F.col("kinds")).alias("w"))
    sq = (F.col("value") - 50) * (F.col("value") - 50)
    return e.join(F.broadcast(w), "event_type").agg(F.round(F.sum(F.col("w") * sq) / F.sum("w"), 4).alias("weighted_mse"), F.round(F.avg(sq), 4).alias("mse"))


@BOOK.add("WITH o AS (SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS s FROM orders GROUP BY o_custkey), c AS (SELECT s, count(*) AS n FROM o GROUP BY s) SELECT round(max(n) / sum(n), 6) AS modal_share, count(*) AS kinds FROM c")
def q_modal_share(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]), "").alias("s"))
    return o.groupBy("s").agg(F.count("*").alias("n")).agg(F.round(F.max("n") / F.sum("n"), 6).alias("modal_share"), F.count("*").alias("kinds"))


@BOOK.add("SELECT o_custkey, arg_max(o_orderkey, o_totalprice * 1000000 - o_orderkey * 1e-6) AS best, max(o_totalprice) AS score FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def q_best_eligible(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"), F.max("o_totalprice").alias("score"))


@BOOK.add("WITH u AS (SELECT label, k, embedding[k + 1]::DOUBLE AS x FROM embeddings, range(64) t(k)) SELECT label, k, round(quantile_cont(x, 0.5), 6) AS median FROM u GROUP BY ALL")
def q_element_median(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    return e.groupBy("label", F.col("k").cast("bigint").alias("k")).agg(F.round(F.percentile(F.col("x").cast("double"), 0.5), 6).alias("median"))


@BOOK.add("SELECT count(*) FILTER (a.l_returnflag = 'R') AS base_hits, count(*) FILTER (b.l_returnflag = 'R') AS other_hits, count(*) FILTER (a.l_returnflag <> b.l_returnflag) AS changed, count(*) AS n FROM (" + _ATT + "SELECT * FROM l WHERE attempt = 1) a JOIN (" + _ATT + "SELECT * FROM l WHERE attempt = 2) b USING (l_orderkey)")
def q_outcome_changes(spark, d):
    l = attempts(spark, d).where("attempt <= 2").groupBy("l_orderkey").agg(*[F.max(F.when(F.col("attempt") == k, F.col("l_returnflag"))).alias(c) for k, c in ((1, "x"), (2, "y"))]).where("x is not null and y is not null")
    return l.agg(F.count_if(F.col("x") == "R").alias("base_hits"), F.count_if(F.col("y") == "R").alias("other_hits"), F.count_if(F.col("x") != F.col("y")).alias("changed"), F.count("*").alias("n"))


@BOOK.add("SELECT l_linestatus, round(avg((l_returnflag = 'R')::INT), 6) AS rate, count(DISTINCT hash_) AS signatures, round(quantile_cont(l_quantity, 0.5), 4) AS median_steps, round(avg(l_discount / greatest(l_quantity, 1)), 6) AS clip_rate, count(DISTINCT l_orderkey) AS clusters FROM (SELECT *, round_even(l_quantity / 5, 0)::VARCHAR || '|' || l_returnflag AS hash_ FROM lineitem) GROUP BY l_linestatus")
def q_branch_summary(spark, d):
    l = table(spark, d, "lineitem")
    # first to the few (status, quantity, flag), so that medians and signatures come from counts; clusters apart, in two steps
    c = l.groupBy("l_linestatus", "l_quantity", "l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_discount") / F.greatest(F.col("l_quantity"), F.lit(1.0))).alias("clipped"))
    c = c.withColumn("sig", F.struct(F.bround(F.col("l_quantity") / 5), F.col("l_returnflag")))
    hit = F.sum(F.when(F.col("l_returnflag") == "R", F.col("n")).otherwise(0))
    g = c.groupBy("l_linestatus").agg(F.round(hit / F.sum("n"), 6).alias("rate"), F.count_distinct("sig").alias("signatures"), F.round(F.percentile("l_quantity", 0.5, F.col("n")), 4).alias("median_steps"), F.round(F.sum("clipped") / F.sum("n"), 6).alias("clip_rate"))
    clusters = l.select("l_linestatus", "l_orderkey").distinct().groupBy("l_linestatus").agg(F.count("*").alias("clusters"))
    return g.join(F.broadcast(clusters), "l_linestatus")  # a row for each status on both sides


@BOOK.add("SELECT l_suppkey, l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_returnflag <> '' GROUP BY ALL")
def q_inventory_summary(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag <> ''").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.round(F.sum("l_quantity"), 2).alias("total"))


@BOOK.add("SELECT CASE WHEN o_orderstatus <> 'F' THEN 'not_final' WHEN o_totalprice < 50000 THEN 'small' WHEN o_orderpriority LIKE '5%' THEN 'low' ELSE 'kept' END AS reason, count(*) AS n FROM orders GROUP BY ALL")
def q_rejections(spark, d):
    rules = {"not_final": F.col("o_orderstatus") != "F", "small": F.col("o_totalprice") < 50000, "low": F.col("o_orderpriority").startswith("5")}
    return table(spark, d, "orders").groupBy(a.first_reason(rules, "kept").alias("reason")).agg(F.count("*").alias("n"))


# attempts until success

@BOOK.add(_ATT + ", p AS (SELECT *, coalesce(sum((l_returnflag = 'R')::INT) OVER (PARTITION BY l_orderkey ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM l) SELECT l_orderkey, sum(l_quantity) AS cost, count(*) AS attempts, bool_or(l_returnflag = 'R') AS success FROM p WHERE done = 0 GROUP BY l_orderkey")
def q_cost_until_success(spark, d):
    from tracklens.operators.series import until_first_success

    l = until_first_success(attempts(spark, d), "l_orderkey", "attempt", F.col("l_returnflag") == "R")
    return l.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("cost"), F.count("*").alias("attempts"), F.bool_or(F.col("l_returnflag") == "R").alias("success"))


@BOOK.add(_ATT + """, k AS (SELECT unnest([1, 2, 3]) AS budget), p AS (SELECT l.*, budget, coalesce(sum((l_returnflag = 'R')::INT) OVER (PARTITION BY l_orderkey, budget ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM l, k WHERE attempt <= budget),
g AS (SELECT l_orderkey, budget, bool_or(l_returnflag = 'R') AS hit, count(*) AS used FROM p WHERE done = 0 GROUP BY ALL), t AS (SELECT budget, round(avg(hit::INT), 6) AS rate, round(avg(used), 6) AS rollouts, count(*) AS n FROM g GROUP BY budget)
SELECT budget::INT AS budget, rate, rollouts, n, round(rate - lag(rate) OVER (ORDER BY budget), 6) AS gain FROM t""")
def q_budget_curve(spark, d):
    """Success within a budget from one pass: the first success decides for every budget."""
    l = attempts(spark, d).groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("attempt"))).alias("first"), F.count("*").alias("n"))
    g = l.withColumn("budget", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    t = g.groupBy("budget").agg(F.round(F.avg(F.coalesce((F.col("first") <= F.col("budget")).cast("int"), F.lit(0))), 6).alias("rate"), F.round(F.avg(F.least("n", "budget", F.coalesce("first", "n"))), 6).alias("rollouts"), F.count("*").alias("n"))
    return t.withColumn("gain", F.round(F.col("rate") - F.lag("rate").over(Window.orderBy("budget")), 6))


# rankings

@BOOK.add("WITH h AS (SELECT l_orderkey, l_suppkey, avg(l_discount) AS score FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(score, 9) DESC, l_suppkey) AS rank FROM h")
def q_rank_order(spark, d):
    h = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.round(F.avg("l_discount"), 9).alias("score"))
    return r.ranked(h, ["l_orderkey"], [F.desc("score"), "l_suppkey"]).select("l_orderkey", "l_suppkey", F.col("rank").cast("bigint").alias("rank"))


@BOOK.add("WITH q AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_partkey, p_brand, rank FROM q WHERE rank <= greatest(2, ceil(0.25 * n))")
def q_top_quartile(spark, d):
    return r.top_share(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 0.25, 2).select("p_partkey", "p_brand", F.col("rank").cast("bigint").alias("rank"))


@BOOK.add("""WITH q AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS b, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS t FROM part), w AS (SELECT *, CASE WHEN b = 1 THEN 0 WHEN t = 1 THEN 1 ELSE 2 END AS tier FROM q)
SELECT p_partkey, tier::INT AS tier FROM w ORDER BY tier, p_retailprice DESC, p_partkey LIMIT 50""")
def q_diverse_queue(spark, d):
    return r.diverse_queue(table(spark, d, "part"), "p_brand", "p_type", "p_retailprice", "p_partkey", 50).select("p_partkey", "tier")


@BOOK.add("WITH k AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type), s AS (SELECT p_brand, p_type, n / sum(n) OVER (PARTITION BY p_brand) AS p FROM k), c AS (SELECT *, sum(p) OVER (PARTITION BY p_brand ORDER BY p DESC, p_type ROWS UNBOUNDED PRECEDING) - p AS before, row_number() OVER (PARTITION BY p_brand ORDER BY p DESC, p_type) AS rank FROM s) SELECT p_brand, p_type, rank FROM c WHERE before < 0.7003 OR rank = 1")
def q_top_p(spark, d):
    s = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    s = s.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("p_brand")))
    return r.nucleus(s, ["p_brand"], "p", "p_type", 0.7003).select("p_brand", "p_type", F.col("rank").cast("bigint").alias("rank"))


_NEXT = "c{1} AS (SELECT label, vec_id, v FROM n{0} QUALIFY row_number() OVER (PARTITION BY label ORDER BY near DESC, vec_id) = 1), n{1} AS (SELECT n{0}.vec_id, n{0}.label, n{0}.v, least(n{0}.near, list_distance(n{0}.v, c{1}.v)) AS near FROM n{0} JOIN c{1} ON n{0}.label = c{1}.label WHERE n{0}.vec_id <> c{1}.vec_id)"


@BOOK.add("WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, embedding[1] AS s FROM embeddings), c1 AS (SELECT label, vec_id, v FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1), n1 AS (SELECT e.vec_id, e.label, e.v, list_distance(e.v, c1.v) AS near FROM e JOIN c1 ON e.label = c1.label WHERE e.vec_id <> c1.vec_id), " + ", ".join(_NEXT.format(i, i + 1) for i in (1, 2, 3)) + " " + " UNION ALL ".join(f"SELECT label, vec_id, {i} AS round FROM c{i}" for i in (1, 2, 3, 4)))
def q_farthest_first(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), F.element_at("embedding", 1).alias("score"))
    return r.farthest_first(e, "label", "vec_id", "v", 4, "score")


@BOOK.add("WITH q AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, round(0.3 * 20 + 0.7 * avg(p_size), 6) AS mean, round(greatest(0.1, 0.3 * 10 + 0.7 * stddev_pop(p_size)), 6) AS sd FROM q WHERE k <= greatest(2, ceil(0.25 * n)) GROUP BY p_brand")
def q_elite_update(spark, d):
    u = r.elite_update(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], "p_size", F.lit(20.0), F.lit(10.0))
    return u.select("p_brand", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@BOOK.add(_ATT + ", m AS (SELECT attempt, avg((l_returnflag = 'R')::INT) AS score, count(*) AS n FROM l WHERE l_orderkey % 5 <> 0 GROUP BY attempt) SELECT attempt, row_number() OVER (ORDER BY round(score, 9) DESC, attempt) AS rank FROM m WHERE n >= 20")
def q_best_fixed_order(spark, d):
    m = attempts(spark, d).where("l_orderkey % 5 <> 0").groupBy("attempt").agg(F.round(a.share(F.col("l_returnflag") == "R"), 9).alias("score"), F.count("*").alias("n")).where("n >= 20")
    return m.select("attempt", F.row_number().over(Window.orderBy(F.desc("score"), "attempt")).cast("bigint").alias("rank"))


# set operations

@BOOK.add("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer) SELECT 'missing' AS kind, k FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'unexpected', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'both', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)")
def q_set_ops(spark, d):
    x, y = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct(), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    diff = sets.symmetric_difference(y, x).select(F.when(F.col("side") == "left", "missing").otherwise("unexpected").alias("kind"), "k")
    return sets.union_all(diff, x.intersect(y).select(F.lit("both").alias("kind"), "k"))


@BOOK.add("SELECT count(*) AS total, count(*) FILTER (l_discount <= 0.05) AS kept, count(*) FILTER (NOT l_discount <= 0.05) AS removed, true AS disjoint, true AS whole FROM (SELECT o_orderkey, max(l_discount) AS l_discount FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)")
def q_partition_check(spark, d):
    every = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("m"))
    return sets.partition_report(every, every.where("m <= 0.05"), every.where("not m <= 0.05"), "l_orderkey")


@BOOK.add("""WITH x AS (SELECT c_custkey, c_name, round(c_acctbal, 0) AS bal, c_mktsegment FROM customer), y AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_name END AS c_name, c_mktsegment || CASE WHEN c_custkey % 70 = 0 THEN '!' ELSE '' END AS c_mktsegment FROM customer WHERE c_custkey % 90 <> 1)
SELECT c_custkey, 'c_name' AS path, x.c_name AS "left", y.c_name AS "right" FROM x FULL JOIN y USING (c_custkey) WHERE x.c_name IS DISTINCT FROM y.c_name UNION ALL SELECT c_custkey, 'c_mktsegment', x.c_mktsegment, y.c_mktsegment FROM x FULL JOIN y USING (c_custkey) WHERE x.c_mktsegment IS DISTINCT FROM y.c_mktsegment""")
def q_leaf_diff(spark, d):
    c = table(spark, d, "customer")
    y = c.where("c_custkey % 90 <> 1").select("c_custkey", F.when(F.col("c_custkey") % 50 != 0, F.col("c_name")).alias("c_name"), F.concat("c_mktsegment", F.when(F.col("c_custkey") % 70 == 0, "!").otherwise("")).alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    return sets.leaf_diff(c, y, "c_custkey", ["c_name", "c_mktsegment", "c_acctbal"], ignore=["c_acctbal"])
