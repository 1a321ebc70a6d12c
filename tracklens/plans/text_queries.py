"""Classification, parsing, contracts and scalar functions on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklens.functions import numbers as nb
from tracklens.operators import classify as c
from tracklens.operators import contracts as k
from tracklens.plans.base import Book, table
from tracklens.plans.series_queries import ORDER, events, numbered
from tracklens.sources.runs import inspect

BOOK = Book()
_E = "WITH e AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) "


@BOOK.add(r"""WITH s AS (SELECT page_id, unnest(string_split(url, '/')) AS segment, generate_subscripts(string_split(url, '/'), 1) - 1 AS depth FROM pages), h AS (SELECT page_id, depth, t.term FROM s JOIN (VALUES ('example'), ('example.com'), ('example.net'), ('en'), ('de'), ('fr')) t(term) ON contains(upper(segment), upper(t.term)))
SELECT p.page_id, (SELECT term FROM h WHERE h.page_id = p.page_id ORDER BY depth DESC, length(term) DESC, term DESC LIMIT 1) AS term, CASE WHEN url LIKE 'https%' THEN 'secure' ELSE 'plain' END AS mode, nullif(regexp_extract(url, '([0-9]+)', 1), '') AS clause FROM pages p""")
def q_path_classify(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    terms = spark.createDataFrame([(t,) for t in ("example", "example.com", "example.net", "en", "de", "fr")], "term string")
    t = c.deepest_term(p, "page_id", "url", terms)
    return p.join(t, "page_id", "left").select("page_id", "term", F.when(F.col("url").startswith("https"), "secure").otherwise("plain").alias("mode"), F.nullif(F.regexp_extract("url", "([0-9]+)", 1), F.lit("")).alias("clause"))


@BOOK.add("SELECT p_partkey, CASE WHEN regexp_matches(upper(p_type), '(^|[^A-Z])STEEL([^A-Z]|$)') THEN 'steel' WHEN regexp_matches(upper(p_type), '(^|[^A-Z])BRASS([^A-Z]|$)') THEN 'brass' WHEN regexp_matches(upper(p_type), '(^|[^A-Z])COPPER([^A-Z]|$)') THEN 'copper' ELSE 'unknown' END AS kind FROM part")
def q_token_class(spark, d):
    return table(spark, d, "part").select("p_partkey", c.token_rule("p_type", ["steel", "brass", "copper"]).alias("kind"))


@BOOK.add(r"SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS number, split_part(p_type, ' ', 1) AS sub_variant, coalesce(nullif(regexp_extract(p_name, '([a-z]+)$', 1), ''), 'none') AS tail, CASE WHEN contains(lower(p_type), 'anodized') THEN 'night' ELSE 'day' END AS light FROM part")
def q_params_regex(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).try_cast("int").alias("number"), F.get(F.split("p_type", " "), 0).alias("sub_variant"), F.coalesce(F.nullif(F.regexp_extract("p_name", "([a-z]+)$", 1), F.lit("")), F.lit("none")).alias("tail"), F.when(F.lower("p_type").contains("anodized"), "night").otherwise("day").alias("light"))


@BOOK.add("WITH g AS (SELECT user_id, list(DISTINCT event_type) AS p FROM events GROUP BY user_id) SELECT user_id, concat_ws(',', CASE WHEN NOT list_contains(p, 'click') THEN 'click' END, CASE WHEN NOT list_contains(p, 'signup') THEN 'signup' END, CASE WHEN NOT list_contains(p, 'refund') THEN 'refund' END) AS missing FROM g")
def q_missing_columns(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("p"))
    return g.select("user_id", c.missing_required(["click", "signup", "refund"], "p").alias("missing"))


@BOOK.add("WITH g AS (SELECT user_id, list(DISTINCT event_type) AS p FROM events WHERE value > 100 GROUP BY user_id) SELECT user_id, len(list_filter(p, lambda x: regexp_matches(x, '^(click|view)'))) > 0 AS browses, list_contains(p, 'purchase') AS buys FROM g")
def q_capabilities(spark, d):
    g = table(spark, d, "events").where("value > 100").groupBy("user_id").agg(F.collect_set("event_type").alias("p"))
    return g.select("user_id", *[x.alias(n) for n, x in c.capabilities("p", {"browses": "^(click|view)", "buys": "^purchase$"}).items()])


@BOOK.add("""WITH l AS (SELECT conv_id, turn, unnest(string_split(replace(text, ' the ', chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, ' the ', chr(10)), chr(10)), 1) - 1 AS k FROM conversations), o AS (SELECT *, turn * 100000 + k AS ord FROM l), s AS (SELECT *, sum((trim(line) = '')::INT) OVER (PARTITION BY conv_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section FROM o)
SELECT conv_id, count(*) AS lines, max(section)::BIGINT AS last_section FROM s GROUP BY conv_id""")
def q_spec_sections(spark, d):
    l = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.replace("text", F.lit(" the "), F.lit("\n")), "\n")).alias("k", "line"))
    w = Window.partitionBy("conv_id").orderBy("turn", "k")
    s = l.withColumn("section", F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(w))
    return s.groupBy("conv_id").agg(F.count("*").alias("lines"), F.max("section").alias("last_section"))


@BOOK.add("SELECT event_id, (props->>'$.k')::INT AS k, coalesce((props->>'$.absent')::INT, -1) AS absent, CASE WHEN (props->>'$.k')::INT > 50 THEN 'late' ELSE 'early' END AS stage FROM events")
def q_json_props(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k int, absent int"))
    return e.select("event_id", "p.k", F.coalesce("p.absent", F.lit(-1)).alias("absent"), F.when(F.col("p.k") > 50, "late").otherwise("early").alias("stage"))


@BOOK.add("""WITH n AS (SELECT DISTINCT p_type AS name FROM part), r AS (SELECT name, CASE WHEN name = 'steel' THEN 0 WHEN replace(lower(name), ' ', '') = 'steel' THEN 1 WHEN starts_with(replace(lower(name), ' ', ''), 'steel') THEN 2 WHEN contains(replace(lower(name), ' ', ''), 'steel') THEN 3 END AS rule FROM n) SELECT name, rule::INT AS rule FROM r WHERE rule IS NOT NULL ORDER BY rule, length(name), name LIMIT 1""")
def q_fuzzy_column(spark, d):
    return c.resolve(table(spark, d, "part").select(F.col("p_type").alias("name")).distinct(), "name", "steel")


@BOOK.add("WITH s AS (SELECT user_id, coalesce(CASE WHEN event_type = 'signup' THEN 1 END, CASE WHEN value > 200 THEN 2 END, CASE WHEN event_type = 'error' THEN 3 END) AS trigger_ FROM events) SELECT user_id, min(trigger_)::INT AS trigger_, CASE min(trigger_) WHEN 1 THEN 'signup' WHEN 2 THEN 'value' WHEN 3 THEN 'error' ELSE 'none' END AS source FROM s GROUP BY user_id")
def q_trigger_priority(spark, d):
    t = F.coalesce(F.when(F.col("event_type") == "signup", 1), F.when(F.col("value") > 200, 2), F.when(F.col("event_type") == "error", 3))
    g = table(spark, d, "events").groupBy("user_id").agg(F.min(t).alias("trigger_"))
    return g.withColumn("source", c.ordered([(F.col("trigger_") == 1, "signup"), (F.col("trigger_") == 2, "value"), (F.col("trigger_") == 3, "error")], "none"))


@BOOK.add("SELECT CASE WHEN contains(lower(text), 'error') OR contains(lower(text), 'no') THEN 'negative' WHEN trim(text) = '' THEN 'blank' WHEN contains(lower(text), 'the') THEN 'plain' ELSE 'other' END AS note, role, count(*) AS n FROM conversations GROUP BY ALL")
def q_note_class(spark, d):
    t = F.lower("text")
    note = c.ordered([(t.contains("error") | t.contains("no"), "negative"), (F.trim("text") == "", "blank"), (t.contains("the"), "plain")], "other")
    return table(spark, d, "conversations").groupBy(note.alias("note"), "role").agg(F.count("*").alias("n"))


@BOOK.add("WITH s AS (SELECT o_orderkey, max(l_quantity) AS travel, max(l_discount) AS force_, min(l_tax) AS tension FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_orderkey, CASE WHEN travel >= 40 AND force_ >= 0.08 THEN 'pressed' WHEN travel >= 40 THEN 'moved' WHEN force_ >= 0.08 THEN CASE WHEN tension > 0.02 THEN 'held' ELSE 'touched' END ELSE 'clear' END AS class FROM s")
def q_signature_class(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("travel"), F.max("l_discount").alias("force_"), F.min("l_tax").alias("tension"))
    moved, forced = F.col("travel") >= 40, F.col("force_") >= 0.08
    return s.select("o_orderkey", c.ordered([(moved & forced, "pressed"), (moved, "moved"), (forced & (F.col("tension") > 0.02), "held"), (forced, "touched")], "clear").alias("class"))


@BOOK.add("SELECT l_orderkey, CASE WHEN a AND NOT b THEN 'script' WHEN b AND NOT a THEN 'policy' WHEN a AND b THEN 'both' ELSE 'none' END AS layer FROM (SELECT l_orderkey, bool_or(l_linestatus = 'O' AND l_returnflag = 'R') AS a, bool_or(l_linestatus = 'F' AND l_returnflag = 'R') AS b FROM lineitem GROUP BY 1)")
def q_failure_layer(spark, d):
    r = F.col("l_returnflag") == "R"
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or((F.col("l_linestatus") == "O") & r).alias("a"), F.bool_or((F.col("l_linestatus") == "F") & r).alias("b"))
    a, b = F.col("a"), F.col("b")
    return g.select("l_orderkey", c.ordered([(a & ~b, "script"), (b & ~a, "policy"), (a & b, "both")], "none").alias("layer"))


@BOOK.add("SELECT page_id, regexp_replace(replace(trim(url), chr(92), '/'), '^https?://', '') AS path, lpad((page_id % 1000)::VARCHAR, 3, '0') AS shard, string_split(url, '/')[3] AS location FROM pages")
def q_path_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.replace(F.trim(u), F.lit("\\"), F.lit("/")), "^https?://", "").alias("path"), F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0").alias("shard"), F.get(F.split(u, "/"), 2).alias("location"))


@BOOK.add("SELECT doc_id, CASE WHEN quality = 1 THEN true WHEN quality = 0 THEN false END AS good FROM labels")
def q_tri_state(spark, d):
    return table(spark, d, "labels").select("doc_id", nb.tri_state(F.col("quality").cast("string")).alias("good"))


@BOOK.add("SELECT p_type, count(*) FILTER (p_brand = 'Brand#11') AS b11, count(*) FILTER (p_brand = 'Brand#12') AS b12, count(DISTINCT p_size) > 1 AS varies FROM part GROUP BY p_type")
def q_one_hot(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count_if(F.col("p_brand") == "Brand#11").alias("b11"), F.count_if(F.col("p_brand") == "Brand#12").alias("b12"), (F.count_distinct("p_size") > 1).alias("varies"))


@BOOK.add("SELECT o_orderkey, least(o_totalprice, 300000) AS clipped FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice < 100000) AND o_orderpriority NOT LIKE '4%'")
def q_pool_rule(spark, d):
    o = table(spark, d, "orders").where("not (o_orderstatus = 'P' and o_totalprice < 100000) and o_orderpriority not like '4%'")
    return o.select("o_orderkey", F.least("o_totalprice", F.lit(300000.0)).alias("clipped"))


@BOOK.add("SELECT source, lang, CASE WHEN contains(source, '1') THEN 'one' WHEN contains(source, '2') THEN 'two' ELSE 'rest' END || '_' || lang AS cohort, count(*) AS n FROM documents GROUP BY ALL")
def q_cohorts(spark, d):
    s = F.col("source")
    kind = c.ordered([(s.contains("1"), "one"), (s.contains("2"), "two")], "rest")
    return table(spark, d, "documents").groupBy("source", "lang", F.concat_ws("_", kind, "lang").alias("cohort")).agg(F.count("*").alias("n"))


@BOOK.add(_E + """, n AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS dt, count(*) OVER (PARTITION BY user_id) AS declared FROM e), h AS (SELECT * FROM n WHERE i <= 50), m AS (SELECT user_id, quantile_cont(dt, 0.5) AS med FROM h GROUP BY user_id),
g AS (SELECT h.user_id, count(*) AS rows_, max(declared) > count(*) AS truncated, coalesce(bool_and(dt > 0), true) AS monotonic, coalesce(max(abs(dt - med)) <= 0.05 * max(med), true) AS uniform FROM h JOIN m ON h.user_id = m.user_id GROUP BY h.user_id)
SELECT *, concat_ws(',', CASE WHEN truncated THEN 'truncated' END, CASE WHEN NOT monotonic THEN 'not_monotonic' END, CASE WHEN NOT uniform THEN 'not_uniform' END) AS reasons FROM g""")
def q_bounded_inspection(spark, d):
    e = events(spark, d).withColumn("declared", F.count("*").over(Window.partitionBy("user_id")))
    e = e.withColumn("o", F.struct(*ORDER))
    return inspect(e, "user_id", "o", "t", "declared", max_rows=50)


@BOOK.add(_E + "SELECT user_id, count(*) AS n, arg_min(value, i) AS first_value, arg_max(value, i) AS last_value, max(t) - min(t) AS span FROM e GROUP BY user_id")
def q_head_tail(spark, d):
    return numbered(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.min_by("value", "i").alias("first_value"), F.max_by("value", "i").alias("last_value"), (F.max("t") - F.min("t")).alias("span"))


@BOOK.add("SELECT count(*) AS rows_, count(*) FILTER (value IS NOT NULL AND NOT isnan(value) AND abs(value) < 400) AS good, count(*) FILTER (NOT (value IS NOT NULL AND NOT isnan(value) AND abs(value) < 400)) AS bad FROM events")
def q_strict_scan(spark, d):
    ok = nb.finite("value") & (F.abs("value") < 400)
    return table(spark, d, "events").agg(F.count("*").alias("rows_"), F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))


@BOOK.add("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_extendedprice DESC) AS k FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, coalesce(nullif(l_discount, 0), 1.8) AS size_ FROM r WHERE k = 1")
def q_last_row_wins(spark, d):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*[F.desc(x) for x in ("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")])
    l = table(spark, d, "lineitem").withColumn("k", F.row_number().over(w)).where("k = 1")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.nullif("l_discount", F.lit(0.0)), F.lit(1.8)).alias("size_"))


@BOOK.add(r"WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT page_id, count(*) AS links, count(DISTINCT href) AS distinct_links FROM t GROUP BY page_id")
def q_markup_tags(spark, d):
    t = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return t.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("distinct_links"))


# contracts

@BOOK.add("""SELECT o_orderkey, unnest(list_filter([CASE WHEN NOT o_totalprice > 2000 THEN 'price' END, CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'status' END, CASE WHEN NOT o_custkey % 10 <> 7 THEN 'customer' END], lambda x: x IS NOT NULL)) AS rule FROM orders""")
def q_violations(spark, d):
    return k.violations(table(spark, d, "orders"), ["o_orderkey"], {"price": F.col("o_totalprice") > 2000, "status": F.col("o_orderstatus").isin("F", "O"), "customer": F.col("o_custkey") % 10 != 7})


@BOOK.add("WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT sum(n)::BIGINT AS rows_, count(*) AS keys, 0::BIGINT AS nulls, max(n) = 1 AS is_unique FROM g")
def q_unique_ids(spark, d):
    return k.uniqueness(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@BOOK.add("SELECT count(*) FILTER (NOT (l_discount BETWEEN 0 AND 0.1)) AS discount_bad, count(*) FILTER (NOT (l_tax BETWEEN 0 AND 0.05)) AS tax_bad, count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) AS flag_bad FROM lineitem")
def q_range_checks(spark, d):
    l = table(spark, d, "lineitem")
    return l.agg(F.count_if(~F.col("l_discount").between(0, 0.1)).alias("discount_bad"), F.count_if(~F.col("l_tax").between(0, 0.05)).alias("tax_bad"), F.count_if(~F.col("l_returnflag").isin("A", "N", "R")).alias("flag_bad"))


@BOOK.add("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS versions, count(DISTINCT c_mktsegment) = 1 AS consistent FROM customer GROUP BY ALL")
def q_version_equality(spark, d):
    return k.one_version(table(spark, d, "customer"), ["c_nationkey"], ["c_mktsegment"])


@BOOK.add("SELECT l_orderkey, count(*) AS rows_, bool_and(l_linestatus = 'O' OR l_quantity > 5) AND count(*) >= 3 AS complete FROM lineitem GROUP BY ALL")
def q_completeness(spark, d):
    return k.complete(table(spark, d, "lineitem"), ["l_orderkey"], {"status": (F.col("l_linestatus") == "O") | (F.col("l_quantity") > 5)}, 3)


@BOOK.add("WITH a AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 11 <> 3), e AS (SELECT doc_id, sha256(CASE WHEN doc_id % 13 = 5 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 17 <> 4) SELECT doc_id, CASE WHEN a.sha IS NULL THEN 'missing' WHEN e.sha IS NULL THEN 'unexpected' WHEN a.sha = e.sha THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN e USING (doc_id)")
def q_hash_verification(spark, d):
    t = table(spark, d, "documents")
    a = t.where("doc_id % 11 <> 3").select("doc_id", F.sha2("text", 256).alias("sha"))
    e = t.where("doc_id % 17 <> 4").select("doc_id", F.sha2(F.when(F.col("doc_id") % 13 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return k.hash_check(a, e, "doc_id", "sha")


@BOOK.add("SELECT event_id FROM events WHERE event_id % 100 = 0")
def q_replay(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return k.replay_differences(e, e.withColumn("value", F.when(F.col("event_id") % 100 == 0, F.col("value") + 1e-3).otherwise(F.col("value"))), ["event_id"], ["value"])


@BOOK.add(_E + ", w AS (SELECT user_id, i // 20 AS g, min(t) AS s, max(t) AS f FROM e GROUP BY ALL) SELECT a.user_id, a.g, a.f + 3600000000 < b.s OR b.f + 3600000000 < a.s AS feasible FROM w a JOIN w b ON a.user_id = b.user_id AND b.g = a.g + 1")
def q_feasible_windows(spark, d):
    w = numbered(spark, d).groupBy("user_id", F.floor(F.col("i") / 20).alias("g")).agg(F.min("t").alias("s"), F.max("t").alias("f"))
    o = Window.partitionBy("user_id").orderBy("g")
    w = w.withColumns({"s2": F.lead("s").over(o), "f2": F.lead("f").over(o)}).where("s2 is not null")
    return w.select("user_id", "g", k.disjoint_windows("s", "f", "s2", "f2", 3_600_000_000).alias("feasible"))


@BOOK.add("""WITH r AS (SELECT l_suppkey, list(DISTINCT l_returnflag) FILTER (l_linestatus = 'O') AS o, list(DISTINCT l_returnflag) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, list_has_any(coalesce(o, []), coalesce(f, [])) AS overlaps, list_has_all(coalesce(f, []), coalesce(o, [])) AS inside FROM r""")
def q_role_sets(spark, d):
    """Whether the return flags of a supplier's open lines overlap those of finished ones, and whether they are a subset."""
    flags = lambda status: F.collect_set(F.when(F.col("l_linestatus") == status, F.col("l_returnflag")))
    r = table(spark, d, "lineitem").groupBy("l_suppkey").agg(flags("O").alias("o"), flags("F").alias("f"))
    return r.select("l_suppkey", F.arrays_overlap("o", "f").alias("overlaps"), (F.size(F.array_except("o", "f")) == 0).alias("inside"))


@BOOK.add("SELECT lang, (SELECT count(*) FROM documents x WHERE x.lang = d.lang AND doc_id % 5 <> 0) AS train_n, (SELECT count(*) FROM documents x WHERE x.lang = d.lang AND doc_id % 5 = 0) AS val_n FROM (SELECT DISTINCT lang FROM documents) d")
def q_modulo_split(spark, d):
    v = F.pmod("doc_id", F.lit(5)) == 0
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(~v).alias("train_n"), F.count_if(v).alias("val_n"))


@BOOK.add("SELECT s_suppkey, k AS perturbation, h AS head, s_suppkey * 100 + k * 10 + h AS seed FROM supplier, range(4) t(k), range(3) u(h)")
def q_evaluation_plan(spark, d):
    """Conditions times perturbations times heads, by two explodes of short ranges."""
    s = table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("perturbation"))
    s = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("head"))
    return s.withColumn("seed", F.col("s_suppkey") * 100 + F.col("perturbation") * 10 + F.col("head"))


@BOOK.add("SELECT d.doc_id, coalesce(p.quality, -1) AS review, p.quality IS NOT NULL AS carried FROM documents d LEFT JOIN labels p USING (doc_id)")
def q_review_upsert(spark, d):
    p = table(spark, d, "labels").select("doc_id", "quality")
    return table(spark, d, "documents").join(p, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("review"), F.col("quality").isNotNull().alias("carried"))


@BOOK.add("WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type, value FROM events) SELECT user_id, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(avg((value > 100)::INT), 6) AS miss_rate FROM e GROUP BY user_id")
def q_latency_percentiles(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.99), 6).alias("p99"), F.round(F.avg((F.col("value") > 100).cast("int")), 6).alias("miss_rate"))
