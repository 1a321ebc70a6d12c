"""Runs, files and corpora: gates, screening, scans of text, audits, streams and baselines on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklens.functions import hashing as hs
from tracklens.functions import numbers as nb
from tracklens.lineage import shared_dir
from tracklens.operators import classify as c
from tracklens.operators import contracts as k
from tracklens.operators import corpora, models, scenes, sets
from tracklens.operators import inference as x
from tracklens.operators import sampling as sm
from tracklens.operators import vectors as v
from tracklens.operators.order import ranked
from tracklens.plans import series_queries as sq
from tracklens.plans.base import Book, table
from tracklens.sources import files, records, runs, texts, units
from tracklens.sources.ranges import listing

BOOK = Book()

# gates and classes


@BOOK.add("SELECT doc_id, CASE WHEN source LIKE '%3' THEN 'no_spec' WHEN n_chars / 1000 <= 0.1 THEN 'tiny_txt' WHEN len(string_split(text, ' ')) <= 50 THEN 'few_channels' ELSE '' END AS reason FROM documents")
def q_validity_gates(spark, d):
    return table(spark, d, "documents").select("doc_id", c.validity(~F.col("source").like("%3"), F.col("n_chars") / 1000, F.size(F.split("text", " "))).alias("reason"))


_CONTACT = "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), g AS (SELECT user_id, min(value) - 2 AS nearest, arg_min(event_id % 40, i) FILTER (value <= 3) AS speed FROM e GROUP BY user_id) "


@BOOK.add(_CONTACT + "SELECT user_id, CASE WHEN nearest > 2 THEN 'clear' WHEN nearest > 0.5 THEN 'near' WHEN speed IS NOT NULL AND abs(nearest) <= 0.8 AND speed <= 15 THEN 'contact_and_stopped' ELSE 'passed' END AS outcome FROM g")
def q_contact_outcome(spark, d):
    e = sq.numbered(spark, d)
    g = e.groupBy("user_id").agg((F.min("value") - 2).alias("nearest"), F.min_by(F.when(F.col("value") <= 3, F.col("event_id") % 40), F.when(F.col("value") <= 3, F.col("i"))).alias("speed"))
    return g.select("user_id", c.contact_outcome(F.col("nearest"), F.col("speed"), 0.5, 0.8, 15, 2.0).alias("outcome"))


_SCREEN = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT user_id, user_id % 3 = 0 AS quiet, coalesce(max(value) FILTER (event_type = 'error' AND i > 5), 0) AS win, coalesce(max(value) FILTER (event_type = 'error' AND i <= 5), 0) AS pre, min(i - 5) FILTER (event_type = 'error' AND i > 5 AND value > 60) AS first_,
    CASE WHEN avg(value) < 45 THEN 'static_no_force' WHEN avg(value) < 55 THEN 'static' ELSE 'dragged' END AS signature, count(*) % 2 = 0 AS judged FROM e GROUP BY user_id),
p AS (SELECT *, CASE WHEN NOT judged AND signature LIKE '%no_force' THEN 'signature_without_force' ELSE signature END AS plain FROM g) """


@BOOK.add(_SCREEN + """SELECT user_id, CASE WHEN quiet THEN CASE WHEN win > 60 THEN 'command_against_status' ELSE plain END WHEN win > 60 THEN CASE WHEN first_ > 4 THEN 'joined_in_window' ELSE 'commanded_window' END
WHEN pre > 60 THEN CASE WHEN pre <= 90 THEN 'light_touch_before' ELSE 'large_pulse_before' END ELSE plain END AS class FROM p""")
def q_screen_class(spark, d):
    e = sq.numbered(spark, d).withColumn("cmd", F.when(F.col("event_type") == "error", F.col("value")))
    late = F.col("i") > 5
    g = e.groupBy("user_id").agg(
        F.coalesce(F.max(F.when(late, F.col("cmd"))), F.lit(0.0)).alias("win"), F.coalesce(F.max(F.when(~late, F.col("cmd"))), F.lit(0.0)).alias("pre"), F.min(F.when(late & (F.col("cmd") > 60), F.col("i") - 5)).alias("first_"),
        F.avg("value").alias("mean"), (F.count("*") % 2 == 0).alias("judged"),
    )
    signature = c.ordered([(F.col("mean") < 45, "static_no_force"), (F.col("mean") < 55, "static")], "dragged")
    return g.select("user_id", c.screen_class(F.col("user_id") % 3 == 0, F.col("win"), F.col("pre"), F.col("first_"), signature, F.col("judged"), 60, 4, 90).alias("class"))


@BOOK.add("SELECT * FROM (" + sq.BOOK.sql["q_event_features"] + ") f JOIN (" + _SCREEN + "SELECT user_id, signature, win, pre FROM p) p USING (user_id) JOIN (" + _CONTACT + "SELECT user_id, round(nearest, 6) AS nearest FROM g) n USING (user_id) WHERE f.n > 0")
def q_screen_runs(spark, d):
    """A run's screening end to end: event features, command activity and signature, nearest distance; one row a run with an event."""
    e = sq.numbered(spark, d).withColumn("cmd", F.when(F.col("event_type") == "error", F.col("value")))
    late = F.col("i") > 5
    g = e.groupBy("user_id").agg(F.coalesce(F.max(F.when(late, F.col("cmd"))), F.lit(0.0)).alias("win"), F.coalesce(F.max(F.when(~late, F.col("cmd"))), F.lit(0.0)).alias("pre"), F.avg("value").alias("mean"), F.round(F.min("value") - 2, 6).alias("nearest"))
    g = g.withColumn("signature", c.ordered([(F.col("mean") < 45, "static_no_force"), (F.col("mean") < 55, "static")], "dragged")).drop("mean")
    return sq.q_event_features(spark, d).where("n > 0").join(g, "user_id")


_MAP = "WITH m AS (SELECT p_partkey, p_size % 4 AS trigger, p_partkey % 3 AS slot, CASE WHEN p_size % 5 = 0 THEN 'CAN user defined ' || (p_partkey % 9)::VARCHAR || CASE WHEN p_size % 2 = 0 THEN ' - ' || p_type ELSE '' END ELSE p_name END AS v, p_brand FROM part) "


@BOOK.add(_MAP + r"SELECT p_partkey, trigger::BIGINT AS trigger, slot, regexp_extract(v, '^CAN user defined (\d+)', 1)::BIGINT AS channel, trim(regexp_extract(v, '^CAN user defined \d+ - (.*)$', 1)) AS label, CASE WHEN regexp_matches(lower(trim(regexp_extract(v, '^CAN user defined \d+ - (.*)$', 1))), 'brass|steel') THEN 'by_label' WHEN p_brand LIKE '%1' THEN 'by_context' ELSE 'unconfirmed' END AS status FROM m WHERE v LIKE 'CAN user defined%'")
def q_channel_mappings(spark, d):
    value = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("CAN user defined "), (F.col("p_partkey") % 9).cast("string"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" - "), F.col("p_type"))).otherwise(""))).otherwise(F.col("p_name"))
    m = table(spark, d, "part").withColumn("entries", F.create_map(F.concat(F.lit("Tolerance"), (F.col("p_size") % 4).cast("string"), F.lit("Slot"), (F.col("p_partkey") % 3).cast("string")), value))
    e = m.select("p_partkey", "p_brand", F.explode("entries").alias("name", "value")).where(F.col("value").rlike(r"^CAN user defined \d+"))
    part = lambda x, p: F.regexp_extract(x, p, 1)
    e = e.withColumn("label", F.trim(part("value", r"^CAN user defined \d+ - (.*)$")))
    return e.select("p_partkey", part("name", r"^Tolerance(\d+)").cast("bigint").alias("trigger"), part("name", r"Slot(\d+)$").cast("bigint").alias("slot"), part("value", r"^CAN user defined (\d+)").cast("bigint").alias("channel"), "label", c.mapping_status(F.col("label"), F.col("p_brand").like("%1"), ["brass", "steel"]).alias("status"))


@BOOK.add("SELECT c_custkey, CASE n_regionkey WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM customer JOIN nation ON n_nationkey = c_nationkey")
def q_split_policy(spark, d):
    policy = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), c.ordered([(F.col("n_regionkey") == 0, "test"), (F.col("n_regionkey") == 1, "val")], "train").alias("split"))
    return c.lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", policy, "split").select("c_custkey", "split")


@BOOK.add("SELECT lang, CASE WHEN contains(lower(text), 'night') THEN 'night' WHEN contains(lower(text), 'day') THEN 'day' ELSE '' END AS light, count(*) AS n FROM documents GROUP BY ALL")
def q_light(spark, d):
    return table(spark, d, "documents").groupBy("lang", c.light("text").alias("light")).agg(F.count("*").alias("n"))


@BOOK.add("""SELECT doc_id, CASE WHEN quality IS NULL THEN CASE WHEN source LIKE '%7' THEN 'robot' ELSE 'unreviewed' END WHEN toxic = 1 THEN 'excluded' WHEN quality = 1 AND lang = 'en' THEN 'driver_confirmed' WHEN quality = 1 THEN 'driver' ELSE 'system' END AS reading,
coalesce(toxic = 0 AND quality = 1, false) AS eligible FROM documents LEFT JOIN labels USING (doc_id)""")
def q_reviewed_sources(spark, d):
    """Reviewed records beside all runs; the review decides first, then what the run says."""
    j = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    by_run = c.ordered([(F.col("source").like("%7"), "robot")], "unreviewed")
    reading = F.when(F.col("quality").isNull(), by_run).when(F.col("toxic") == 1, "excluded").when((F.col("quality") == 1) & (F.col("lang") == "en"), "driver_confirmed").when(F.col("quality") == 1, "driver").otherwise("system")
    return j.select("doc_id", reading.alias("reading"), F.coalesce((F.col("toxic") == 0) & (F.col("quality") == 1), F.lit(False)).alias("eligible"))


# scalars


@BOOK.add("SELECT event_id, round(value * 0.44704, 9) AS from_mph, round(value / 3.6, 9) AS from_kmh, round((event_id % 1000) / 10, 9) AS seconds FROM events")
def q_units(spark, d):
    number = F.col("value").cast("string")
    return table(spark, d, "events").select("event_id", F.round(files.speed_limit(F.concat(number, F.lit(" mph"))), 9).alias("from_mph"), F.round(files.speed_limit(number), 9).alias("from_kmh"), F.round(F.col("event_id") % 1000 / 10, 9).alias("seconds"))


@BOOK.add(r"WITH t AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS last FROM pages) SELECT page_id, last, CASE WHEN isfinite(try_cast(trim(last) AS DOUBLE)) THEN try_cast(trim(last) AS DOUBLE) END AS number FROM t")
def q_safe_number(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("last")).withColumn("number", nb.to_double("last"))


_UTM = """WITH k AS (SELECT 1 / 298.257223563 / (2 - 1 / 298.257223563) AS n), p AS (SELECT c_custkey, radians(35 + c_custkey % 300 / 20) AS phi, radians(c_nationkey / 6 + 1 - 3) AS lam, n, 2 * sqrt(n) / (1 + n) AS e, 0.9996 * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS s,
n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3 FROM customer, k), q AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM p), r AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM q) """


@BOOK.add(_UTM + "SELECT c_custkey, round(500000 + s * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS easting, round(s * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS northing FROM r")
def q_projection(spark, d):
    x, y = nb.utm(35 + F.col("c_custkey") % 300 / 20, F.col("c_nationkey") / 6 + 1)
    return table(spark, d, "customer").select("c_custkey", F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"))


# text and tables of runs

_LINES = "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events) "


def run_files(spark, d):
    """(run, lines): the events of each user as a text export: banner, number of points, names, units, rows."""
    e = sq.numbered(spark, d).withColumn("line", F.concat_ws("\t", F.col("i").cast("string"), F.when(F.col("event_id") % 11 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")), F.col("event_type")))
    rows = e.groupBy(F.col("user_id").alias("run")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("rows"))
    head = F.array(F.lit("export"), F.concat(F.lit("Points="), F.size("rows")), F.lit("Point\tValue\tKind"), F.lit("-\tm\t-"))
    return rows.select("run", F.concat(head, "rows").alias("lines"))


@BOOK.add(_LINES + 'SELECT user_id AS run, seq, CASE WHEN event_id % 11 <> 0 THEN value END AS "Value" FROM e')
def q_run_scan(spark, d):
    return runs.parse_runs(run_files(spark, d), ["Value"])


@BOOK.add(_LINES + 'SELECT user_id AS run, seq, CASE WHEN event_id % 11 <> 0 THEN value END AS "Value", (seq + 1)::DOUBLE AS "Point", event_id % 11 <> 0 AS good FROM e')
def q_run_scan_strict(spark, d):
    return runs.parse_runs(run_files(spark, d), ["Value", "Point"], strict=True)


@BOOK.add("""WITH l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'Type' ELSE 'key' || (o_orderkey % 4)::VARCHAR END AS name, o_orderpriority AS value FROM orders),
t AS (SELECT o_custkey, list(value ORDER BY seq) AS types FROM l WHERE name = 'Type' GROUP BY o_custkey)
SELECT l.o_custkey AS run, name, arg_min(value, seq) AS value, array_to_string(any_value(types), ';') AS types FROM l LEFT JOIN t ON t.o_custkey = l.o_custkey GROUP BY l.o_custkey, name""")
def q_spec_scan(spark, d):
    o = table(spark, d, "orders").withColumn("line", F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.lit("Type")).otherwise(F.concat(F.lit("key"), (F.col("o_orderkey") % 4).cast("string"))), F.lit(" = "), F.col("o_orderpriority")))
    f = o.groupBy(F.col("o_custkey").alias("run")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]).alias("lines"))
    return runs.parse_specs(f).withColumn("types", F.array_join("types", ";"))


@BOOK.add("SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars, count(*) FILTER (role = 'user') AS by_user FROM conversations WHERE turn % 5 <> 4 GROUP BY conv_id")
def q_json_lines(spark, d):
    t = table(spark, d, "conversations")
    value = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    lines = t.select(F.col("conv_id").cast("string").alias("file"), F.when(F.col("turn") % 5 == 4, F.concat(F.lit("{broken"), value)).otherwise(value).alias("value"))
    good, _ = files.parse_jsonl(lines, "conv_id long, turn long, role string, text string")
    return good.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "user").alias("by_user"))


@BOOK.add("SELECT user_id::VARCHAR AS file, count(*) AS rows_, count(*) FILTER (event_id % 7 = 0) AS unparsable FROM events GROUP BY user_id")
def q_csv_scan(spark, d):
    """Track rows whose number doesn't parse are counted by file."""
    e = table(spark, d, "events")
    lines = e.select(F.col("user_id").cast("string").alias("file"), F.concat_ws(",", F.col("event_id").cast("string"), F.when(F.col("event_id") % 7 == 0, F.lit("bad")).otherwise(F.col("value").cast("string"))).alias("value"))
    return files.tracks_of_csv(lines, "track_id long, x double", ["track_id", "x"])[1]


@BOOK.add(r"WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages), s AS (SELECT DISTINCT path[:-2] AS stem FROM p WHERE path LIKE '%2') SELECT path, path[:-2] AS stem, s.stem IS NOT NULL AS has_companion FROM p LEFT JOIN s ON s.stem = p.path[:-2] WHERE path LIKE '%1'")
def q_discovery(spark, d):
    """Runs by name, and whether a companion stands beside them: paths that end in 1 and 2 stand for export and sidecar."""
    f = table(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path"))
    f = f.withColumn("path", F.regexp_replace("path", "1$", ".txt")).withColumn("path", F.regexp_replace("path", "2$", ".spec"))
    found = files.discover(f, r"\.txt$", ".spec")
    return found.select(F.concat("stem", F.lit("1")).alias("path"), "stem", "has_companion")


@BOOK.add("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'stale' END AS state FROM documents WHERE doc_id % 4 = 0 OR doc_id % 4 = 1 AND doc_id % 3 = 0")
def q_pending_units(spark, d):
    units = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    done = units.where("doc_id % 4 <> 0").withColumn("sha", F.when((F.col("doc_id") % 4 == 1) & (F.col("doc_id") % 3 == 0), "changed").otherwise(F.col("sha")))
    return files.pending(units, done, "doc_id", "sha").select("doc_id", "state")


@BOOK.add("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS shard, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 16 AS row FROM documents")
def q_row_pointers(spark, d):
    return sm.row_pointers(table(spark, d, "documents").select("doc_id", "source"), ["doc_id"], 16, ["source"])


@BOOK.add("WITH i AS (SELECT source AS file, count(*) AS n FROM documents GROUP BY source) SELECT file, CASE WHEN file LIKE '%1' THEN 'version' ELSE 'row_count' END AS problem FROM i WHERE file LIKE '%1' OR file LIKE '%2'")
def q_shard_check(spark, d):
    """Shards by source; the manifest of some has an old version or a row too many."""
    index = table(spark, d, "documents").groupBy(F.col("source").alias("file")).agg(F.count("*").alias("rows_"))
    manifest = index.select("file", (F.col("rows_") + F.when(F.col("file").like("%2"), 1).otherwise(0)).alias("rows_"), F.when(F.col("file").like("%1"), "v0").otherwise("v1").alias("version"))
    return files.shard_check(manifest, index, "v1")


@BOOK.add("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents), s AS (SELECT * FROM o WHERE n <= 5 OR list_contains([round_even(k * (n - 1) / 4, 0)::BIGINT for k in range(5)], i))
SELECT source, doc_id, n AS files_, n_chars, length(text) <> n_chars AS size_differs, len(string_split(text, ' ')) AS words, CASE WHEN n_chars > 2000 THEN 'truncated' ELSE '' END AS reason FROM s""")
def q_dataset_audit(spark, d):
    """An evenly spaced sample of each source, peeked at, beside the size of the source."""
    docs = table(spark, d, "documents")
    some = sm.evenly(docs.select("source", "doc_id"), ["source"], ["doc_id"], 5).select("doc_id")  # ids alone are ranked
    sizes = docs.groupBy("source").agg(F.count("*").alias("files_"))
    peeked = docs.join(some, "doc_id", "left_semi").join(sizes, "source")
    return peeked.select("source", "doc_id", "files_", "n_chars", (F.length("text") != F.col("n_chars")).alias("size_differs"), F.size(F.split("text", " ")).alias("words"), F.when(F.col("n_chars") > 2000, "truncated").otherwise("").alias("reason"))


# contracts


@BOOK.add("""WITH g AS (SELECT p_partkey, p_size * 8 AS width, p_size % 7 + 1 AS heads, p_size % 4 + 1 AS chunk, 50 AS future, p_partkey % 300 AS vocabulary, p_size % 9 AS budget FROM part)
SELECT p_partkey, unnest(list_filter([CASE WHEN width % heads <> 0 THEN 'heads' END, CASE WHEN future % chunk <> 0 THEN 'chunks' END, CASE WHEN vocabulary > 255 THEN 'ignore_index' END, CASE WHEN budget > 6 THEN 'budget' END, CASE WHEN chunk = heads THEN 'roles' END], lambda x: x IS NOT NULL)) AS rule FROM g""")
def q_config_invariants(spark, d):
    """Configurations with the invariants they break: divisors, the index that is ignored, budgets, roles that overlap."""
    g = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 8).alias("width"), (F.col("p_size") % 7 + 1).alias("heads"), (F.col("p_size") % 4 + 1).alias("chunk"), (F.col("p_partkey") % 300).alias("vocabulary"), (F.col("p_size") % 9).alias("budget"))
    return k.violations(g, ["p_partkey"], {"heads": F.col("width") % F.col("heads") == 0, "chunks": 50 % F.col("chunk") == 0, "ignore_index": F.col("vocabulary") <= 255, "budget": F.col("budget") <= 6, "roles": ~F.arrays_overlap(F.array("chunk"), F.array("heads"))})


@BOOK.add("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'changed' WHEN doc_id % 10 = 4 THEN 'unlisted' WHEN doc_id % 10 = 5 THEN 'missing' ELSE 'same' END AS state FROM documents")
def q_provenance(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    manifest = t.where("doc_id % 10 <> 4").withColumn("sha", F.when(F.col("doc_id") % 10 == 3, "old").otherwise(F.col("sha")))
    return k.provenance(manifest, t.where("doc_id % 10 <> 5"), "doc_id", "sha")


@BOOK.add("SELECT label AS token, embedding[1] AS first_, 64 AS dim FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)")
def q_codebook_reuse(spark, d):
    """A codebook with a token for each label (its first vector), taken over only if whole."""
    e = table(spark, d, "embeddings").groupBy(F.col("label").alias("token")).agg(F.min_by("embedding", "vec_id").alias("c"))
    size = table(spark, d, "embeddings").select("label").distinct().count()
    return models.reuse_codebook(e, size, 64).select("token", F.get("c", 0).alias("first_"), F.size("c").alias("dim"))


# corpora and streams


@BOOK.add("SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier")
def q_union_sources(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return sets.union_all(a, b)


_STREAM = "WITH s AS (SELECT doc_id, source, pass, row_number() OVER (PARTITION BY source ORDER BY pass, sha256('11|' || pass::VARCHAR || '|' || doc_id::VARCHAR), doc_id) - 1 AS place FROM documents, range(3) t(pass)) "


@BOOK.add(_STREAM + "SELECT doc_id, source, pass, place, place // 4 AS batch FROM s WHERE place >= 6")
def q_batch_stream(spark, d):
    """Three passes over each source, each in an order of its own, resumed at place 6."""
    s = sm.stream(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 11, 3, 4)
    return s.where("place >= 6")


@BOOK.add(_STREAM + "SELECT source, sum(n)::BIGINT AS shown, count(*) AS distinct_, max(n) AS most FROM (SELECT source, doc_id, count(*) AS n FROM s WHERE place < 30 GROUP BY ALL) GROUP BY source")
def q_exposure(spark, d):
    s = sm.stream(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 11, 3, 4)
    return sm.exposure(s.where("place < 30"), "source", "doc_id")


_U = "(('0x' || substr(md5('w4|{0}|' || o_orderkey::VARCHAR || '|' || k::VARCHAR), 1, 8))::BIGINT % 1000000) / 1e6"


@BOOK.add("WITH t AS (SELECT o_orderkey, k, 5 + 15 * " + _U.format("speed") + " AS speed, 10 + 50 * " + _U.format("gap") + " AS gap, 0.1 + 0.4 * " + _U.format("delay") + " AS delay, 3 + 6 * " + _U.format("limit") + """ AS lim FROM orders, range(8) r(k)),
c AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN speed * delay + speed * speed / (2 * lim) < gap THEN k - 1000 ELSE -k END) AS o FROM t) SELECT o_orderkey, round(speed, 9) AS speed, round(gap, 9) AS gap, round(delay, 9) AS delay, round(lim, 9) AS "limit" FROM c WHERE o = 1""")
def q_scenarios(spark, d):
    """Parameters of a scenario for every order, drawn by hash until they can be driven."""
    return sm.scenarios(table(spark, d, "orders"), "o_orderkey", "w4").select("o_orderkey", *[F.round(x, 9).alias(x) for x in ("speed", "gap", "delay", "limit")])


@BOOK.add("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS attempt FROM lineitem),
e AS (SELECT l_orderkey, attempt, l_returnflag || '|' || round_even(l_quantity / 5, 0)::VARCHAR AS sig, l_quantity FROM l WHERE l_returnflag <> 'N' AND l_quantity > 5),
u AS (SELECT l_orderkey, sig, min(attempt) AS attempt, arg_min(l_quantity, attempt) AS q FROM e GROUP BY ALL), g AS (SELECT l_orderkey, list(q ORDER BY attempt) AS q FROM u GROUP BY l_orderkey)
SELECT l_orderkey, len(q) AS n, round(coalesce(q[1], 0), 4) AS p1, round(coalesce(q[2], 0), 4) AS p2, round(coalesce(q[3], 0), 4) AS p3, CASE WHEN (('0x' || substr(sha256('pulse' || l_orderkey::VARCHAR), 1, 16))::UBIGINT::HUGEINT * 100) // 18446744073709551616::HUGEINT < 90 THEN 'train' ELSE 'val' END AS split FROM g""")
def q_pulse_corpus(spark, d):
    """A corpus of action sets: eligible attempts, one of each signature, padded to three, split by condition so that none is in both."""
    from tracklens.plans.table_queries import attempts

    l = attempts(spark, d).where("l_returnflag <> 'N' and l_quantity > 5").withColumn("sig", F.concat_ws("|", "l_returnflag", F.bround(F.col("l_quantity") / 5).cast("string")))
    u = l.groupBy("l_orderkey", "sig").agg(F.min("attempt").alias("attempt"), F.min_by("l_quantity", "attempt").alias("q"))
    g = u.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("attempt", "q"))), lambda x: x["q"]).alias("q"))
    return g.select("l_orderkey", F.size("q").alias("n"), *[F.round(F.coalesce(F.get("q", i), F.lit(0.0)), 4).alias(f"p{i + 1}") for i in range(3)], hs.salted_split("pulse", "l_orderkey").alias("split"))


@BOOK.add("""WITH u AS (SELECT doc_id, source, lang, doc_id % 6 AS ord, row_number() OVER (PARTITION BY source, lang, sha256(text) ORDER BY doc_id % 6, doc_id) AS k FROM documents WHERE lang IN ('en', 'de')),
r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY ord, doc_id) AS n FROM u WHERE k = 1), c AS (SELECT 160 // count(DISTINCT source) AS each FROM documents)
SELECT doc_id, source, lang FROM r, c WHERE n <= greatest(1, CASE lang WHEN 'en' THEN each * 3 // 5 ELSE each * 2 // 5 END)""")
def q_quota_corpus(spark, d):
    """Examples by source and language up to quotas, from files that are read in rounds until the quotas are full."""
    out = _in_shared(spark, "corpus")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text", (F.col("doc_id") % 6).alias("part"))
    docs.repartition("source", "part").write.partitionBy("source", "part").parquet(out)
    place = lambda f: (F.regexp_extract(f, "source=([^/]*)/", 1), F.regexp_extract(f, "part=([0-9]+)/", 1).cast("int"))
    grp, part = place("file")
    found = listing(spark, out, "*.parquet").select("file", grp.alias("grp"), part.alias("ord"))

    def read(names):
        g, o = place(F.col("_metadata.file_path"))
        return spark.read.parquet(*names).select(o.alias("ord"), g.alias("grp"), F.col("lang").alias("kind"), F.col("doc_id").alias("place"), F.sha2("text", 256).alias("key"))

    taken, _ = corpora.quota_corpus(found, read, 160, {"en": (3, 5), "de": (2, 5)})
    return taken.select(F.col("place").alias("doc_id"), F.col("grp").alias("source"), F.col("kind").alias("lang"))


@BOOK.add("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS attempt FROM lineitem),
s AS (SELECT l_orderkey, list(l_quantity::DOUBLE ORDER BY attempt) AS q FROM l GROUP BY l_orderkey), e AS (SELECT o_orderkey, q FROM orders JOIN s ON l_orderkey = o_orderkey WHERE o_orderkey % 7 <> 0 AND o_orderstatus = 'F' AND o_totalprice > 100000)
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'dual' ELSE 'single' END AS branch, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, len(q)::INT AS steps, list_concat(q, list_transform(range(0, (SELECT max(len(q)) FROM e) - len(q)), lambda x: 0.0::DOUBLE)) AS target FROM e""")
def q_sequence_corpus(spark, d):
    """Sequences of valid, dangerous solutions of training conditions, padded; development conditions are disjoint, every fifth validates."""
    from tracklens.plans.table_queries import attempts

    seq = attempts(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("attempt", "l_quantity"))), lambda x: x["l_quantity"]).alias("q"))
    o = table(spark, d, "orders").withColumn("branch", F.when(F.col("o_orderkey") % 2 == 0, "dual").otherwise("single")).withColumn("fingerprint", F.sha2(F.col("o_orderkey").cast("string"), 256))
    train, dev = o.where("o_orderkey % 7 <> 0"), o.where("o_orderkey % 7 = 0")
    solved = train.join(seq, "o_orderkey").withColumn("index", F.col("o_orderkey"))
    good = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)
    return corpora.sequence_corpus(solved, train.select("branch", "o_orderkey", "fingerprint"), dev, ["branch", "o_orderkey"], "fingerprint", good, "q", "index").drop("mask")


_LANES = """WITH pts AS (SELECT c_nationkey AS relation, CASE WHEN c_custkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 2 ORDER BY c_custkey) - 1 AS ord, c_acctbal / 1000 AS lat, c_custkey / 100.0 AS lon FROM customer),
n AS (SELECT relation, arg_min({l: lat, o: lon}, ord) FILTER (side = 'left') AS l0, arg_max({l: lat, o: lon}, ord) FILTER (side = 'left') AS l1, arg_min({l: lat, o: lon}, ord) FILTER (side = 'right') AS r0, arg_max({l: lat, o: lon}, ord) FILTER (side = 'right') AS r1, max(ord) FILTER (side = 'right') AS last FROM pts GROUP BY relation),
f AS (SELECT relation, last, sqrt((l0.l - r1.l) ** 2 + (l0.o - r1.o) ** 2) + sqrt((l1.l - r0.l) ** 2 + (l1.o - r0.o) ** 2) < sqrt((l0.l - r0.l) ** 2 + (l0.o - r0.o) ** 2) + sqrt((l1.l - r1.l) ** 2 + (l1.o - r1.o) ** 2) AS flip FROM n) """


@BOOK.add(_LANES + "SELECT pts.relation, side, CASE WHEN side = 'right' AND flip THEN last - ord ELSE ord END AS ord, lat, lon FROM pts JOIN f USING (relation)")
def q_lane_borders(spark, d):
    """Lanes as relations of a left and a right way; customers of a nation are the nodes."""
    cust = table(spark, d, "customer")
    way = F.col("c_nationkey") * 2 + F.col("c_custkey") % 2
    order = F.row_number().over(Window.partitionBy(way).orderBy("c_custkey")) - 1
    maps = {
        "node": cust.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("lat"), (F.col("c_custkey") / F.lit(100.0)).alias("lon")),
        "way_node": cust.select(way.alias("way"), order.alias("ord"), F.col("c_custkey").alias("node")),
        "member": cust.select(F.col("c_nationkey").alias("relation"), F.when(F.col("c_custkey") % 2 == 0, "left").otherwise("right").alias("role"), way.alias("ref")).distinct(),
    }
    return scenes.lanes(maps)


def _in_shared(spark, kind):
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _exports(spark, d):
    """Events as text exports in the shared folder, a file a user."""
    out = _in_shared(spark, "runs")
    rows = sq.numbered(spark, d).select("user_id", F.col("i").alias("Point"), F.col("t").alias("Time"), "value")
    runs.write_runs(rows, out, "user_id", ["Point"], {"Point": "-", "Time": "us", "value": "m"})
    return out


def _user(c="run"):
    return F.regexp_extract(c, r"user_id=(-?\d+)/", 1).cast("bigint").alias("user_id")


@BOOK.add(_LINES + "SELECT user_id, count(*)::INT AS declared, 3 AS channels, min(epoch_us(ts))::DOUBLE AS first_time, max(epoch_us(ts))::DOUBLE AS last_time FROM e GROUP BY user_id")
def q_run_peek(spark, d):
    """Declared points, channels, first and last time of exports, from the first and last 8 KiB of each file."""
    return runs.peek(spark, _exports(spark, d)).select(_user(), "declared", "channels", "first_time", "last_time")


@BOOK.add(_LINES + """, n AS (SELECT *, epoch_us(ts) AS t, count(*) OVER (PARTITION BY user_id) AS declared FROM e), h AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY seq) AS dt FROM n WHERE seq < 40), m AS (SELECT user_id, quantile_cont(dt, 0.5) AS med FROM h GROUP BY user_id),
g AS (SELECT h.user_id, max(declared)::INT AS declared, count(*) AS rows_, max(declared) > count(*) AS truncated, coalesce(bool_and(dt > 0), true) AS monotonic, coalesce(max(abs(dt - med)) <= 0.05 * max(med), true) AS uniform FROM h JOIN m ON h.user_id = m.user_id GROUP BY h.user_id)
SELECT *, concat_ws(',', CASE WHEN truncated THEN 'truncated' END, CASE WHEN NOT monotonic THEN 'not_monotonic' END, CASE WHEN NOT uniform THEN 'not_uniform' END) AS reasons FROM g""")
def q_run_inspection(spark, d):
    """At most 40 rows of each export, read from its beginning alone: truncation, order and step of the times."""
    g = runs.inspect_files(spark, _exports(spark, d), max_rows=40)
    return g.select(_user(), "declared", "rows_", "truncated", "monotonic", "uniform", "reasons")


@BOOK.add("SELECT source AS unit, CASE WHEN source < 'src15' THEN 'reused' ELSE 'converted' END AS state, count(*) FILTER (length(text) > 100) AS rows_, sum(length(text)) FILTER (length(text) > 100)::BIGINT AS chars FROM documents GROUP BY source")
def q_unit_conversion(spark, d):
    """A conversion by source that some units have behind them: these are reused, the others are converted, and every unit is there once."""
    out = _in_shared(spark, "units")
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    prints = docs.groupBy("source").agg(F.sum(F.xxhash64("doc_id", "text").cast("decimal(20,0)")).cast("string").alias("sha"))
    long = lambda x: x.where("length(text) > 100")
    units.convert_units(prints.where("source < 'src15'"), docs, out, "source", "sha", long)
    state = units.convert_units(prints, docs, out, "source", "sha", long, batches=3, rows_per_file=200)
    chars = units.read_units(spark, out).groupBy(F.col("source").alias("unit")).agg(F.sum(F.length("text")).alias("chars"))
    return state.join(chars, "unit", "left").select("unit", "state", F.col("rows").alias("rows_"), "chars")


@BOOK.add("SELECT doc_id, sha256(text) AS sha, length(text) AS chars FROM documents WHERE doc_id % 9 = 4")
def q_pointer_reads(spark, d):
    """Samples read by pointers to the shards that were written: pointers come from the files, and only these files are opened."""
    out = _in_shared(spark, "shards")
    files.write_shards(table(spark, d, "documents").withColumn("split", hs.salted_split("p", "doc_id")), out, rows=64)
    found = units.pointers(spark, out, ["doc_id"]).where("doc_id % 9 = 4")
    return units.read_pointers(found).select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").cast("bigint").alias("chars"))


RECORD_SPLIT = 64 << 10  # far below a file, so that each is read by many tasks


@BOOK.add("SELECT octet_length(encode(text)) AS bytes, sha256(text) AS sha, count(*) AS n FROM documents GROUP BY ALL")
def q_record_round_trip(spark, d):
    """Texts as framed records in files, read again by byte ranges: every record once, whatever range its bytes lie in."""
    out = _in_shared(spark, "records")
    records.write_records(table(spark, d, "documents").select(F.col("text").cast("binary").alias("record")), out)
    got = records.read_records(spark, out, splitBytes=RECORD_SPLIT)
    return got.groupBy(F.octet_length("record").cast("bigint").alias("bytes"), F.sha2("record", 256).alias("sha")).agg(F.count("*").alias("n"))


@BOOK.add("""SELECT CASE WHEN doc_id % 50 = 3 THEN 'checksum' WHEN doc_id % 50 = 17 THEN 'length' ELSE 'good' END AS problem, count(*) AS n, sum(octet_length(encode(text)) + CASE WHEN doc_id % 50 = 17 THEN 16 ELSE 0 END)::BIGINT AS bytes FROM documents GROUP BY ALL""")
def q_damaged_records(spark, d):
    """Framed texts of which some have a wrong checksum and some a broken length: both are told, and all others are read."""
    out = _in_shared(spark, "records")
    f = records.frames(table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("b")), "b", "f").withColumn("n", F.octet_length("f"))
    wrong = F.concat(F.substring("f", 1, F.col("n") - 4), F.unhex(F.lit("00000000")))
    hurt = F.concat(F.unhex(F.lit("FFFFFFFF")), F.substring("f", 5, F.col("n") - 4))
    f = f.withColumn("record", F.when(F.col("doc_id") % 50 == 3, wrong).when(F.col("doc_id") % 50 == 17, hurt).otherwise(F.col("f")))
    records.write_records(f.sortWithinPartitions("doc_id"), out, framed=True)
    got = records.read_records(spark, out, splitBytes=RECORD_SPLIT, mode="keep")
    return got.groupBy(F.coalesce("problem", F.lit("good")).alias("problem")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def _scenarios(spark, d):
    """A scenario of each user: events are states of one track, those with an even id points of a lane."""
    n = sq.numbered(spark, d).withColumn("s", F.col("t") / F.lit(1e6))
    state = F.struct(F.col("s").alias("t"), F.col("value").alias("x"), F.col("event_id").cast("double").alias("y"), F.col("value").cast("float").alias("vx"), F.lit(0.5).cast("float").alias("vy"), (F.col("event_id") % 7 != 0).alias("valid"))
    rows = n.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("i", state.alias("st")))).alias("a"))
    even = F.transform(F.filter("a", lambda v: v["st"]["y"] % 2 == 0), lambda v: F.struct(v["st"]["x"].alias("x"), v["st"]["y"].alias("y")))
    t = rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("scenario"), F.col("user_id").cast("long").alias("track"), F.lit(2).cast("long").alias("kind"), F.transform("a", lambda v: v["st"]).alias("states"), even.alias("points"), F.lit(25.0).alias("speed"))
    out = _in_shared(spark, "scenarios")
    records.write_records(records.encode_scenarios(t), out)
    return out


@BOOK.add(_LINES + "SELECT 'u' || user_id::VARCHAR AS scenario, user_id::BIGINT AS track, 2::BIGINT AS kind, seq::BIGINT AS frame, round(epoch_us(ts) / 1e6, 6) AS t, value AS x, event_id::DOUBLE AS y, round(value::FLOAT::DOUBLE, 6) AS vx, event_id % 7 <> 0 AS valid FROM e")
def q_scenario_states(spark, d):
    """States of binary scenario records, written and read by byte ranges; wire fields are decoded by number and kind."""
    s = records.read_scenarios(spark, _scenarios(spark, d), splitBytes=RECORD_SPLIT)
    return s.select("scenario", "track", "kind", "frame", F.round("t", 6).alias("t"), "x", "y", F.round("vx", 6).alias("vx"), "valid")


@BOOK.add(_LINES + "SELECT 'u' || user_id::VARCHAR AS scenario, user_id::VARCHAR AS feature, 'lane_center' AS kind, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS ord, value AS x, event_id::DOUBLE AS y, 11.176 AS speed FROM e WHERE event_id % 2 = 0")
def q_scenario_lanes(spark, d):
    """Points of lanes in scenario records, with the limit in metres a second."""
    return records.read_map_points(spark, _scenarios(spark, d), splitBytes=RECORD_SPLIT).withColumn("speed", F.round("speed", 9))


@BOOK.add("SELECT 'customer' AS kind, c_custkey::VARCHAR AS id, c_name AS name, '' AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, '', s_nationkey::VARCHAR FROM supplier")
def q_csv_round_trip(spark, d):
    """Two sources in one CSV data set with a byte-order mark, read again by trial of encodings; what a source lacks is empty."""
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    out = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    files.write_csv(out, a, b)
    return texts.read_csv_auto(spark, f"{out}/*.csv", split_bytes=RECORD_SPLIT).select("kind", "id", "name", "nation")


@BOOK.add(r"""SELECT doc_id::VARCHAR AS id, sha256(regexp_replace(text, '[\x00\r]', '', 'g')) AS sha, coalesce(lang, '') AS lang FROM documents""")
def q_csv_texts(spark, d):
    """Whole texts, with their line feeds, commas and quotes, as quoted cells of CSV files that are read by ranges far below a file's size."""
    out = _in_shared(spark, "csv")
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[\\x00\\r]", "").alias("text"), "lang")
    t.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(out)
    return texts.read_csv_auto(spark, f"{out}/*.csv", split_bytes=RECORD_SPLIT).select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"), "lang")


@BOOK.add("SELECT source, count(*) * 65 AS bytes, count(DISTINCT lang)::BIGINT AS files_ FROM documents GROUP BY source")
def q_inventory(spark, d):
    """Sizes of files by source and language, from the listing alone: each holds a digest and a line feed for every document."""
    out = _in_shared(spark, "inventory")
    lines = table(spark, d, "documents").select("source", "lang", F.sha2("text", 256).alias("line"))
    lines.repartition("source", "lang").write.partitionBy("source", "lang").text(out)
    found = files.inventory(spark, out, "*.txt").withColumn("source", F.regexp_extract("path", "source=([^/]*)/", 1))
    return found.groupBy("source").agg(F.sum("size").alias("bytes"), F.count("*").alias("files_"))


@BOOK.add("""SELECT label::VARCHAR AS file, 'v' AS name, 'float64' AS kind, count(*) AS rows_, 64 AS wide, round(sum(list_sum(embedding::DOUBLE[])), 6) AS total FROM embeddings GROUP BY label
UNION ALL SELECT label::VARCHAR, 'vec_id', 'int64', count(*), 1, sum(vec_id)::DOUBLE FROM embeddings GROUP BY label""")
def q_array_archives(spark, d):
    """Vectors and ids as NumPy archives of at most 64 samples, unpacked again."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    got = files.parse_npz(files.archives(e, "label", "vec_id", ["vec_id", "v"], rows=64)).withColumn("file", F.substring_index("file", "-", 1))
    wide = F.coalesce(F.get("shape", F.lit(1)), F.lit(1)).cast("int")
    sums = got.withColumns({"wide": wide, "part": F.aggregate("values", F.lit(0.0), lambda a, b: a + b)})
    return sums.groupBy("file", "name", "kind", "wide").agg(F.sum(F.get("shape", F.lit(0))).alias("rows_"), F.round(F.sum("part"), 6).alias("total"))


@BOOK.add("SELECT c_mktsegment AS segment, c_custkey::VARCHAR AS id, c_name AS name FROM customer")
def q_group_csv(spark, d):
    """A CSV folder for each group, read again with the group as a column."""
    out = _in_shared(spark, "groups")
    c_ = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    files.write_csv(out, c_, mark=False, by=["segment"])
    return spark.read.option("header", True).csv(out).select("segment", "id", "name")


@BOOK.add("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id, sha256(text) AS sha FROM documents")
def q_input_order(spark, d):
    """Inputs hashed wherever they are, told in the order of the input list."""
    t = table(spark, d, "documents")
    return ranked(t.select("doc_id", F.sha2("text", 256).alias("sha")), [], ["doc_id"], "ord").select((F.col("ord") - 1).alias("ord"), "doc_id", "sha")


@BOOK.add("SELECT unnest(['p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS \"column\"")
def q_varying_columns(spark, d):
    p = table(spark, d, "part").withColumns({"fixed": F.lit("x"), "nothing": F.lit(None).cast("string")})
    return c.varying(p, ["p_name", "p_brand", "fixed", "p_type", "p_size", "nothing", "p_retailprice"])


@BOOK.add("SELECT o_orderkey, list_contains(s, 'ship') AS ships, list_contains(s, 'audit') AS audits, len(s) AS stages FROM (SELECT o_orderkey, list_filter(['read', CASE WHEN o_orderstatus = 'F' THEN 'ship' END, CASE WHEN o_totalprice > 100000 THEN 'audit' END], lambda x: x IS NOT NULL) AS s FROM orders)")
def q_stage_selection(spark, d):
    """Which stages of a plan run, by membership in an array."""
    s = F.array_compact(F.array(F.lit("read"), F.when(F.col("o_orderstatus") == "F", "ship"), F.when(F.col("o_totalprice") > 100000, "audit")))
    return table(spark, d, "orders").withColumn("s", s).select("o_orderkey", F.array_contains("s", "ship").alias("ships"), F.array_contains("s", "audit").alias("audits"), F.size("s").alias("stages"))


@BOOK.add("WITH g AS (SELECT l_suppkey, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY l_suppkey) SELECT round(avg(v), 6) AS within, round(var_pop(m), 6) AS between, round(sqrt(avg(v)), 6) AS rms_within, round(stddev_pop(m), 6) AS rms_between FROM g")
def q_variance_variants(spark, d):
    return x.variance_variants(table(spark, d, "lineitem"), "l_suppkey", "l_quantity").select(*[F.round(k_, 6).alias(k_) for k_ in ("within", "between", "rms_within", "rms_between")])


@BOOK.add("""WITH s AS (SELECT vec_id, embedding[1]::DOUBLE * 40 AS x, embedding[2]::DOUBLE * 40 AS y, label * 0.4 AS yaw FROM embeddings), f AS (SELECT vec_id, abs((3 - x) * cos(yaw) + (1 - y) * sin(yaw)) - 2 AS du, abs((1 - y) * cos(yaw) - (3 - x) * sin(yaw)) - 1 AS dv FROM s)
SELECT vec_id, round(sqrt(greatest(du, 0) ** 2 + greatest(dv, 0) ** 2) + least(greatest(du, dv), 0) - 0.5, 6) AS clearance FROM f""")
def q_circle_clearance(spark, d):
    """Boxes against a round obstacle at (3, 1)."""
    s = table(spark, d, "embeddings").select("vec_id", (F.get("embedding", 0).cast("double") * 40).alias("x"), (F.get("embedding", 1).cast("double") * 40).alias("y"), (F.col("label") * 0.4).alias("yaw"))
    return s.select("vec_id", F.round(v.clearance_circle("x", "y", "yaw", F.lit(4.0), F.lit(2.0), F.lit(3.0), F.lit(1.0), F.lit(0.5)), 6).alias("clearance"))


@BOOK.add("""WITH l AS (SELECT c_custkey, 'spec.segment' AS path, c_mktsegment AS "left", CASE WHEN c_custkey % 70 = 0 THEN c_mktsegment || '!' ELSE c_mktsegment END AS "right" FROM customer UNION ALL SELECT c_custkey, 'spec.name.text', c_name, CASE WHEN c_custkey % 50 <> 0 THEN c_name END FROM customer UNION ALL SELECT c_custkey, 'more', NULL, 'new' FROM customer WHERE c_custkey % 40 = 0) SELECT * FROM l WHERE "left" IS DISTINCT FROM "right" """)
def q_nested_diff(spark, d):
    t = table(spark, d, "customer")
    nest = lambda name, segment: F.struct(segment.alias("segment"), F.struct(name.alias("text"), F.col("c_acctbal").alias("noise")).alias("name"))
    a = t.select("c_custkey", nest(F.col("c_name"), F.col("c_mktsegment")).alias("spec"))
    b = t.select("c_custkey", nest(F.when(F.col("c_custkey") % 50 != 0, F.col("c_name")), F.concat("c_mktsegment", F.when(F.col("c_custkey") % 70 == 0, "!").otherwise(""))).alias("spec"), F.when(F.col("c_custkey") % 40 == 0, "new").alias("more"))
    return sets.nested_diff(a, b, "c_custkey", ignore=["spec.name.noise"])


@BOOK.add("""WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS i FROM lineitem), g AS (SELECT l_orderkey, list({i: i, c: l_linenumber} ORDER BY i) FILTER (l_returnflag = 'R') AS picks, count(*) AS n FROM l GROUP BY l_orderkey)
SELECT c.c AS candidate, count(*) AS picked, round(count(*) / sum(count(*)) OVER (), 6) AS density, round(avg(i), 6) AS mean_place FROM (SELECT unnest(picks) AS c, (unnest(picks)).i AS i FROM g) GROUP BY c.c""")
def q_candidate_histogram(spark, d):
    """How often each candidate was chosen, from nested lists of choices a condition."""
    from tracklens.plans.table_queries import attempts

    l = attempts(spark, d)
    g = l.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct((F.col("attempt") - 1).alias("i"), F.col("l_linenumber").alias("c")))).alias("picks"))
    h = g.select(F.explode("picks").alias("p")).groupBy(F.col("p.c").alias("candidate")).agg(F.count("*").alias("picked"), F.round(F.avg("p.i"), 6).alias("mean_place"))
    total = h.agg(F.sum("picked").alias("_total"))
    return h.join(F.broadcast(total)).select("candidate", "picked", F.round(F.col("picked") / F.col("_total"), 6).alias("density"), "mean_place")  # one row


@BOOK.add("""SELECT (SELECT count(*) FROM documents) AS rows_, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS repeated_ids, (SELECT count(*) FROM documents WHERE text IS NULL OR n_chars <> length(text)) AS wrong_sizes,
(SELECT count(*) FROM (SELECT sha256(text) AS s FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT sha256(text) FROM documents WHERE doc_id % 5 <> 0)) AS leaks, (SELECT count(*) FROM (SELECT source FROM documents GROUP BY source HAVING count(DISTINCT doc_id % 5 = 0) > 1)) AS shared_groups""")
def q_dataset_verification(spark, d):
    """A data set's checks in one row: sizes, repeated ids, texts and groups on both sides of a split."""
    t = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"), (F.col("doc_id") % 5 == 0).alias("held"))
    both = lambda key: t.groupBy(key).agg(F.bool_or("held").alias("a"), F.bool_or(~F.col("held")).alias("b")).agg(F.count_if(F.col("a") & F.col("b")).alias("n"))
    sums = t.agg(F.count("*").alias("rows_"), F.count_if(F.col("chars").isNull() | (F.col("n_chars") != F.col("chars"))).alias("wrong_sizes"))
    ids = t.groupBy("doc_id").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("repeated_ids"))
    return sums.join(ids).join(both("sha").withColumnRenamed("n", "leaks")).join(both("source").withColumnRenamed("n", "shared_groups"))  # single rows


_TYPES = ["line_thin", "curbstone", "virtual", "pedestrian_marking", "stop_line", "fence"]


@BOOK.add("SELECT p_partkey AS way, CASE p_partkey % 6 WHEN 0 THEN 'lane_boundary' WHEN 1 THEN 'road_boundary' WHEN 2 THEN 'lane_boundary' WHEN 3 THEN 'crosswalk' WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN 'other' ELSE 'stop_line' END ELSE 'other' END AS kind FROM part")
def q_way_kinds(spark, d):
    """Kinds of map lines: parts are ways, some without a type tag."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("way"), "p_size", F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.col("p_partkey") % 6 + 1).cast("int")).alias("v"))
    return files.way_kinds(p.where("not (v = 'stop_line' and p_size % 2 = 0)").select("way", F.lit("type").alias("k"), "v"), p)


@BOOK.add("WITH m AS (SELECT c_custkey AS relation, c_nationkey AS ref FROM customer), r AS (SELECT n_nationkey AS ref, CASE WHEN n_nationkey % 3 = 1 THEN (30 + n_nationkey) / 3.6 END AS lim FROM nation WHERE n_nationkey % 3 <> 0) SELECT relation, round(coalesce(max(lim), 0), 9) AS speed FROM m LEFT JOIN r USING (ref) GROUP BY relation")
def q_lane_speeds(spark, d):
    """Speed limits of lanes: customers are lanes, nations the rules that they refer to."""
    cust, nation = table(spark, d, "customer"), table(spark, d, "nation")
    rule = nation.select((F.col("n_nationkey") + 10_000_000).alias("relation"), F.explode(F.create_map(
        F.lit("type"), F.lit("regulatory_element"), F.lit("subtype"), F.when(F.col("n_nationkey") % 3 == 0, "right_of_way").otherwise("speed_limit"), F.lit("sign_type"), F.when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("de"), F.col("n_nationkey") + 30)).otherwise("unknown"),
    )).alias("k", "v"))
    lane = cust.select(F.col("c_custkey").alias("relation"), F.lit("type").alias("k"), F.lit("lanelet").alias("v"))
    member = cust.select(F.col("c_custkey").alias("relation"), F.lit("regulatory_element").alias("role"), (F.col("c_nationkey") + 10_000_000).alias("ref"))
    return files.lane_speeds(rule.union(lane), member).withColumn("speed", F.round("speed", 9))


@BOOK.add()
def q_boosted_baseline(spark, d):
    """(target, model_error, mean_error, auc): boosted trees against the mean, for prices; and how well a boosted classifier tells returns apart."""
    l = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), "l_quantity", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("double").alias("label"), (F.crc32(F.concat_ws("|", "l_orderkey", "l_linenumber").cast("binary")) % 5 == 0).alias("test"))
    return models.boosted_baseline(l, ["l_quantity", "l_discount", "l_tax"], "y", "label", "test").drop("residual_errors").withColumn("target", F.lit("price"))
