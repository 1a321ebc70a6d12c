"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm import bytepairs, contextmix, counting, decontaminate, filteraudit, langid, minhash, neighbours, pieces, substrings, urls, warc, whitening
from tracklens.llm.spark import read

PIECES = "piece_bpe_32k.model"
PAIRS = "word_bpe_49k.json"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read(spark, sf_dir, "documents"), vocabulary_path(PIECES))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextmix.score_texts(read(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(read(spark, sf_dir, "documents"), vocabulary_path(PIECES))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model).drop("text")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(read(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.digests(read(spark, sf_dir, "documents"), vocabulary_path(PAIRS))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_lm_score": op2_lm_score,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_decontaminate": op5_decontaminate,
    "op6_url_filter": op6_url_filter,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_filter_audit": op12_filter_audit,
    "op13_byte_pairs": op13_byte_pairs,
}

ORACLES: dict[str, str] = {
    "op3_embedding_dedup": """
WITH RECURSIVE n AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9),
r(id, c) AS (SELECT vec_id, vec_id FROM n UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.id)
SELECT n.vec_id, coalesce(k.c, 0) AS n_links, m.c AS component_id, n.vec_id = m.c AS kept FROM n
JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = n.vec_id LEFT JOIN (SELECT a, count(*) AS c FROM l GROUP BY a) k ON k.a = n.vec_id""",
    "op5_decontaminate": r"""
WITH w AS (SELECT doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT DISTINCT id, len(w) - 4 AS size, p, array_to_string(w[p:p + 4], ' ') AS x FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS p FROM w)),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
b AS (SELECT item_id, x, count(*) AS c FROM (SELECT item_id, p, array_to_string(w[p:p + 4], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM iw)) GROUP BY ALL),
s AS (SELECT item_id, sum(c)::INT AS s FROM b GROUP BY ALL),
hit AS (SELECT h.id, h.p, h.x, h.size, b.item_id, b.c, s.s FROM h JOIN b USING (x) JOIN s USING (item_id)),
t AS (SELECT DISTINCT id, item_id, s, size, unnest(range(least(greatest(1, p - s + 1), greatest(1, size - s + 1)), least(p, greatest(1, size - s + 1)) + 1)) AS start FROM hit),
o AS (SELECT t.id, t.item_id, t.s, t.size, t.start, hit.x, least(count(*), any_value(hit.c)) AS m FROM t JOIN hit ON t.id = hit.id AND t.item_id = hit.item_id AND hit.p BETWEEN t.start AND t.start + t.s - 1 GROUP BY ALL),
r AS (SELECT id, item_id, s, s + least(s, size) AS weight, start, sum(m)::BIGINT AS shared FROM o GROUP BY ALL HAVING shared * 9 >= 4 * weight)
SELECT id AS doc_id, item_id, max(shared / (weight - shared)) AS similarity, arg_max(start - 1, shared * 1000000000 - start)::BIGINT AS start_word, (any_value(s) + 4)::BIGINT AS n_words FROM r GROUP BY id, item_id""",
    "op6_url_filter": r"""
WITH u AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '^((?s).*?)://([^/?#]*)', 2), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^((?s).*?)://[^/?#]*([^?#]*)', 2), '') AS path FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT u.host, u.path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
    FROM (SELECT DISTINCT host, path FROM u) u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path""",
    "op7_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS p FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.a, r.m FROM r JOIN l ON l.b = r.id),
g AS (SELECT id, min(m) AS m FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.m AS component_id, d.doc_id = g.m AS kept FROM documents d JOIN g ON g.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op8_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM w)),
f AS (SELECT x, min(doc_id) AS first FROM k GROUP BY x),
g AS (SELECT DISTINCT doc_id, p + d AS p FROM (SELECT k.doc_id, k.p FROM k JOIN f USING (x) WHERE f.first < k.doc_id), range(13) t(d)),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
o AS (SELECT u.doc_id, count(*) AS n_words, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY u.p) AS kept FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.p = u.p GROUP BY u.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN o USING (doc_id)""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT hex, max(page_id) AS first FROM s GROUP BY hex),
d AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4)) & 31)::INT, 1), '' ORDER BY i) AS payload_digest
    FROM f, range(32) t(i) GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to
FROM s JOIN f USING (hex) JOIN d USING (hex)""",
    "op12_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(first < t.doc_id, false)::INT AS mask
    FROM t JOIN e USING (text) LEFT JOIN l ON l.doc_id = t.doc_id),
f(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits FROM f p, f q, f r, f s, f u WHERE p.b | q.b | r.b | s.b | u.b = 31),
k AS (SELECT filter_order, bits, unnest(range(1, 6))::INT AS step FROM o),
c AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS before FROM k),
g AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
a AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (bit | coalesce(before, 0)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0) = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0) <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (good AND mask & bit <> 0 AND mask & coalesce(before, 0) = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (toxic AND mask & bit <> 0 AND mask & coalesce(before, 0) = 0), 0)::BIGINT AS toxic_lost
    FROM g, c GROUP BY ALL)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM a""",
}
