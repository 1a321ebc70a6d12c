"""Operator 6: host and path rules on URLs, in DataFrame functions only.

Every distinct pair of a host and the start of a path is expanded into
host suffixes and path prefixes, of the label counts and lengths that rules have. The expansions meet the rules by an equi-join
on the first 8 hex digits of SHA-256 of ``host + path`` alone: rules that share them stand in one row. Then the full digests
are compared, and the longest rule wins (of equal length: the longer host, then block).

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, with A-Z lower-cased; the path follows up to ``?``, ``#`` or the end. A
null URL, or one without ``://``, has both empty and fits no rule. A rule fits
its host and all subdomains if the path starts with the rule's path, by
characters. Rules with a null or empty host are left out; a null path counts as empty.
Of rules that repeat with different verdicts, block holds. Null ids and repeated rows are kept;
columns of the input that have the name of one added are replaced.

The work is done on distinct (host, path start) pairs, so one host with a
third of all pages is expanded once. Rules, and the pairs that a rule fits, are broadcast only if they are few
(BROADCAST_RULES, BROADCAST_PAIRS rows); beyond that Spark joins by shuffle, the pairs dealt into SALTS parts, so that
a host with many pages is not one task's. Hosts and paths of any length cost what the rules can reach: the last
labels of the host, as many as the deepest rule has, and the first characters of the path, as many as the longest
rule path has, take part in the expansion; host and path are returned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.llm.spark import cut

BROADCAST_RULES, BROADCAST_PAIRS, SALTS = 20_000, 500_000, 16


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of pages, and host, path, rule, verdict.

    rules: host, path, verdict (allow or block). rule is host + path of the
    rule that wins, else null; verdict is the rule's, else default.
    """
    rules = rules.where("host is not null and host <> ''").select(ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.lower("verdict").alias("said"))
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("said").alias("said"))  # block over allow
    found = rules.select(F.collect_set(F.char_length("rule_path")).alias("lengths"), F.collect_set(F.size(F.split("rule_host", r"\.", -1))).alias("depths"), F.count("*").alias("n")).first()
    lengths, depths, longest = sorted(found.lengths), sorted(found.depths), max(found.lengths, default=0)
    rules = rules.withColumn("digest", F.sha2(F.concat("rule_host", "rule_path"), 256))
    rules = rules.groupBy(F.substring("digest", 1, 8).alias("short")).agg(F.collect_list(F.struct("digest", "rule_host", "rule_path", "said")).alias("same"))
    rules = F.broadcast(rules) if found.n <= BROADCAST_RULES else rules

    pages = pages.drop(*(c for c in ("rule", "verdict", "__start", "__h", "__s", "__salt") if c != url_col))
    marked = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}).withColumn("__start", F.substring("path", 1, longest))
    # the part of the host that rules can reach
    deep = lambda n: F.substring_index("host", ".", -n)
    marked = marked.withColumn("__end", deep(max(depths, default=1)))
    keys = marked.where("host <> ''").select("__end", "__start").distinct()
    labels = F.size(F.split("__end", r"\.", -1))
    suffixes = F.filter(F.array(*[F.when(labels >= n, F.substring_index("__end", ".", -n)) for n in depths] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.char_length("__start") >= n, F.substring("__start", 1, n)) for n in lengths] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    tried = keys.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes)).withColumn("full", F.sha2(F.concat("suffix", "prefix"), 256)).withColumn("near", F.substring("full", 1, 8))
    met = tried.join(rules, F.col("near") == F.col("short")).withColumn("r", F.explode("same"))
    fits = met.where((F.col("r.digest") == F.col("full")) & (F.col("r.rule_host") == F.col("suffix")) & (F.col("r.rule_path") == F.col("prefix")))
    name = F.concat("r.rule_host", "r.rule_path")
    best = fits.groupBy("__end", "__start").agg(F.max(F.struct(F.char_length(name).alias("n"), F.char_length("r.rule_host").alias("h"), F.col("r.said").alias("said"), name.alias("rule"))).alias("best"))
    best = cut(best.select(F.col("__end").alias("__h"), F.col("__start").alias("__s"), "best.rule", F.col("best.said").alias("verdict")))
    same = (F.col("__end") == F.col("__h")) & (F.col("__start") == F.col("__s"))
    if best.count() <= BROADCAST_PAIRS:
        out = marked.join(F.broadcast(best), same, "left")
    else:
        marked = marked.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in pages.dtypes if t in ("bigint", "int", "string")]), F.lit(SALTS)).cast("int"))
        best = best.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = marked.join(best, same & (F.col("__salt") == F.col("__part")), "left")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default))).drop("__h", "__s", "__start", "__end", "__salt", "__part")
