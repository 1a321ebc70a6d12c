"""Operator 12: what each filter removes under every order of the filters, by direct relational replay.

Five conditions are told for every document, from its whole text (null: empty), each a bit of a mask:

- A: fewer than 50 words (maximal runs without ASCII white space, case-sensitive);
- B: fewer than 65 distinct words in 100;
- C: more than 5 capitals A-Z in 100 code points;
- D: any of # $ % & * |;
- E: a document with a smaller id has the identical text, whatever becomes of that document.

Every document's mask is crossed with the 120 orders of the filters (a broadcast table of this fixed size), which gives
the step of its first failure in each order; five steps are exploded, and counts by part, order and step are conditional
sums. The 600 rows of a document never leave their task: sums are combined there before the shuffle, which
moves at most 600 rows for each task and part, however many documents a part holds.

Identical texts are told by SHA-256 and length. A text that holds more than one document in HOT is joined by broadcast: there are fewer
than HOT such texts. All others are joined by shuffle, and none of them holds more than its share of it.

Null and empty texts have no words, so they fail A alone of A to D, and are identical to each other. Documents
without an id are counted and never count as smaller ones, nor do they fail E; equal ids are not smaller than each other. Repeated rows
count each. A null source is the part of the empty string. Several labels of a document count as 1 where any of them is 1;
null labels and those of null ids count for nothing. Without documents there are no rows. Other columns of docs and labels are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.llm.spark import cut

FILTERS = "ABCDE"
HOT = 1000
_SPACES = "\t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _bit(condition: Column, letter: str) -> Column:
    return F.when(condition, 1 << FILTERS.index(letter)).otherwise(0)


def flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of every row; the mask holds A to D."""
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split(F.translate("text", _SPACES, " " * len(_SPACES)), " "), ""))
    points, words, distinct = F.char_length("text"), F.size("words"), F.size(F.array_distinct("words"))
    capitals = points - F.char_length(F.translate("text", _CAPITALS, ""))
    mask = (
        _bit(words < 50, "A") + _bit(F.lit(100) * distinct.cast("long") < F.lit(65) * words.cast("long"), "B")
        + _bit(F.lit(100) * capitals.cast("long") > F.lit(5) * points.cast("long"), "C") + _bit(F.col("text").rlike("[#$%&*|]"), "D")
    )
    digest = F.concat(F.unhex(F.sha2("text", 256)), F.unhex(F.hex(F.octet_length("text").cast("long"))))
    return d.select("doc_id", "part", digest.alias("digest"), mask.alias("mask"))


def with_copies(told: DataFrame) -> DataFrame:
    """told with E in the mask; told should be cut, since it is read three times."""
    same = cut(told.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").drop("most"))
    bound = told.count() / HOT
    hot, rest = F.broadcast(same.where(F.col("n") > bound)), same.where(F.col("n") <= bound)
    joined = told.join(hot, "digest").unionByName(told.join(hot, "digest", "left_anti").join(rest, "digest", "left"), allowMissingColumns=True)
    return joined.select("doc_id", "part", (F.col("mask") + _bit(F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)), "E")).alias("mask"))


def orders(docs: DataFrame) -> DataFrame:
    """All 120 orders: filter_order and the bits of its five filters."""
    rows = [("".join(p), *[1 << FILTERS.index(x) for x in p]) for p in permutations(FILTERS)]
    return docs.sparkSession.createDataFrame(rows, "filter_order string, b1 int, b2 int, b3 int, b4 int, b5 int")


def replay(judged: DataFrame) -> DataFrame:
    """Counts by (part, filter_order, step) of rows (part, mask, good, toxic)."""
    crossed = judged.crossJoin(F.broadcast(orders(judged)))
    failed = F.lit(6)
    for k in range(5, 0, -1):
        failed = F.when(F.col("mask").bitwiseAND(F.col(f"b{k}")) != 0, k).otherwise(failed)
    steps = crossed.select("part", "filter_order", "mask", "good", "toxic", failed.alias("failed"), F.inline(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"b{k}").alias("bit")) for k in range(1, 6)])))
    fails, here = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("failed") == F.col("step")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))

    return steps.groupBy("part", "filter_order", "step").agg(
        total(F.col("failed") > F.col("step")).alias("kept"),
        total(here).alias("removed"),
        total(fails & (F.col("failed") < F.col("step"))).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"),
        total(here & F.col("toxic")).alias("toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), zeros included."""
    judged = with_copies(cut(flags(docs)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("good or toxic")
    judged = judged.join(known, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    counts = cut(replay(judged))  # 600 rows a part
    own = F.substring("filter_order", F.col("step"), F.lit(1)).alias("letter")
    shares = counts.groupBy("part", own).agg(F.sum("removed").alias("shapley"))
    return counts.withColumn("letter", own).join(shares, ["part", "letter"]).drop("letter")
