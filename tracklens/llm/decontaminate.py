"""Operator 5: benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

A document is contaminated by an item if a window of it, with as many words
as the item (the whole document, if it has fewer), has a weighted-shingle similarity of at least num/den to it. Words are
``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Shingles are ``k`` words (an item with fewer
words is one shingle); the weight of a shingle is how often it occurs, and the
similarity is the sum of the smaller weights over the sum of the larger.

1. A window that shares no shingle with any item of its size has similarity 0; an equi-join
   finds the positions that hold a shingle of an item, and every window around one is made.
2. Each of them gets a 64-bit SimHash, the bitwise majority of its shingle hashes, counted in
   bit-sliced counters.
3. Windows meet items of the same size by a multi-index, which alone makes the candidates: 64 bits in BLOCKS blocks;
   two fingerprints within RADIUS bits agree in some block up to RADIUS // BLOCKS
   bits, and items are entered under all such keys, so no fingerprint within the radius is
   missed. Shingles that differ by a fifth move about 10 bits, with a deviation of 3; RADIUS is 20.
4. Exact weighted similarity decides.

Null or empty texts and items have no windows. Null document ids and item ids
are kept as null. Repeated rows give one result row. Extra columns are not looked at.

Tables made from items are broadcast if they have at most BROADCAST_ROWS rows;
beyond that Spark joins by shuffle. So is the list of documents that share any shingle
(BROADCAST_POSITIONS positions).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.llm.spark import cut
from tracklens.llm.urls import ascii_lower

SHINGLE = 5
RADIUS, BLOCKS = 20, 7
BROADCAST_ROWS = 500_000
BROADCAST_POSITIONS = 1_000_000
ITEM_TASKS = 32
_WHITE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    trimmed = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def with_shingles(df: DataFrame, text_col: str, k: int) -> DataFrame:
    """df with __h: hashes of all k-word shingles in order (empty where there are fewer words) and __n: words.

    The columns are built one projection at a time, since an expression
    inlined into a lambda would be computed once for each element. For the
    same reason use explode_outer on __h: explode infers a filter on its
    size, which is pushed below the projections with everything inlined.
    """
    df = df.withColumn("__w", F.transform(words(F.col(text_col)), lambda x: F.xxhash64(x))).withColumn("__n", F.size("__w"))
    each = F.transform(F.sequence(F.lit(0), F.col("__n") - k), lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(k)]))
    return df.withColumn("__h", F.when(F.col("__n") >= k, each).otherwise(F.array().cast("array<bigint>"))).drop("__w")


def simhash(h: Column, longest: int) -> Column:
    """The bitwise strict majority of an array of at most ``longest`` hashes."""
    bits = max(1, longest.bit_length())
    names = [f"c{b}" for b in range(bits)]

    def add(acc: Column, x: Column) -> Column:
        carry, out = x, []
        for name in names:
            out.append(acc[name].bitwiseXOR(carry).alias(name))
            carry = carry.bitwiseAND(acc[name])
        return F.struct(*out)

    def majority(acc: Column) -> Column:
        need = F.floor(F.size(h) / 2).cast("bigint") + 1  # a bit is set if at least so many hashes have it
        borrow = F.lit(0).cast("bigint")
        for b, name in enumerate(names):
            t = -F.shiftright(need, b).bitwiseAND(F.lit(1).cast("bigint"))
            c = F.bitwise_not(acc[name])
            borrow = c.bitwiseAND(t).bitwiseOR(c.bitwiseOR(t).bitwiseAND(borrow))
        return F.bitwise_not(borrow)

    zero = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in names])
    return F.aggregate(h, zero, add, majority)


def _blocks(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block of 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _block(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def window_keys(fp: str, blocks: int = BLOCKS) -> Column:
    return F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col(fp), *x).alias("key")) for b, x in enumerate(_blocks(blocks))])


def item_keys(fp: str, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """All keys within radius // blocks bits of each block."""
    out = []
    for b, (shift, width) in enumerate(_blocks(blocks)):
        masks = [sum(1 << i for i in c) for r in range(radius // blocks + 1) for c in combinations(range(width), r)]
        out.append(_neighbours(b, _block(F.col(fp), shift, width), masks))
    return F.concat(*out)


def _neighbours(block: int, own: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: F.struct(F.lit(block).alias("block"), own.bitwiseXOR(m).alias("key")))


def first_block(x: Column, block: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """Whether ``block`` is the first in which fingerprints that differ by x are close enough, so that a pair is met once."""
    near = [F.bit_count(_block(x, *s)) <= radius // blocks for s in _blocks(blocks)]
    return block == reduce(lambda rest, b: F.when(near[b], F.lit(b)).otherwise(rest), range(blocks - 1, -1, -1), F.lit(-1))


def shared_weight(a: Column, b: Column) -> Column:
    """The sum over shingles of the smaller number of occurrences."""

    def numbered(x: Column) -> Column:
        return F.transform(x, lambda v, i: F.xxhash64(v, F.size(F.filter(F.slice(x, 1, i), lambda y: y == v))))

    alike = F.size(F.array_intersect(a, b))
    distinct = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(distinct, alike).otherwise(F.size(F.array_intersect(numbered(a), numbered(b))))


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _matches(docs: DataFrame, items: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, th, item_id, similarity, start, n) for items of at least k words; docs: id, text, th; items: item_id, __h, s, n."""
    sizes = [r.s for r in items.select("s").distinct().collect()]  # one entry for each length of an item
    shingles = _small(items.select(F.explode_outer("__h").alias("x"), "s").distinct())
    hits = with_shingles(docs, "text", k).select("id", "th", F.posexplode_outer("__h").alias("p", "x")).join(shingles, "x")
    hits = hits.groupBy("id", "th", "s").agg(F.sort_array(F.collect_set("p")).alias("at"))
    hits = cut(hits.groupBy("id", "th").agg(F.collect_list(F.struct("s", "at")).alias("sized"), F.sum(F.size("at") + 4).alias("held")))
    total = hits.agg(F.sum("held")).first()[0] or 0
    near = hits.select(F.col("id").alias("hid"), F.col("th").alias("hth"), "sized")
    near = F.broadcast(near) if total <= BROADCAST_POSITIONS else near
    some = docs.join(near, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth"))).dropDuplicates(["id", "th"])
    some = with_shingles(some, "text", k).select("id", "th", "__h", "sized")

    w = some.select("id", "th", "__h", F.explode("sized").alias("z")).select("id", "th", "__h", F.col("z.s").alias("s"), F.col("z.at").alias("at"))
    last = F.greatest(F.size("__h") - F.col("s"), F.lit(0))
    around = F.transform("at", lambda p: F.sequence(F.least(F.greatest(p - F.col("s") + 1, F.lit(0)), last), F.least(p, last)))
    w = w.withColumn("start", F.explode(F.array_distinct(F.flatten(around)))).select("id", "th", "start", "s", F.slice("__h", F.col("start") + 1, F.col("s")).alias("win"))
    w = w.withColumn("fp", simhash(F.col("win"), max(sizes))).withColumn("kb", F.explode(window_keys("fp")))

    prints = items.repartition(ITEM_TASKS, "item").withColumn("ifp", simhash(F.col("__h"), max(sizes)))
    index = _small(cut(prints.select(F.col("item").alias("item"), F.col("s").alias("is"), "ifp", F.explode(item_keys("ifp")).alias("ib"))))
    x = F.col("fp").bitwiseXOR(F.col("ifp"))
    met = w.join(index, (F.col("s") == F.col("is")) & (F.col("kb.block") == F.col("ib.block")) & (F.col("kb.key") == F.col("ib.key")) & (F.bit_count(x) <= RADIUS) & first_block(x, F.col("kb.block")))
    full = _small(items.select(F.col("item").alias("item2"), "item_id", "n", F.col("__h").alias("bag")))
    both = met.join(full, F.col("item") == F.col("item2")).withColumn("shared", shared_weight(F.col("win"), F.col("bag")))
    weight = F.col("s") + F.size("win")  # of both together
    both = both.where(F.col("shared") * (num + den) >= num * weight)
    return both.select("id", "th", "item_id", (F.col("shared") / (weight - F.col("shared"))).alias("similarity"), "start", "n")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = SHINGLE, num: int = 4, den: int = 5) -> DataFrame:
    """(id, th, item_id, similarity, start, n): the best window of each contaminated row and item, the first of equals; th identifies the text."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").withColumn("th", F.xxhash64("text"))
    i = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    counted = i.withColumn("n", F.size(words(F.col("text"))))
    small = sorted({min(r.n, k) for r in counted.select(F.least("n", F.lit(k)).alias("n")).distinct().collect()} - {0})
    parts = []
    for kk in small:
        own = with_shingles(counted.where(F.least("n", F.lit(k)) == kk), "text", kk)
        own = own.withColumn("s", F.size("__h")).withColumn("item", F.xxhash64("item_id", "text"))
        parts.append(_matches(d, own, kk, num, den))
    if not parts:
        return d.select("id", "th").limit(0).selectExpr("id", "th", "cast(null as bigint) as item_id", "0D as similarity", "0 as start", "0 as n")
    best = reduce(DataFrame.union, parts).groupBy("id", "th", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("b"))
    return best.select("id", "th", "item_id", "b.similarity", (-F.col("b.back")).alias("start"), "b.n")


def pairs(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """(id, item_id, similarity, start_word, n_words), one row for each contaminated id and item."""
    m = matches(docs, items, **columns)
    best = m.groupBy("id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("b"))
    return best.select(F.col("id").alias(columns.get("id_col", "doc_id")), "item_id", "b.similarity", (-F.col("b.back")).cast("bigint").alias("start_word"), F.col("b.n").cast("bigint").alias("n_words"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, with their columns."""
    bad = matches(docs, items, id_col=id_col, text_col=text_col).select(F.col("id").alias("__bad_id"), F.col("th").alias("__bad_th")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("__bad_id")) & (F.xxhash64(docs[text_col]) == F.col("__bad_th")), "left_anti")
