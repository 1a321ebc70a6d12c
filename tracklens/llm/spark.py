"""What the operators share: the shared folder, row groups and links to components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.lineage import shared_dir

GROUP_BYTES = 4 << 20
BATCH_ROWS = 1000


def scratch(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Computes df once into the shared folder, so that later reads survive lost executors.

    Arrow batches hold at most batch_rows rows meanwhile: with long texts or
    sets in them, the usual number would need much memory on both sides.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    shared_dir(df.sparkSession)
    usual = conf.get(key)
    conf.set(key, str(min(batch_rows, int(usual)) if int(usual) > 0 else batch_rows))
    try:
        return df.checkpoint()
    finally:
        conf.set(key, usual)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that are done with; its cleaner hears of them only when the driver's JVM collects garbage."""
    gc.collect()  # Python's objects hold those of the JVM
    spark.sparkContext._jvm.System.gc()


def leaving_nothing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], clear: Callable[[], None] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; when its task ends, clear is called and Arrow gives back what it has freed.

    Python workers outlive their tasks, and what they hold counts beside all later stages of the session.
    """

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if clear:
                clear()
            pa.default_memory_pool().release_unused()

    return task


def with_fields(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df and more fields; df's own stays as it is."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def grouped(docs: DataFrame, id_col: str, text_col: str, group_bytes: int = GROUP_BYTES, rest: list[str] | None = None, total: int | None = None) -> tuple[DataFrame, int, int]:
    """(g, id, text[, rest]), the number of groups and the bytes of text.

    A group has about group_bytes of text, however ids and texts repeat. It
    depends on id and text alone, so that a recomputed partition deals its
    rows out as before; equal texts of different ids spread. rest: a struct
    of these columns. total: the bytes, where they are known.
    """
    if total is None:
        total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-total // group_bytes))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []))
    return d.select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int").alias("g"), *d.columns), n, total


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, component_id) for every id in links (a, b): the smallest id reachable.

    Alternates large-star and small-star steps, each an aggregation by node
    and an equi-join, until the set of edges stays the same; every round is
    cut, so no lineage grows and nothing is collected but two sums.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last = cut(e), None
    for _ in range(max_rounds):
        e = cut(_star(_star(e, large=True), large=False))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).union(e.select("v", "v").distinct())


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One star step on edges u > v; returns edges u > v again."""
    near = e.select(F.col("u").alias("n"), F.col("v").alias("o"))
    if large:
        near = near.union(e.select("v", "u"))
    least = near.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m")).withColumnRenamed("n", "k")
    j = near.join(least, near.n == least.k)
    if large:
        out = j.where("o > n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("o").alias("u"), F.col("m").alias("v")).union(j.select(F.col("n"), F.col("m")))
    return out.where("u <> v").distinct()
