"""Files as tables: inventories, discovery, CSV sinks, map XML, shards and resumable units."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.operators.sets import union_all


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, modified) from the file system's listing; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


#: How run exports and their sidecars are named.
RUN_NAME, SIDECAR = r"V\d+_T\d+_R\d+\.txt$", ".spec"


def discover(files: DataFrame, pattern: str = RUN_NAME, companion: str = SIDECAR) -> DataFrame:
    """(path, stem, has_companion) of run files by name."""
    f = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("stem", F.regexp_replace("path", r"\.[^./]*$", ""))
    side = f.where(F.col("name").endswith(companion)).select("stem", F.lit(True).alias("_has")).distinct()
    return f.where(F.col("name").rlike(pattern)).join(side, "stem", "left").select("path", "stem", F.coalesce("_has", F.lit(False)).alias("has_companion"))


def write_csv(path: str, *frames: DataFrame, mark: bool = True, by: Sequence[str] = ()) -> None:
    """One CSV data set with a header from frames whose columns may differ, in the order in which they first appear.

    mark: every file begins with the UTF-8 byte-order mark, as part of its header. by: a folder for each group.
    """
    every = union_all(*frames)
    first = next(c for c in every.columns if c not in by)
    if mark:
        every = every.select(first, *[c for c in every.columns if c != first]).withColumnRenamed(first, f"\ufeff{first}")
    writer = every.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).csv(path, header=True, encoding="UTF-8")


def write_shards(df: DataFrame, path: str, partitions: tuple[str, ...] = ("source", "split"), rows: int = 4096) -> None:
    """Parquet partitioned for pruning, at most rows a file; only the partitions written are replaced. Spark commits a job's files at once."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows).partitionBy(*partitions).parquet(path)


def shard_catalog(spark: SparkSession, path: str, source: str = "source") -> DataFrame:
    """(file, rows_, sources, single_source) of written shards."""
    s = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), source)
    return s.groupBy("file").agg(F.count("*").alias("rows_"), F.count_distinct(source).alias("sources")).withColumn("single_source", F.col("sources") == 1)


def pending(units: DataFrame, done: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Units that are not done; a done unit whose input fingerprint changed is an error in state."""
    j = units.join(done.select(key, F.col(fingerprint).alias("_f")), key, "left")
    return j.where(F.col("_f").isNull() | (F.col("_f") != F.col(fingerprint))).withColumn("state", F.when(F.col("_f").isNull(), "new").otherwise("stale")).drop("_f")


def read_map(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """node (id, lat, lon), way_node (way, ord, node), way_tag, member (relation, ord, role, ref), relation_tag of a map document."""
    ref = "array<struct<_ref:long>>"
    tag = "array<struct<_k:string,_v:string>>"
    node = spark.read.format("xml").option("rowTag", "node").schema("_id long, _lat double, _lon double").load(path)
    way = spark.read.format("xml").option("rowTag", "way").schema(f"_id long, nd {ref}, tag {tag}").load(path)
    rel = spark.read.format("xml").option("rowTag", "relation").schema(f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, tag {tag}").load(path)
    tags = lambda d, name: d.select(F.col("_id").alias(name), F.explode("tag").alias("t")).select(name, F.col("t._k").alias("k"), F.col("t._v").alias("v"))
    return {
        "node": node.select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon")),
        "way_node": way.select(F.col("_id").alias("way"), F.posexplode("nd").alias("ord", "n")).select("way", "ord", F.col("n._ref").alias("node")),
        "way_tag": tags(way, "way"),
        "member": rel.select(F.col("_id").alias("relation"), F.posexplode("member").alias("ord", "m")).select("relation", "ord", F.col("m._role").alias("role"), F.col("m._ref").alias("ref")),
        "relation_tag": tags(rel, "relation"),
    }


def speed_limit(text: Column) -> Column:
    """km/h or mph text to m/s."""
    n = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(F.lower(text).contains("mph"), n * 0.44704).otherwise(n / 3.6)


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of all files at path."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines with a fixed schema, and (file, line) of those that don't parse."""
    return parse_jsonl(spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), "value"), schema)


def parse_jsonl(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """read_jsonl of (file, value)."""
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return parsed.where(~bad).select("file", "row.*").drop("_bad"), parsed.where(bad).select("file", F.col("value").alias("line"))


def shard_check(catalog: DataFrame, index: DataFrame, version: str) -> DataFrame:
    """(file, problem): shards whose manifest (file, rows_, version) doesn't agree with the index (file, rows_), by the first reason."""
    j = catalog.join(index.select("file", F.col("rows_").alias("_n")), "file", "full_outer")
    problem = F.when(F.col("_n").isNull(), "not_indexed").when(F.col("rows_").isNull(), "no_manifest").when(F.col("version") != version, "version").when(F.col("rows_") != F.col("_n"), "row_count")
    return j.select("file", problem.alias("problem")).where("problem is not null")


def tracks_of_csv(lines: DataFrame, schema: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of (file, value) parsed by a schema, and (file, rows_, unparsable): a row counts as unparsable if a required column is null."""
    row = F.from_csv("value", schema)
    p = lines.withColumn("row", row).withColumn("_bad", F.greatest(*[F.col(f"row.{c}").isNull().cast("int") for c in required], F.lit(0)) == 1)
    counts = p.groupBy("file").agg(F.count("*").alias("rows_"), F.count_if("_bad").alias("unparsable"))
    return p.where(~F.col("_bad")).select("file", "row.*"), counts


#: Kinds of map lines by the type that their tag gives.
WAY_KINDS = {"lane_boundary": ("line_thin", "line_thick", "virtual"), "road_boundary": ("curbstone", "guard_rail", "road_border"), "crosswalk": ("pedestrian_marking",), "stop_line": ("stop_line",)}


def way_kinds(way_tag: DataFrame, ways: DataFrame) -> DataFrame:
    """(way, kind) of all ways by their type tag; other where it is none of the known ones."""
    kind = None
    for name, types in WAY_KINDS.items():
        test = F.col("v").isin(*types)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    typed = way_tag.where("k = 'type'").groupBy("way").agg(F.max("v").alias("v"))
    return ways.select("way").distinct().join(typed, "way", "left").select("way", F.coalesce(kind, F.lit("other")).alias("kind"))


def lane_speeds(relation_tag: DataFrame, member: DataFrame) -> DataFrame:
    """(relation, speed) of lane relations: the largest limit of the rules they refer to, in metres a second; 0 if none.

    A rule is a relation of type regulatory_element and subtype speed_limit, whose sign_type holds km/h.
    """
    t = relation_tag.groupBy("relation").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("type", "subtype", "sign_type")])
    rule = t.where("type = 'regulatory_element' and subtype = 'speed_limit'").select(F.col("relation").alias("ref"), (F.regexp_extract("sign_type", r"(\d+(?:\.\d+)?)", 1).try_cast("double") / 3.6).alias("limit"))
    told = member.where("role = 'regulatory_element'").select("relation", "ref").join(rule, "ref").groupBy("relation").agg(F.max("limit").alias("limit"))
    return t.where("type = 'lanelet'").select("relation").join(told, "relation", "left").select("relation", F.coalesce("limit", F.lit(0.0)).alias("speed"))


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, shape, kind, values) of every numeric array in NumPy archives; objects are refused."""
    return parse_npz(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"))


def parse_npz(files: DataFrame) -> DataFrame:
    """read_npz of (file, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with np.load(io.BytesIO(data.as_py()), allow_pickle=False) as z:
                    got = [(k, z[k]) for k in sorted(z.files)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(got)), pa.array([k for k, _ in got], pa.string()), pa.array([list(x.shape) for _, x in got], pa.list_(pa.int64())), pa.array([str(x.dtype) for _, x in got], pa.string()), pa.array([x.astype(float).reshape(-1).tolist() for _, x in got], pa.list_(pa.float64()))], names=["file", "name", "shape", "kind", "values"])

    return files.select("file", "content").mapInArrow(run, "file string, name string, shape array<long>, kind string, values array<double>")


def archives(df: DataFrame, file: str, order: str, columns: Sequence[str], rows: int = 4096) -> DataFrame:
    """(file, content): NumPy archives of the columns, numbers or arrays of equal length, with at most ``rows`` samples in order in each.

    A file of more rows is dealt out by a hash of the order into archives named file-0, file-1, ..., so a hot one is many tasks' work.
    """
    sizes = df.groupBy(F.col(file).alias("_f")).agg(F.ceil(F.count("*") / rows).alias("_parts"))
    d = df.join(sizes, F.col(file).eqNullSafe(F.col("_f"))).withColumn("_part", F.pmod(F.xxhash64(order), F.col("_parts")))
    d = d.select(F.concat_ws("-", F.col(file).cast("string"), F.when(F.col("_parts") > 1, F.col("_part").cast("string"))).alias("file"), F.col(order).alias("_o"), *columns)

    def pack(t: pa.Table) -> pa.Table:
        t, out = t.sort_by("_o"), io.BytesIO()
        flat = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False)
        np.savez(out, **{c: flat(t.column(c).combine_chunks()) for c in columns})
        return pa.table({"file": t.column("file")[:1], "content": pa.array([out.getvalue()], pa.binary())})

    return d.groupBy("file").applyInArrow(pack, "file string, content binary")
