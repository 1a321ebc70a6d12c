"""Resumable conversion of units, and pointers to the rows of written files.

A conversion writes units in batches, each into a run folder of its own by Spark's writer; then markers of its units
(unit, fingerprint, run, rows, files) are appended to the folder of markers, in one commit. A unit exists if and only if it has a marker, so
readers see whole units alone. What an interrupted conversion has left has no marker: the next one wipes it and converts these units anew,
while units of batches that were finished stay as they are. One conversion writes to a folder at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.lineage import cut
from tracklens.sources.files import pending

MARKERS = "_units"
_DDL = "unit string, fingerprint string, run string, rows long, files array<string>"


def _store(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Hadoop's file system of a path, and the path in it; metadata operations of the driver go through it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    store, p = _store(spark, path)
    return store.exists(p)


def markers(spark: SparkSession, out: str) -> DataFrame:
    """(unit, fingerprint, run, rows, files) of the units that are done."""
    return spark.read.schema(_DDL).parquet(f"{out}/{MARKERS}") if _exists(spark, f"{out}/{MARKERS}") else spark.createDataFrame([], _DDL)


def wipe_partial(spark: SparkSession, out: str) -> list[str]:
    """Deletes run folders that no marker names; returns their names."""
    if not _exists(spark, out):
        return []
    known = {r.run for r in markers(spark, out).select("run").distinct().collect()}  # a run a batch
    store, p = _store(spark, out)
    left = [f.getPath() for f in store.listStatus(p) if f.getPath().getName().startswith("run-") and f.getPath().getName() not in known]
    for f in left:
        store.delete(f, True)
    return sorted(f.getName() for f in left)


def missing_files(spark: SparkSession, out: str) -> DataFrame:
    """(unit, file) that a marker names and that is not there; found by Spark's listing, contents aren't read."""
    said = markers(spark, out).select("unit", F.explode(F.transform("files", lambda f: F.concat_ws("/", "run", f))).alias("file"))
    if not _exists(spark, out):
        return said
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(out).select(F.substring_index("path", "/", -2).alias("file"))
    return said.join(there, "file", "left_anti").select("unit", "file")


def convert_units(units: DataFrame, rows: DataFrame, out: str, unit: str, fingerprint: str, convert: Callable[[DataFrame], DataFrame], batches: int = 1, rows_per_file: int = 4096) -> DataFrame:
    """(unit, state, rows): every unit of units (unit, fingerprint), converted now or reused.

    rows hold the inputs by unit; convert takes those of some units and returns rows with the column unit. Units are
    dealt by a hash into batches; each is committed with its markers. ValueError if the input of a unit that is done has changed, or a file of one is gone.
    A unit without converted rows is done as well. Units are text in markers.
    """
    spark = rows.sparkSession
    wipe_partial(spark, out)
    done = markers(spark, out).select(F.col("unit").alias(unit), F.col("fingerprint").alias(fingerprint))
    gone = missing_files(spark, out).limit(5).collect()
    if gone:
        raise ValueError(f"units are done but files are gone: {', '.join(f'{r.unit} ({r.file})' for r in gone)}")
    known = cut(units.select(F.col(unit).cast("string").alias(unit), F.col(fingerprint).cast("string").alias(fingerprint)).distinct())
    todo = cut(pending(known, done, unit, fingerprint))
    stale = todo.where("state = 'stale'").limit(5).collect()
    if stale:
        raise ValueError(f"finished units changed: {', '.join(str(r[unit]) for r in stale)}")
    todo = todo.select(unit, fingerprint, F.pmod(F.xxhash64(unit), F.lit(batches)).alias("_batch"))
    for b in range(batches):
        own, run = todo.where(F.col("_batch") == b).drop("_batch"), f"run-{uuid.uuid4().hex}"
        if own.isEmpty():
            continue
        part = rows.join(own.select(F.col(unit).alias("_u")), F.col(unit).cast("string") == F.col("_u"), "left_semi")
        convert(part).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{out}/{run}")
        wrote = spark.read.parquet(f"{out}/{run}").groupBy(F.col(unit).cast("string").alias("_u")).agg(F.count("*").alias("rows"), F.sort_array(F.collect_set("_metadata.file_name")).alias("files"))
        mark = own.join(wrote, F.col(unit) == F.col("_u"), "left").select(F.col(unit).alias("unit"), F.col(fingerprint).alias("fingerprint"), F.lit(run).alias("run"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))
        mark.coalesce(1).write.mode("append").parquet(f"{out}/{MARKERS}")  # published last, at once: small rows of one batch
    new = todo.select(F.col(unit).alias("unit"), F.lit("converted").alias("_s"))
    now = markers(spark, out).join(known.select(F.col(unit).alias("unit")), "unit", "left_semi")
    return now.join(new, "unit", "left").select("unit", F.coalesce("_s", F.lit("reused")).alias("state"), "rows")


def read_units(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all units that are done, with ``file`` and ``row``, their pointers."""
    runs = sorted(r.run for r in markers(spark, out).where("rows > 0").select("run").distinct().collect())
    if not runs:
        raise ValueError(f"no unit with rows is done in {out}")
    return with_pointers(spark.read.parquet(*[f"{out}/{r}" for r in runs]))


def with_pointers(stored: DataFrame) -> DataFrame:
    """Rows of Parquet files with the file and the place in it where each stands, as the reader tells them."""
    return stored.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def pointers(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """(keys, file, row) of every sample in the Parquet files at path; other columns aren't read."""
    return with_pointers(spark.read.parquet(path)).select(*keys, "file", "row")


def read_pointers(found: DataFrame) -> DataFrame:
    """The samples that pointers (file, row, ...) point at, with file and row; no other file is opened.

    The list of their files goes through the driver, as that of any scan. A pointer that repeats gives its sample once; one past the end of its file is an error.
    """
    spark = found.sparkSession
    want = cut(found.select("file", "row").distinct())
    names = [r.file for r in want.select("file").distinct().orderBy("file").collect()]
    if not names:
        raise ValueError("no pointers")
    stored = with_pointers(spark.read.parquet(*names))
    lost = want.join(stored.select("file", "row"), ["file", "row"], "left_anti").limit(1).collect()  # no column of the files is read for it
    if lost:
        raise ValueError(f"{lost[0].file} has no row {lost[0].row}")
    return stored.join(want, ["file", "row"])
