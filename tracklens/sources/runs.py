"""Text exports of test runs: banner, Points=N, channel names, units, rows; and their key=value sidecars.

read_runs takes files whole, one row a file, and apart by array functions, so the order of lines is
kept; convert to Parquet once for repeated use. Only wanted channels are projected. peek and inspect_files
read the ends or the first rows of files by place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracklens.functions.numbers import finite
from tracklens.sources.ranges import Window, listing


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))


def _cell(cells: Column, names: Column, wanted: str) -> Column:
    at = F.array_position(F.transform(names, lambda x: F.trim(x)), wanted)
    return F.trim(F.get(cells, (at - 1).cast("int"))).try_cast("double")


def read_runs(spark: SparkSession, path: str, wanted: Sequence[str], strict: bool = False, units: bool = True) -> DataFrame:
    """(run, seq, <wanted channels>[, good]) of all exports at path.

    Lenient: short rows are left out and bad cells are null. Strict: adds good,
    which is false where the width differs or a wanted cell isn't finite.
    The delimiter is a tab if the name line has one, else a comma. Channels that a file lacks are null.
    """
    return parse_runs(_files(spark, path), wanted, strict, units)


def parse_runs(files: DataFrame, wanted: Sequence[str], strict: bool = False, units: bool = True) -> DataFrame:
    """read_runs of (run, lines)."""
    f = files.withColumn("d", F.when(F.get("lines", 2).contains("\t"), "\t").otherwise(","))
    f = f.withColumn("names", F.split(F.get("lines", 2), F.col("d")))
    rows = f.select("run", "d", "names", F.posexplode(F.slice("lines", 5 if units else 4, F.size("lines"))).alias("seq", "line")).where("trim(line) <> ''")
    rows = rows.withColumn("cells", F.split("line", F.col("d")))
    out = rows.select("run", "seq", (F.size("cells") == F.size("names")).alias("_whole"), *[_cell(F.col("cells"), F.col("names"), c).alias(c) for c in wanted])
    if not strict:
        return out.where("_whole").drop("_whole")
    good = F.col("_whole")
    for c in wanted:
        good = good & F.coalesce(finite(F.col(f"`{c}`")), F.lit(False))
    return out.withColumn("good", good).drop("_whole")


PEEK = 8 << 10


def _number(cell: str) -> float | None:
    try:
        return float(cell)
    except ValueError:
        return None


def _time(line: str) -> float | None:
    cells = line.split("\t")
    return _number(cells[1]) if len(cells) > 1 else None


def _head(w: Window, lines: int = 5) -> list[str]:
    """The first lines of a file, from as few bytes as hold them."""
    size = PEEK
    while True:
        got = w.get(0, size, size)
        if got.count(b"\n") >= lines or len(got) == w.size:
            return got.decode("utf-8", "replace").replace("\r", "").split("\n")[:lines]
        size *= 2


def _declared(head: list[str]) -> int | None:
    return next((int(m[1]) for x in head if (m := re.match(r"Points\s*=\s*(\d+)\s*$", x))), None)


def peek(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(run, declared, channels, first_time, last_time, taken): heads and tails of exports whose second column is the time.

    taken bytes of each file are read: PEEK from either end, and more only where a line is longer. The last time is that of the last line
    with a number there.
    """

    def told(file: str) -> tuple:
        with Window.open(file) as w:
            head, size = _head(w), PEEK
            while True:
                at = max(0, w.size - size)
                rows = w.get(at, w.size - at, size).decode("utf-8", "replace").replace("\r", "").split("\n")[0 if at == 0 else 1 :]
                rows = rows[4:] if at == 0 else rows
                last = next((t for x in reversed(rows) if (t := _time(x)) is not None), None)
                if last is not None or at == 0 or any(x.strip() for x in rows):
                    break
                size *= 2
            return file, _declared(head), len(head[2].split("\t")) if len(head) > 2 else 0, _time(head[4]) if len(head) > 4 else None, last, w.taken

    return _each_file(listing(spark, path, glob), told, "run string, declared int, channels int, first_time double, last_time double, taken long")


def _each_file(files: DataFrame, told: Callable[[str], tuple], ddl: str) -> DataFrame:
    """A row from each file; files are dealt out evenly, since a listing of small ones may be few partitions."""
    schema = T.StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [dict(zip(schema.names, told(f), strict=True)) for f in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))

    return files.select("file").repartition("file").mapInArrow(run, schema)


def inspect_files(spark: SparkSession, path: str, max_rows: int = 2000, tolerance: float = 0.05, glob: str | None = None) -> DataFrame:
    """(run, declared, rows_, truncated, monotonic, uniform, reasons, taken) of exports whose second column is the time.

    Reading of a file ends with its row max_rows, so taken depends on max_rows and the length of rows, not on the size of the file. Rows
    without a time are read but not compared. uniform: no step differs from the median step by more than the tolerance's part of it.
    """
    if max_rows < 1:
        raise ValueError("max_rows must be positive")

    def told(file: str) -> tuple:
        with Window.open(file) as w:
            head, rows, rest = _head(w, 4), [], b""
            skip = 4
            for _, piece in w.pieces(0, PEEK):
                lines = (rest + piece).split(b"\n")
                rest = lines.pop()
                rows += [x for x in lines[skip:] if x.strip()]
                skip = max(0, skip - len(lines))
                if len(rows) >= max_rows:
                    break
            else:
                rows += [rest] if rest.strip() and not skip else []
            rows = [x.decode("utf-8", "replace").replace("\r", "") for x in rows[:max_rows]]
            declared = _declared(head)
            t = [x for r in rows if (x := _time(r)) is not None]
            step = np.diff(np.array(t))
            middle = float(np.median(step)) if len(step) else 0.0
            truncated, monotonic = declared is not None and declared > len(rows), bool((step > 0).all())
            uniform = not len(step) or bool(np.abs(step - middle).max() <= tolerance * middle)
            reasons = [k for k, bad in (("truncated", truncated), ("not_monotonic", not monotonic), ("not_uniform", not uniform)) if bad]
            return file, declared, len(rows), truncated, monotonic, uniform, ",".join(reasons), w.taken

    return _each_file(listing(spark, path, glob), told, "run string, declared int, rows_ long, truncated boolean, monotonic boolean, uniform boolean, reasons string, taken long")


def inspect(series: DataFrame, key: str, order: str, t: str, declared: str, max_rows: int = 2000, tolerance: float = 0.05) -> DataFrame:
    """(key, rows_, truncated, monotonic, uniform, reasons) from at most max_rows of each series.

    The first rows are picked first, by a limit that Spark applies in each task before the shuffle; steps are taken among them.
    """
    w = WindowSpec.partitionBy(key).orderBy(order)
    head = series.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= max_rows)
    head = head.withColumn("_d", F.col(t) - F.lag(t).over(w)).withColumn("_m", F.percentile("_d", 0.5).over(WindowSpec.partitionBy(key)))
    g = head.groupBy(key).agg(F.count("*").alias("rows_"), F.max(declared).alias("_declared"), F.coalesce(F.bool_and(F.col("_d") > 0), F.lit(True)).alias("monotonic"), F.coalesce(F.max(F.abs(F.col("_d") - F.col("_m"))) <= tolerance * F.max("_m"), F.lit(True)).alias("uniform"))
    g = g.withColumn("truncated", F.col("_declared") > F.col("rows_"))
    why = F.array_compact(F.array(F.when(F.col("truncated"), F.lit("truncated")), F.when(~F.col("monotonic"), F.lit("not_monotonic")), F.when(~F.col("uniform"), F.lit("not_uniform"))))
    return g.select(key, "rows_", "truncated", "monotonic", "uniform", F.array_join(why, ",").alias("reasons"))


def write_runs(rows: DataFrame, path: str, run: str, order: Sequence[str], channels: dict[str, str], banner: str = "export") -> None:
    """A text export in a folder of its own (run=value) for each run: banner, Points=N, names, units, rows in order. channels: name to unit."""
    cell = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in channels])
    whole = WindowSpec.partitionBy(run)
    at = F.row_number().over(whole.orderBy(*[F.col(f"`{c}`") for c in order]))
    body = rows.repartition(run).select(run, F.count("*").over(whole).alias("_n"), at.alias("_at"), cell.alias("_cell"))
    # the head goes with the first row: a union of heads and rows could be dealt out apart, in two files of a run
    head = F.array(F.lit(banner), F.concat(F.lit("Points="), F.col("_n").cast("string")), F.lit("\t".join(channels)), F.lit("\t".join(channels.values())), F.col("_cell"))
    lines = body.select(run, "_at", F.posexplode(F.when(F.col("_at") == 1, head).otherwise(F.array("_cell"))).alias("_part", "line"))
    lines.sortWithinPartitions(run, "_at", "_part").select(F.col(run), "line").write.partitionBy(run).text(path)


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """(run, name, value, types): sidecars; the first value of a name holds, values of Type are gathered in order."""
    return parse_specs(_files(spark, path))


def parse_specs(files: DataFrame) -> DataFrame:
    """read_specs of (run, lines)."""
    lines = files.select("run", F.posexplode("lines").alias("seq", "line")).where("line like '%=%'")
    kv = lines.select("run", "seq", F.trim(F.get(F.split("line", "=", 2), 0)).alias("name"), F.trim(F.get(F.split("line", "=", 2), 1)).alias("value"))
    types = kv.where("name = 'Type'").groupBy("run").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("types"))
    return kv.groupBy("run", "name").agg(F.min_by("value", "seq").alias("value")).join(types, "run", "left")
