"""CSV files of unknown encoding, read by byte ranges.

Which encoding a file has is a verdict over all of its bytes, and where a record begins depends on all quotes before it. Both are
found by ranges: each range tells whether its bytes are UTF-8 (its first bytes may end a character that the range before has begun) and
to which state each state of the parser leads over it. Verdicts are all of a file's ranges together, states are carried from range
to range, and then every range parses the records that begin in it. No file is one task's work, and none is held whole.

In UTF-8 and in GB 18030 a line feed, a carriage return, a comma or a quote is never part of another character, so bytes can be
looked at before the encoding is known.
"""

from __future__ import annotations

import codecs
import csv
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklens.lineage import cut
from tracklens.sources.ranges import SPLIT_BYTES, listing, splits
from tracklens.sources.ranges import Window as Bytes

MARK = codecs.BOM_UTF8
STATES = "SFQE"  # at the start of a field, in a plain field, in quotes, behind a quote in quotes
_QUOTE = str.maketrans(STATES, "QFEQ")
_ENDED, _OPEN = str.maketrans(STATES, "SSQS"), str.maketrans(STATES, "FFQF")  # bytes without a quote, the last of which ends a field or doesn't
_PIECE = 1 << 20


def carried(piece: bytes, states: str = STATES) -> str:
    """The states that states lead to over the bytes. Between quotes only the last byte counts."""
    for k, part in enumerate(piece.split(b'"')):
        if k:
            states = states.translate(_QUOTE)
        if part:
            states = states.translate(_ENDED if part[-1] in b",\n\r" else _OPEN)
    return states


def _surveyed(w: Bytes, start: int, end: int) -> tuple[bool, int, int, str]:
    """(whether the range is UTF-8, bytes at its start that end a character before it, bytes behind its end that its last character takes, states)."""
    first, head = w.get(start, min(3, end - start)), 0
    while start and head < len(first) and first[head] & 0xC0 == 0x80:
        head += 1
    mark = len(MARK) if w.get(0, len(MARK)) == MARK else 0  # no part of the first field
    decoder, utf8, states = codecs.getincrementaldecoder("utf-8")(), True, STATES
    for at in range(start, end, _PIECE):
        piece = w.get(at, min(_PIECE, end - at), _PIECE)
        states = carried(piece[max(0, mark - at) :], states)
        try:
            utf8 and decoder.decode(piece[head if at == start else 0 :])
        except UnicodeDecodeError:
            utf8 = False
    over = 0
    while utf8 and decoder.getstate()[0]:
        more = w.get(end + over, 1)
        try:
            decoder.decode(more, final=not more)
        except UnicodeDecodeError:
            utf8 = False
        over += 1
    return utf8, head, over, states


def survey(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, size, start, end, encoding, state): ranges of all files, the encoding of the file and the state in which the range begins.

    A file is UTF-8 if all ranges are and each begins where the last character before it ends; else it is GB 18030.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = []
            for file, start, end in zip(*(b.column(c).to_pylist() for c in ("file", "start", "end")), strict=True):
                with Bytes.open(file) as w:
                    told.append(_surveyed(w, start, end))
            types = {"utf8": pa.bool_(), "head": pa.int32(), "over": pa.int32(), "states": pa.string()}
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([r[k] for r in told], t) for k, t in enumerate(types.values())]], names=[*b.schema.names, *types])

    if split_bytes < 4:
        raise ValueError("a range must hold the longest character")
    ranges = splits(listing(spark, path), split_bytes).select("file", "size", "start", "end")
    found = ranges.mapInArrow(run, "file string, size long, start long, end long, utf8 boolean, head int, over int, states string")
    fits = F.col("utf8") & (F.col("head") == F.coalesce(F.lag("over").over(Window.partitionBy("file").orderBy("start")), F.lit(0)))
    files = found.withColumn("fits", fits).groupBy("file", "size").agg(F.bool_and("fits").alias("whole"), F.sort_array(F.collect_list(F.struct("start", "end", "states"))).alias("r"))  # some bytes a range
    onward = lambda seen, r: F.concat(seen, F.array(F.substring(r["states"], F.instr(F.lit(STATES), F.element_at(seen, -1)), F.lit(1))))
    states = F.aggregate("r", F.array(F.lit("S")), onward)
    out = files.select("file", "size", F.when(F.col("whole"), "utf-8-sig").otherwise("gb18030").alias("encoding"), "r", states.alias("s"))
    return out.select("file", "size", "encoding", F.posexplode("r").alias("k", "x"), "s").select("file", "size", F.col("x.start").alias("start"), F.col("x.end").alias("end"), "encoding", F.get("s", F.col("k")).alias("state"))


def _first_record(w: Bytes, start: int, state: str) -> int:
    """Where the first record begins from start on, if the parser is in this state there; the size of the file if none does."""
    if start == 0 or state == "S" and w.get(start - 1, 1) == b"\n":
        return start
    for at, piece in w.pieces(start, _PIECE):
        i = 0
        while (j := piece.find(b"\n", i)) >= 0:
            state = carried(piece[i:j], state)
            if state != "Q":
                return at + j + 1
            i = j + 1
            state = carried(b"\n", state)
        state = carried(piece[i:], state)
    return w.size


def _lines(w: Bytes, at: int, end: int, encoding: str) -> Iterator[str]:
    """Lines of the records that begin in [at, end); a record that begins there is read to its end."""
    state, rest, place = "S", b"", at
    for _, piece in w.pieces(at, _PIECE):
        rest += piece
        i = 0
        while (j := rest.find(b"\n", i)) >= 0:
            if place + i >= end and state == "S":
                return
            state = carried(rest[i : j + 1], state)
            yield rest[i : j + 1].decode(encoding)
            i = j + 1
        rest, place = rest[i:], place + i
    if rest and not (place >= end and state == "S"):
        yield rest.decode(encoding)


def records(w: Bytes, start: int, end: int, encoding: str, state: str) -> Iterator[list[tuple[str, str]]]:
    """The records that begin in a range, as (name, cell); the first record of a file names the cells. Missing cells are empty, extra ones are left out, empty lines are no records."""
    csv.field_size_limit(sys.maxsize)
    plain = "utf-8" if encoding == "utf-8-sig" else encoding
    top = len(MARK) if plain == "utf-8" and w.get(0, len(MARK)) == MARK else 0
    names = next(csv.reader(_lines(w, top, top + 1, plain)), [])
    begin = max(top, _first_record(w, start, state))
    if begin >= end:
        return
    rows = csv.reader(_lines(w, begin, end, plain))
    if begin == top:
        next(rows, None)
    for r in rows:
        if r:
            yield list(dict(zip(names, [*r, *[""] * (len(names) - len(r))], strict=False)).items())


def read_cells(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, batch: int = 2000) -> DataFrame:
    """(file, row, cells) of CSV files with a header; row numbers the records of a file from 0. Parsed once, into the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(file: str, start: int, first: int, rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([start] * len(rows), pa.int64()), pa.array(range(first, first + len(rows)), pa.int64()), pa.array(rows, pa.map_(pa.string(), pa.string()))], names=["file", "start", "place", "cells"])

        for b in batches:
            for file, start, end, encoding, state in zip(*(b.column(c).to_pylist() for c in ("file", "start", "end", "encoding", "state")), strict=True):
                with Bytes.open(file) as w:
                    held, n = [], 0
                    for r in records(w, start, end, encoding, state):
                        held.append(r)
                        if len(held) == batch:
                            yield out(file, start, n, held)
                            held, n = [], n + batch
                    if held:
                        yield out(file, start, n, held)

    ranges = cut(survey(spark, path, split_bytes)).repartition("file", "start")
    cells = cut(ranges.mapInArrow(run, "file string, start long, place long, cells map<string,string>"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("f").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cells.groupBy(F.col("file").alias("f"), F.col("start").alias("s")).agg(F.count("*").alias("n")).select("f", "s", before.alias("before"))
    return cells.join(counts, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s"))).select("file", (F.col("place") + F.col("before")).alias("row"), "cells")


def read_csv_auto(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, row, <columns>): CSV files with a header, UTF-8 (with or without mark), else GB 18030; all columns are text, null where a file lacks them."""
    cells = cut(read_cells(spark, path, split_bytes))
    names = sorted(r[0] for r in cells.select(F.explode(F.map_keys("cells"))).distinct().collect())
    return cells.select("file", "row", *[F.col("cells")[n].alias(n) for n in names])
