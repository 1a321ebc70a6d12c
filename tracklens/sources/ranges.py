"""Byte ranges of files: the listing that Spark's readers make, cut into splits, and reads by place inside tasks.

Files are opened by pyarrow.fs, so they must be in a store that it reaches from the executors (local or
shared disks, HDFS, object stores). No file is read whole, and what is read of a file is what the caller asks for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatch
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_BYTES = 64 << 20
_PIECE = 1 << 20


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path inside it; file:/x as Spark writes it is taken too."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri) if ":" in uri.split("/")[0] else f"file://{uri}")


def listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, size) of every file at path that isn't empty, by Spark's own listing, which leaves empty ones out; contents aren't read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))


def list_files(path: str, glob: str | None = None) -> list[tuple[str, int]]:
    """(uri, size) of a file, of all files below a folder, or of those that a path with wildcards names; for planning without a session."""
    scheme, _, _ = path.partition(":/") if ":" in path.split("/")[0] else ("file", "", "")
    fixed = re.split(r"/[^/]*[*?\[{]", path)[0] if re.search(r"[*?\[{]", path) else path
    store, top = store_of(fixed)
    root = re.match(r"^[a-z][a-z0-9+.-]*://[^/]*(?=/)", path)
    uri = lambda p: f"file://{p}" if scheme == "file" else f"{root[0]}{p}" if root and p.startswith("/") else f"{scheme}://{p}"
    info = store.get_file_info(top)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(top, recursive=True)) if info.type == fs.FileType.Directory else []
    if not found and info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    wild = store_of(fixed)[1] + path[len(fixed) :] if fixed != path else None
    hidden = lambda f: re.search(r"/[._]", f.path[len(top) :])
    keep = [f for f in found if f.is_file and not hidden(f) and (glob is None or fnmatch(f.base_name, glob)) and (wild is None or f.path.count("/") == wild.count("/") and fnmatch(f.path, wild))]
    return sorted((uri(f.path), f.size) for f in keep)


def splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """files with (start, end): ranges of at most split_bytes, which cover each file once; an empty file has none. Dealt out evenly."""
    step = F.lit(split_bytes).cast("long")
    cut = files.where("size > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)))
    return cut.withColumn("end", F.least(F.col("start") + step, F.col("size"))).repartition("file", "start")


class Window:
    """Bytes of an open file by place; one piece is held at a time. taken: the bytes that have been read."""

    def __init__(self, file: Any, size: int):
        self.file, self.size = file, size
        self.at, self.piece, self.taken = 0, b"", 0

    @classmethod
    def open(cls, uri: str) -> Window:
        store, path = store_of(uri)
        f = store.open_input_file(path)
        return cls(f, f.size())

    def __enter__(self) -> Window:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def get(self, at: int, n: int, ahead: int = _PIECE) -> bytes:
        """The n bytes from at on, fewer at the end of the file; reads ahead at least so far if it reads at all."""
        n = max(0, min(n, self.size - at))
        if at < self.at or at + n > self.at + len(self.piece):
            self.at, self.piece = at, self.file.read_at(min(max(n, ahead), self.size - at), at) if n else b""
            self.taken += len(self.piece)
        return self.piece[at - self.at : at - self.at + n]

    def pieces(self, at: int, size: int = _PIECE) -> Iterator[tuple[int, bytes]]:
        """(place, bytes) from at to the end of the file."""
        while at < self.size:
            yield at, self.get(at, size, size)
            at += size
