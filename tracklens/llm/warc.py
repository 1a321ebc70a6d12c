"""Operator 9: WARC archives of Zstandard frames with a shared dictionary, written and read back.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; then comes one frame for each record. The reader loads the
dictionary from that frame, decodes one frame at a time and checks record
headers: version line, type, block length against Content-Length, and the
SHA-1 payload digest wherever the payload is there.

Of records with equal payloads of at least ``min_revisit_bytes``, that with
the largest page_id is written as response and the others as revisit records that refer
to it; smaller ones are all responses. Rows with the same payload and the
same page_id as the response are all responses; so are rows with a null page_id if no other
row has their payload, and revisits otherwise. Null html is an empty payload.
A null URL has no WARC-Target-URI; line ends in URLs are percent-encoded.

Archives are rolled at ARCHIVE_BYTES. They are written below a folder that
driver and executors share, each attempt of a task in a folder of its own;
write() tells the files of the attempts that counted, and only those are
decoded, so repeated or abandoned tasks add no record. Reading goes through
Spark's binaryFile source; the list of files stays a table. The dictionary is trained on at most DICT_ROWS payloads of
at most DICT_CUT bytes each (it steers compression alone; payloads are stored whole).
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.spark import cut, scratch

SKIP = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 16 << 20
DICT_BYTES, DICT_ROWS, DICT_CUT = 32 << 10, 400, 8 << 10
LEVEL = 3
FIRST_PIECE, PIECE = 4 << 10, 64 << 10
BROADCAST_FILES = 500_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises ValueError where it isn't whole and right."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    if "warc-type" not in fields or "warc-record-id" not in fields or not fields.get("content-length", "").isdigit():
        raise ValueError("a required header is missing")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("block length differs from Content-Length")
    return fields, rest[:n]


def header(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIP, len(dictionary)) + dictionary


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True)


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, a frame each."""
    dictionary, at = b"", 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIP:
        size = struct.unpack_from("<I", data, 4)[0]
        if len(data) < 8 + size:
            raise ValueError("the dictionary frame is cut short")
        dictionary, at = data[8 : 8 + size], 8 + size
        if dictionary[:4] == FRAME:  # it may be compressed itself
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    view = memoryview(data)
    while at < len(data):
        frame, raw, next_ = codec.decompressobj(), [], at
        while not frame.eof and next_ < len(data):  # pieces, since what a frame doesn't use is copied
            piece = view[next_ : next_ + (PIECE if raw else FIRST_PIECE)]
            try:
                raw.append(frame.decompress(piece))
            except zstandard.ZstdError as e:
                raise ValueError(f"bad frame at {at}: {e}") from e
            next_ += len(piece)
        if not frame.eof:
            raise ValueError("the last frame is cut short")
        at = next_ - len(frame.unused_data)
        yield parse(b"".join(raw))


def train(pages: DataFrame, html_col: str) -> bytes:
    """A dictionary from the payloads with the smallest hashes; empty where there is too little to learn from."""
    h = F.xxhash64(F.col(html_col))
    hashes = [r.h for r in pages.where(F.octet_length(html_col) >= 64).select(h.alias("h")).distinct().orderBy("h").limit(DICT_ROWS).collect()]
    some = pages.where(h.isin(hashes)).select(h.alias("h"), F.substring(F.col(html_col).cast("binary"), 1, DICT_CUT).alias("b")).dropDuplicates(["h"])
    samples = [b for _, b in sorted((r.h, bytes(r.b)) for r in some.collect())]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def plan(pages: DataFrame, id_col: str, html_col: str, min_revisit_bytes: int) -> DataFrame:
    """pages with __sha (SHA-1, hex), __bytes and __first (page_id of the response, or null)."""
    p = pages.withColumn("__b", F.coalesce(F.col(html_col), F.lit("")).cast("binary")).withColumns({"__sha": F.sha1("__b"), "__bytes": F.octet_length("__b").cast("long")}).drop("__b")
    first = p.where(F.col("__bytes") >= min_revisit_bytes).groupBy(F.col("__sha").alias("__k")).agg(F.max(id_col).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return p.join(first, F.col("__sha") == F.col("__k"), "left").drop("__k")


def write(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Writes archives below out; returns (folder, name, records, bytes), one row a file, computed once."""
    spark = pages.sparkSession
    rows = plan(pages.select(id_col, url_col, html_col), id_col, html_col, min_revisit_bytes).select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.coalesce(F.col(html_col), F.lit("")).cast("binary"), F.col("__first").cast("long"))
    shared = spark.sparkContext.broadcast(train(pages, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(out)
        zip_, head, task = compressor(shared.value), header(shared.value), TaskContext.get()
        folder = f"task-{task.partitionId():06d}-{task.taskAttemptId()}"
        frames, size, done = [], 0, []

        def roll() -> None:
            nonlocal frames, size
            if frames:
                name = f"{len(done):04d}.warc.zst"
                store.create_dir(f"{top}/{folder}", recursive=True)
                with store.open_output_stream(f"{top}/{folder}/{name}", compression=None) as f:
                    f.write(head)
                    for x in frames:
                        f.write(x)
                done.append((folder, name, len(frames), size + len(head)))
                frames, size = [], 0

        for b in batches:
            for key, url, html, first in zip(*(c for c in b.columns), strict=True):
                key, first, payload = key.as_py(), first.as_py(), html.as_py()
                name = digest(payload)
                fields = [("WARC-Record-ID", f"<urn:page:{'' if key is None else key}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{name}"), ("X-Payload-Length", str(len(payload)))]
                if url.is_valid:
                    fields.append(("WARC-Target-URI", url.as_py().replace("\r", "%0D").replace("\n", "%0A").strip()))
                if first is None or key == first:
                    raw = record("response", fields, payload)
                else:
                    raw = record("revisit", [*fields, ("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], b"")
                frames.append(zip_.compress(raw))
                size += len(frames[-1])
                if size >= ARCHIVE_BYTES:
                    roll()
        roll()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["folder", "name", "records", "bytes"])

    return cut(rows.mapInArrow(run, "folder string, name string, records long, bytes long"))


def read(out: str, files: DataFrame) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to, url, payload) of all records in the files (folder, name) below out.

    payload is null for revisits. A record that fails a check fails the read.
    """
    spark = files.sparkSession

    def number(x: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", x or "")
        return int(m[1]) if m else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list) -> pa.RecordBatch:
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"])

        for b in batches:
            for data in b.column(0):
                rows, held = [], 0
                for h, block in read_archive(data.as_py()):
                    said = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    n = int(h.get("x-payload-length", len(block)))
                    if h["warc-type"] == "response" and (digest(block) != said or len(block) != n):
                        raise ValueError(f"payload of {h['warc-record-id']} differs from its digest")
                    rows.append((number(h["warc-record-id"]), h["warc-type"], n, said, number(h.get("warc-refers-to")), h.get("warc-target-uri"), block if h["warc-type"] == "response" else None))
                    held += len(block)
                    if held > ARCHIVE_BYTES:
                        yield pack(rows)
                        rows, held = [], 0
                yield pack(rows)

    schema = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary"
    n = files.count()
    if not n:
        return spark.createDataFrame([], schema)
    counted = files.select(F.concat_ws("/", "folder", "name").alias("file"))
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(out)
    stored = stored.join(F.broadcast(counted) if n <= BROADCAST_FILES else counted, F.substring_index("path", "/", -2) == F.col("file"), "left_semi")
    return stored.select("content").mapInArrow(run, schema)


def dangling(records: DataFrame) -> DataFrame:
    """(page_id, refers_to, problem) of revisits in the rows of read that no response backs: missing, payload_digest or payload_bytes.

    A response that is there more than once backs a revisit if one of them agrees; revisits without a reference are missing theirs.
    """
    said = records.where("record_type = 'response'").select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes"))
    found = records.where("record_type = 'revisit'").select("page_id", "refers_to", "payload_digest", "payload_bytes").join(said, F.col("refers_to") == F.col("__id"), "left")
    same = F.col("payload_digest").eqNullSafe(F.col("__digest"))
    worst = F.when(F.col("__id").isNull(), 3).when(~same, 2).when(~F.col("payload_bytes").eqNullSafe(F.col("__bytes")), 1).otherwise(0)
    by = found.groupBy("page_id", "refers_to", "payload_digest", "payload_bytes").agg(F.min(worst).alias("k")).where("k > 0")
    return by.select("page_id", "refers_to", F.element_at(F.array(F.lit("payload_bytes"), F.lit("payload_digest"), F.lit("missing")), F.col("k")).alias("problem"))


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    out = scratch(pages.sparkSession, "warc")
    return read(out, write(pages, out, min_revisit_bytes=min_revisit_bytes)).drop("payload", "url")
