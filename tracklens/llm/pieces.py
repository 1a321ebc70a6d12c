"""Operator 1: SentencePiece encoding and decoding through distinct-chunk tables.

Where no piece of the model holds a whitespace marker after another character,
no piece crosses into a marked word, so the ids of a text are those of its
marked words, one after the other, and its decoding is theirs, without the
space that the model puts before a text. Each task keeps a table of the
marked words it has met, segments and decodes every new one once and joins ids
and decoded bytes back by position. There is no shuffle. The worker keeps the model
for its next task, but not the words: they would stay beside whatever runs later.

The table has two generations. When the young one holds TABLE_ENTRIES words or
TABLE_BYTES bytes it becomes the old one; words met again move over as they are. That bounds
memory, keeps what recurs and changes no result.

Null texts count as empty, so they give the begin and end ids alone. Repeated
rows and null ids are kept, row by row. A column of the input that has the name
of one added is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tracklens.llm.spark import leaving_nothing, with_fields

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
TABLE_ENTRIES = 150_000
TABLE_BYTES = 48 << 20


class ChunkTable:
    """Ids (as little-endian 32-bit integers) and decoded bytes of marked words."""

    def __init__(self, model: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces of this model cross whitespace markers")
        self.lone = sp.piece_to_id(MARK)
        self.begin, self.end = (np.array([x], "<u4").tobytes() for x in (sp.bos_id(), sp.eos_id()))
        raw = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        raw[sp.unk_id()] = sp.decode([self.lone, sp.unk_id()]).encode()
        self.leads = np.array([p.startswith(MARK) for p in pieces])
        self.size = np.array([len(x) for x in raw])
        self.at, self.raw = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(raw), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, bytes] = {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.held = 0

    def add(self, words: list[str]) -> None:
        """Enters words that the young table lacks; those that the old one lacks are segmented, each once."""
        if len(self.ids) >= TABLE_ENTRIES or self.held >= TABLE_BYTES:
            self.old, self.ids, self.text, self.held = (self.ids, self.text), {}, {}, 0
        ids, text = self.old
        new = [w for w in words if w not in ids]
        plain = [w for w in new if w[1:2] != MARK and len(w) > 1]
        if plain:  # one text of all words with a single marker; its pieces with a marker begin the words
            self._enter(plain, self.sp.encode(" ".join([w[1:] for w in plain])))
        for w in new if len(plain) < len(new) else ():
            if w not in self.ids:
                self._enter([w], [self.lone] if w == MARK else self.sp.encode(w[1:]))  # a lone marker stands at the end of a text only
        for w in words:
            if w not in self.ids:
                self.ids[w], self.text[w] = ids[w], text[w]
            self.held += len(self.ids[w]) + len(self.text[w]) + 4 * len(w)

    def _enter(self, words: list[str], ids: list[int]) -> None:
        x = np.array(ids, "<u4")
        first = np.flatnonzero(self.leads[x]) if len(words) > 1 else np.zeros(1, np.int64)
        if len(first) != len(words):
            raise ValueError("pieces don't follow the words")
        size = self.size[x]
        end = np.cumsum(size)
        text = self.raw[np.repeat(self.at[x] - (end - size), size) + np.arange(end[-1])].tobytes()
        raw, cuts, ends = x.tobytes(), [*(4 * first).tolist(), 4 * len(x)], [*(end - size)[first].tolist(), int(end[-1])]
        for w, i, j, k, m in zip(words, cuts, cuts[1:], ends, ends[1:], strict=False):
            self.ids[w], self.text[w] = raw[i:j], text[k:m]

    def both(self, text: str | None) -> tuple[bytes, bytes]:
        """All ids of a whole text, with begin and end, and what they decode to."""
        if not text:
            return self.begin + self.end, b""
        words = CHUNK.findall(MARK + text.replace(" ", MARK))
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        if new:
            kept = len(self.ids)
            self.add(new)
            if len(self.ids) < kept + len(new):  # a new generation has begun
                self.add([w for w in dict.fromkeys(words) if w not in self.ids])
        return b"".join([self.begin, *map(self.ids.__getitem__, words), self.end]), b"".join(map(self.text.__getitem__, words))[1:]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.both(text)[0], "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


@lru_cache(2)
def table(model: str) -> ChunkTable:
    return ChunkTable(model)


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """All columns of docs and ``ids`` (array of int): the whole text's ids with begin and end."""
    docs = docs.drop("ids")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(model)
        for b in batches:
            got = [t.encode(x.as_py()).astype(np.int32) for x in b.column(at)]
            off = np.zeros(len(got) + 1, np.int32)
            np.cumsum([len(x) for x in got], out=off[1:])
            ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*names, "ids"])

    return docs.mapInArrow(leaving_nothing(run, lambda: table(model).clear()), with_fields(docs, "ids array<int>"))


def decode(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """All columns of rows and ``decoded``: the text of the ids; null ids give null."""
    rows = rows.drop("decoded")
    names = rows.columns
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x if x is None else t.sp.decode(x) for x in b.column(at).to_pylist()], pa.string())], names=[*names, "decoded"])

    return rows.mapInArrow(run, with_fields(rows, "decoded string"))


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, n_decoded_bytes) of every whole text, and the columns in keep."""
    docs = docs.select(id_col, text_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(model)
        for b in batches:
            n, a, d, m = [], [], [], []
            for x in b.column(1):
                ids, back = t.both(x.as_py())
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(back).hexdigest())
                m.append(len(back))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(m, pa.int64())], names=[id_col, *keep, "n_tokens", "ids_sha256", "decoded_sha256", "n_decoded_bytes"])

    return docs.mapInArrow(leaving_nothing(run, lambda: table(model).clear()), with_fields(docs.drop(text_col), "n_tokens long, ids_sha256 string, decoded_sha256 string, n_decoded_bytes long"))
