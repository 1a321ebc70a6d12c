"""Operator 13: byte-pair encoding and decoding with a contiguous array of ranks.

A word is a string of symbols: one for each of its bytes, another set of symbols for a byte that ends a word.
Its parts stand in an array, and beside them, for each boundary between two, the rank of their merge. The
smallest rank is looked for again and again (the leftmost where it is held twice), its boundary goes, and the ranks
on both sides of the new part are looked up anew. That is the least work for short words; words of more than LONG
symbols get the same merges from a heap of the same ranks, in n log n steps.

Texts are cut at ASCII white space first. The tokenizers that this operator takes (word ends, white space dropped)
never carry anything across it, which is checked, so that ids of a text are those of its words, one after the
other. Each word is normalised and cut into pieces by the library's own normaliser and pre-tokeniser, so both agree
with it in every character class; words of printable ASCII are cut by the tokenizer's own pattern. Strings of added tokens inside a text count as these tokens, as the library does.

Each worker keeps a table of the words that it has met, with their ids and their decoded bytes. It has two generations:
when the young one holds TABLE_ENTRIES words or TABLE_BYTES bytes it becomes the old one, and words met again move over as
they are. A second table of the same kind holds the pieces of words, since many words differ in case and signs around them
alone. That bounds memory, keeps what recurs and changes no result. There is no shuffle.

Null and empty texts, and such of white space alone, have no ids and decode to nothing. Repeated rows and null ids are kept,
row by row. A column of the input that has the name of one added is replaced. The memory of a task follows the longest text;
texts are never cut short.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tracklens.llm.spark import with_fields

TABLE_ENTRIES = 250_000
TABLE_BYTES = 48 << 20
PIECE_ENTRIES = 150_000
LONG = 256
NEVER = 1 << 62


class Merges:
    """Ranks of merges and ids of tokens over a string of symbols; a symbol is the character with its token's id."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        made = {a + b for a, b in merges}
        spelled = {t: chr(i) for t, i in vocab.items() if t not in made}
        if max(map(ord, spelled.values())) >= 0xD800 or max(vocab.values()) >= 1 << 20:
            raise ValueError("too many tokens")
        self.rank: dict[tuple[str, str], int] = {}
        self.pair: dict[int, int] = {}  # the same by tokens
        self.made = [vocab[a + b] for a, b in merges]
        for r, (a, b) in enumerate(merges):
            spelled.setdefault(a + b, spelled[a] + spelled[b])
            self.rank[spelled[a], spelled[b]] = self.pair[vocab[a] << 20 | vocab[b]] = r
        self.token = {s: vocab[t] for t, s in spelled.items()}
        self.inner = {ord(t): s for t, s in spelled.items() if len(t) == 1}
        self.last = {t[0]: s for t, s in spelled.items() if len(t) == 1 + len(suffix) and t.endswith(suffix) and t not in made}

    def symbols(self, piece: str) -> str:
        return piece[:-1].translate(self.inner) + self.last[piece[-1]]

    def ids(self, word: str) -> list[int]:
        if len(word) <= LONG:
            return self.scanned(word)
        cut = self.queued(word)
        return [self.token[word[i:j]] for i, j in zip(cut, cut[1:], strict=False)]

    def scanned(self, word: str) -> list[int]:
        """Tokens of the parts that are left when no two neighbours have a merge. A part is held by its token, a boundary by the
        rank of its two sides, so both arrays stay without gaps."""
        look, made = self.pair.get, self.made
        parts = [ord(x) for x in word]
        ranks = [look(a << 20 | b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            parts[i] = new = made[least]
            del parts[i + 1], ranks[i]  # the boundary goes
            if i:
                ranks[i - 1] = look(parts[i - 1] << 20 | new, NEVER)
            if i < len(ranks):
                ranks[i] = look(new << 20 | parts[i + 1], NEVER)
        return parts

    def queued(self, word: str) -> list[int]:
        """Boundaries of the parts that scanned gives; for long words, whose array would be read too often."""
        look, n = self.rank.get, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins here; an end of 0: none does
        queue = [(r, i, i + 1, i + 2) for i, pair in enumerate(zip(word, word[1:], strict=False)) if (r := look(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, j, k = heapq.heappop(queue)
            if end[i] != j or end[j] != k:
                continue  # one of the two parts has changed since
            end[i], end[j] = k, 0
            before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := look((word[a:b], word[b : end[b]]))) is not None:
                    heapq.heappush(queue, (r, a, b, end[b]))
        return [i for i in range(n) if end[i]] + [n]


class WordTable:
    """Ids (as little-endian 32-bit integers) and decoded bytes, a space behind each token, of words."""

    def __init__(self, path: str):
        tok = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or not model.get("end_of_word_suffix") or tok.decoder is not None or tok.normalizer is None or tok.pre_tokenizer is None:
            raise ValueError("a BPE model with word ends, a normaliser, a pre-tokeniser and no decoder is needed")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"[\s]", t["content"]) for t in spec["added_tokens"]):
            raise ValueError("added tokens with conditions aren't supported")
        self.norm, self.pre = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        for space in "\x20\x09\x0a\x0b\x0c\x0d":
            if [p for p, _ in self.pre(self.norm(f"a{space}b"))] != ["a", "b"]:
                raise ValueError("this pre-tokeniser keeps white space")
        self.merges = Merges(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.name = {i: t.encode() + b" " for t, i in tok.get_vocab(with_added_tokens=True).items()}
        self.plain = _plain_pattern(spec)
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, bytes] = {}
        self.text: dict[bytes, bytes] = {}
        self.old: tuple[dict[bytes, bytes], dict[bytes, bytes]] = ({}, {})
        self.held = 0
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.old_pieces: dict[str, tuple[bytes, bytes]] = {}

    def word(self, word: str) -> list[tuple[bytes, bytes]]:
        """Ids and decoded bytes of the pieces of a text without ASCII white space."""
        if not self.split or not self.split.search(word):
            return [self.piece(p) for p in self._cut(word)]
        out, at = [], 0
        for m in self.split.finditer(word):
            i = self.added[m[0]]
            out += [*map(self.piece, self._cut(word[at : m.start()])), (np.array([i], "<u4").tobytes(), self.name[i])]
            at = m.end()
        return out + [self.piece(p) for p in self._cut(word[at:])]

    def _cut(self, word: str) -> list[str]:
        if self.plain and word.isascii() and word.isprintable():
            return self.plain(word.lower())
        return [p for p, _ in self.pre(self.norm(word))] if word else []

    def piece(self, piece: str) -> tuple[bytes, bytes]:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= PIECE_ENTRIES:
                self.old_pieces, self.pieces = self.pieces, {}
            found = self.old_pieces.get(piece)
            if found is None:
                x = self.merges.ids(self.merges.symbols(piece))
                found = array("I", x).tobytes(), b"".join(map(self.name.__getitem__, x))
            if len(piece) <= LONG:
                self.pieces[piece] = found
        return found

    def add(self, words: set[bytes]) -> None:
        """Enters words that the young table lacks; those that the old one lacks are encoded, each once."""
        ids, text = self.old
        for w in words:
            if w in ids:
                self.ids[w], self.text[w] = ids[w], text[w]
            else:
                got = self.word(w.decode())
                self.ids[w], self.text[w] = got[0] if len(got) == 1 else (b"".join([x for x, _ in got]), b"".join([x for _, x in got]))
            self.held += len(w) + len(self.ids[w]) + len(self.text[w])

    def both(self, text: bytes | None) -> tuple[bytes, bytes]:
        """All ids of a whole text in UTF-8, and what they decode to."""
        if len(self.ids) >= TABLE_ENTRIES or self.held >= TABLE_BYTES:
            self.old, self.ids, self.text, self.held = (self.ids, self.text), {}, {}, 0
        words = text.split() if text else []
        self.add({w for w in words if w not in self.ids})
        return b"".join(map(self.ids.__getitem__, words)), b"".join(map(self.text.__getitem__, words))[:-1]

    def decode(self, ids: list[int | None]) -> str:
        return b"".join(self.name.get(i, b"") for i in ids)[:-1].decode()


def _plain_pattern(spec: dict) -> Callable[[str], list[str]] | None:
    """How printable ASCII words in lower case are cut, where the tokenizer does nothing else to them: its own pattern, whose
    classes are the same for ASCII in any version of Unicode. None: the library cuts them."""
    norm, pre = spec["normalizer"], spec["pre_tokenizer"]
    kinds = [n["type"] for n in norm.get("normalizers", [norm])]
    steps = pre.get("pretokenizers", [pre])
    lowers = kinds.count("Lowercase") == 1 and set(kinds) <= {"NFC", "Lowercase", "Replace"} and all(n["pattern"] == {"Regex": r"\s+"} for n in norm.get("normalizers", []) if n["type"] == "Replace")
    if not lowers or [p["type"] for p in steps] != ["Split", "ByteLevel"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        return None
    if steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or "Regex" not in steps[0]["pattern"]:
        return None
    return regex.compile(steps[0]["pattern"]["Regex"]).findall


@lru_cache(2)
def table(path: str) -> WordTable:
    return WordTable(path)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns of docs and ``ids`` (array of int): the whole text's ids."""
    docs = docs.drop("ids")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for b in batches:
            got = [np.frombuffer(t.both(x.as_py())[0], "<i4") for x in b.column(at).cast(pa.binary())]
            off = np.cumsum([0, *map(len, got)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*names, "ids"])

    return docs.mapInArrow(run, with_fields(docs, "ids array<int>"))


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of rows and ``decoded``: the tokens of the ids, a space between two; null ids give null, unknown ones nothing."""
    rows = rows.drop("decoded")
    names = rows.columns
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x if x is None else t.decode(x) for x in b.column(at).to_pylist()], pa.string())], names=[*names, "decoded"])

    return rows.mapInArrow(run, with_fields(rows, "decoded string"))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, n_decoded_bytes) of every whole text."""
    docs = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for b in batches:
            n, a, d, m = [], [], [], []
            for x in b.column(1).cast(pa.binary()):
                ids, back = t.both(x.as_py())
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(back).hexdigest())
                m.append(len(back))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(m, pa.int64())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_decoded_bytes"])

    return docs.mapInArrow(run, with_fields(docs.drop(text_col), "n_tokens long, ids_sha256 string, decoded_sha256 string, n_decoded_bytes long"))
