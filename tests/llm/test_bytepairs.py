"""Operator 13 against the library and against merging by hand."""

import hashlib
import json
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import DOCS, corpus
from tracklens.llm import bytepairs

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
TEXT = st.text(st.one_of(st.sampled_from(list("abthein'sSdre  \n\t\x0b\x1c\x85\xa0İßéé́中😀<|>/w12²½Ⅷ①\x00 　ﬁΣς.!?")), st.characters(exclude_categories=("Cs",))), max_size=60)
PARTS = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "e", "́", " ", "\n", "It's", "</w>", "the", " ", "12", "''ll", "!!'s", "\x85"]), max_size=12).map("".join)


def library(text):
    ids = TOK.encode(text or "", add_special_tokens=False).ids
    return ids, TOK.decode(ids, skip_special_tokens=False)


def same(text):
    got, back = bytepairs.table(PATH).both(text.encode())
    assert (np.frombuffer(got, "<u4").tolist(), back.decode()) == library(text)


@given(TEXT)
@settings(max_examples=600, deadline=None)
def test_ids_are_those_of_the_library(text):
    same(text)


@given(PARTS)
@settings(max_examples=400, deadline=None)
def test_added_tokens_and_borders(text):
    same(text)


@pytest.mark.parametrize("text", ["", " \t\n", "\xa0", "a" * 5000, "internationalization" * 40, "ö" * 700 + "!" * 900, "中文" * 800, "́" * 300, "x " * 3000, "<|endoftext|>" * 50, "'" * 2000 + "s"])
def test_long_and_odd_texts(text):
    same(text)


@given(st.text(st.sampled_from(list("aeinorst")), min_size=1, max_size=400))
@settings(max_examples=200, deadline=None)
def test_the_array_and_the_queue_merge_alike(word):
    m = bytepairs.table(PATH).merges
    s = m.symbols(word)
    cut = m.queued(s)
    assert m.scanned(s) == [m.token[s[i:j]] for i, j in zip(cut, cut[1:], strict=False)]


def test_merges_by_hand():
    """Ranks decide before position, the leftmost of equal ranks goes first, and a word's last symbol is its own."""
    vocab = {t: i for i, t in enumerate(["a", "b", "a/", "b/", "ab", "ba", "aba", "ab/", "aab/"])}
    m = bytepairs.Merges(vocab, [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "b/"), ("a", "ab/")], "/")
    names = list(vocab)

    def ids(word):
        return [names[i] for i in m.ids(m.symbols(word))]

    assert ids("a") == ["a/"]
    assert ids("ab") == ["ab/"]
    assert ids("aab") == ["aab/"]
    assert ids("abab") == ["aba", "b/"]
    assert ids("bab") == ["ba", "b/"]  # rank 1 goes before rank 3
    assert ids("ababa") == ["ab", "ab", "a/"]


def test_table_is_emptied_without_effect(monkeypatch):
    monkeypatch.setattr(bytepairs, "TABLE_ENTRIES", 3)
    monkeypatch.setattr(bytepairs, "PIECE_ENTRIES", 2)
    t = bytepairs.WordTable(PATH)
    rng = random.Random(3)
    for _ in range(60):
        text = " ".join(rng.choice(["one", "two", "three's", "x<|endoftext|>y", "\xa0", "FÜNF"]) for _ in range(rng.randrange(9)))
        got, back = t.both(text.encode())
        assert (np.frombuffer(got, "<u4").tolist(), back.decode()) == library(text)
    want = t.both(b"a b c d")
    t.both(b"z")
    assert len(t.ids) == 1
    t.merges = t.pieces = None  # words of the old generation aren't merged again
    assert t.both(b"a b c d") == want


@given(st.text(st.characters(min_codepoint=33, max_codepoint=126), max_size=40))
@settings(max_examples=400, deadline=None)
def test_printable_words_are_cut_as_the_library_cuts_them(word):
    t = bytepairs.table(PATH)
    assert t.plain(word.lower()) == [p for p, _ in t.pre(t.norm(word))]


def test_the_pattern_is_used_for_such_tokenizers_alone():
    spec = json.loads(Path(PATH).read_text())
    assert bytepairs._plain_pattern(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}):
        assert bytepairs._plain_pattern(spec | change) is None


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="word ends"):
        bytepairs.WordTable(public_tokenizers.path("byte_bpe_50k.json"))


def test_frames(spark):
    docs = spark.createDataFrame(corpus(), DOCS).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1)).withColumn("n_tokens", F.lit("clash"))
    out = bytepairs.decode(bytepairs.encode(docs, PATH), PATH).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.ids, r.decoded) == library(r.text)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytepairs.digests(docs, PATH).collect())
    assert got == Counter((r.doc_id, len(r.ids), hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in out)
    assert bytepairs.digests(docs.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([(1, [320, None, 10**9]), (2, None), (3, [])], "id long, ids array<int>")
    assert {r.id: r.decoded for r in bytepairs.decode(odd, PATH).collect()} == {1: TOK.decode([320]), 2: None, 3: ""}
