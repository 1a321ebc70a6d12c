"""The five stages against brute force, one after the other."""

import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.fixtures import prose, words
from tests.llm.test_pairs import contamination, near_reference, removal_reference

NAMES = {"en": "the and with ship", "de": "der und mit schiff"}


def documents():
    rng = random.Random(12)
    item = prose(rng, 25, 300)
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        text = " ".join(rng.choice(NAMES[lang].split() + [prose(rng, 1, 300)]) for _ in range(50))
        rows.append((i, text, lang, "s", len(text)))
    passage = prose(rng, 20, 300)
    rows += [(100, rows[3][1], "de", "s", 0), (101, rows[4][1] + " more", "en", "s", 0), (102, f"{rows[5][1][:60]} {passage}", "en", "s", 0), (103, f"{passage} {rows[6][1][:90]}", "en", "s", 0)]
    rows += [(104, f"{rows[7][1][:80]} {item}", "de", "s", 0), (105, "12 34 !!", "en", "s", 0), (106, None, "en", "s", None), (107, passage, "en", "s", 0)]
    return rows, item


def test_stages(spark, tmp_path):
    rows, item = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {i: t for i, t, *_ in rows if i not in (105, 106)}
    of = near_reference(list(kept.items()), 80, 100)
    kept = {i: t for i, t in kept.items() if of[i] == i}
    assert 100 not in kept and 101 not in kept
    removed = {i: (n, m, t) for i, n, m, t in removal_reference(list(kept.items()), 13)}
    kept = {i: removed[i][2] if removed[i][1] else t for i, t in kept.items() if not removed[i][1] or removed[i][1] < removed[i][0]}
    assert 107 not in kept and len(words(kept[103])) < len(words(rows[63][1]))
    bad = {i for i, *_ in contamination(list(kept.items()), [(1, item)])}
    assert bad == {104}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i, t in kept.items():
        if i not in bad:
            ids = sp.encode(t, add_bos=True, add_eos=True)
            want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out} == want
    assert len(out) == len(want)

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_documents_without_any_language_are_kept(spark):
    docs = spark.createDataFrame([(1, "the ship", None), (2, "12 !!", None), (3, None, None), (4, "", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [1]


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_rows_that_repeat(spark, tmp_path):
    """Null ids, full copies of a row, and ids that stand for several texts, with a column that clashes."""
    rng = random.Random(3)
    a, b, c = (" ".join(rng.choice(["the", "ship", prose(rng, 1, 900)]) for _ in range(60)) for _ in range(3))
    rows = [(1, a, "en", "s", 0), (1, a, "en", "s", 0), (1, b, "en", "t", 0), (2, b, "en", "s", 0), (None, c, "en", "s", 0), (None, c, "en", "s", 0), (3, c, "en", "s", 0), (1, a, "en", "u", 0), (4, "solo the ship", None, "s", 0)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, text_hash string")
    out = corpus_pipeline.minhash_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (1, b), (0, c), (0, c), (3, c), (4, "solo the ship")], key=str)
    told = corpus_pipeline.language_id(spark, docs, "")
    assert told.columns == docs.columns and {r.lang for r in told.collect()} == {"en"}


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Null ids, rows that repeat whole, null benchmark texts and names that clash, through run()."""
    rng = random.Random(15)
    item = prose(rng, 30, 400)
    text = lambda: " ".join(rng.choice(["the", "ship", "and", prose(rng, 1, 900)]) for _ in range(50))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a, "en", "s", 0), (1, a, "en", "s", 0), (2, b, "en", "s", 0), (None, c, "en", "s", 0), (None, c, "en", "s", 0), (None, f"{d[:50]} {item}", "en", "s", 0), (None, None, None, None, None), (3, f"{d} {item}", "en", "s", 0), (4, "²² 12", "en", "s", 0)]
    spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, words string, score int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None, "clash"), (None, item, None), (2, item, None), (3, "", None)], "item_id long, text string, lang string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 0, 1, 2]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: hashlib.sha256(np.array(sp.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest() for i, t in ((1, a), (2, b), (None, c))}
    assert all(r.ids_sha256 == want[r.doc_id] for r in out)


def test_documents_whose_label_is_contradicted_go(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(NAMES[x].split()) for _ in range(40)), x) for i, x in enumerate(["en", "de"] * 60)]
    rows += [(500, "der und mit schiff " * 20, "en"), (501, "the and with ship " * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert 500 not in got and got[501] == "en" and len(got) == 121
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from tracklens import lineage

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint"):
        lineage.shared_dir(bare)
