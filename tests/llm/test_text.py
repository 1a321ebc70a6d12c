"""Tokens, counts, languages and scores: operators 1, 2, 4, 10."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, corpus, words
from tracklens.llm import contextmix, counting, langid, pieces
from tracklens.llm import words as w

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXT = st.text(st.sampled_from(list("ab  \n\t▁éñ中😀<s>/\x00ﬁ　​Z.")), max_size=40)


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_ids_are_those_of_the_library(text):
    got, back = pieces.table(MODEL).both(text)
    ids = np.frombuffer(got, "<u4").tolist()
    assert ids == SP.encode(text, add_bos=True, add_eos=True)
    assert back.decode() == SP.decode(ids)


def test_table_is_emptied_without_effect(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ENTRIES", 3)
    t = pieces.ChunkTable(MODEL)
    for text in ("a b c d e f", "", "a b", "x" * 5000, " " * 9 + "q"):
        assert t.encode(text).tolist() == SP.encode(text, add_bos=True, add_eos=True)
    want = t.both("a b c d")
    t.both("z")
    assert len(t.ids) == 1
    t.sp = None  # words of the old generation aren't segmented again
    assert t.both("a b c d") == want


def test_encode_decode_frames(spark):
    docs = spark.createDataFrame(corpus(), DOCS).withColumn("ids", F.lit("clash"))
    out = pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()
    assert len(out) == docs.count()
    for r in out:
        ids = SP.encode(r.text or "", add_bos=True, add_eos=True)
        assert (r.ids, r.decoded) == (ids, SP.decode(ids))
    digests = pieces.digests(docs, MODEL, keep=("lang",)).collect()
    want = Counter((r.doc_id, r.lang, len(r.ids), hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in out)
    assert Counter((r.doc_id, r.lang, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == want
    assert pieces.digests(docs.limit(0), MODEL).count() == 0


def test_tables_end_with_their_task(spark):
    """A worker that has encoded texts holds none of their words while later stages run in it."""

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(t.ids) + len(t.text) + len(t.old[0]) + t.held for t in [pieces.table(MODEL)]], pa.int64())], names=["n"])

    docs = spark.createDataFrame(corpus(), DOCS).repartition(4)
    for step in (pieces.digests, pieces.encode):
        assert step(docs, MODEL).count() == docs.count()
        step(docs, MODEL).collect()
        assert {r.n for r in spark.range(0, 64, 1, 64).mapInArrow(held, "n long").collect()} == {0}


VOCABULARY = {SP.id_to_piece(i) for i in range(SP.get_piece_size()) if not (SP.is_control(i) or SP.is_unknown(i) or SP.is_byte(i))}


def greedy(word):
    i = n = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if ("" if i else "▁") + word[i:j] in VOCABULARY and "▁" not in word[i:j]), None)
        if j is None:
            return 0
        i, n = j, n + 1
    return n


@given(st.text(st.sampled_from(list("abcdetionésth中▁<q😀")), min_size=1, max_size=16))
@settings(max_examples=400, deadline=None)
def test_automaton_counts_greedy_pieces(word):
    assert counting.automaton(MODEL).count(word) == greedy(word)


def test_small_vocabulary_needs_failure_links():
    a = counting.Automaton(["▁a", "▁abcd", "b", "bc", "c", "d", "dx"])
    assert [a.count(x) for x in ("abcd", "abcx", "abc", "abcdx", "a", "b", "abcddx")] == [1, 0, 2, 0, 1, 0, 2]


def test_token_counts(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    got = Counter((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in counting.token_counts(docs, MODEL).collect())
    want = Counter()
    for i, text, *_ in corpus():
        n = [greedy(x) for x in words(text, fold=False)]
        want[i, len(n), sum(x or 1 for x in n), n.count(0)] += 1
    assert got == want


def test_token_counts_of_nothing_and_clashing_columns(spark):
    assert counting.token_counts(spark.createDataFrame([], DOCS), MODEL).count() == 0
    rows = spark.createDataFrame([(1, "a b", "x", 5), (1, "a b", "y", 6), (None, None, "z", 7)], "doc_id long, text string, n_words string, n_tokens int")
    got = counting.token_counts(rows, MODEL)
    assert got.columns == ["doc_id", "n_words", "n_tokens", "n_unknown"]
    assert sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in got.collect()) == [(0, 0, 0), (1, 2, 2), (1, 2, 2)]


def test_words_and_hashes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\tÀ\xa0C") for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, ""]
    h, seen = w.Hasher(3, True), {}
    for s in w.slices(pa.array(texts), size=300):
        hashes, at = s.windows(s.hashes(h), 3, h, short=True)
        for d in range(len(s.first) - 1):
            ws = words(texts[s.at + d])
            assert [s.text(i).lower().decode() for i in range(s.first[d], s.first[d + 1])] == ws
            want = [tuple(ws[i : i + 3]) for i in range(max(len(ws) - 2, 1 if ws else 0))]
            got = [int(x) for x, i in zip(hashes, at, strict=True) if s.first[d] <= i < s.first[d + 1]]
            assert len(got) == len(want)
            assert all(seen.setdefault(a, b) == b for a, b in zip(got, want, strict=True))
    assert len(set(seen.values())) == len(seen)


SPELL = {"en": ["the", "and", "with", "ship"], "de": ["der", "und", "mit", "schiff"], "fr": ["le", "et", "avec", "bateau"], "es": ["el", "y", "con", "barco"]}


def test_languages_held_out(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(SPELL[x]) for _ in range(30)), x) for i, x in enumerate(rng.choice(list(SPELL)) for _ in range(400))]
    odd = [(1000, None, "en"), (1001, "12 !!", "de"), (1002, "", None), (None, "the ship", None), (1003, "the and " * 200000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(docs.where(~langid.held_out()), sample_rows=200)
    assert len(model.families) == 2
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 1000)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[None].lang_pred == "en" and by[1003].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    for r in docs.select("doc_id", langid.held_out().alias("h")).where("doc_id is not null").collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.predict(docs, langid.fit(docs)).first().lang_pred == "und"
    one = spark.createDataFrame([(1, "abc", "en")], "doc_id long, text string, lang string")
    assert langid.predict(one, langid.fit(one)).first().lang_pred == "en"
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_rows_without_letters_take_no_place_in_the_sample(spark):
    rows = [(i, f"{i} !!", "de") for i in range(400)] + [(500, "der und", "de"), (501, "the and", "en")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=16)
    assert model.langs == ["de", "en"]
    odd = ["12 !!", "", "_", "é", "中", "Ⅷ", "²", "٣", "\n\x00a", "😀"]
    got = spark.createDataFrame([(x,) for x in odd], "t string").select("t", F.col("t").rlike(langid.SQL_LETTER)).collect()
    assert [b for _, b in got] == [langid.has_letter(t) for t, _ in got] == [False, False, False, True, True, False, False, False, True, False]


def test_texts_without_letters_have_no_language(spark):
    docs = spark.createDataFrame([(1, "der und die", "de"), (2, "the and of", "en")], "doc_id long, text string, lang string")
    odd = ["²½", "①② ⑳", "Ⅷ Ⅻ", "12 ३४ ٣", "\u0301", "!?", "😀", " ", None]
    got = langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string"), langid.fit(docs)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(odd)
    assert langid.fit(docs.withColumn("text", F.lit("Ⅷ ²"))).langs == []


def test_more_families_rare_languages_and_repeated_rows(spark):
    """Nine languages in three alphabets, one of three rows alone; every row twice."""
    rng = random.Random(7)
    alphabets = ["abcdefgh", "ijklmnop", "абвгдежз"]
    vocabulary = {f"l{k}": ["".join(rng.choice(alphabets[k % 3]) for _ in range(4)) for _ in range(30)] for k in range(9)}
    rows = [(i, " ".join(rng.choice(vocabulary[x]) for _ in range(80)), x) for i, x in enumerate([f"l{k % 8}" for k in range(320)] + ["l8"] * 3)]
    held = {i for i, _, x in rows if i % 5 == 0 and x != "l8"}
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where(~F.col("doc_id").isin(*held)))
    assert len(model.langs) == 9 and len(model.families) == 3
    assert all(len({int(model.langs[i][1:]) % 3 for i in g}) == 1 for g in model.families)
    got = langid.predict(docs, model).collect()
    assert len(got) == 2 * len(rows)
    right = [r.lang_pred == r.lang for r in got if r.doc_id in held]
    assert sum(right) / len(right) > 0.95
    by = {}
    assert all(by.setdefault(r.doc_id, (r.lang_pred, r.score)) == (r.lang_pred, r.score) for r in got)


def votes(model, text):
    """A prediction again, from the weights, by plain loops."""
    v = langid.features(text)

    def duel(d):
        won, total, weakest = [0] * len(d.classes), [0.0] * len(d.classes), [math.inf] * len(d.classes)
        for (a, b), w_ in zip(d.pairs, d.weights, strict=True):
            m = sum(float(x) * float(y) for x, y in zip(w_[:-1], v, strict=True)) + float(w_[-1])
            won[a if m >= 0 else b] += 1
            total[a], total[b] = total[a] + m, total[b] - m
            weakest[a], weakest[b] = min(weakest[a], m), min(weakest[b], -m)
        best = sorted(range(len(won)), key=lambda i: (-won[i], -total[i], i))[0]
        return best, 1 / (1 + math.exp(-2 * max(-20, min(20, weakest[best])))) if d.pairs else 1.0

    family, a = duel(model.top)
    lang, b = duel(model.within[family])
    return model.langs[model.families[family][lang]], a * b


def test_votes_equal_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 3000)
    model = langid.fit(docs)
    for r in langid.predict(docs, model).orderBy("doc_id").limit(40).collect():
        lang, score = votes(model, r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-6)


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = "Größe und Maß " * 50
    whole = langid.features(text)
    monkeypatch.setattr(langid, "_PIECE", 37)
    np.testing.assert_allclose(langid.features(text), whole)
    assert langid.features("a").shape == whole.shape


def test_scores(spark):
    rows = [r for r in corpus() if r[0] is not None]
    docs = spark.createDataFrame(corpus(), DOCS)
    tokens = [(i, [x.encode() for x in words(t)] + [b"\n"]) for i, t, *_ in corpus()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(x for i, ts in tokens if not held(i) for x in ts)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ts), sum(c[x] > 0 for x in ts), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts), 4)) for i, ts in tokens)
    got = contextmix.score_texts(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got) and len(rows) + 2 == len(got)
    long = max(got, key=lambda r: r.n_tokens)
    assert long.score > long.base_score


def test_scores_depend_on_words_alone(spark):
    docs = spark.createDataFrame([(1, "Red  fish"), (2, "red\tfish\n"), (3, "blue fish red"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in contextmix.score_texts(docs).collect()}
    assert got[1] == pytest.approx(got[2])
    again = {r.doc_id: r.score for r in contextmix.score_texts(docs.repartition(3)).collect()}
    assert again == pytest.approx(got)
    assert contextmix.score_texts(docs.limit(0)).count() == 0


def test_scores_depend_on_the_order_of_words(spark):
    docs = spark.createDataFrame([(i, "red fish swims") for i in range(40)] + [(100, "swims red fish"), (101, "fish swims red"), (102, "red zebra")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in contextmix.score_texts(docs).collect()}
    assert got[1] > got[100] + 1 and got[1] > got[101] + 1 and got[1] == pytest.approx(got[2])


def test_probabilities_sum_to_one():
    """What can follow two tokens, the escape included, has a total probability of at most 1 in any context, after learning."""
    rng = np.random.default_rng(3)
    count = np.array([1] * 40 + [3] * 9 + [20, 70, 300])
    kinds, mass = np.bincount(contextmix.classes(count), minlength=64), np.bincount(contextmix.classes(count), weights=count, minlength=64)
    kinds[contextmix.ESCAPE], mass[contextmix.ESCAPE] = 1, 40
    book = contextmix.Code(mass.astype(float), kinds)
    rank = np.array([int((contextmix.classes(count[:i]) == contextmix.classes(count[i : i + 1])[0]).sum()) for i in range(len(count))])
    code, kind = book.of(np.append(count, 0), np.append(rank, 0))
    assert len(set(code.tolist())) == len(code)
    key = np.repeat(np.array([5, 5 << 28, (5 << 28) + 256], np.uint64), len(code))
    seen = np.concatenate([rng.integers(0, 2, len(code)), rng.integers(0, 90, len(code)) * (rng.random(len(code)) < 0.2), np.zeros(len(code))]).astype(np.int64)
    code, kind = np.tile(code, 3), np.tile(kind, 3)
    order = np.lexsort((code, key))
    score, _ = contextmix.code_contexts(key[order], code[order], kind[order], seen[order], book)
    total = [(10 ** score[key[order] == k]).sum() for k in np.unique(key)]
    assert all(0.4 < x <= 1 + 1e-9 for x in total)


def test_counters_are_exact():
    common = contextmix._common(np.array([0, 1 << 63], np.uint64), np.array([False, True]))
    assert contextmix._along(common, np.array([1 << 40, 1]), 2).tolist() == [[(1 << 40) + 1] * 2, [1 << 40, 1]]


def test_spelling_sums_to_one():
    known = [b"aa", b"ab", b"ba", b"abc"]
    every = [bytes([b]) for b in range(33, 127)]
    words_ = [*known, *every]
    got = contextmix.spell(np.frombuffer(b"".join(words_), np.uint8), np.array([len(x) for x in words_]), np.array([1, 1, 1, 5] + [0] * len(every)))
    assert (got[:4] == 0).all() and 0 < (10 ** got[4:]).sum() < 1 and got[4 + 97 - 33] > got[4 + 122 - 33]


def slow_scores(rows):
    """The model again, by dictionaries and one context at a time."""
    from tracklens.llm.words import join, mix

    U = np.uint64
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    texts = [(i, [x.encode() for x in words(t)] + [b"\n"]) for i, t in rows]
    count = Counter(x for i, ts in texts if not held(i) for x in ts)
    hashes = {}
    for s in w.slices(pa.array([" ".join(x.decode() for x in ts[:-1]) for _, ts in texts])):
        hashes |= {s.text(k): h for k, h in enumerate(s.hashes(contextmix._WORD))}
    hashes[b"\n"] = contextmix._END_HASH
    kind_of = lambda x: count[x].bit_length() - 1 if count[x] else 63
    kinds, mass = np.zeros(64, int), np.zeros(64)
    for x in count:
        kinds[kind_of(x)] += 1
        mass[kind_of(x)] += count[x]
    kinds[63], mass[63] = 1, max(1, mass[0])
    book = contextmix.Code(mass, kinds)
    rank = {}
    for x in sorted(count, key=lambda x: hashes[x]):
        rank[x] = sum(1 for y in rank if kind_of(y) == kind_of(x))
    unknown = sorted((x for x in hashes if x not in count), key=lambda x: hashes[x])
    known = sorted(count, key=lambda x: hashes[x])
    every = sorted(known + unknown, key=lambda x: hashes[x])
    spelled = dict(zip(every, contextmix.spell(np.frombuffer(b"".join(every), np.uint8), np.array([len(x) for x in every]), np.array([count[x] for x in every])), strict=True))

    def bits(x):
        c, _ = book.of(np.array([count[x]]), np.array([rank.get(x, 0)]))
        return format(int(c[0]), "064b")[: int(book.length[kind_of(x)])]

    def contexts(ts):
        before = [b"\n", b"\n", *ts]
        for k, x in enumerate(ts):
            one, two = np.array([hashes[before[k + 1]]]), np.array([hashes[before[k]]])
            a = mix(one + mix(two) % U(count[before[k + 1]] // contextmix.SPLIT + 1) * U(0xD6E8FEB86659FD93))[0] >> U(28)
            yield int(a), int(join(two, one)[0] >> U(44)), x

    told, asked = Counter(), set()
    for i, ts in texts:
        for a, b, x in contexts(ts):
            asked.add((a, b, bits(x), x))
            told[a, b, x] += not held(i)
    one, two = Counter(), Counter()
    for (a, b, x), c in told.items():
        for k in range(len(bits(x)) + 1):
            one[a, bits(x)[:k]] += c
            two[a, b, bits(x)[:k]] += c
    steps = lambda n: next(s for s, top in enumerate((0, 1, 2, 4, 8, 16, math.inf)) if n <= top)
    lean = lambda own, all_: math.log((own + 0.4) / (all_ - own + 0.4))

    def events(a, b, code, x, own):
        for d in range(len(code)):
            o2, a2, o1, a1 = (t - own for t in (two[a, b, code[: d + 1]], two[a, b, code[:d]], one[a, code[: d + 1]], one[a, code[:d]]))
            yield [float(book.logit[min(d, len(book.logit) - 1), kind_of(x)]), lean(o1, a1), lean(o2, a2)], ((steps(a2) * 7 + steps(a1)) * 2 + (o2 in (0, a2))) * 2 + (d < book.width[kind_of(x)])

    w_, hit, total = [[0.5] * 3 for _ in range(196)], Counter(), Counter()
    order = sorted(asked)

    def coded(xs, g):
        z = max(-14, min(14, sum(p * q for p, q in zip(w_[g], xs, strict=True))))
        p = 1 / (1 + math.exp(-abs(z)))
        at = (g, round(abs(z) * 2))
        better = min(1 - 1e-7, max(1e-7, 0.5 * p + 0.5 * (hit[at] + 8 * p) / (total[at] + 8)))
        return z, at, better if z > 0 else 1 - better if z < 0 else 0.5

    def learn(some, map_too):
        up, down, seen = Counter(), Counter(), []
        for k in some:
            c = told[k[0], k[1], k[3]]
            for xs, g in events(*k, 1) if c else ():
                z, at, _ = coded(xs, g)
                q = 1 / (1 + math.exp(-z))
                for j in range(3):
                    up[g, j] += (1 - q) * c * xs[j]
                    down[g, j] += q * (1 - q) * c * xs[j] ** 2
                seen.append((at, c, 1 if z > 0 else 0 if z < 0 else 0.5))
        for g, j in up:
            w_[g][j] += contextmix.RATE * max(-2, min(2, up[g, j] / (down[g, j] + 4)))
        for at, c, up_ in seen if map_too else ():
            hit[at] += c * up_
            total[at] += c

    cost, segments = {}, []
    for k in order:  # whole last tokens until a segment has enough contexts of training texts
        if not segments or k[0] != segments[-1][-1][0] and sum(told[x[0], x[1], x[3]] > 0 for x in segments[-1]) >= contextmix.SEGMENT:
            segments.append([])
        segments[-1].append(k)
    for n, some in enumerate(segments):
        for _ in range(contextmix.WARM if n == 0 else 0):
            learn(some, False)
        for k in some:
            cost[k] = sum(math.log10(coded(xs, g)[2]) for xs, g in events(*k, 0)) + spelled[k[3]]
        learn(some, True)
    slow_scores.segments, slow_scores.bins = len(segments), sum(v > 0 for v in total.values())
    return {i: sum(cost[a, b, bits(x), x] for a, b, x in contexts(ts)) for i, ts in texts}


def test_scores_equal_a_slow_version(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(60)))) for i in range(60)] + [(99, None), (100, "Never SEEN words w1")]
    rows += [(200 + i, rows[3][1]) for i in range(3)]
    got = {r.doc_id: r.score for r in contextmix.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pytest.approx(slow_scores(rows), rel=5e-3)  # costs come in parts of a bit, and single precision moves a few events to the next bin of the map


def test_several_segments_and_a_filled_map_equal_a_slow_version(spark, monkeypatch):
    monkeypatch.setattr(contextmix, "SEGMENT", 150)
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(70)))) for i in range(70)] + [(99, "new words of one text w1 w2"), (100, None)]
    t = pa.table({"id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    x = contextmix.Lexicon(t, bytes_too=True)  # in this process, where SEGMENT is small
    want = slow_scores(rows)
    assert slow_scores.segments > 5 and slow_scores.bins > 30
    kinds, mass = (np.bincount(contextmix.classes(x.count), weights=y, minlength=64) for y in (None, x.count))
    kinds[63], mass[63] = 1, max(1, mass[0])
    book, of = contextmix.Code(mass.astype(float), kinds.astype(int)), contextmix.classes(x.count)
    rank = np.array([int((of[:i] == of[i]).sum()) if x.count[i] else 0 for i in range(len(of))])
    c = contextmix.Contexts(x, x.count, 0)
    code, kind = book.of(x.count, rank)
    order = np.lexsort((code[c.token], c.key))
    got = np.empty(len(order))
    at, run = contextmix.runs(c.key[order], code[c.token][order])  # tokens that no training text has share a code
    one = order[at]
    score, _ = contextmix.code_contexts(c.key[one], code[c.token][one], kind[c.token][one], np.add.reduceat(c.count[order], at), book)
    got[order] = score[run]
    spelled = contextmix.spell(x.raw, x.size, x.count)
    sums = np.bincount(x.doc, weights=got[c.of] + spelled[x.token])
    assert dict(zip(t.column("id").to_pylist(), sums, strict=True)) == pytest.approx(want, rel=5e-3)


def test_held_out_texts_change_no_other_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held = sorted(r.doc_id for r in docs.select("doc_id").collect() if contextmix.is_held_out(r.doc_id))
    gone = set(held[::2])
    want = {r.doc_id: (r.score, r.fresh_bits_per_byte) for r in contextmix.score_texts(docs).collect() if r.doc_id not in gone}
    got = {r.doc_id: (r.score, r.fresh_bits_per_byte) for r in contextmix.score_texts(docs.where(~F.col("doc_id").isin(*gone))).collect()}
    assert len(gone) > 5 and got.keys() == want.keys()
    assert max(abs(got[k][0] / want[k][0] - 1) for k in got) < 1e-6
    other = docs.withColumn("text", F.when(F.col("doc_id").isin(*gone), "quite other zebra words " * 3000).otherwise(F.col("text")))
    got = {r.doc_id: r.score for r in contextmix.score_texts(other).collect() if r.doc_id not in gone}
    assert max(abs(got[k] / want[k][0] - 1) for k in got) < 1e-6


def test_costs_of_any_size():
    x = np.array([0.0, 1e-9, -1.0, -400.0, -1e6])
    back = contextmix.unpack(contextmix.pack(contextmix.parts_of_a_bit(x))).astype(float) / (-np.log2(10) * contextmix.GRAIN)
    assert back == pytest.approx(x, abs=2e-3)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("score", F.lit("clash"))
    usual, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 5, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append({r.doc_id: (r.score, r.fresh_bits_per_byte) for r in contextmix.score_texts(docs.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    for other in out[1:]:
        assert {k: v[0] for k, v in other.items()} == pytest.approx({k: v[0] for k, v in out[0].items()}, rel=1e-9)
        assert {k: v[1] for k, v in other.items()} == pytest.approx({k: v[1] for k, v in out[0].items()}, rel=1e-9)


def test_repeated_texts_stand_apart(spark):
    rng = random.Random(4)
    texts = [" ".join(f"v{rng.randrange(300)}" for _ in range(80)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:20])], "doc_id long, text string")
    got = {r.doc_id: r.fresh_bits_per_byte for r in contextmix.score_texts(docs).collect()}
    twice = [got[i] for i in range(20) if not (contextmix.is_held_out(i) or contextmix.is_held_out(1000 + i))]
    assert len(twice) > 10 and max(twice) < min(got[i] for i in range(20, 120))


def test_frequent_tokens_are_dealt_out(spark, monkeypatch):
    """Hot tokens in many contexts, and hot pairs by the group, change what is counted together, never what is coded."""
    rows = [(i, f"a b {i % 7} a b c{i % 3}") for i in range(60)]
    table = pa.table({"id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    x = contextmix.Lexicon(table)
    counts = np.full(len(x.h), 1 << 30)
    parts = [contextmix.Contexts(x, counts, g) for g in (0, 1)]
    assert all(int(p.count.sum()) == int(x.length[x.train].sum()) and len(p.of) == len(x.token) for p in parts)
    assert set(parts[0].key.tolist()) != set(parts[1].key.tolist())
    assert len(set((parts[0].key >> np.uint64(28)).tolist())) > len(set((contextmix.Contexts(x, counts * 0, 0).key >> np.uint64(28)).tolist()))
