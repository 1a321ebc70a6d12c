"""Duplicates, neighbours, contamination, rules and archives against brute force: operators 3, 5, 6, 7, 8, 9."""

import base64
import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, components, corpus, find, lower, prose, words
from tracklens.llm import decontaminate, minhash, neighbours, packed, substrings, urls, warc
from tracklens.llm.spark import components as spark_components


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1 if w else 0)))


def near_reference(rows, num, den):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingles(t))
    links = [(a, b) for a in sets for b in sets if a < b and any(s and r and den * len(s & r) >= num * len(s | r) for s in sets[a] for r in sets[b])]
    return components(sets, links)


@pytest.mark.parametrize("num", [85, 80, 50])
def test_near_duplicates(spark, num):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    of = near_reference(rows, num, 100)
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs, num=num).collect())
    assert got == Counter((i, len(shingles(t)), of.get(i), i is None or of[i] == i) for i, t, *_ in rows)


@pytest.mark.parametrize("block", [1024, 7])
def test_no_link_is_lost_between_stars(spark, monkeypatch, block):
    """A chain of texts each close to the next alone, and many that share half their words."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(8)
    w = prose(rng, 150, 900).split()
    rows = []
    for i in range(25):
        rows.append((1000 - i, " ".join(w)))
        w[6 * i] = f"c{i}"
    half = prose(rng, 60, 900)
    rows += [(2000 + i, f"{half} {prose(rng, 40, 900)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = near_reference(rows, 85, 100)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == of


def test_shuffles_of_crossed_buckets_are_released(spark, monkeypatch):
    """What _cross shuffles to gather sets is dropped before the next step; Spark keeps the shuffles of the last plan until another runs."""
    rng = random.Random(8)
    w = prose(rng, 150, 900).split()
    rows = []
    for i in range(25):
        rows.append((1000 - i, " ".join(w)))
        w[6 * i] = f"c{i}"
    half = prose(rng, 60, 900)
    rows += [(2000 + i, f"{half} {prose(rng, 40, 900)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    live = lambda: {int(k) for k in tracker.shuffleStatuses().keySet().mkString(",").split(",") if k}
    cross, release, seen = minhash._cross, minhash.release, {}

    def crossing(*a):
        seen["before"] = max(live(), default=-1)
        out = cross(*a)
        seen["crossed"] = True
        return out

    def releasing(session):
        release(session)
        if "crossed" in seen and "left" not in seen:
            for _ in range(100):  # the cleaner works in a thread of its own
                if seen["before"] + 1 not in (left := live()):
                    break
                time.sleep(0.1)
            seen["left"] = left

    monkeypatch.setattr(minhash, "_cross", crossing)
    monkeypatch.setattr(minhash, "release", releasing)
    minhash.near_duplicates(docs).collect()
    assert "crossed" in seen and seen["before"] + 1 not in seen["left"]


def thue_morse(n):
    """A word of 2**n letters and its complement: their hashes are equal under every polynomial modulo 2**64 once n is 11."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [11, 13])
def test_structured_words_do_not_collide(spark, n):
    x, y = thue_morse(n)
    rest = " ".join(f"c{i}" for i in range(12))
    rows = [(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, x), (4, y), (5, " ".join(x)), (6, " ".join(y)), (7, f"{x} {rest}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == near_reference(rows, 85, 100)
    removed = {r.doc_id: r.n_removed for r in substrings.dedup(docs, digest=True).collect()}
    assert removed == {i: brute_removed(rows, i) for i, _ in rows}
    assert removed[2] == 0 and removed[7] == 13


def brute_removed(rows, i, k=13):
    earlier = {tuple(w[p : p + k]) for j, t in rows if j < i for w in [words(t, fold=False)] for p in range(len(w) - k + 1)}
    w = words(dict(rows)[i], fold=False)
    return len({p + q for p in range(len(w) - k + 1) if tuple(w[p : p + k]) in earlier for q in range(k)})


def test_a_large_star_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(minhash, "STAR", 4)
    rng = random.Random(9)
    base = prose(rng, 120, 900).split()
    rows = [(i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == near_reference(rows, 85, 100)


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_estimates_are_close():
    rng = np.random.default_rng(3)
    for size in (8, 60, 900):
        h = rng.integers(0, 2**63, (40, size * 2)).astype(np.uint64)
        level = int(minhash._level(np.array([size]))[0])
        est = []
        for x in h:
            both = np.concatenate([x[:size], x[size // 10 : size + size // 10]])
            r = minhash._registers(both, np.repeat([0, 1], size), 2, level)
            est.append(minhash.estimate(r[:1], r[1:])[0][0])
        true = (size - size // 10) / (size + size // 10)
        assert np.mean(est) == pytest.approx(true, abs=0.03)


def removal_reference(rows, k):
    first = {}
    for i, t, *_ in rows:
        w = words(t, fold=False)
        for a in range(len(w) - k + 1 if i is not None else 0):
            key = tuple(w[a : a + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = words(t, fold=False)
        gone = [False] * len(w)
        for a in range(len(w) - k + 1 if i is not None else 0):
            if first[tuple(w[a : a + k])] < i:
                gone[a : a + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return Counter(out)


@pytest.mark.parametrize(("k", "size"), [(13, 4000), (13, 1 << 30), (4, 9000)])
def test_substrings(spark, k, size):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept_text", F.lit("clash"))
    want = removal_reference(rows, k)
    got = substrings.dedup(docs, k=k, group_bytes=size)
    assert set(docs.columns) <= set(got.columns)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text if r.n_removed else " ".join(words(r.text, fold=False))) for r in got.collect()) == want
    short = substrings.dedup(docs.select("doc_id", "text"), k=k, digest=True, group_bytes=size).collect()
    assert Counter(tuple(r) for r in short) == Counter((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for (i, n, m, t), c in want.items() for _ in range(c))


def test_substrings_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words) for r in substrings.dedup(docs).collect()) == [(1, 0), (2, 0)]
    assert substrings.dedup(docs.limit(0)).count() == 0


def test_packed_arrays():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64)), np.zeros(5, np.uint64)):
        assert (packed.unpack(packed.pack(x, True), True) == x).all() and (packed.unpack(packed.pack(x)) == x).all()
    bits = rng.random(77) < 0.3
    assert (packed.unpack_bits(packed.pack_bits(bits)) == bits).all()


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    of = components({x for p in links for x in p}, links)
    got = {r.id: r.component_id for r in spark_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in of.items() if sum(k in p and p[0] != p[1] for p in links)}
    assert spark_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 24))
    near = np.concatenate([base[:40] + s * rng.standard_normal((40, 24)) for s in (0.05, 0.2, 0.35, 0.5)])
    hot = base[0] + 0.15 * rng.standard_normal((150, 24))
    x = np.concatenate([base, near, hot, base[:5], 3 * base[5:9]])
    rows = [(int(i), [float(y) for y in v], int(i) % 3) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    odd = [(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [float("nan")] + [1.0] * 23, 1), (9004, [None] + [1.0] * 23, 1), (9005, [1.0, 2.0], 1), (9006, [float("inf")] * 24, 1), (9007, [], 1), (None, rows[0][1], 1)]
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows) + len(odd)
    ids = np.array([r[0] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    want = Counter(ids[i].tolist()) + Counter(ids[j].tolist())
    found = sum(got[k].n_links for k in ids.tolist())
    assert found <= 2 * len(i) and found >= 0.98 * 2 * len(i)
    assert all(got[k].n_links <= want[k] for k in ids.tolist())
    of = components(ids.tolist(), list(zip(ids[i].tolist(), ids[j].tolist(), strict=True)))
    assert np.mean([got[k].component_id == of[k] for k in ids.tolist()]) > 0.98
    assert all((got[k].n_links, got[k].component_id) == (0, k) for k, *_ in odd)


def test_only_counted_pairs_are_compared(monkeypatch):
    """Pairs that the cosine would link but the count doesn't reach are never compared; links equal a plain loop."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((40, 16))
    u = np.concatenate([base, base + 0.2 * rng.standard_normal((40, 16)), base[:3] + 0.4 * rng.standard_normal((3, 16))])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    plan = neighbours.Plan.calibrate(500, 16, 0.9)
    v, c = plan.values(u), plan.cells(u)
    seen = []
    usual = neighbours.cosines
    monkeypatch.setattr(neighbours, "cosines", lambda a, b: seen.append(len(a)) or usual(a, b))
    monkeypatch.setattr(neighbours, "TILE", 32)
    met = lambda i, j: sum(abs(int(x) - int(y)) <= neighbours.STEPS for x, y in zip(v[i], v[j], strict=True))
    for table in (0, 1):
        counted = {(i, j) for i in range(len(u)) for j in range(i) if met(i, j) >= plan.least and not (c[i, :table] == c[j, :table]).any()}
        seen.clear()
        i, j = neighbours._links(plan, table, (u, c, v), None)
        assert sum(seen) == len(counted) < len(u) * (len(u) - 1) / 8
        want = {p for p in counted if u[p[0]] @ u[p[1]] >= 0.9}
        assert {(max(p), min(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want and len(i) == len(want)
    half = (u[:40], c[:40], v[:40]), (u[40:], c[40:], v[40:])
    i, j = neighbours._links(plan, 0, *half)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(40) for b in range(43) if met(a, 40 + b) >= plan.least and u[a] @ u[40 + b] >= 0.9}


def test_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.ones((1, 8)) + 0.05 * rng.standard_normal((120, 8)), rng.standard_normal((30, 8))])
    docs = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(tuple(r) for r in neighbours.near_duplicates(docs).collect())
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    assert sorted(tuple(r) for r in neighbours.near_duplicates(docs).collect()) == whole
    assert neighbours.near_duplicates(docs.limit(0)).count() == 0


def bag(text, k):
    w = words(text)
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def contamination(docs, items):
    out = {}
    for i, t in set(docs):
        w = words(t)
        for j, s in set(items):
            n = len(words(s))
            if not n:
                continue
            k, want = min(n, 5), bag(s, min(n, 5))
            m = min(n, len(w))  # a shorter document is one window
            for a in range(len(w) - m + 1):
                have = Counter(tuple(w[b : b + k]) for b in range(a, a + m - k + 1))
                low, high = sum((have & want).values()), sum((have | want).values())
                if 5 * low >= 4 * high:
                    out[i, j] = max(out.get((i, j), (0, 0, 0)), (low / high, -a, n))
    return {(i, j, s, -a, n) for (i, j), (s, a, n) in out.items()}


def test_recall_of_the_radius(spark):
    """Of windows whose shingles just reach the similarity, the radius keeps over 99 %."""
    rng, n = np.random.default_rng(2), 400
    rows = []
    for size in (20, 60, 150):
        for _ in range(n):
            h = rng.integers(-(2**63), 2**63, size + size // 9).tolist()
            rows.append((h[:size], h[size // 9 :]))
    d = spark.createDataFrame(rows, "a array<long>, b array<long>").select(decontaminate.simhash(F.col("a"), 150).alias("a"), decontaminate.simhash(F.col("b"), 150).alias("b"))
    assert d.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= decontaminate.RADIUS).count() > 0.99 * len(rows)


def test_contamination(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, n, 500)) for i, n in enumerate((1, 3, 5, 6, 15, 30, 30, 59, 120))] + [(90, None), (91, " "), (None, prose(rng, 20)), (92, "ab " * 30), (3, prose(rng, 9, 500))]
    docs = [(i, prose(rng, 80, 500)) for i in range(10)]
    for n, (j, t) in enumerate(items):
        w = (t or "").split()
        docs.append((100 + n, f"{prose(rng, 9, 500)} {(t or '').upper()}\n{prose(rng, 30, 500)}"))
        for k in (1, 2, 4):
            v = list(w)
            for _ in range(k if v else 0):
                v[rng.randrange(len(v))] = "zz"
            docs.append((200 + 10 * n + k, f"{prose(rng, 4, 500)} {' '.join(v)} {prose(rng, 3, 500)}"))
    for n, (_, t) in enumerate(items):
        v = (t or "").split()
        docs += [(5000 + 10 * n + cut_, " ".join(v[cut_:])) for cut_ in range(4)] + [(6000 + n, " ".join(v[2:-1]))]
    docs += [docs[12], (None, docs[13][1]), (7000, None), (7001, ""), (7002, " ".join(docs[k][1] for k in (11, 15, 20)) + " " + prose(rng, 9000, 5000))]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.pairs(d, b).collect()}
    want = contamination(docs, items)
    assert got == want and len(want) > 20
    bad = {(i, t) for i, t in docs if contamination([(i, t)], items)}
    assert Counter((r.doc_id, r.text) for r in decontaminate.clean(d, b).collect()) == Counter(x for x in docs if x not in bad)
    assert decontaminate.pairs(d, b.limit(0)).count() == 0 and decontaminate.pairs(d.limit(0), b).count() == 0


def test_hamming_blocks_miss_nothing(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 24)))
        rows.append((a - (1 << 63), b - (1 << 63)))
    d = spark.createDataFrame(rows, "a long, b long")
    both = d.select("*", F.explode(decontaminate.window_keys("a")).alias("k")).join(d.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.explode(decontaminate.item_keys("b")).alias("k2")), (F.col("a") == F.col("a2")) & (F.col("k.block") == F.col("k2.block")) & (F.col("k.key") == F.col("k2.key")))
    x = F.col("a").bitwiseXOR(F.col("b"))
    met = Counter((r.a, r.b) for r in both.where((F.bit_count(x) <= decontaminate.RADIUS) & decontaminate.first_block(x, F.col("k.block"))).select("a", "b").collect())
    assert met == Counter((a, b) for a, b in rows if ((a ^ b) & (2**64 - 1)).bit_count() <= decontaminate.RADIUS)


def test_simhash_is_the_majority(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 40):
        h = [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
        got = spark.createDataFrame([(h,)], "h array<long>").select(decontaminate.simhash(F.col("h"), 40)).first()[0]
        assert got & (2**64 - 1) == sum(1 << b for b in range(64) if sum((x >> b) & 1 for x in h) * 2 > n)


URLS = ["http://a.net/x", "HTTP://A.Example.NET/en/x?q=/de/", "http://example.net/en", "http://badexample.com/de/", "http://x.example.com/de/", "http://m.org/fr/#a", "http://org/fr/", "http://net", "no url", "", None, "x://y://net/", "http://a.net:80/x", "http://.net/", "http://a.net//en/", "http://a.net/" + "p" * 5000, "http://é.net/ü"]


def test_rules(spark):
    rules = [("net", "/", "block"), ("Example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block"), ("", "", "block"), ("m.org", None, "block"), ("m.org", None, "allow")]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate([*URLS, URLS[0]])] + [(None, URLS[0], None, None)], "page_id long, url string, rule string, host string")
    got = urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host = path = ""
        if r.url and "://" in r.url:
            rest = r.url.split("://", 1)[1]
            cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
            host, path = lower(rest[:cut]), rest[cut:]
            path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
        fit = [(len(h + (p or "")), len(h), v, lower(h) + (p or "")) for h, p, v in rules if h and (host == lower(h) or host.endswith("." + lower(h))) and path.startswith(p or "")]
        best = max(fit, default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[3], best[2] if best else "allow"), r.url
    none = urls.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).collect()
    assert {r.verdict for r in none} == {"allow"}
    assert urls.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def pages_of(rng):
    html = [f"<p>{prose(rng, 60)}</p>" for _ in range(60)]
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(html)] + [(100 + i, None, html[i % 7]) for i in range(40)]
    rows += [(300, "http://x/\r\ny", None), (301, "u", ""), (302, "u", "\r\n\r\nWARC/1.1\r\n"), (303, "u", "ä" * 200000), (50, "again", html[50]), (None, "n", html[3]), (None, "n", "alone")]
    return rows


def test_archives(spark, tmp_path):
    rows = pages_of(random.Random(1))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    out = f"file://{tmp_path}/w"
    wrote = warc.write(pages, out)
    files = wrote.collect()
    assert sum(f.records for f in files) == len(rows)
    data = (tmp_path / "w" / files[0].folder / files[0].name).read_bytes()
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    stray = tmp_path / "w" / "task-000000-99999"
    stray.mkdir()
    (stray / "0000.warc.zst").write_bytes(data)
    got = warc.read(out, wrote).collect()
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        first = largest.get(h or "")
        response = first is None or i == first
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else first, raw if response else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload if r.payload is None else bytes(r.payload)) for r in got) == want
    assert warc.round_trip(pages, min_revisit_bytes=10**9).where("record_type = 'revisit'").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_revisits_need_their_response(spark, tmp_path):
    rows = [(i, "u", h) for i, h in enumerate(["a" * 90, "b" * 90, "a" * 90, "b" * 90, "c", "a" * 90])]
    out = f"file://{tmp_path}/w"
    records = warc.read(out, warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), out))
    assert warc.dangling(records).count() == 0 and records.where("record_type = 'revisit'").count() == 3
    gone = warc.dangling(records.where("page_id <> 5"))
    assert sorted(tuple(r) for r in gone.collect()) == [(0, 5, "missing"), (2, 5, "missing")]
    other = records.withColumn("payload_digest", F.when(F.col("page_id") == 3, "x").otherwise(F.col("payload_digest"))).withColumn("payload_bytes", F.when(F.col("page_id") == 2, 7).otherwise(F.col("payload_bytes")))
    assert sorted(tuple(r) for r in warc.dangling(other).collect()) == [(1, 3, "payload_digest"), (2, 5, "payload_bytes")]
    twice = records.unionByName(records.where("page_id = 5").withColumn("payload_digest", F.lit("x")))
    assert warc.dangling(twice).count() == 0 and warc.dangling(records.limit(0)).count() == 0


def test_archives_of_many_records_are_read_in_linear_time():
    block = random.Random(3).randbytes(2000)
    zip_ = warc.compressor(b"")
    frames = [zip_.compress(warc.record("response", [("WARC-Record-ID", f"<urn:page:{i}>")], block[i % 7 :])) for i in range(8000)]
    data = warc.header(b"") + b"".join(frames)
    began = time.process_time()
    assert [h["warc-record-id"] for h, _ in warc.read_archive(data)] == [f"<urn:page:{i}>" for i in range(8000)]
    assert time.process_time() - began < 3
    big = warc.header(b"") + zip_.compress(warc.record("response", [("WARC-Record-ID", "<urn:page:1>")], block * 500)) + frames[0]
    assert [len(b) for _, b in warc.read_archive(big)] == [1000000, 2000]


def test_archives_of_clashing_columns(spark):
    rows = [(1, "u", "x", "a", 5, None), (2, "u", "x", "b", None, "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, payload_bytes int, __first string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None)}


def test_broken_archives():
    rec = warc.record("response", [("WARC-Record-ID", "<urn:page:1>")], b"abc")
    head, zip_ = warc.header(b""), warc.compressor(b"")
    good = head + zip_.compress(rec) + zip_.compress(rec)
    assert [b for _, b in warc.read_archive(good)] == [b"abc"] * 2
    for bad in (good[:-3], head + zip_.compress(rec[:-4]), head + zip_.compress(b"HTTP/1.1\r\n\r\n"), head + zip_.compress(rec.replace(b"Length: 3", b"Length: 4")), head + b"garbage", warc.header(b"x" * 50)[:20], head + zip_.compress(rec.replace(b"WARC-Type", b"WARC Type"))):
        with pytest.raises(ValueError):
            list(warc.read_archive(bad))


def test_forest():
    rng = random.Random(5)
    links = [(rng.randrange(50), rng.randrange(50)) for _ in range(40)]
    a, b = (np.array([p[k] for p in links]) for k in (0, 1))
    of = components(range(50), links)
    parent = {i: i for i in range(50)}
    for x, r in packed.forest(50, a, b):
        parent[find(parent, x)] = find(parent, r)
    assert all((of[i] == of[j]) == (find(parent, i) == find(parent, j)) for i in range(50) for j in range(50))


def test_very_long_hosts_and_paths(spark, monkeypatch):
    """A host of a megabyte costs what the rules can reach; the shuffled join gives the same."""
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("x.y.z", "", "block")], "host string, path string, verdict string")
    long = "a." * (1 << 19)
    rows = [(1, f"http://{long}net/{'p/' * 300000}"), (2, f"http://{long}example.net/en/q"), (3, "http://net/"), (4, "http://y.z/"), (5, "http://w.x.y.z"), (6, "http://.net/"), (7, None), (8, "http://xnet/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = {1: ("net/", "block"), 2: ("example.net/en/", "allow"), 3: ("net/", "block"), 4: (None, "allow"), 5: ("x.y.z", "block"), 6: ("net/", "block"), 7: (None, "allow"), 8: (None, "allow")}
    for few in (500_000, 0):
        monkeypatch.setattr(urls, "BROADCAST_PAIRS", few)
        got = urls.judge(pages, rules).select("page_id", "rule", "verdict", F.length("host").alias("n")).collect()
        assert {r.page_id: (r.rule, r.verdict) for r in got} == want
        assert next(r.n for r in got if r.page_id == 1) == len(long) + 3
    assert urls.judge(pages, rules.limit(0)).where("rule is null and verdict = 'allow'").count() == len(rows)
