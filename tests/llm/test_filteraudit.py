"""Operator 12 against a replay document by document."""

from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, WORD, corpus
from tracklens.llm import filteraudit
from tracklens.llm.queries import ORACLES, op12_filter_audit

NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    out = {}
    for p in {d[3] or "" for d in docs}:
        rows = []
        for i, text, source in [(d[0], d[1] or "", d[3] or "") for d in docs]:
            if source != p:
                continue
            w = WORD.findall(text)
            fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}
            fails["E"] = i is not None and any(d[0] is not None and d[0] < i and (d[1] or "") == text for d in docs)
            rows.append((fails, any(x[0] == i and x[1] == 1 for x in labels if i is not None), any(x[0] == i and x[2] == 1 for x in labels if i is not None)))
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                here = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                shapley[f] += len(here)
                out[p, order, step] = [len(left), len(here), sum(r[0][f] for r in rows) - len(here), sum(r[0][f] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)]
        for (q, order, step), x in out.items():
            if q == p:
                x.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def rows(df):
    got = df.select(NAMES).collect()
    assert len(got) == len({tuple(r[:3]) for r in got})
    return {tuple(r[:3]): tuple(r[3:]) for r in got}


def many():
    docs = [r for r in corpus() if len(r[1] or "") < 9000]
    more = ["#1 " * 70, "ABC DEF ghi " * 20, " ".join(f"q{i}" for i in range(60)), " ".join(f"q{i}" for i in range(60)), " ".join(f"Q{i}" for i in range(49)) + "|", "é" * 19 + "A", "é" * 20 + "A"]
    docs += [(1000 + i, t, "en", ("", None, "s")[i % 3], None) for i, t in enumerate(more)]
    docs += [(2000 + i, "copy of a text", "en", "hot", None) for i in range(40)] + [(2003, "copy of a text", "en", "hot", None)]
    return docs


def test_every_order_by_hand(spark):
    docs = many()
    labels = [(d[0], i % 2, i % 3 % 2) for i, d in enumerate(docs)] + [(docs[0][0], 1, 1), (docs[1][0], None, None), (None, 1, 1), (10**9, 1, 1)]
    d = spark.createDataFrame(docs, DOCS).withColumn("mask", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("good", F.lit("clash"))
    got = filteraudit.audit(d, spark.createDataFrame(labels, LABELS).withColumn("part", F.lit("clash")))
    assert dict(got.dtypes)["shapley"] == dict(got.dtypes)["kept"] == "bigint" and dict(got.dtypes)["step"] == "int"
    assert rows(got) == brute(docs, labels)


def test_frequent_texts_are_joined_alike(spark, monkeypatch):
    docs = many()
    d = filteraudit.cut(filteraudit.flags(spark.createDataFrame(docs, DOCS)))
    want = sorted(filteraudit.with_copies(d).collect(), key=str)
    monkeypatch.setattr(filteraudit, "HOT", 1)  # none is frequent
    assert sorted(filteraudit.with_copies(d).collect(), key=str) == want
    monkeypatch.setattr(filteraudit, "HOT", 10**9)  # all are
    assert sorted(filteraudit.with_copies(d).collect(), key=str) == want


def test_empty_tables(spark):
    d, l = spark.createDataFrame(many(), DOCS), spark.createDataFrame([], LABELS)
    assert filteraudit.audit(d.limit(0), l).count() == 0
    assert rows(filteraudit.audit(d, l)) == brute(many(), [])


def test_query_and_sql(spark):
    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = c.sql(ORACLES["op12_filter_audit"])
    at = [want.columns.index(n) for n in NAMES]
    assert rows(op12_filter_audit(spark, data)) == {tuple(r[i] for i in at[:3]): tuple(r[i] for i in at[3:]) for r in want.fetchall()}
