"""Corpora from as few files as quotas need, and padded sequences."""

import random

import pytest
from pyspark.sql import functions as F

from tracklens.operators import corpora


def test_quotas_are_those_of_reading_everything(spark):
    rng = random.Random(3)
    rows, names = [], []
    for g in "abcde":
        for ord_ in range(12):
            names.append((f"{g}{ord_}", g, ord_))
            for p in range({"a": 30, "b": 2, "c": 1, "d": 9, "e": 0}[g]):
                kind = rng.choice(["car", "car", "walker", "other"]) if g != "d" else "car"
                rows.append((f"{g}{ord_}", ord_, g, kind, p, f"{g}{rng.randrange(40)}", ord_ % 2))
    files, data = spark.createDataFrame(names, "file string, grp string, ord int"), spark.createDataFrame(rows, "file string, ord int, grp string, kind string, place int, key string, split int")
    asked = []

    def read(some):
        asked.append(set(some))
        return data.where(F.col("file").isin(*some)).drop("file")

    taken, seen = corpora.quota_corpus(files, read, 100, {"car": (3, 5), "walker": (2, 5)})
    caps, want, have = corpora.quotas(5, 100, {"car": (3, 5), "walker": (2, 5)}), [], {}
    assert caps == {"car": 12, "walker": 8}
    for _, o, g, kind, p, key, split in sorted(rows, key=lambda r: (r[2], r[1], r[4])):
        mine = have.setdefault((g, kind), set())
        if kind in caps and key not in mine and len(mine) < caps[kind]:
            mine.add(key)
            want.append((o, g, kind, p, key, split))
    assert sorted(tuple(r) for r in taken.collect()) == sorted(want)
    opened = {r.file for r in seen.collect()}
    assert opened == set().union(*asked) and sum(map(len, asked)) == len(opened) < 60
    assert len([f for f in opened if f[0] == "a"]) <= 3 and len([f for f in opened if f[0] == "b"]) == 12  # full early; never full
    with pytest.raises(ValueError, match="no files"):
        corpora.quota_corpus(files.limit(0), read, 100, {"car": (1, 1)})


def test_sequences_are_padded_and_checked(spark):
    train = spark.createDataFrame([("single", i, f"f{i}") for i in range(6)], "branch string, id int, print string")
    dev = spark.createDataFrame([("single", 9, "f9")], "branch string, id int, print string")
    solved = spark.createDataFrame([("single", i, i, i % 2 == 0, [float(k) for k in range(i)]) for i in range(6)], "branch string, id int, idx int, ok boolean, s array<double>")
    build = lambda s, t, d: corpora.sequence_corpus(s, t, d, ["branch", "id"], "print", F.col("ok"), "s", "idx")
    got = {r.id: (r.split, r.steps, r.target, r.mask) for r in build(solved, train, dev).collect()}
    assert got == {0: ("val", 0, [0.0] * 4, [False] * 4), 2: ("train", 2, [0.0, 1.0, 0.0, 0.0], [True, True, False, False]), 4: ("train", 4, [0.0, 1.0, 2.0, 3.0], [True] * 4)}
    for bad, message in (((solved, train, train.limit(1)), "both sets"), ((solved, train.union(train.limit(1)), dev), "repeats"), ((solved, train.where("id <> 2"), dev), "no training condition"), ((solved.where("not ok"), train, dev), "no eligible")):
        with pytest.raises(ValueError, match=message):
            build(*bad)
