"""Operator 10: language identification by family first, then one-versus-one linear SVMs.

Features are hashed counts of the byte 1- to 4-grams of a whole text, in
which A-Z are lower-cased and bytes that are neither ASCII letters nor part of
other characters count as one space. The families are learned too: languages whose mean
features lie closest are merged until about the square root of their number
is left. A linear SVM for each pair of families votes for the family, then
one for each pair of languages inside it for the language; margins break ties
of votes. All are fitted on the driver from a sample of at most SAMPLE_ROWS
labelled rows, the same number for each language, chosen by a hash of the text;
their features are computed on the executors.

A text that is null or has no letter (number signs such as a superscript two are none) gets ``und`` and score 0. Null languages
are never learned. One language alone is predicted for every text with a
letter; without any labelled row every prediction is ``und``. Null ids and repeated rows are
kept. Columns of the input named lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.llm.spark import leaving_nothing, with_fields

DIM = 1 << 12
SAMPLE_ROWS = 1600  # bound of the labelled sample that the SVMs are fitted on
MIN_SAMPLE = 8
PARTS = 64
SQL_LETTER = r"\p{L}"  # what has_letter tells, for Spark
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123], _FOLD[65:91], _FOLD[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)
_PIECE = 1 << 20


def has_letter(text: str) -> bool:
    """Whether any character is a letter (categories L*); number signs, marks and symbols are none."""
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of the hashed n-gram counts, of length 1."""
    x = _FOLD[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    total = np.zeros(DIM)
    for at in range(0, len(x), _PIECE):
        y = x[max(0, at - 3) : at + _PIECE]
        code = np.zeros(len(y), np.uint32)
        for n in range(1, 5):
            code = (code[1:] if n > 1 else code) * np.uint32(256) + y[n - 1 :]
            if not len(code):
                break
            new = code[max(0, min(at, 3) - n + 1) :]
            h = (new ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            total += np.bincount((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(20), minlength=DIM)
    v = np.sqrt(total)
    return v / max(np.sqrt((v * v).sum()), 1e-12)


def svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 200) -> np.ndarray:
    """Weights and bias of a linear SVM (squared hinge), by accelerated gradient steps. y: 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)], dtype=np.float32)
    y = y.astype(np.float32)
    cost = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * c
    cost = cost.astype(np.float32)
    step = np.float32(1 / (1 + 4 * c))
    w = z = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        miss = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (z - 2 * x.T @ (cost * y * miss))
        z = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w.astype(np.float64)


@dataclass
class Duel:
    """One-versus-one SVMs of some classes: weights by pair."""

    classes: list
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: list) -> Duel:
        pairs = list(combinations(range(len(classes)), 2))
        w = [svm(x[m], np.where(y[m] == a, 1.0, -1.0)) for a, b in pairs for m in [(y == a) | (y == b)]]
        return cls(classes, pairs, np.array(w) if w else np.zeros((0, DIM + 1)))

    def predict(self, v: np.ndarray) -> tuple[int, float]:
        """Class number with the most votes, then the largest summed margin; its weakest duel as a probability."""
        if not self.pairs:
            return 0, 1.0
        margins = self.weights[:, :-1] @ v + self.weights[:, -1]
        votes, total, weakest = np.zeros(len(self.classes)), np.zeros(len(self.classes)), np.full(len(self.classes), np.inf)
        for (a, b), m in zip(self.pairs, margins, strict=True):
            votes[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
            weakest[a], weakest[b] = min(weakest[a], m), min(weakest[b], -m)
        best = max(range(len(votes)), key=lambda i: (votes[i], total[i], -i))
        return best, float(1 / (1 + np.exp(-2 * np.clip(weakest[best], -20, 20))))


@dataclass
class Model:
    langs: list[str]
    families: list[list[int]]
    top: Duel | None
    within: list[Duel]

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> Model:
        langs = sorted(set(labels))
        y = np.searchsorted(langs, labels)
        groups = [[i] for i in range(len(langs))]
        mean = lambda g: x[np.isin(y, g)].mean(0)
        while len(groups) > max(1, round(len(langs) ** 0.5)) and len(groups) > 1:
            centre = [mean(g) for g in groups]
            a, b = min(combinations(range(len(groups)), 2), key=lambda p: (float(((centre[p[0]] - centre[p[1]]) ** 2).sum()), p))
            groups[a] = sorted(groups[a] + groups.pop(b))
        of = np.zeros(len(langs), int)
        for k, g in enumerate(groups):
            of[g] = k
        if not langs:
            return cls([], [], None, [])
        top = Duel.fit(x, of[y], list(range(len(groups))))
        return cls(langs, groups, top, [Duel.fit(x[np.isin(y, g)], np.searchsorted(g, y[np.isin(y, g)]), g) for g in groups])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not has_letter(text):
            return "und", 0.0
        v = features(text)
        family, a = self.top.predict(v)
        lang, b = self.within[family].predict(v)
        return self.langs[self.families[family][lang]], a * b


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most sample_rows rows with a letter and a language, the same number for each language.

    Chosen are the rows whose text has the smallest hashes, so that the
    sample depends on the set of rows alone; exact copies count once.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(SQL_LETTER)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    langs = rows.agg(F.countDistinct("lang")).first()[0]
    if not langs:
        return Model.fit(np.zeros((0, DIM)), [])
    each = max(MIN_SAMPLE, sample_rows // langs)
    smallest = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= each).drop("r")
    # first in parts of each language, so that one with most rows isn't a single task's
    picked = smallest(smallest(rows.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(PARTS))), "lang", "part"), "lang").drop("part")
    rows = rows.join(F.broadcast(picked), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])  # at most sample_rows, or MIN_SAMPLE a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [(x, t) for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keep], pa.string()), pa.array([features(t).astype(np.float16).tobytes() for _, t in keep], pa.binary())], names=["lang", "v"])

    got = sorted((r.lang, bytes(r.v)) for r in rows.select("lang", "text").mapInArrow(run, "lang string, v binary").collect())
    if not got:
        return Model.fit(np.zeros((0, DIM)), [])
    return Model.fit(np.frombuffer(b"".join(v for _, v in got), np.float16).reshape(len(got), DIM).astype(np.float32), [x for x, _ in got])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs, ``lang_pred`` and ``score`` (0 to 1, how clearly the weakest duels were won)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(x.as_py()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(leaving_nothing(run), with_fields(docs, "lang_pred string, score double"))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text is 2 modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
