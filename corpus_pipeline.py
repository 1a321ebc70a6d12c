"""From raw documents to tokens: five stages, each written as Parquet and read again.

1. language_id: every document gets a language; one without letters goes, and so does one whose label
   a clear prediction (score CLEAR or more) contradicts. Where the label is null, lang becomes the
   prediction. Where no row has a language to learn, documents without letters go.
2. minhash_dedup: of each group of near-duplicates (five-word shingles,
   similarity 0.8 or more) the document with the smallest id stays, once.
3. substring_dedup: words covered by 13-word passages of earlier documents are
   removed; a document of which no word is left goes.
4. decontaminate: documents with a passage of the benchmark go.
5. sentencepiece: ids of every text, and their decoding, as counts and digests.

Documents with a null id are never compared with others: stages 2 and 3 keep them as they are, stage 4
judges them; null texts are rejected by stage 1. Of rows that repeat a doc_id with equal words one is
kept (that with the smallest hash of the row); if their words differ, each is judged by its own words in stage 2 and counts as one
document with the others in stage 3. All stages but the last return
the columns of documents; n_chars follows the text. No stage changes the session's settings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm import decontaminate, langid, minhash, pieces, substrings
from tracklens.llm.queries import PIECES, vocabulary_path
from tracklens.llm.spark import read, scratch

CLEAR = 0.7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(langid.SQL_LETTER))
    judged = langid.predict(docs, model)
    contradicted = F.col("lang").isNotNull() & (F.col("lang") != F.col("lang_pred")) & (F.col("score") >= CLEAR)
    return judged.where((F.col("lang_pred") != "und") & ~contradicted).withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, num=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substrings.dedup(docs).where("n_words = 0 or n_removed < n_words")
    out = out.withColumn("text", F.coalesce("kept_text", "text"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(docs, vocabulary_path(PIECES), keep=("lang", "source"))


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs


ORACLE_SQL = None
