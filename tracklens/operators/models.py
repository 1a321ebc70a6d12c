"""Small models and projections: kernel ridge, trajectory projection, codebooks, flat features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.lineage import cut
from tracklens.operators.kernels import KernelRidge  # noqa: F401
from tracklens.operators.vectors import squared_distance


def reuse_codebook(book: DataFrame, size: int, dim: int) -> DataFrame:
    """book (token, c) if it has the expected shape and tokens 0 to size - 1, else ValueError."""
    r = book.agg(F.count("*"), F.count_distinct("token"), F.min("token"), F.max("token"), F.min(F.size("c")), F.max(F.size("c"))).first()
    if tuple(r) != (size, size, 0, size - 1, dim, dim):
        raise ValueError(f"the codebook is {tuple(r)}, not {size} tokens of {dim} components")
    return book


def boosted_baseline(df: DataFrame, features: Sequence[str], target: str, label: str, test: str, rounds: int = 15, depth: int = 3, seed: int = 7) -> DataFrame:
    """(model_error, mean_error, auc, residual_errors), one row, from the test rows: mean absolute errors of boosted trees and of the training mean, the
    area under the curve of a boosted classifier for a 0/1 label, and the error by label value of the trees, pooled (label: error, rows).

    Training is distributed; test is a boolean column. Where training rows have one label alone, the area is null.
    Trees see rows by their features alone, so training rows with equal features are one row with a weight, that has their mean target (squared
    errors: what they differ from it adds the same to all trees) or, with the label, their number. Rounds then read no more rows than there are features.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    from tracklens.operators.inference import auc

    assembler = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip")
    d = assembler.transform(df.select(*features, F.col(target).cast("double").alias("_y"), F.col(label).cast("double").alias("_l"), F.col(test).alias("_t")))
    train, held = d.where(~F.col("_t")), d.where("_t")
    mean, labels = train.agg(F.avg("_y"), F.count_distinct("_l")).first()
    common = {"featuresCol": "_x", "predictionCol": "_guess", "weightCol": "_w", "maxIter": rounds, "maxDepth": depth, "seed": seed}
    alike = cut(train.groupBy(*features).agg(F.avg("_y").alias("_y"), F.count("*").cast("double").alias("_w")))
    told = GBTRegressor(labelCol="_y", **common).fit(assembler.transform(alike)).transform(held)
    by = told.groupBy("_l").agg(F.sum(F.abs(F.col("_guess") - F.col("_y"))).alias("e"), F.sum(F.abs(F.col("_y") - F.lit(mean))).alias("m"), F.count("*").alias("n"))
    pooled = F.map_from_entries(F.sort_array(F.collect_list(F.struct("_l", F.struct((F.col("e") / F.col("n")).alias("error"), F.col("n").alias("rows"))))))
    errors = by.agg((F.sum("e") / F.sum("n")).alias("model_error"), (F.sum("m") / F.sum("n")).alias("mean_error"), pooled.alias("residual_errors"))
    if labels < 2:
        return errors.withColumn("auc", F.lit(None).cast("double"))
    alike = cut(train.groupBy(*features, "_l").agg(F.count("*").cast("double").alias("_w")))
    judged = GBTClassifier(labelCol="_l", **common).fit(assembler.transform(alike)).transform(held)
    judged = judged.select(F.col("_l").cast("int").alias("_l"), vector_to_array("probability")[1].alias("_score"))
    return errors.join(auc(judged, [], "_l", "_score").select("auc"))


def flat_features(values: Sequence[str], mask: str) -> Column:
    """Arrays of equal length, zero where the mask is false, then the mask as numbers, in one array."""
    parts = [F.zip_with(F.col(v), F.col(mask), lambda x, m: F.when(m, x).otherwise(F.lit(0.0))) for v in values]
    return F.flatten(F.array(*parts, F.transform(mask, lambda m: m.cast("double"))))


def kernel(a: str | Column, b: str | Column, width: float) -> Column:
    return F.exp(-squared_distance(a, b) / (2 * width * width))

