"""Model metrics, folds and blends as aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.slices import spread

C = F.col


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 from the confusion counts (0 for an empty class)."""
    by = list(by)
    m = df.where(C(prediction).isNotNull()).groupBy(*by, C(label).cast("double").alias("_y"), C(prediction).cast("double").alias("_p")).agg(F.count("*").alias("_n"))
    each = m.select(*by, F.inline(F.array(F.struct(C("_y").alias("c"), C("_n").alias("act"), F.lit(0).cast("long").alias("pred"), F.when(C("_y") == C("_p"), C("_n")).otherwise(0).alias("hit")),
                                          F.struct(C("_p").alias("c"), F.lit(0).cast("long").alias("act"), C("_n").alias("pred"), F.lit(0).cast("long").alias("hit")))))
    c = each.groupBy(*by, "c").agg(F.sum("act").alias("act"), F.sum("pred").alias("pred"), F.sum("hit").alias("hit"))
    p = F.when(C("pred") > 0, C("hit") / C("pred")).otherwise(0.0)
    r = F.when(C("act") > 0, C("hit") / C("act")).otherwise(0.0)
    f1 = F.when(C("pred") + C("act") > 0, 2 * C("hit") / (C("pred") + C("act"))).otherwise(0.0)
    w = lambda x: F.sum(x * C("act")) / F.sum("act")
    return c.groupBy(*by).agg((F.sum("hit") / F.sum("act")).alias("accuracy"), w(p).alias("weighted_precision"), w(r).alias("weighted_recall"), w(f1).alias("weighted_f1"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    e = C(label) - C(prediction)
    return df.where(C(label).isNotNull() & C(prediction).isNotNull()).groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(label) * F.count("*"))).alias("r2"))


def time_folds(df: DataFrame, order: Sequence, folds: int = 5, bin=None) -> DataFrame:
    """Expanding-window folds over the row order: (fold, role) rows, every row once per fold it takes part in.

    The test block has n // (folds + 1) rows; the remainder goes to the first training block.
    """
    n = df.agg(F.count("*").alias("_n"))
    d = spread(df, keys=[], order=order, bin=bin or "month").position("_pos").done().join(n)  # one-row count
    d = d.withColumn("_b", F.floor(C("_n") / (folds + 1))).withColumn("_first", C("_n") - folds * C("_b"))
    block = F.when(C("_pos") < C("_first"), 0).otherwise(F.floor((C("_pos") - C("_first")) / C("_b")) + 1)
    d = d.withColumn("_k", block)
    d = d.withColumn("fold", F.explode(F.sequence(F.greatest(C("_k"), F.lit(1)), F.lit(folds))))
    return d.withColumn("role", F.when(C("fold") == C("_k"), "test").otherwise("train")).drop("_pos", "_n", "_b", "_first", "_k")


def blend_predictions(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Weighted mean of prediction columns; null as soon as one is missing."""
    total = sum(weights.values())
    out = None
    for c, w in weights.items():
        out = C(c) * (w / total) if out is None else out + C(c) * (w / total)
    return df.withColumn("ensemble", out)
