"""Mask, ranking and embedding metrics as aggregates. Ratios are null where their denominator is 0, but IoU of nothing is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import even_round
from .ordered import running


def mask_scores(pixels: DataFrame, keys: list[str], pred: Column, pos: Column, neg: Column) -> DataFrame:
    """One row of segmentation scores a target from its pixels, in one aggregation."""
    n = lambda c: F.count_if(c)
    counted = pixels.groupBy(*keys).agg(
        n(pred).alias("p"), n(pos).alias("g"), n(neg).alias("k"), n(pred & pos).alias("tp"), n(pred & neg).alias("fn_"), n(pred | pos).alias("u"), n(pred & ~pos & ~neg).alias("other"), F.count(F.lit(1)).alias("n")
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return counted.select(
        *keys,
        ratio("tp", "g").alias("coverage"),
        F.coalesce(ratio("tp", "u"), F.lit(0.0)).alias("mask_iou"),
        ratio("fn_", "k").alias("fp_on_black"),
        (F.col("other").cast("double") / F.col("n")).alias("fp_area_frac"),
        ratio("tp", "p").alias("precision_pos"),
        (F.col("p").cast("double") / F.col("n")).alias("pred_area_frac"),
        (F.col("p").cast("double") / F.greatest(F.col("g"), F.lit(1))).alias("area_ratio"),
    )


def auroc(df: DataFrame, keys: list[str], score: Column, positive: Column) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; null with one class.

    Rows are counted by score first, and the counts of lower scores are running totals of small blocks, so groups may have any size.
    """
    by = df.groupBy(*keys, score.alias("__s")).agg(F.count_if(positive).cast("double").alias("__p"), F.count_if(~positive).cast("double").alias("__n"))
    below = running(by, keys, ["__s"], "__n", "__below")
    won = below.withColumn("__w", F.col("__p") * (F.col("__below") + F.col("__n") / 2))
    return won.groupBy(*keys).agg(F.try_divide(F.sum("__w"), F.sum("__p") * F.sum("__n")).alias("auroc"))


def config_summary(rows: DataFrame, config: list[str], iou: str = "iou", cov: str = "cov") -> DataFrame:
    """Mean, median, min and max IoU, mean coverage (nulls skipped), and the robust score 0.5 * (mean + min), of each configuration."""
    four = lambda c: even_round(c, 4)
    return rows.groupBy(*config).agg(
        four(F.avg(iou)).alias("mean_iou"), four(F.median(iou)).alias("median_iou"), four(F.min(iou)).alias("min_iou"), four(F.max(iou)).alias("max_iou"),
        four(F.avg(cov)).alias("mean_cov"), even_round(0.5 * (F.avg(iou) + F.min(iou)), 6).alias("robust"),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def class_sums(df: DataFrame, keys: list[str], vector: str, positive: Column, width: int) -> DataFrame:
    """Per group: element sums and counts of positive and other vectors (pos, neg: arrays; n_pos, n_neg)."""
    element = lambda i, c: F.sum(F.when(c, F.get(F.col(vector), F.lit(i)).cast("double")).otherwise(0.0))
    return df.groupBy(*keys).agg(
        F.array(*[element(i, positive) for i in range(width)]).alias("pos"), F.array(*[element(i, ~positive) for i in range(width)]).alias("neg"),
        F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg"),
    )


def loo_prototype_scores(df: DataFrame, keys: list[str], vector: str, positive: Column, width: int) -> DataFrame:
    """df with loo_score: similarity to the positive prototype minus that to the negative one, each without the row itself (class sums minus self)."""
    joined = df.withColumn("__y", positive).join(class_sums(df, keys, vector, positive, width), keys)
    v, y = F.col(vector), F.col("__y")
    less = lambda total, n, own: F.when(own, (dot(total, v) - dot(v, v)) / F.greatest(n - 1, F.lit(1))).otherwise(dot(total, v) / F.greatest(n, F.lit(1)))
    score = less(F.col("pos"), F.col("n_pos"), y) - less(F.col("neg"), F.col("n_neg"), ~y)
    return joined.withColumn("loo_score", score).drop("pos", "neg", "n_pos", "n_neg", "__y")
