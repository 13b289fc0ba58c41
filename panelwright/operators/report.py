"""Ranking and shaping of metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import melt, top_per_group


def validation_rank(metrics: DataFrame, measures: Sequence[str], unique: Sequence[str], name: str = "validation_rank") -> DataFrame:
    """Rank of method rows by several validation measures (F10). Test measures take no part."""
    order = [*[F.col(m).desc_nulls_last() for m in measures], *[F.col(u).asc() for u in unique]]
    return metrics.withColumn(name, F.row_number().over(Window.partitionBy().orderBy(*order)))


def top_areas(df: DataFrame, key: str, measures: Sequence[str], k: int = 20) -> DataFrame:
    """Highest areas for each of several measures, stacked."""
    long = melt(df, [key], measures, "measure").where(F.col("value").isNotNull())
    return top_per_group(long, ["measure"], [F.desc("value"), F.asc(key)], k)


WIDE = [
    "row_count", "positive_rows", "predicted_positive_rows", "accuracy", "balanced_accuracy", "precision",
    "recall", "specificity", "npv", "f1", "f2", "roc_auc", "pr_auc", "tn", "fp", "fn", "tp",
]


def wide_comparison(metrics: DataFrame, keys: Sequence[str] = ("method_id", "score_col", "threshold_mode"), measures: Sequence[str] = tuple(WIDE)) -> DataFrame:
    """One row per method with val_* and test_* columns and its validation rank."""
    aggs = [
        F.max(F.when(F.col("split") == split, F.col(m))).alias(f"{prefix}_{m}")
        for split, prefix in (("validation", "val"), ("test", "test"))
        for m in measures
    ]
    return validation_rank(metrics.groupBy(*keys).agg(*aggs), ["val_f1", "val_pr_auc", "val_balanced_accuracy"], ["method_id"])


def macro_table(by_category: DataFrame, keys: Sequence[str] = ("method_id", "threshold_mode")) -> DataFrame:
    """Macro and worst-category measures per method on the test split."""
    return by_category.where(F.col("split") == "test").groupBy(*keys).agg(
        F.count_distinct("category").alias("category_count"),
        F.avg("f1").alias("macro_f1"),
        F.min("f1").alias("worst_category_f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("pr_auc").alias("macro_pr_auc"),
        F.avg("roc_auc").alias("macro_roc_auc"),
        F.avg("predicted_positive_share").alias("mean_alert_rate"),
    )


def stability(runs: DataFrame, measures: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, sample std (0 for one run), min and max of each measure over runs."""
    long = melt(runs, keys, measures, "metric").where(F.col("value").isNotNull())
    return long.groupBy(*keys, "metric").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
