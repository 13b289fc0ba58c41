"""Rule scores and ensemble columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.cleaning import clip, finite


def _margin(c: Column) -> Column:
    return F.coalesce(finite(c.cast("double")), F.lit(fv.NO_SCORE))


def _threshold(multiplier: float) -> Column:
    return F.col("rolling_8w_mean") + multiplier * F.coalesce(F.col("rolling_8w_std"), F.lit(0.0))


def prevalence(train: DataFrame, label: str) -> DataFrame:
    """Share of positives in training rows and the majority class."""
    return train.agg(F.avg(label).alias("score")).withColumn("alert", (F.col("score") >= 0.5).cast("int"))


def majority_scores(df: DataFrame, train: DataFrame, label: str) -> DataFrame:
    """The same constant score for every row (H08): one pass over the training rows, two numbers."""
    p = prevalence(train, label).first()
    return df.withColumns({"majority_score": F.lit(p["score"]).cast("double"), "majority_alert": F.lit(p["alert"]).cast("int")})


def rule_scores(df: DataFrame, multiplier: float = fv.LABEL_MULTIPLIER) -> DataFrame:
    """Persistence (H09), momentum (H10), seasonal (H11) and z-score (H12) rules as columns."""
    n = F.col("n").cast("double")
    mean4, diff1 = F.col("rolling_4w_mean"), F.col("diff_1w_count")
    persistence = n - _threshold(multiplier)
    z = (n - F.col("rolling_8w_mean")) / F.nullif(F.col("rolling_8w_std"), F.lit(0.0))
    return df.withColumns(
        {
            "persistence_score": _margin(persistence),
            "persistence_alert": F.coalesce((persistence > 0).cast("int"), F.lit(0)),
            "momentum_score": F.coalesce(n - mean4, F.lit(fv.NO_SCORE)) + F.coalesce(diff1, F.lit(0.0)),
            "momentum_alert": F.coalesce(((n > mean4) & (diff1 > 0)).cast("int"), F.lit(0)),
            "seasonal_score": _margin(F.col("lag_52w_count") - _threshold(multiplier)),
            "zscore_score": _margin(z),
        }
    )


def ensemble(df: DataFrame, first: str, second: str, weights: Sequence[float]) -> DataFrame:
    """Weighted means of two scores, clipped to [0, 1] (H16); weights are those of the first score."""
    bad = [w for w in weights if not 0 <= w <= 1]
    if bad:
        raise ValueError(f"ensemble weights must lie in [0, 1]: {bad}")
    made = {
        f"ensemble_{round(w * 100):02d}_score": clip(w * F.col(first) + (1 - w) * F.col(second)) for w in weights
    }
    return df.withColumns({first: clip(F.col(first)), second: clip(F.col(second))}).withColumns(made)
