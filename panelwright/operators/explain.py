"""Contributions, importances and local cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .metrics import rank_metrics, score_histogram
from .ordered import melt, running_totals, top_per_group


def select_cases(scored: DataFrame, threshold: float, n: int, unique: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """Up to n true/false positives and false negatives by high score, true negatives by low score."""
    alert = (F.col(score) >= threshold).cast("int")
    case = (
        F.when((F.col(label) == 1) & (alert == 1), "true_positive_high_score")
        .when((F.col(label) == 0) & (alert == 1), "false_positive_high_score")
        .when((F.col(label) == 1) & (alert == 0), "false_negative_low_score")
        .otherwise("true_negative_low_score")
    )
    signed = F.when(F.col("case_type") == "true_negative_low_score", F.col(score)).otherwise(-F.col(score))
    flagged = scored.withColumns({"alert": alert, "case_type": case})
    return top_per_group(flagged, ["case_type"], [signed.asc(), *[F.col(u).asc() for u in unique]], n, "case_rank")


@dataclass(frozen=True)
class LinearTerms:
    """A fitted linear model on the columns as they come: log odds = intercept + sum of coefficient * value."""

    intercept: float
    coefficients: Mapping[str, float]

    def base(self, means: Mapping[str, float]) -> float:
        """The log odds of a row at the means: what the contributions are added to."""
        return self.intercept + sum(c * means[f] for f, c in self.coefficients.items())


def linear_terms(model: PipelineModel, inputs: Sequence[str]) -> LinearTerms:
    """Coefficients of a fitted pipeline with its scaling undone (H37). `inputs` names the places of its vector."""
    linear = model.stages[-1]
    weights = linear.coefficients.toArray()
    for scaler in (s for s in model.stages if isinstance(s, StandardScalerModel)):
        std = scaler.std.toArray()
        if scaler.getWithMean() or not scaler.getWithStd():
            raise ValueError("contributions need a scaler that divides and does not centre")
        weights = [w / s if s else 0.0 for w, s in zip(weights, std, strict=True)]
    return LinearTerms(float(linear.intercept), {f: float(w) for f, w in zip(inputs, weights, strict=True)})


def training_means(train: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Means of the training rows, one aggregate for all."""
    return {f: float(v) for f, v in train.agg(*[F.avg(F.col(f"`{f}`")).alias(f) for f in features]).first().asDict().items()}


def linear_contributions(
    df: DataFrame,
    ids: Sequence[str],
    coefficients: Mapping[str, float],
    means: Mapping[str, float],
) -> DataFrame:
    """coefficient * (x - train mean) per row and feature: an exact split of the log odds."""
    made = [((F.col(f).cast("double") - F.lit(float(means[f]))) * F.lit(float(c))).alias(f) for f, c in coefficients.items()]
    return melt(df.select(*ids, *made), ids, list(coefficients))


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute and signed contribution, share and rank per feature."""
    per = contributions.groupBy("feature").agg(
        F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean_signed"), F.count("*").alias("row_count")
    )
    return _ranked(per, "mean_abs", "feature")


def _ranked(df: DataFrame, measure: str, name: str) -> DataFrame:
    """Share and rank over one row per feature or group; measures that agree to nine places go by name."""
    whole = Window.partitionBy()
    return df.withColumns(
        {
            "share": F.col(measure) / F.nullif(F.sum(measure).over(whole), F.lit(0.0)),
            "importance_rank": F.row_number().over(whole.orderBy(F.round(measure, 9).desc(), F.asc(name))),
        }
    )


def group_importance(importance: DataFrame, groups: DataFrame) -> DataFrame:
    """Summed importance per feature group (H34); `groups` maps feature to feature_group."""
    joined = importance.join(groups, "feature", "left").withColumn("feature_group", F.coalesce("feature_group", F.lit("other")))
    per = joined.groupBy("feature_group").agg(F.sum("mean_abs").alias("mean_abs_sum"), F.count("*").alias("feature_count"))
    return _ranked(per, "mean_abs_sum", "feature_group")


def category_importance(contributions: DataFrame, n: int, category: str = "category") -> DataFrame:
    """Top features per category."""
    per = contributions.groupBy(category, "feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.count("*").alias("row_count"))
    return top_per_group(per, [category], [F.desc("mean_abs"), F.asc("feature")], n, "category_rank")


def local_contributions(cases: DataFrame, contributions: DataFrame, ids: Sequence[str], n: int) -> DataFrame:
    """Strongest contributions of each selected case (H36); the case table is small and joins by row id."""
    picked = contributions.join(cases.select(*ids, "case_type", "case_rank"), list(ids), "inner")
    return top_per_group(picked, ["case_type", "case_rank"], [F.desc(F.abs(F.col("value"))), F.asc("feature")], n, "contribution_rank")


def local_summary(cases: DataFrame, contributions: DataFrame, ids: Sequence[str], n: int = 5) -> DataFrame:
    """Sum of contributions and the strongest features in both directions per case."""
    picked = contributions.join(cases.select(*ids, "case_type", "case_rank"), list(ids), "inner")
    pair = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), F.col("feature").alias("f"))))
    names = lambda a: F.array_join(F.transform(a, lambda s: s["f"]), ";")
    per = picked.groupBy("case_type", "case_rank").agg(F.sum("value").alias("contribution_sum"), pair.alias("_a"))
    flipped = F.array_sort(F.transform("_a", lambda s: F.struct((-s["v"]).alias("v"), s["f"].alias("f"))))
    return per.select(
        "case_type",
        "case_rank",
        "contribution_sum",
        names(F.slice("_a", 1, n)).alias("top_positive"),
        names(F.slice(flipped, 1, n)).alias("top_negative"),
    )


def permuted(df: DataFrame, key: Sequence[str], columns: Sequence[str], seed: int) -> DataFrame:
    """The table with `columns` exchanged between rows by a fixed permutation.

    Rows get two ranks from two hashes; a row takes the values of the row whose second rank equals its
    first. Both rankings and the join are distributed.
    """
    # the sign bit is dropped so that the hash orders the same as long and as double range
    mixed = lambda s: F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in key], F.lit(s)), 11)
    base = stage(df.withColumns({"_h1": mixed(seed), "_h2": mixed(seed + 1), "_one": F.lit(1).cast("long")}))
    takes = running_totals(base, [], "_h1", {"_one": "_rank"}, then=key)
    gives = running_totals(base, [], "_h2", {"_one": "_rank"}, then=key).select("_rank", *columns)
    return takes.drop(*columns).join(gives, "_rank", "inner").drop("_rank", "_h1", "_h2", "_one")


def permutation_importance(
    df: DataFrame,
    key: Sequence[str],
    groups: Mapping[str, Sequence[str]],
    scorer,
    label: str,
    seed: int = 42,
) -> DataFrame:
    """Loss of average precision when one feature group is permuted (H37 for tree models).

    `scorer` maps a DataFrame to one with a column `score`. The loop runs over feature groups only.
    """
    parts = []
    base = rank_metrics(stage(score_histogram(scorer(df), [], "score", label)), []).select(F.lit("none").alias("feature_group"), "pr_auc", "roc_auc")
    parts.append(base)
    for name, cols in groups.items():
        mixed = scorer(permuted(df, key, cols, seed))
        hist = stage(score_histogram(mixed, [], "score", label))
        parts.append(rank_metrics(hist, []).select(F.lit(name).alias("feature_group"), "pr_auc", "roc_auc"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    whole = Window.partitionBy()
    reference: Column = F.max(F.when(F.col("feature_group") == "none", F.col("pr_auc"))).over(whole)
    return out.withColumn("pr_auc_loss", reference - F.col("pr_auc"))
