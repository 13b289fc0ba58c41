"""Confusion metrics, ranking metrics and lift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .ordered import attach, finite, ordered_value, running_sums, running_totals, step_of


def confusion_columns(tp: Column, alerts: Column, positives: Column, rows: Column) -> dict[str, Column]:
    """All threshold metrics from four counts (H17): 0 on empty precision, recall and F, null otherwise."""
    d = lambda c: c.cast("double")
    fp, fn = alerts - tp, positives - tp
    tn = rows - alerts - fn
    over = lambda a, b: d(a) / F.nullif(d(b), F.lit(0.0))
    zero = lambda a, b: F.coalesce(over(a, b), F.lit(0.0))
    recall, specificity = zero(tp, positives), over(tn, rows - positives)
    # with one class only, the average runs over the class that occurs
    balanced = (
        F.when(positives == 0, specificity).when(positives == rows, recall).otherwise((recall + specificity) / 2)
    )
    return {
        "positive_share": over(positives, rows),
        "predicted_positive_share": over(alerts, rows),
        "accuracy": over(tp + tn, rows),
        "balanced_accuracy": balanced,
        "precision": zero(tp, alerts),
        "recall": recall,
        "specificity": specificity,
        "npv": over(tn, tn + fn),
        "f1": zero(tp * 2, positives + alerts),
        "f2": zero(tp * 5, positives * 4 + alerts),
        "tn": tn,
        "fp": fp,
        "fn": fn,
    }


def evaluate(scored: DataFrame, keys: Sequence[str], label: str = "y", alert: str = "alert") -> DataFrame:
    """Confusion metrics per group (H17) from one aggregation."""
    return evaluate_sets(scored, [list(keys)], label, alert).drop("level")


def evaluate_sets(scored: DataFrame, sets: Sequence[Sequence[str]], label: str = "y", alert: str = "alert") -> DataFrame:
    """H17 for several groupings in one pass."""
    weighted = scored.withColumns({"n": F.lit(1).cast("long"), "pos": F.col(label).cast("long"), "alert": F.col(alert)})
    return evaluate_weighted(weighted, sets)


def evaluate_weighted(counted: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Metrics from rows that stand for `n` observations with `pos` positives sharing one `alert` value."""
    cols = sorted({c for s in sets for c in s})
    level = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in cols])
    hit = F.col("alert") == 1
    counts = counted.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        level.alias("level"),
        F.sum("n").alias("row_count"),
        F.sum("pos").alias("positive_rows"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("predicted_positive_rows"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
    )
    return with_confusion(counts)


def with_confusion(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        confusion_columns(F.col("tp"), F.col("predicted_positive_rows"), F.col("positive_rows"), F.col("row_count"))
    )


def score_histogram(scored: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y", unscored: bool = False) -> DataFrame:
    """Rows and positives per distinct score: everything ranking metrics and thresholds need.

    NaN is no score. Rows without one are left out, or kept as one row with a null score per group.
    """
    value = ordered_value(scored, score)
    rows = scored if unscored else scored.where(value.isNotNull())
    return rows.groupBy(*keys, value.alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))


def coarsen(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histogram of fewer keys from a finer one."""
    return hist.groupBy(*keys, "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def rank_metrics(hist: DataFrame, keys: Sequence[str], ranges: int | None = None) -> DataFrame:
    """ROC-AUC with mid-ranks for ties and average precision by steps per group.

    Both come from cumulative counts over distinct scores; null when a group has one class only. Rows of a null score
    are counted as `unscored_rows` and by no other column.
    """
    keys = list(keys)
    cum = running_totals(hist, keys, "score", {"n": "seen", "pos": "hits"}, descending=True, ranges=ranges)
    seen, hits = F.col("seen").cast("double"), F.col("hits").cast("double")
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    has = F.col("score").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(has, c)), F.lit(0))
    parts = cum.groupBy(*keys).agg(
        total(F.col("n")).alias("row_count"),
        total(F.col("pos")).alias("positive_rows"),
        F.sum(F.when(has, pos * hits / seen)).alias("_ap"),
        F.sum(F.when(has, (n - pos) * (hits - pos / 2))).alias("_auc"),
        F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("unscored_rows"),
    )
    p, q = F.col("positive_rows").cast("double"), (F.col("row_count") - F.col("positive_rows")).cast("double")
    both = (p > 0) & (q > 0)
    return parts.select(
        *keys,
        "row_count",
        "positive_rows",
        F.when(both, F.col("_auc") / (p * q)).alias("roc_auc"),
        F.when(both, F.col("_ap") / p).alias("pr_auc"),
        "unscored_rows",
    )


def lift_at(
    scored: DataFrame,
    keys: Sequence[str],
    unique: Sequence[str],
    fractions: Sequence[float] = (0.01, 0.05, 0.10),
    score: str = "score",
    label: str = "y",
) -> DataFrame:
    """Precision, recall and lift among the highest scores (F12); ties are ordered by `unique`. NaN is no score.

    A selection, not a ranking: counts by even steps of the score decide all steps but the one that the cut-off of a
    fraction falls into, and only the rows of that step are put in order.
    """
    keys = list(keys)
    value = ordered_value(scored, score)
    others = [u for u in unique if u not in keys]
    base = stage(scored.where(value.isNotNull()).select(*keys, *others, value.cast("double").alias("_score"), F.col(label).cast("long").alias("y")))
    sizes = stage(
        base.groupBy(*keys).agg(
            F.count("*").alias("_total"), F.sum("y").alias("_positives"),
            F.min(finite(F.col("_score"))).alias("_low"), F.max(finite(F.col("_score"))).alias("_high"),
        )
    )
    stepped = attach(base, sizes.select(*keys, "_low", "_high"), keys).withColumn("_step", step_of(F.col("_score"), F.col("_low"), F.col("_high"))).drop("_low", "_high")
    top = lambda f: F.greatest(F.lit(1), F.ceil(F.col("_total") * F.lit(float(f)))).cast("long")
    wanted = F.explode(F.array(*[F.struct(F.lit(float(f)).alias("fraction"), top(f).alias("rows_or_alerts")) for f in fractions])).alias("_f")
    down = Window.partitionBy(*keys).orderBy(F.col("_step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counts = stepped.groupBy(*keys, "_step").agg(F.count("*").alias("_n"), F.sum("y").alias("_y"))
    counts = counts.withColumns({"_seen": F.sum("_n").over(down), "_hits": F.sum("_y").over(down)})
    cut = attach(counts, sizes.select(*keys, "_total", "_positives"), keys).select("*", wanted).select("*", "_f.*")
    cut = cut.where((F.col("_seen") >= F.col("rows_or_alerts")) & (F.col("_seen") - F.col("_n") < F.col("rows_or_alerts")))
    cut = stage(
        cut.select(
            *keys, "_step", "fraction", "rows_or_alerts", "_total", "_positives",
            (F.col("_seen") - F.col("_n")).alias("_above"), (F.col("_hits") - F.col("_y")).alias("_hits_above"),
        )
    )
    inside = attach(stepped, cut.select(*keys, "_step").distinct(), [*keys, "_step"])
    inside = stage(inside.withColumn("_one", F.lit(1).cast("long")))
    order = [F.col("_score").desc(), *[F.col(u).asc() for u in others]]
    ranked = running_sums(inside, [*keys, "_step"], order, {"_one": "_rank", "y": "_in"}).select(*keys, "_step", "_rank", "_in")
    hits = attach(ranked, cut, [*keys, "_step"]).where(F.col("_above") + F.col("_rank") == F.col("rows_or_alerts"))
    tp, base_rate = F.col("_hits_above") + F.col("_in"), F.col("_positives") / F.col("_total")
    precision = tp / F.col("rows_or_alerts")
    return hits.select(
        *keys,
        "fraction",
        "rows_or_alerts",
        tp.alias("tp"),
        precision.alias("precision"),
        (tp / F.nullif(F.col("_positives"), F.lit(0))).alias("recall"),
        (precision / F.nullif(base_rate, F.lit(0.0))).alias("lift"),
        base_rate.alias("base_rate"),
    )


def alert_row(evaluated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row for all alerts in the shape of the lift table."""
    return evaluated.select(
        *keys,
        F.lit(None).cast("double").alias("fraction"),
        F.col("predicted_positive_rows").alias("rows_or_alerts"),
        "tp",
        "precision",
        "recall",
        (F.col("precision") / F.nullif(F.col("positive_share"), F.lit(0.0))).alias("lift"),
        F.col("positive_share").alias("base_rate"),
    )

