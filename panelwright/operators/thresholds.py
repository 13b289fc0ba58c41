"""Alert thresholds from one cumulative pass per grouping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fv
from ..session import stage
from .metrics import coarsen, confusion_columns, evaluate_sets, evaluate_weighted, rank_metrics, score_histogram
from .ordered import attach, ordered_value, quantiles_of_histogram, range_count, running_totals


def linspace(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n)]


@dataclass(frozen=True)
class Grid:
    """Candidate thresholds: an even grid, one half, and quantiles of the scores."""

    low: float = 0.01
    high: float = 0.99
    step: float = 0.005
    quantiles: int = 200
    fixed: Sequence[float] = field(default=(0.5,))
    bounded: bool = True
    digits: int | None = 6

    def even(self) -> list[float]:
        if not self.step:
            return list(self.fixed)
        n = int((self.high - self.low) / self.step + 1e-9) + 1
        values = [round(self.low + i * self.step, 6) for i in range(n)]
        return sorted({*[v for v in values if not self.bounded or 0 <= v <= 1], *self.fixed})

    def probs(self) -> list[float]:
        return linspace(0.01, 0.99, self.quantiles) if self.quantiles else []


RULE_GRID = Grid(step=0, quantiles=200, fixed=(0.0,), bounded=False, digits=None)


def candidates(hist: DataFrame, keys: Sequence[str], grid: Grid = Grid(), ranges: int | None = None) -> DataFrame:
    """Distinct candidate thresholds per group."""
    keys = list(keys)
    even = F.explode(F.array(*[F.lit(float(v)) for v in grid.even()])).alias("threshold")
    groups = hist.select(*keys).distinct() if keys else hist.sparkSession.range(1).select()
    out = groups.select(*keys, even)
    if grid.quantiles:
        q = quantiles_of_histogram(hist, keys, "score", grid.probs(), "n", ranges).select(*keys, F.col("quantile").alias("threshold"))
        out = out.unionByName(q)
    if grid.digits is not None:
        out = out.withColumn("threshold", F.round("threshold", grid.digits))
    if grid.bounded:
        out = out.where(F.col("threshold").between(0, 1))
    return out.distinct()


def threshold_grid(hist: DataFrame, keys: Sequence[str], cands: DataFrame, ranges: int | None = None) -> DataFrame:
    """Confusion metrics at every candidate.

    Candidates enter the score histogram as rows without weight; one cumulative sum then gives alerts
    and hits for all of them, whatever their number.
    """
    keys = list(keys)
    zero = F.lit(0).cast("long")
    scores = hist.select(*keys, "score", "n", "pos", F.lit(0).alias("_kind"))
    marks = cands.select(*keys, F.col("threshold").alias("score"), zero.alias("n"), zero.alias("pos"), F.lit(1).alias("_kind"))
    cum = running_totals(
        scores.unionByName(marks), keys, "score", {"n": "predicted_positive_rows", "pos": "tp"}, True, ["_kind"], ranges
    ).where("_kind = 1")
    totals = hist.groupBy(*keys).agg(F.sum("n").alias("row_count"), F.sum("pos").alias("positive_rows"))
    joined = attach(cum.select(*keys, F.col("score").alias("threshold"), "predicted_positive_rows", "tp"), totals, keys)
    return joined.withColumns(
        confusion_columns(F.col("tp"), F.col("predicted_positive_rows"), F.col("positive_rows"), F.col("row_count"))
    )


def _best(grid: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return grid.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumn("strategy", F.lit(name))


def pick_thresholds(
    grid: DataFrame,
    keys: Sequence[str],
    min_recall: float = 0.5,
    min_precision: float = 0.3,
    strategies: Sequence[str] | None = None,
    highest_on_ties: bool = False,
) -> DataFrame:
    """Selected grid row per group and strategy (H21); a grid group holds only the candidates.

    Ties go to the lowest threshold, or to the highest on request.
    """
    tie = F.col("threshold").desc() if highest_on_ties else F.col("threshold").asc()
    feasible_recall = (F.col("recall") >= min_recall).cast("int")
    feasible_precision = (F.col("precision") >= min_precision).cast("int")
    constrained = lambda ok, metric: [
        ok.desc(), F.when(ok == 1, F.col(metric)).desc(), F.col("f1").desc(),
        F.when(ok == 1, F.col("balanced_accuracy")).desc(), tie,
    ]
    orders = {
        "default_0_5": [F.abs(F.col("threshold") - 0.5).asc(), F.col("threshold").asc()],
        "best_f1": [F.desc("f1"), tie],
        "best_f2": [F.desc("f2"), tie],
        "best_balanced_accuracy": [F.desc("balanced_accuracy"), tie],
        "best_precision_at_min_recall": constrained(feasible_recall, "precision"),
        "best_recall_at_min_precision": constrained(feasible_precision, "recall"),
    }
    out = None
    for name in strategies or list(orders):
        part = _best(grid, keys, orders[name], name)
        out = part if out is None else out.unionByName(part)
    return out


def tune(hist: DataFrame, keys: Sequence[str], grid: Grid = Grid(), strategy: str = "best_f1", ranges: int | None = None) -> DataFrame:
    """Candidates, grid and choice for all groups in one job (H22 with a constant group, H23)."""
    cands = candidates(hist, keys, grid, ranges)
    return pick_thresholds(threshold_grid(hist, keys, cands, ranges), keys, strategies=[strategy])


def rule_threshold(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best-F1 threshold of unbounded rule scores (H13); 0.0 where all rows are of one class."""
    keys = list(keys)
    chosen = tune(hist, keys, RULE_GRID)
    one_class = (F.col("positive_rows") == 0) | (F.col("positive_rows") == F.col("row_count"))
    at_zero = threshold_grid(hist, keys, candidates(hist, keys, Grid(step=0, quantiles=0, fixed=(0.0,), bounded=False, digits=None)))
    at_zero = at_zero.where(one_class).withColumn("strategy", F.lit("best_f1")).select(chosen.columns)
    return chosen.where(~one_class).unionByName(at_zero)


def category_thresholds(
    hist: DataFrame,
    group: Sequence[str] = ("score_col",),
    category: str = "category",
    grid: Grid = Grid(),
    strategy: str = "best_f1",
    min_positives: int = fv.MIN_CATEGORY_POSITIVES,
) -> DataFrame:
    """Per-category thresholds with the global one where a category is too thin.

    `hist` is the validation histogram by group, category and score; it is staged once and serves the
    global and the per-category search.
    """
    group = list(group)
    hist = stage(hist)
    ranges = range_count(hist)
    overall = tune(coarsen(hist, group), group, grid, strategy, ranges).select(*group, F.col("threshold").alias("global_threshold"))
    fine = [*group, category]
    local = tune(hist, fine, grid, strategy, ranges).select(*fine, F.col("threshold").alias("_local"))
    counts = hist.groupBy(*fine).agg(F.sum("n").alias("validation_rows"), F.sum("pos").alias("validation_positive_rows"))
    p, n = F.col("validation_positive_rows"), F.col("validation_rows")
    thin = (n == 0) | (p == 0) | (p == n) | (p < min_positives)
    joined = counts.join(overall, group, "inner").join(local, fine, "left")
    return joined.select(
        *fine,
        "validation_rows",
        "validation_positive_rows",
        "global_threshold",
        F.when(thin, F.col("global_threshold")).otherwise(F.col("_local")).alias("threshold"),
        thin.cast("int").alias("is_fallback"),
    )


def long_scores(scored: DataFrame, ids: Sequence[str], scores: Sequence[str], label: str = "y") -> DataFrame:
    """One row per observation and score column."""
    return scored.select(*ids, F.col(label).cast("int").alias("y"), *scores).unpivot([*ids, "y"], list(scores), "score_col", "score")


def with_alerts(hist: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Alert flag of the global and the per-category method for every distinct score (H24 input)."""
    t = thresholds.select("score_col", "category", "threshold")
    overall = thresholds.groupBy("score_col").agg(F.max("global_threshold").alias("_overall"))
    joined = hist.join(t, ["score_col", "category"], "left").join(overall, "score_col", "left")
    modes = F.array(
        F.struct(F.lit("global").alias("threshold_mode"), F.col("_overall").alias("used")),
        F.struct(F.lit("per_category").alias("threshold_mode"), F.coalesce("threshold", "_overall").alias("used")),
    )
    return (
        joined.withColumn("_m", F.explode(modes))
        .withColumns({"threshold_mode": F.col("_m.threshold_mode"), "alert": (F.col("score") >= F.col("_m.used")).cast("int")})
        .drop("_m", "threshold", "_overall")
    )


def evaluate_methods(long: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Every score and threshold mode on every split, overall and by category.

    The rows are reduced to a staged score histogram first; confusion counts of both levels come from
    grouping sets over it, and ranking metrics, which do not depend on the mode, from the same histogram.
    """
    method = ["score_col", "threshold_mode", "split"]
    hist = stage(score_histogram(long, ["score_col", "split", "category"]))
    confusion = evaluate_weighted(with_alerts(hist, thresholds), [method, [*method, "category"]])
    ranges = range_count(hist)
    fine = rank_metrics(hist, ["score_col", "split", "category"], ranges)
    whole = rank_metrics(coarsen(hist, ["score_col", "split"]), ["score_col", "split"], ranges).withColumn("category", F.lit(None).cast("string"))
    ranks = fine.unionByName(whole).select(
        F.col("score_col").alias("_sc"), F.col("split").alias("_sp"), F.col("category").alias("_ca"), "roc_auc", "pr_auc"
    )
    same = (
        (confusion["score_col"] == ranks["_sc"])
        & (confusion["split"] == ranks["_sp"])
        & confusion["category"].eqNullSafe(ranks["_ca"])
    )
    joined = confusion.join(ranks, same, "left").drop("_sc", "_sp", "_ca", "level")
    return joined.withColumn("method_id", F.concat_ws("_", F.regexp_replace("score_col", "_score$", ""), "threshold_mode"))


def metrics_by(scored: DataFrame, threshold: float, columns: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """H17 at one threshold by several single columns in one pass."""
    alerts = scored.withColumn("alert", (ordered_value(scored, score) >= threshold).cast("int"))
    return evaluate_sets(alerts, [[c] for c in columns], label)

