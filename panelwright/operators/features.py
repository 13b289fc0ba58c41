"""Leakage-safe lags, rolling statistics, momentum and labels."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fv
from ..functions.cleaning import ratio
from .panel import SERIES


def series_window(series: Sequence[str] = tuple(SERIES), week: str = "week_start"):
    """One exchange and one sort serve every feature of a series; a series holds one row per week."""
    return Window.partitionBy(*series).orderBy(week)


def lags(count: str, w, weeks: Sequence[int] = tuple(fv.LAG_WEEKS)) -> dict[str, Column]:
    """Count k weeks ago."""
    return {f"lag_{k}w_count": F.lag(count, k).over(w).cast("double") for k in weeks}


def rolling(count: str, w, weeks: Sequence[int] = tuple(fv.ROLLING_WEEKS), full_window: bool = True) -> dict[str, Column]:
    """Mean, sample std and sum of the n weeks before t (F02); null below the minimum history."""
    out: dict[str, Column] = {}
    for n in weeks:
        frame = w.rowsBetween(-n, -1)
        enough = F.count(count).over(frame) >= (n if full_window else 1)
        out[f"rolling_{n}w_mean"] = F.when(enough, F.avg(count).over(frame))
        out[f"rolling_{n}w_std"] = F.when(enough, F.stddev_samp(count).over(frame))
        out[f"rolling_{n}w_sum"] = F.when(enough, F.sum(count).over(frame).cast("double"))
    return out


def exact_multiplier(multiplier: float) -> Fraction:
    """The multiplier as the fraction its decimal notation says; squares of larger denominators would not fit the comparison."""
    exact = Fraction(str(multiplier))
    if exact < 0 or exact.denominator > 100 or exact.numerator > 10_000:
        raise ValueError("label multiplier must be a non-negative decimal with two places at most")
    return exact


def abnormal_next_week(count: str, w, weeks: int, multiplier: float, n_expr: Column | None = None) -> Column:
    """next > mean + m*std over the n weeks before t, in whole numbers.

    With S = sum x, Q = sum x*x, d = n*next - S and m = p / q the comparison equals
    d > 0 and (n-1) q^2 d^2 > p^2 n (nQ - S^2): no rounding, so exact ties are decided correctly.
    Null unless the window is full and a next week exists.
    """
    frame = w.rowsBetween(-weeks, -1)
    x = F.col(count).cast("long")
    nxt = F.lead(x, 1).over(w)
    s, q = F.sum(x).over(frame), F.sum(x * x).over(frame)
    full = F.count(x).over(frame) >= weeks
    # decimals keep the squares exact for weekly counts up to about 10^11
    wide = lambda c: c.cast("decimal(19,0)")
    d = wide(nxt * weeks - s)
    m = exact_multiplier(multiplier)
    left = d * d * F.lit(m.denominator**2 * (weeks - 1))
    right = (wide(q) * F.lit(weeks) - wide(s) * wide(s)) * F.lit(m.numerator**2 * weeks)
    return F.when(full & nxt.isNotNull(), ((d > 0) & (left > right)).cast("int"))


def momentum() -> dict[str, Column]:
    """Differences and ratios from existing columns (F05); ratios null unless the denominator is positive."""
    n = F.col("n")
    positive = lambda d, e: F.when(d > 0, e)
    return {
        "diff_1w_count": n - F.col("lag_1w_count"),
        "diff_4w_count": n - F.col("lag_4w_count"),
        "pct_change_1w": positive(F.col("lag_1w_count"), ratio(n - F.col("lag_1w_count"), F.col("lag_1w_count"))),
        "ratio_to_8w_mean": positive(F.col("rolling_8w_mean"), ratio(n, F.col("rolling_8w_mean"))),
        "ratio_to_12w_mean": positive(F.col("rolling_12w_mean"), ratio(n, F.col("rolling_12w_mean"))),
    }


def add_temporal_features(
    panel: DataFrame,
    multiplier: float = fv.LABEL_MULTIPLIER,
    min_history: int = fv.MIN_HISTORY_WEEKS,
    full_window: bool = True,
    series: Sequence[str] = tuple(SERIES),
) -> DataFrame:
    """All temporal features, the label and the readiness flags (F01-F06, F08) over one exchange."""
    w = series_window(series)
    base = panel.withColumns(
        {
            "history_weeks": F.row_number().over(w) - 1,
            **lags("n", w),
            **rolling("n", w, full_window=full_window),
            "next_week_count": F.lead("n", 1).over(w).cast("double"),
            "is_abnormal_next_week": abnormal_next_week("n", w, fv.LABEL_WEEKS, multiplier),
        }
    )
    return add_readiness(base.withColumns(momentum()), multiplier, min_history)


def add_readiness(df: DataFrame, multiplier: float, min_history: int) -> DataFrame:
    """Float threshold for display and the three readiness flags."""
    enough = (F.col("history_weeks") >= min_history).cast("int")
    has_target = F.col("next_week_count").isNotNull().cast("int")
    return df.withColumns(
        {
            "abnormal_threshold": F.col("rolling_8w_mean") + multiplier * F.col("rolling_8w_std"),
            "has_min_history": enough,
            "has_target_next_week": has_target,
            "is_train_ready": (
                (enough == 1) & (has_target == 1) & F.col("is_abnormal_next_week").isNotNull()
            ).cast("int"),
        }
    )


def label_variants(panel: DataFrame, definitions: Sequence[tuple[int, float]], series: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """One 0/1 column per (window, multiplier) definition (F07); an undefined label counts as 0."""
    w = series_window(series)
    made = {
        f"label_{n}w_{str(m).replace('.', '_')}": F.coalesce(abnormal_next_week("n", w, n, m), F.lit(0))
        for n, m in definitions
    }
    return panel.withColumns({**made, "has_target_next_week": F.lead("n", 1).over(w).isNotNull().cast("int")})


def label_sensitivity(panel: DataFrame, definitions: Sequence[tuple[int, float]], series: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """Positives and share per label definition over rows that have a next week."""
    wide = label_variants(panel, definitions, series).where("has_target_next_week = 1")
    names = [c for c in wide.columns if c.startswith("label_")]
    long = wide.select(*names).unpivot([], names, "definition", "y")
    return long.groupBy("definition").agg(
        F.count("*").alias("row_count"), F.sum("y").alias("positive_rows"), F.avg("y").alias("positive_share")
    )
