"""Week, calendar, split and experiment expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from .cleaning import flag_or_zero


def week_start(ts: Column) -> Column:
    """Monday of the week, as a date; pure date arithmetic, so no session time zone is involved."""
    d = F.to_date(ts)
    return F.date_sub(d, F.weekday(d))


def month_ranges(spark, start: str, end: str) -> DataFrame:
    """Half-open month ranges covering start..end, clipped to end plus one day."""
    span = F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("interval 1 month"))
    return (
        spark.range(1)
        .select(F.explode(span).alias("month"))
        .select(
            F.greatest("month", F.lit(start).cast("date")).alias("range_start"),
            F.least(F.add_months("month", 1), F.date_add(F.lit(end).cast("date"), 1)).alias("range_end"),
        )
    )


def add_calendar(df: DataFrame, week: str = "week_start") -> DataFrame:
    """Calendar year, ISO week and year, quarter, edge-of-year flags (T02) and period."""
    w = F.col(week)
    iso_week = F.weekofyear(w)
    return df.withColumns(
        {
            "year": F.year(w),
            "month": F.month(w),
            "quarter": F.quarter(w),
            "week_of_year": iso_week,
            "iso_year": F.extract(F.lit("YEAROFWEEK"), w),
            "week_end": F.date_add(w, 6),
            "is_year_start": (iso_week <= 2).cast("int"),
            "is_year_end": (iso_week >= 51).cast("int"),
            "period_type": period_type(F.year(w)),
            "is_covid_period": F.coalesce(F.year(w).between(2020, 2021).cast("int"), F.lit(0)),
        }
    )


def period_type(year: Column, first_year: int | None = None) -> Column:
    """Before, during and after 2020-2021 (T03); years before `first_year` are unknown when it is given."""
    known = year.isNotNull() if first_year is None else year >= first_year
    return (
        F.when(known & (year <= 2019), "pre_covid")
        .when(year.between(2020, 2021), "covid_disruption")
        .when(year >= 2022, "post_covid")
        .otherwise("unknown")
    )


def target_week(week: Column, has_target: Column) -> Column:
    """Week the label looks at, null without one."""
    return F.when(flag_or_zero(has_target) == 1, F.date_add(week, 7))


def time_split(target: Column, bounds: Mapping[str, str] = fv.DEFAULT_SPLIT) -> Column:
    """Chronological split of the target week."""
    day = {k: F.lit(v).cast("date") for k, v in bounds.items()}
    return (
        F.when(target.isNull(), "bad_date")
        .when(target >= day["test_start"], "test")
        .when(target.between(day["validation_start"], day["validation_end"]), "validation")
        .when(target <= day["train_end"], "train")
        .otherwise("out_of_range")
    )


def year_split(year: Column, train_until: int, validation_year: int) -> Column:
    """Split by year where no target week is stored (T05 fallback)."""
    return (
        F.when(year.isNull(), "bad_date")
        .when(year <= train_until, "train")
        .when(year == validation_year, "validation")
        .otherwise("test")
    )


def experiment_masks(
    ready: Column,
    label: Column,
    target_year: Column,
    split: Column,
    gap_years: tuple[int, int] = (2020, 2021),
    pre_until: int = 2019,
    post_validation: tuple[int, int] = (2022, 2023),
    post_test_from: int = 2024,
) -> dict[tuple[str, str], Column]:
    """(experiment, split) -> predicate; the subsets overlap."""
    usable = (F.coalesce(ready, F.lit(0)) == 1) & label.isNotNull()
    masks: dict[tuple[str, str], Column] = {}
    for s in ("train", "validation", "test"):
        masks["E1", s] = usable & (split == s)
        masks["E2", s] = usable & (split == s) & ~F.coalesce(target_year.between(*gap_years), F.lit(False))
        masks["E3", s] = masks["E1", s]
    masks["E4", "train"] = usable & (target_year <= pre_until)
    masks["E4", "validation"] = usable & target_year.between(*post_validation)
    masks["E4", "test"] = usable & (target_year >= post_test_from)
    return masks


def infer_core_fields(df: DataFrame, week: str = "week_start", bounds: Mapping[str, str] = fv.DEFAULT_SPLIT) -> DataFrame:
    """Add target week/year, split, period and readiness where the table lacks them."""
    made: dict[str, Column] = {}
    target = F.col("target_week") if "target_week" in df.columns else F.date_add(F.col(week), 7)
    if "target_week" not in df.columns:
        made["target_week"] = target
    if "target_year" not in df.columns:
        made["target_year"] = F.year(target)
    if "time_split" not in df.columns:
        made["time_split"] = time_split(target, bounds)
    if "period_type" not in df.columns:
        made["period_type"] = period_type(F.year(F.col(week)))
    if "final_train_ready_flag" not in df.columns:
        made["final_train_ready_flag"] = F.col("is_abnormal_next_week").isNotNull().cast("int")
    return df.withColumns(made)
