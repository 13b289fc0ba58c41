"""Daily and weekly weather."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.calendar import week_start
from ..functions.cleaning import mask_sentinels
from .ordered import distribution, profile_of
from .panel import densify_weeks

COMPARE = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}
TEMPERATURES = ["tmax", "tmin", "tavg"]
DEPTHS = ["prcp", "snow", "snwd"]


def pivot_daily(
    long: DataFrame,
    keys: Sequence[str],
    datatypes: Sequence[str] = tuple(fv.WEATHER_DATATYPES),
    flags: Sequence[tuple[str, str, str, float]] = tuple(fv.DAILY_FLAGS),
) -> DataFrame:
    """Long daily rows to one row per key with a column per datatype.

    Repeated measurements keep the smallest record (value order), which does not depend on file order.
    Absent datatypes become null columns, flags are 0 where the measure is missing.
    """
    wide = long.groupBy(*keys).agg(
        *[F.min(F.when(F.col("datatype") == d, F.col("value"))).alias(d) for d in datatypes]
    )
    made = {"TAVG_est": (F.col("TMAX") + F.col("TMIN")) / 2} if {"TMAX", "TMIN"} <= set(datatypes) else {}
    for name, d, op, limit in flags:
        made[name] = F.coalesce(COMPARE[op](F.col(d), limit).cast("int"), F.lit(0))
    return wide.withColumns(made)


def unit_decisions(long: DataFrame, requested: Mapping[str, str], family: str = "family", value: str = "value") -> DataFrame:
    """One row per family: observed range, chosen unit, scale and offset.

    `requested` maps a family to a unit or to 'auto'. Statistics are exact and computed in one job
    for all families; the choice itself is an expression over those few rows.
    """
    clean = long.select(F.col(family).alias("family"), mask_sentinels(F.col(value)).alias("value")).where("value is not null")
    stats = profile_of(distribution(clean, ["family"], "value"), ["family"], "value", {"p50": 0.5, "p99": 0.99})
    stats = stats.withColumnsRenamed({"n": "n_valid", "min": "min_value", "max": "max_value"})
    asked = long.sparkSession.createDataFrame(sorted(requested.items()), "family string, requested_unit string")
    r = asked.join(stats, "family", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    fam, p99, top = F.col("family"), F.col("p99"), F.col("max_value")
    auto = (
        F.when(F.col("n_valid") == 0, "unknown")
        .when(fam.isin(TEMPERATURES), F.when(top > 80, "tenths_c").when(p99 > 45, "fahrenheit").otherwise("celsius"))
        .when(fam.isin(DEPTHS), F.when((p99 <= 20) & (top <= 80), "mm").when((p99 > 300) | (top > 600), "tenths_mm").otherwise("mm"))
        .otherwise(F.when(p99 > 50, "tenths_mps").otherwise("mps"))
    )
    unit = F.when(F.col("requested_unit") == "auto", auto).otherwise(F.col("requested_unit"))
    return r.withColumn("unit", unit).withColumns({"scale": _unit_scale(F.col("unit")), "shift": _unit_shift(F.col("unit"))})


def _unit_scale(unit: Column) -> Column:
    return (
        F.when(unit.isin("tenths_c", "tenths_mm", "tenths_mps"), 0.1)
        .when(unit == "fahrenheit", 5.0 / 9.0)
        .when(unit == "inches", 25.4)
        .when(unit == "mph", 0.44704)
        .otherwise(1.0)
    )


def _unit_shift(unit: Column) -> Column:
    return F.when(unit == "fahrenheit", -32.0).otherwise(0.0)


def apply_units(long: DataFrame, decisions: DataFrame, family: str = "family", value: str = "value") -> DataFrame:
    """Scaled values in Celsius, millimetres and metres per second; one decision row per family."""
    d = decisions.select(F.col("family").alias(family), "unit", "scale", "shift")
    return long.join(d, family, "left").withColumn(value, (mask_sentinels(F.col(value)) + F.col("shift")) * F.col("scale")).drop("scale", "shift")


def row_statistics(df: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """Mean, min, max and number of values across the columns of each family in a row."""
    made = {}
    for fam, cols in families.items():
        values = F.array_compact(F.array(*[mask_sentinels(F.col(c)) for c in cols]))
        n = F.size(values)
        made[f"row_{fam}_mean"] = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.nullif(n, F.lit(0))
        made[f"row_{fam}_min"] = F.array_min(values)
        made[f"row_{fam}_max"] = F.array_max(values)
        made[f"row_{fam}_obs"] = n
    return df.withColumns(made)


def daily_city(df: DataFrame, date: str, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per day over all stations, with a derived mean temperature where none was read."""
    rows = row_statistics(df.where(F.col(date).isNotNull()).withColumn("date", F.to_date(date)), families)
    aggs = [F.count("*").alias("source_rows")]
    for fam in families:
        aggs += [
            F.avg(f"row_{fam}_mean").alias(f"daily_{fam}_mean"),
            F.min(f"row_{fam}_min").alias(f"daily_{fam}_min"),
            F.max(f"row_{fam}_max").alias(f"daily_{fam}_max"),
            F.count(f"row_{fam}_mean").alias(f"daily_{fam}_rows"),
            F.sum(f"row_{fam}_obs").alias(f"daily_{fam}_obs"),
        ]
    daily = rows.groupBy("date").agg(*aggs)
    if "tavg" not in families and {"tmax", "tmin"} <= set(families):
        derived = (F.col("daily_tmax_mean") + F.col("daily_tmin_mean")) / 2
        none = F.lit(None).cast("double")
        daily = daily.withColumns(
            {
                "daily_tavg_mean": derived,
                "daily_tavg_min": none,
                "daily_tavg_max": none,
                "daily_tavg_rows": derived.isNotNull().cast("long"),
                "daily_tavg_obs": F.lit(None).cast("long"),
            }
        )
    return daily.withColumn("week_start", week_start(F.col("date")))


# weekly column -> (aggregate, daily column)
WEEKLY_MEASURES = {
    "weather_tmax_mean": ("avg", "daily_tmax_mean"),
    "weather_tmax_max": ("max", "daily_tmax_mean"),
    "weather_tmax_min": ("min", "daily_tmax_mean"),
    "weather_tmax_station_max": ("max", "daily_tmax_max"),
    "weather_tmin_mean": ("avg", "daily_tmin_mean"),
    "weather_tmin_min": ("min", "daily_tmin_mean"),
    "weather_tmin_max": ("max", "daily_tmin_mean"),
    "weather_tavg_mean": ("avg", "daily_tavg_mean"),
    "weather_prcp_sum": ("sum", "daily_prcp_mean"),
    "weather_prcp_mean": ("avg", "daily_prcp_mean"),
    "weather_prcp_max": ("max", "daily_prcp_mean"),
    "weather_prcp_station_max": ("max", "daily_prcp_max"),
    "weather_snow_sum": ("sum", "daily_snow_mean"),
    "weather_snow_mean": ("avg", "daily_snow_mean"),
    "weather_snow_max": ("max", "daily_snow_mean"),
    "weather_snwd_mean": ("avg", "daily_snwd_mean"),
    "weather_snwd_max": ("max", "daily_snwd_mean"),
    "weather_awnd_mean": ("avg", "daily_awnd_mean"),
    "weather_awnd_max": ("max", "daily_awnd_mean"),
}


def weekly_measures(daily: DataFrame) -> list[Column]:
    """Aggregates of E10; a measure missing all week stays null."""
    out = [F.count_distinct("date").alias("weather_days_observed"), F.sum("source_rows").alias("weather_source_rows")]
    for name, (how, source) in WEEKLY_MEASURES.items():
        c = getattr(F, how)(source) if source in daily.columns else F.max(F.lit(None).cast("double"))
        out.append(c.alias(name))
    return out


def event_day_counts(daily: DataFrame, events: Sequence[tuple[str, str, str, float]] = tuple(fv.WEATHER_EVENTS)) -> list[Column]:
    """Days meeting each condition, null rather than 0 when the measure is missing all week."""
    out = []
    for name, fam, op, limit in events:
        source = f"daily_{fam}_mean"
        if source in daily.columns:
            x = F.col(source)
            out.append(F.sum(F.when(COMPARE[op](x, limit), 1).when(x.isNotNull(), 0)).alias(name))
        else:
            out.append(F.max(F.lit(None).cast("long")).alias(name))
    return out


def add_coverage(weekly: DataFrame, min_days: int = 4) -> DataFrame:
    """Completeness flags of a week."""
    n = F.col("weather_days_observed")
    return weekly.withColumns(
        {
            "weather_complete_week_flag": (n >= 7).cast("int"),
            "weather_min_days_ok_flag": (n >= min_days).cast("int"),
            "weather_days_missing_in_week": F.greatest(F.lit(7) - n, F.lit(0)),
        }
    )


def weekly_weather(daily: DataFrame, min_days: int = 4, densify: bool = False) -> DataFrame:
    """Weekly measures, event days, coverage and calendar of the week."""
    weekly = daily.groupBy("week_start").agg(*weekly_measures(daily), *event_day_counts(daily))
    if densify:
        weekly = densify_weeks(weekly, ["weather_days_observed", "weather_source_rows"])
    w = F.col("week_start")
    return add_coverage(weekly, min_days).withColumns(
        {
            "week_end": F.date_add(w, 6),
            "weather_year": F.year(w),
            "weather_month": F.month(w),
            "weather_quarter": F.quarter(w),
            "weather_week_of_year": F.weekofyear(w),
            "weather_iso_year": F.extract(F.lit("YEAROFWEEK"), w),
        }
    )
