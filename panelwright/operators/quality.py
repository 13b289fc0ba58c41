"""Imputation defaults, quality flags and the leakage audit (Q01-Q05, Q10)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.cleaning import flag_or_zero
from .ordered import melt, quantiles

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC and c not in skip]


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value) with exact medians of many columns from one long job."""
    long = melt(df, [], columns, "column_name")
    return quantiles(long, ["column_name"], "value", [0.5]).select("column_name", F.col("quantile").alias("value"))


def strategy(source: str, column: str) -> str:
    """How a missing numeric value of a dimension is filled; the order of the tests matters."""
    if source == "weather":
        return "median"
    if source == "poi":
        return "zero"
    if any(word in column for word in fv.AVERAGE_WORDS):
        return "median"
    if any(word in column for word in (*fv.RATIO_WORDS, *fv.VOLUME_WORDS)):
        return "zero"
    return "median"


def imputation_defaults(dimensions: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One row per numeric dimension column: source, strategy and value (Q01).

    `dimensions` maps a source to its table and its key columns. Pass tables restricted to training
    keys to keep held-out periods out of the medians.
    """
    parts = []
    for source, (df, keys) in dimensions.items():
        cols = numeric_columns(df, keys)
        by_median = [c for c in cols if strategy(source, c) == "median"]
        spark = df.sparkSession
        listed = spark.createDataFrame(
            [(source, c, strategy(source, c)) for c in cols], "source string, column_name string, strategy string"
        )
        if by_median:
            found = medians(df, by_median)
            listed = listed.join(found, "column_name", "left")
        else:
            listed = listed.withColumn("value", F.lit(None).cast("double"))
        parts.append(listed.select("source", "column_name", "strategy", F.coalesce("value", F.lit(0.0)).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def text_defaults(dimensions: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One row per text column of a dimension: source, column_name and the word for a missing value (Q01).

    Points of interest have "none", all other sources "unknown". Other sources than parcels and points may be named
    freely; their keys are left out.
    """
    rows = [
        (source, c, "none" if source == "poi" else "unknown")
        for source, (df, keys) in dimensions.items()
        for c, kind in df.dtypes
        if kind == "string" and c not in keys
    ]
    spark = next(iter(dimensions.values()))[0].sparkSession
    return spark.createDataFrame(rows, "source string, column_name string, value string")


def apply_text_defaults(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """Fill null texts from the table of `text_defaults`, which holds one short row per column (Q02)."""
    rows = {r["column_name"]: r["value"] for r in defaults.collect() if r["column_name"] in df.columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in rows.items()})


def apply_defaults(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """Fill nulls from the defaults table (Q02), which holds one short row per column."""
    have = dict(df.dtypes)
    rows = {r["column_name"]: r["value"] for r in defaults.collect() if r["column_name"] in have}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(have[c])) for c, v in rows.items()})


def source_missing(anchors: Sequence[str]) -> Column:
    """1 when every anchor column of a dimension is null (Q04)."""
    return F.coalesce(*[F.col(a).cast("string") for a in anchors]).isNull().cast("int")


def add_quality_flags(df: DataFrame) -> DataFrame:
    """Match, source and readiness flags after the dimension joins and before imputation (Q03).

    Expects the markers weather_present, poi_present, landuse_present set by the joins.
    """
    absent = lambda c: F.col(c).isNull().cast("int")
    flags = {
        "weather_missing_flag": absent("weather_present"),
        "poi_missing_flag": absent("poi_present"),
        "landuse_table_missing_flag": absent("landuse_present"),
        "landuse_source_missing_flag": (
            F.coalesce(F.col("landuse_source_missing"), F.lit(1)) if "landuse_source_missing" in df.columns else absent("landuse_present")
        ),
        "zero_poi_flag": (F.coalesce(F.col("poi_total_count"), F.lit(0)) == 0).cast("int"),
        "weather_incomplete_week_flag": (F.coalesce(F.col("weather_complete_week_flag"), F.lit(0)) != 1).cast("int"),
    }
    merged = (
        F.col("weather_present").isNotNull() & F.col("poi_present").isNotNull() & F.col("landuse_present").isNotNull()
    )
    ready = (
        (flag_or_zero(F.col("is_train_ready")) == 1)
        & (flag_or_zero(F.col("has_target_next_week")) == 1)
        & F.col("is_abnormal_next_week").isNotNull()
        & F.col("next_week_count").isNotNull()
        & merged
    )
    flags["all_merged_flag"] = merged.cast("int")
    flags["final_train_ready_flag"] = ready.cast("int")
    return df.withColumns(flags)


def compact_binary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast columns whose values are only 0, 1 or null to 0/1 integers (Q05); one pass decides for all."""
    odd = df.agg(*[F.max((~F.col(c).isin(0, 1)).cast("int")).alias(c) for c in columns]).first().asDict()
    safe = [c for c in columns if not odd[c]]
    return df.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in safe})


def binary_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Which columns `compact_binary` would cast."""
    wide = df.agg(*[F.coalesce(F.max((~F.col(c).isin(0, 1)).cast("int")), F.lit(0)).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column_name", "has_other_values")


# fixed values: name parts that may not occur among model inputs
FORBIDDEN_NAMES = [r"next_week", r"target", r"future", r"abnormal"]


def forbidden_names(names: Sequence[str], patterns: Sequence[str] = tuple(FORBIDDEN_NAMES)) -> list[str]:
    return sorted({n for n in names if any(re.search(p, n.lower()) for p in patterns)})


def leakage_audit(
    table: DataFrame,
    counts: DataFrame,
    series: Sequence[str],
    bounds: Mapping[str, tuple[int, int]],
    lag_columns: Mapping[str, int],
    features: Sequence[str],
) -> DataFrame:
    """Row-level audit as check, violations, status (Q10), from one aggregation over cells.

    `bounds` gives first and last target year per split. Every count is sent to its own week and to the weeks whose lags
    must show it, so the lags are recomputed from the raw weekly counts and share no code with the feature builder. Cells
    meet in one exchange for all checks. If several rows of a cell do not agree in a lag, all of them violate it.
    """
    outside = F.lit(False)
    for split, (lo, hi) in bounds.items():
        outside = outside | ((F.col("time_split") == split) & ~F.coalesce(F.col("target_year").between(lo, hi), F.lit(False)))
    late = F.col("target_week").isNotNull() & (F.date_diff("target_week", "week_start") != 7)
    lags = {c: f"_lag{i}" for i, c in enumerate(lag_columns)}
    number = lambda c: F.col(c).cast("double")
    rows = table.select(
        *series, "week_start", F.lit(1).alias("_row"), F.coalesce("time_split", F.lit("")).alias("_split"), outside.cast("int").alias("_outside"), late.cast("int").alias("_late"),
        *[number(c).alias(name) for c, name in lags.items()], *[F.lit(None).cast("double").alias(f"_past{name}") for name in lags.values()],
    )
    moved = F.explode(F.array(*[F.struct(F.date_add("week_start", 7 * w).alias("week"), F.lit(name).alias("lag")) for (c, w), name in zip(lag_columns.items(), lags.values(), strict=True)])).alias("_m")
    past = counts.select(*series, number("n").alias("_c"), "week_start", moved) if lags else None
    cells = rows
    if past is not None:
        shifted = past.select(
            *series, F.col("_m.week").alias("week_start"), F.lit(0).alias("_row"), F.lit(None).cast("string").alias("_split"), F.lit(0).alias("_outside"), F.lit(0).alias("_late"),
            *[F.lit(None).cast("double").alias(name) for name in lags.values()],
            *[F.when(F.col("_m.lag") == name, F.col("_c")).alias(f"_past{name}") for name in lags.values()],
        )
        cells = rows.unionByName(shifted)
    seen = []
    for name in lags.values():
        own = F.col("_row") == 1
        seen += [F.min(name).alias(f"_min{name}"), F.max(name).alias(f"_max{name}"), F.count_if(own & F.col(name).isNull()).alias(f"_none{name}"), F.max(f"_past{name}").alias(f"_past{name}")]
    per_cell = cells.groupBy(*series, "week_start").agg(
        F.sum("_row").alias("_n"), F.sum("_outside").alias("_outside"), F.sum("_late").alias("_late"), (F.min("_split") != F.max("_split")).alias("_mixed"), *seen
    )

    def wrong(name: str) -> Column:
        n, none, past = F.col("_n"), F.col(f"_none{name}"), F.col(f"_past{name}")
        right = F.when(past.isNull(), none == n).otherwise((none == 0) & (F.col(f"_min{name}") == past) & (F.col(f"_max{name}") == past))
        return F.sum(F.when(F.coalesce(right, F.lit(False)), 0).otherwise(n))

    found = {
        "target years stay inside their split": F.sum("_outside"),
        "one split and one row per key": F.count_if((F.col("_n") > 1) | F.coalesce("_mixed", F.lit(False))),
        "the target week follows the feature week": F.sum("_late"),
        **{f"{c} equals the count {w} weeks earlier": wrong(lags[c]) for c, w in lag_columns.items()},
        "no forbidden feature names": F.lit(len(forbidden_names(features))),
    }
    wide = per_cell.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(str(i)) for i, v in enumerate(found.values())])
    pairs = F.array(*[F.struct(F.lit(check).alias("check"), F.col(str(i)).alias("violations")) for i, check in enumerate(found)])
    out = wide.select(F.inline(pairs))
    return out.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))
