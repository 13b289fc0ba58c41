"""Balance tables, profiles and missing-value reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fv
from ..session import stage
from .ordered import attach, distribution, melt, profile_of, quantiles, quantiles_of_histogram, top_per_group

PROFILE_PROBS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def grouping_level(columns: Sequence[str]) -> Column:
    """Readable name of the grouping set of a row, for example 'category+year' or 'all'."""
    return F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])


def target_balance(df: DataFrame, label: str, target: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Valid, positive and negative rows, share, mean and exact median target for several groupings.

    The counts of all groupings come from one expand-and-aggregate job; medians use value histograms.
    """
    cols = sorted({c for s in sets for c in s})
    valid = df.where(F.col(label).isNotNull())
    hist = stage(valid.groupBy(*cols, target).agg(F.count("*").alias("_n"), F.sum(label).alias("_p")))
    grouped = hist.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        grouping_level(cols).alias("level"),
        F.sum("_n").alias("valid_rows"),
        F.sum("_p").alias("positive_rows"),
        (F.sum(F.col(target) * F.col("_n")) / F.sum(F.when(F.col(target).isNotNull(), F.col("_n")))).alias("mean_target"),
    )
    out = grouped.withColumns(
        {
            "negative_rows": F.col("valid_rows") - F.col("positive_rows"),
            "positive_share": F.col("positive_rows") / F.col("valid_rows"),
        }
    )
    fine = hist.groupingSets([[*[F.col(c) for c in s], F.col(target)] for s in sets], *cols, F.col(target)).agg(
        grouping_level(cols).alias("level"), F.sum("_n").alias("_cnt")
    )
    keys = [*cols, "level"]
    med = quantiles_of_histogram(stage(fine.where(F.col(target).isNotNull())), keys, target, [0.5])
    return attach(out, med.select(*keys, F.col("quantile").alias("median_target")), keys)


def category_profile(df: DataFrame, category: str = "category", count: str = "n", ready: str = "is_train_ready") -> DataFrame:
    """Rows, total, mean, median, max, distinct areas and weeks, ready rows and share per category.

    The five columns it needs are written once; totals and medians come from them.
    """
    df = stage(df.select(category, count, "area", "week_start", ready))
    base = df.groupBy(category).agg(
        F.count("*").alias("row_count"),
        F.sum(count).alias("total_count"),
        F.avg(count).alias("mean_count"),
        F.max(count).alias("max_count"),
        F.count_distinct("area").alias("areas"),
        F.count_distinct("week_start").alias("weeks"),
        F.sum(ready).alias("ready_rows"),
    )
    med = quantiles(df, [category], count, [0.5]).select(category, F.col("quantile").alias("median_count"))
    whole = F.sum("total_count").over(Window.partitionBy())
    return base.join(med, category, "left").withColumn("total_share", F.col("total_count") / whole)


def missing_values(df: DataFrame) -> DataFrame:
    """Nulls (and NaN) per column with share and type, one scan."""
    kinds = dict(df.dtypes)

    def absent(c: str) -> Column:
        is_float = kinds[c] in ("double", "float")
        return F.col(c).isNull() | F.isnan(c) if is_float else F.col(c).isNull()

    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(absent(c)).alias(c) for c in df.columns])
    long = counts.unpivot(["_rows"], list(df.columns), "column_name", "missing_count")
    types = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return long.select(
        "column_name",
        "missing_count",
        (F.col("missing_count") / F.nullif(F.col("_rows"), F.lit(0))).alias("missing_share"),
        F.element_at(types, F.col("column_name")).alias("data_type"),
    )


def numeric_profile(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), probs: Mapping[str, float] = PROFILE_PROBS) -> DataFrame:
    """n, mean, std, min, exact quantiles and max of many columns in one long job."""
    by = [*keys, "feature"]
    return profile_of(distribution(melt(df, keys, columns), by, "value"), by, "value", probs)


def flag_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Value counts and shares of 0/1 columns (E32), null kept as its own value."""
    long = df.select(*[F.col(f).cast("int").alias(f) for f in flags]).unpivot([], list(flags), "flag", "flag_value")
    counts = long.groupBy("flag", "flag_value").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("flag")))


def balance_counts(df: DataFrame, label: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Rows per label value for several groupings in one pass, null labels kept."""
    cols = sorted({c for s in sets for c in s})
    full = [[*[F.col(c) for c in s], F.col(label)] for s in sets]
    return df.groupingSets(full, *cols, F.col(label)).agg(
        grouping_level(cols).alias("level"), F.count("*").alias("n")
    )


def rows_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row counts of a combination."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def experiment_balance(df: DataFrame, masks: Mapping[tuple[str, str], Column], label: str) -> DataFrame:
    """Target balance of overlapping subsets (E35): each row unfolds to the subsets it belongs to."""
    members = F.array_compact(
        F.array(*[F.when(m, F.struct(F.lit(e).alias("experiment"), F.lit(s).alias("split"))) for (e, s), m in masks.items()])
    )
    member = df.select(F.explode(members).alias("m"), F.col(label).alias("y"))
    return member.groupBy("m.experiment", "m.split").agg(
        F.count("*").alias("row_count"), F.sum("y").alias("positive_rows"), F.avg("y").alias("positive_share")
    )


def level_preview(df: DataFrame, columns: Sequence[str], k: int = 100) -> DataFrame:
    """Number of levels and the first k of each column in order (E37); the level sets stay distributed."""
    levels = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "level")
    distinct = levels.where("level is not null").distinct()
    shown = top_per_group(distinct, ["column_name"], [F.col("level").asc()], k)
    listed = shown.groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_list("level")), "|").alias("first_levels"))
    return distinct.groupBy("column_name").agg(F.count("*").alias("levels")).join(listed, "column_name")


def area_coverage(df: DataFrame, area: str, measure: str) -> DataFrame:
    """Rows with and without an area value, positive areas and zero measures as (metric, value) rows."""
    wide = df.agg(
        F.count("*").alias("rows_total"),
        F.count(area).alias("rows_with_area"),
        F.count_if(F.col(area).isNull()).alias("rows_missing_area"),
        F.count_if(F.col(area) > 0).alias("rows_positive_area"),
        F.count_if(F.coalesce(F.col(measure), F.lit(0)) == 0).alias("rows_zero_measure"),
    )
    return wide.unpivot([], wide.columns, "metric", "value")


def raw_schema_report(df: DataFrame, required: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Required columns found or missing plus count, min, max and mean of numeric ones."""
    spark = df.sparkSession
    found = spark.createDataFrame([(c, int(c in df.columns)) for c in required], "column_name string, found int")
    stats = melt(df, [], numeric, "column_name").groupBy("column_name").agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )
    return found.join(stats, "column_name", "full_outer").withColumn("found", F.coalesce("found", F.lit(1)))


def date_ranges(df: DataFrame, columns: Sequence[str] | None = None, formats: Sequence[str] = ()) -> DataFrame:
    """First and last moment and the count of readable values per date column, in one pass.

    By default the known date columns that are there. Text is read as a timestamp as it stands, then by `formats`;
    columns without a readable value are left out, as are names that do not exist.
    """
    names = [c for c in (fv.DATE_COLUMNS if columns is None else columns) if c in df.columns]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, n long, first timestamp_ntz, last timestamp_ntz")
    text = lambda c: F.col(c).cast("string")
    read = lambda c: F.coalesce(text(c).try_cast("timestamp_ntz"), *[F.try_to_timestamp(text(c), F.lit(f)).cast("timestamp_ntz") for f in formats])
    one = df.select(*[read(c).alias(c) for c in names])
    long = one.unpivot([], names, "column_name", "_at").where("_at is not null")
    return long.groupBy("column_name").agg(F.count("*").alias("n"), F.min("_at").alias("first"), F.max("_at").alias("last"))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 20) -> DataFrame:
    """Most frequent values per column."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "level")
    counts = long.groupBy("column_name", "level").agg(F.count("*").alias("n"))
    return top_per_group(counts, ["column_name"], [F.desc("n"), F.col("level").asc()], k)


def score_distribution(scored: DataFrame, scores: Sequence[str], split: str = "split") -> DataFrame:
    """Mean, std, range and quantiles per score column and split."""
    probs = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    return numeric_profile(scored, scores, [split], probs).withColumnRenamed("feature", "score_col")

