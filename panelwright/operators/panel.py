"""Weekly counts, densification and panel checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import week_start
from ..functions.classify import with_request_category
from ..session import stage
from .ordered import top_rows

SERIES = ["area", "category"]
CELL = ["area", "week_start", "category"]


def weekly_counts(requests: DataFrame, ts: str = "ts", keys: Sequence[str] = ("area", "category"), out: str = "n") -> DataFrame:
    """Requests per area, Monday week and category (E01). Partial sums leave the map side, not rows."""
    a, c = keys
    return requests.groupBy(a, week_start(F.col(ts)).alias("week_start"), c).agg(F.count("*").alias(out))


def weekly_counts_by_rules(requests: DataFrame, ts: str = "ts", type_col: str = "request_type") -> DataFrame:
    """E01 with rule categories: counts are reduced per raw type first, so rules see few rows."""
    raw = requests.groupBy("area", week_start(F.col(ts)).alias("week_start"), type_col).agg(F.count("*").alias("_n"))
    # the count takes part in the type: a later filter on the category then stays above the aggregation
    raw = raw.withColumn(type_col, F.when(F.col("_n") > 0, F.col(type_col)))
    return (
        with_request_category(raw, type_col)
        .groupBy(*CELL)
        .agg(F.sum("_n").alias("n"))
    )


def type_category_counts(requests: DataFrame, type_col: str, missing: str | None = None) -> DataFrame:
    """(type, category) counts, largest first (E02); null types are dropped or shown as `missing`."""
    t = F.col(type_col) if missing is None else F.coalesce(F.col(type_col), F.lit(missing))
    counted = requests.select(t.alias("request_type")).where(F.col("request_type").isNotNull()).groupBy("request_type").agg(F.count("*").alias("n"))
    return with_request_category(stage(counted), "request_type").orderBy(F.desc("n"), "request_type")


def category_shares(counts: DataFrame, domain: Sequence[str], category: str = "category", n: str = "n") -> DataFrame:
    """Totals and shares over a fixed category domain, absent ones as 0."""
    spark = counts.sparkSession
    fixed = spark.createDataFrame([(i, c) for i, c in enumerate(domain)], "ord int, category string")
    totals = counts.groupBy(F.col(category).alias("category")).agg(F.sum(n).alias("total"))
    joined = fixed.join(totals, "category", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    everything = F.sum("total").over(Window.partitionBy())
    return joined.select("category", "total", (F.col("total") / F.nullif(everything, F.lit(0))).alias("share"))


def top_unclassified(type_counts: DataFrame, k: int = 200, other: str = "other") -> DataFrame:
    """Most frequent types that fell through all rules."""
    return top_rows(type_counts.where(F.col("category") == other), [F.desc("n"), F.asc("request_type")], k)


def representative(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], order: Sequence[str], last: bool = True) -> DataFrame:
    """Last (or first) non-blank value per key in a unique order, independent of file order."""
    pick = F.max_by if last else F.min_by
    made = []
    for a in attributes:
        v = F.nullif(F.trim(F.col(a).cast("string")), F.lit(""))
        key = F.when(v.isNotNull(), F.struct(*order))
        made.append(pick(v, key).alias(a))
    return df.groupBy(*keys).agg(*made)


def most_common(df: DataFrame, keys: Sequence[str], attribute: str) -> DataFrame:
    """Mode per key, smallest value on ties (E05); counts are reduced before the choice."""
    counts = df.where(F.col(attribute).isNotNull()).groupBy(*keys, attribute).agg(F.count("*").alias("_n"))
    best = F.min_by(F.col(attribute), F.struct(-F.col("_n"), F.col(attribute)))
    return counts.groupBy(*keys).agg(best.alias(attribute))


def collapse_duplicates(panel: DataFrame, keys: Sequence[str] = tuple(CELL), count: str = "n", attributes: Sequence[str] = ()) -> DataFrame:
    """One row per cell: counts added, first non-null attribute by value."""
    return panel.groupBy(*keys).agg(F.sum(count).alias(count), *[F.min(a).alias(a) for a in attributes])


def week_axis(df: DataFrame, week: str = "week_start") -> Column:
    """Every Monday from the first to the last week as an array expression.

    Both bounds are scalar subqueries over the weekly table, so nothing is collected or cross joined.
    """
    lo = df.agg(F.min(week).alias("lo")).scalar()
    hi = df.agg(F.max(week).alias("hi")).scalar()
    return F.sequence(lo, hi, F.expr("interval 7 days"))


def densify(
    observed: DataFrame,
    areas: DataFrame,
    categories: Sequence[str],
    count: str = "n",
    weeks: DataFrame | None = None,
    ledger: Observation | None = None,
) -> DataFrame:
    """Areas x weeks x categories with zero-filled counts.

    The observed counts are written once, so that the bounds of the week axis and the cells come from one pass over the
    requests; `weeks` is another table whose week_start bounds the axis.

    Every area row unfolds its own cells with count 0, which are added to the observed counts cell by
    cell. Both are laid out by series once; the sum per cell and all later windows over a series then
    need no further exchange. A series has one row per week, so no partition can grow without bound.

    Counts of other areas, categories or weeks have no cell. `ledger` gets them: grid_cells, grid_count, off_grid_cells
    and off_grid_count, known when the panel has been computed.
    """
    observed = stage(observed.select(*CELL, F.col(count).cast("long").alias(count)))
    grid = areas.select("area").distinct().withColumn("week_start", F.explode(week_axis(observed if weeks is None else weeks)))
    grid = grid.withColumn("category", F.explode(F.array(*[F.lit(c) for c in categories])))
    zeros = grid.select(*CELL, F.lit(0).cast("long").alias(count), F.lit(1).alias("_in_grid"))
    cells = zeros.unionByName(observed.withColumn("_in_grid", F.lit(0))).repartition(*SERIES).groupBy(*SERIES, "week_start")
    summed = cells.agg(F.sum(count).alias(count), F.max("_in_grid").alias("_in_grid"))
    if ledger is not None:
        off = F.col("_in_grid") == 0
        added = lambda where: F.coalesce(F.sum(F.when(where, F.col(count))), F.lit(0))
        summed = summed.observe(
            ledger, F.count_if(~off).alias("grid_cells"), added(~off).alias("grid_count"), F.count_if(off).alias("off_grid_cells"), added(off).alias("off_grid_count")
        )
    return summed.where("_in_grid = 1").select(*CELL, count)


def densify_weeks(weekly: DataFrame, zero_columns: Sequence[str], week: str = "week_start") -> DataFrame:
    """All weeks between first and last; measures stay null, coverage counts become 0."""
    axis = weekly.sparkSession.range(1).select(F.explode(week_axis(weekly, week)).alias(week))
    return axis.join(weekly, week, "left").fillna(0, subset=list(zero_columns))


def panel_summary(panel: DataFrame, count: str = "n") -> DataFrame:
    """Rows, total, distinct keys, week bounds, expected against actual cells."""
    s = panel.agg(
        F.count("*").alias("row_count"),
        F.sum(count).alias("total_count"),
        F.count_distinct("area").alias("areas"),
        F.count_distinct("category").alias("categories"),
        F.count_distinct("week_start").alias("weeks"),
        F.min("week_start").alias("min_week"),
        F.max("week_start").alias("max_week"),
    )
    expected_weeks = (F.date_diff("max_week", "min_week") / 7 + 1).cast("long")
    return s.withColumn("expected_cells", F.col("areas") * F.col("categories") * expected_weeks).withColumn(
        "missing_cells", F.col("expected_cells") - F.col("row_count")
    )


def find_gaps(panel: DataFrame, series: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """Consecutive weeks of a series that are not seven days apart."""
    w = Window.partitionBy(*series).orderBy("week_start")
    return (
        panel.select(*series, F.lag("week_start").over(w).alias("previous_week"), "week_start")
        .withColumn("gap_days", F.date_diff("week_start", "previous_week"))
        .where(F.col("gap_days") != 7)
    )


def integrity_report(panel: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Negative, fractional and missing counts and missing keys in one pass."""
    c = F.col(count).cast("double")
    return panel.agg(
        F.count("*").alias("row_count"),
        F.count_if(c < 0).alias("negative_counts"),
        F.count_if(c != F.floor(c)).alias("fractional_counts"),
        F.count_if(c.isNull()).alias("missing_counts"),
        *[F.count_if(F.col(k).isNull()).alias(f"missing_{k}") for k in keys],
    )


def require_integrity(panel: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Raise on any violation of `integrity_report`; returns the panel unchanged."""
    report = integrity_report(panel, keys, count).first().asDict()
    bad = {k: v for k, v in report.items() if k != "row_count" and v}
    if bad:
        raise ValueError(f"panel integrity violated: {bad}")
    return panel
