"""Order statistics that never put a whole group into one task.

Rows are laid out in ranges of a total order: group, value, tie-breakers, and last a hash of the row. A range may cut
through a group, through tied values and through nulls, so no group, no tie and no crowd of nulls decides how large a
range becomes. Totals of the ranges give every range its offset, and only the inside of a range is windowed. The cuts
are Spark's own (`repartitionByRange`, from a bounded sample); no list of them is held here.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage

ROWS_PER_RANGE = 1_000_000
#: monotonically_increasing_id holds the partition above this bit and the row within it below.
ROW_BITS = 33


def ordered_value(df: DataFrame, value: str) -> Column:
    """The column with NaN as null: neither has a place in an order."""
    return F.nanvl(F.col(value), F.lit(None)) if dict(df.dtypes)[value] in ("double", "float") else F.col(value)


def range_count(df: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> int:
    """Ranges of about `rows_per_range` rows that hold the table: the only number that reaches the driver."""
    return max(1, math.ceil(df.count() / rows_per_range))


def laid_out(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ranges: int) -> DataFrame:
    """Rows written in `ranges` ranges of the order (keys, order, hash of the row), with `_range` and `_row` in it.

    Only rows that agree in every column cannot be told apart and stay in one range; count such rows beforehand.
    """
    kinds = dict(df.dtypes)
    spread = F.xxhash64(*[c for c in df.columns if "map<" not in kinds[c] and kinds[c] != "variant"])
    total = [*[F.col(k).asc_nulls_first() for k in keys], *order, spread]
    sorted_rows = df.repartitionByRange(ranges, *total).sortWithinPartitions(*total)
    return stage(sorted_rows.withColumn("_at", F.monotonically_increasing_id())).select(
        *df.columns,
        F.shiftright("_at", ROW_BITS).cast("int").alias("_range"),
        F.col("_at").bitwiseAND((1 << ROW_BITS) - 1).alias("_row"),
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Mapping[str, str],
    descending: bool = False,
    then: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Inclusive running sums of `measures` (input -> output) per group in the order of `value`.

    `then` breaks ties. Groups are `keys`, possibly none. NaN becomes null; nulls come last in either direction and are
    counted like any row. Data of one range takes the plain window with the same result.
    """
    df = df.withColumn(value, ordered_value(df, value))
    order = [F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last(), *[F.col(t).asc() for t in then]]
    return running_sums(df, keys, order, measures, ranges)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], measures: Mapping[str, str], ranges: int | None = None) -> DataFrame:
    """Inclusive running sums per group in any order; `running_totals` for a numeric value."""
    keys, ranges = list(keys), range_count(df) if ranges is None else ranges
    if ranges <= 1:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(m).over(whole) for m, out in measures.items()})

    ranged = laid_out(df, keys, order, ranges)
    inside = Window.partitionBy("_range", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({out: F.sum(m).over(inside) for m, out in measures.items()})

    # Groups lie one after the other, so a range continues one group of the range before it at most: there is no more
    # than one offset for each range.
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range", *keys).agg(*[F.sum(m).alias(f"_t_{out}") for m, out in measures.items()])
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_range").alias("_k_range"),
        *[F.sum(f"_t_{out}").over(before).alias(f"_o_{out}") for out in measures.values()],
        F.lag("_range").over(Window.partitionBy(*keys).orderBy("_range")).alias("_k_last"),
    )
    offsets = stage(offsets.where("_k_last is not null"))  # its size is then known, so a small one is broadcast and `local` stays where it is
    same = local["_range"] == offsets["_k_range"]
    for k in keys:
        same = same & local[k].eqNullSafe(offsets[f"_k_{k}"])
    joined = local.join(offsets, same, "left")
    helper = ["_range", "_row", "_k_range", "_k_last", *[f"_k_{k}" for k in keys], *[f"_o_{o}" for o in measures.values()]]
    plus = lambda o: F.when(F.col(f"_o_{o}").isNull(), F.col(o)).otherwise(F.coalesce(F.col(o), F.lit(0)) + F.col(f"_o_{o}"))
    return joined.withColumns({o: plus(o) for o in measures.values()}).drop(*helper)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, ranges: int | None = None) -> DataFrame:
    """The place of each row within its group, from 0, in the given order: row_number for groups of any size."""
    counted = running_sums(df.withColumn("_one", F.lit(1).cast("long")), keys, order, {"_one": out}, ranges)
    return counted.withColumn(out, F.col(out) - 1).drop("_one")


#: Even steps between the least and the greatest value, by which a selection is narrowed before anything is ranked.
STEPS = 4096


def step_of(value: Column, low: Column, high: Column, steps: int = STEPS) -> Column:
    """Number of the even step that holds a value: never falls as the value rises, whatever the values are.

    `low` and `high` are the least and greatest finite value; infinite ones get a step of their own at either end,
    and a null has none.
    """
    v, a, b = (c.cast("double") / 2 for c in (value, low, high))  # halves, so that no difference overflows
    inside = F.coalesce(F.try_divide(v - a, b - a), F.lit(0.0))
    step = F.least(F.greatest(F.floor(inside * steps), F.lit(0)), F.lit(steps - 1)).cast("int")
    infinite = F.abs(v) == F.lit(float("inf"))
    return F.when(v.isNull(), F.lit(None)).when(infinite & (v < 0), F.lit(-1)).when(infinite, F.lit(steps)).otherwise(step)


def finite(value: Column) -> Column:
    return F.when(F.abs(value.cast("double")) < F.lit(float("inf")), value)


def histogram(df: DataFrame, keys: Sequence[str], value: str, out: str = "_cnt") -> DataFrame:
    """Distinct values with their counts per group: the pre-aggregated input of all order statistics."""
    return df.withColumn(value, ordered_value(df, value)).where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias(out))


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Histogram written once, so that counting, cutting and ranking it never repeats what lies before."""
    return stage(histogram(df, keys, value))


def summary(hist: DataFrame, keys: Sequence[str], value: str, n: str = "_cnt") -> DataFrame:
    """n, mean, sample std, min and max from a histogram; deviations are taken from the exact mean."""
    keys = list(keys)
    v, w = F.col(value).cast("double"), F.col(n)
    first = hist.groupBy(*keys).agg(
        F.sum(w).alias("n"), (F.sum(v * w) / F.sum(w)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    centre = first.select(*keys, F.col("mean").alias("_mean"))
    spread = attach(hist, centre, keys).groupBy(*keys).agg(F.sum((v - F.col("_mean")) * (v - F.col("_mean")) * w).alias("_ss"))
    joined = attach(first, spread, keys)
    return joined.select(
        *keys, "n", "mean", F.sqrt(F.col("_ss") / F.nullif(F.col("n") - 1, F.lit(0))).alias("std"), "min", "max"
    )


def quantiles_of_histogram(
    hist: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    n: str = "_cnt",
    ranges: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per group and probability (columns prob, quantile).

    A histogram counted to be small goes through the built-in percentile. A larger one is ranked in
    ranges: every row knows which ranks it holds and emits only the few probabilities that fall on it,
    so what is shuffled afterwards is two rows per group and probability.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    ranges = range_count(hist) if ranges is None else ranges
    if ranges <= 1:
        listed = F.array(*[F.lit(p) for p in probs])
        found = hist.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), probs, F.col(n)).alias("_q"))
        pair = F.explode(F.arrays_zip(listed.alias("prob"), F.col("_q").alias("quantile"))).alias("_z")
        return found.select(*keys, pair).select(*keys, F.col("_z.prob"), F.col("_z.quantile")).where(F.col("quantile").isNotNull())
    ranked = running_totals(hist, keys, value, {n: "_hi"}, ranges=ranges)
    ranked = attach(ranked, stage(hist.groupBy(*keys).agg(F.sum(n).alias("_total"))), keys)
    wanted = F.transform(
        F.array(*[F.lit(p) for p in probs]),
        lambda p: F.struct(p.alias("p"), ((F.col("_total") - 1) * p).alias("h")),
    )
    low = F.col("_hi") - F.col(n)
    here = F.filter(
        wanted,
        lambda s: (F.floor(s["h"]) < F.col("_hi")) & (F.least(F.floor(s["h"]) + 1, F.col("_total") - 1) >= low),
    )
    hit = ranked.select(*keys, F.col(value).cast("double").alias("_v"), low.alias("_lo"), "_hi", "_total", F.explode(here).alias("_s"))
    floor_rank = F.floor("_s.h")
    ceil_rank = F.least(floor_rank + 1, F.col("_total") - 1)
    holds = lambda r: (r >= F.col("_lo")) & (r < F.col("_hi"))
    picked = hit.groupBy(*keys, F.col("_s.p").alias("prob")).agg(
        F.max(F.when(holds(floor_rank), F.col("_v"))).alias("_a"),
        F.max(F.when(holds(ceil_rank), F.col("_v"))).alias("_b"),
        F.max(F.col("_s.h") - floor_rank).alias("_w"),
    )
    return picked.select(*keys, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("quantile"))


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of a one-row-per-group table next to the rows of the group, null keys included.

    Without keys the single row comes in as scalar subqueries.
    """
    extra = [c for c in small.columns if c not in keys]
    if not keys:
        return df.withColumns({c: small.select(c).scalar() for c in extra})
    renamed = small.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *extra)
    same = reduce(lambda x, y: x & y, [df[k].eqNullSafe(renamed[f"_g_{k}"]) for k in keys])
    return df.join(renamed, same, "inner").drop(*[f"_g_{k}" for k in keys])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of a column per group (long form)."""
    return quantiles_of_histogram(distribution(df, keys, value), keys, value, probs)


def widen_quantiles(long: DataFrame, keys: Sequence[str], named: Mapping[str, float]) -> DataFrame:
    """Long quantiles as one column per name."""
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(name) for name, p in named.items()]
    )


def profile_of(hist: DataFrame, keys: Sequence[str], value: str, named: Mapping[str, float]) -> DataFrame:
    """Summary and named quantiles of a histogram in one row per group."""
    wide = widen_quantiles(quantiles_of_histogram(hist, keys, value, list(named.values())), keys, named)
    return attach(summary(hist, keys, value), wide, keys)


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Columns to (name, value) rows with one numeric type, so many columns share one job."""
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return casted.unpivot(list(ids), list(columns), name, value)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group (F11). Spark prunes each map task to k rows per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given total order."""
    return top_per_group(df, keys, order, 1, "_first").drop("_first")


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top k, merged from k rows per task."""
    return df.orderBy(*order).limit(k)
