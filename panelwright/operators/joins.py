"""Key contracts, dimension joins, coverage and alignment reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .ordered import top_rows


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("_n"))


def duplicate_key_report(df: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """Rows, unique keys, rows involved in duplicates and surplus rows."""
    n = F.col("_n")
    return key_counts(df, keys).agg(
        F.lit(table).alias("table_name"),
        F.coalesce(F.sum(n), F.lit(0)).alias("row_count"),
        F.count("*").alias("unique_keys"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("duplicate_rows_involved"),
        F.coalesce(F.sum(F.when(n > 1, n - 1)), F.lit(0)).alias("duplicate_extra_rows"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return key_counts(df, keys).where("_n > 1").withColumnRenamed("_n", "copies")


def require_unique(df: DataFrame, keys: Sequence[str], table: str, examples: int = 10) -> DataFrame:
    """Fail with examples when a key repeats (D04); returns the table unchanged."""
    bad = duplicate_keys(df, keys).orderBy(*keys).limit(examples).collect()
    if bad:
        raise ValueError(f"{table}: keys {list(keys)} are not unique, for example {[r.asDict() for r in bad]}")
    return df


def attach_dimensions(
    fact: DataFrame,
    dimensions: Mapping[str, tuple[DataFrame, Sequence[str]]],
    check: bool = True,
) -> DataFrame:
    """Left-join dimensions many-to-one and mark matches with `<name>_present`.

    No join hint: Spark broadcasts a side whose measured size is below its limit and falls back to a
    skew-aware shuffle join otherwise.
    """
    out = fact
    for name, (dim, keys) in dimensions.items():
        if check:
            require_unique(dim, keys, name)
        marked = dim.withColumn(f"{name}_present", F.lit(1))
        out = out.join(marked, list(keys), "left")
    return out


def compare_attribute(left: DataFrame, right: DataFrame, keys: Sequence[str], attribute: str) -> DataFrame:
    """Full outer comparison of one attribute held by two tables."""
    a = left.select(*keys, F.col(attribute).alias("left_value"))
    b = right.select(*keys, F.col(attribute).alias("right_value"))
    return a.join(b, list(keys), "full_outer").withColumn(
        "abs_difference", F.abs(F.col("left_value") - F.col("right_value"))
    )


def merge_attributes(left: DataFrame, right: DataFrame, keys: Sequence[str], attributes: Sequence[str], how: str = "full_outer") -> DataFrame:
    """Outer merge where the left value is preferred."""
    renamed = right.select(*keys, *[F.col(a).alias(f"_r_{a}") for a in attributes if a in right.columns])
    joined = left.join(renamed, list(keys), how)
    picked = [
        (F.coalesce(F.col(a) if a in left.columns else F.lit(None), F.col(f"_r_{a}")) if f"_r_{a}" in joined.columns else F.col(a)).alias(a)
        for a in attributes
    ]
    rest = [c for c in left.columns if c not in keys and c not in attributes]
    return joined.select(*keys, *picked, *rest)


def align_to_universe(universe: DataFrame, table: DataFrame, key: str, zero_columns: Sequence[str]) -> DataFrame:
    """All keys of the universe; counts and sums become 0 where absent, shares stay null."""
    joined = universe.join(table, key, "left")
    return joined.fillna(0, subset=[c for c in zero_columns if c in joined.columns])


def align_scores(left: DataFrame, right: DataFrame, keys: Sequence[str], label: str, scores: Mapping[str, str]) -> DataFrame:
    """Inner join of two score tables on their full key, keeping both labels for the check."""
    l_score, r_score = scores["left"], scores["right"]
    a = left.select(*keys, F.col(label).alias("y_left"), F.col(l_score))
    b = right.select(*keys, F.col(label).alias("y_right"), F.col(r_score))
    return a.join(b, list(keys), "inner")


def alignment_report(left: DataFrame, right: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Row counts on both sides, aligned pairs and label mismatches (D10) as a single row.

    Both sides are counted per key in one aggregation, so each is read once and no pair of rows is made. Labels are 0, 1
    or null.
    """
    side = lambda df, s: df.select(*keys, F.lit(s).alias("_s"), F.col(label).cast("int").alias("_y"))
    own = lambda s, y: F.count_if((F.col("_s") == s) & F.col("_y").eqNullSafe(F.lit(y).cast("int")))
    per_key = side(left, "l").unionByName(side(right, "r")).groupBy(*keys).agg(*[own(s, y).alias(f"{s}{y}") for s in "lr" for y in (0, 1, None)])
    n = {s: F.col(f"{s}0") + F.col(f"{s}1") + F.col(f"{s}None") for s in "lr"}
    known = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(0)) for k in keys], F.lit(1))  # a null key meets none
    pairs, equal = n["l"] * n["r"] * known, (F.col("l0") * F.col("r0") + F.col("l1") * F.col("r1") + F.col("lNone") * F.col("rNone")) * known
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_key.agg(total(n["l"]).alias("left_rows"), total(n["r"]).alias("right_rows"), total(pairs).alias("aligned_rows"), total(pairs - equal).alias("label_mismatches"))


def apply_thresholds(
    scored: DataFrame,
    thresholds: DataFrame,
    keys: Sequence[str],
    score: str,
    fallback: Column,
    out: str = "alert",
) -> DataFrame:
    """Threshold lookup with fallback, then score >= threshold."""
    joined = scored.join(thresholds.select(*keys, "threshold"), list(keys), "left")
    used = F.coalesce(F.col("threshold"), fallback)
    return joined.withColumn("threshold", used).withColumn(out, (F.col(score) >= used).cast("int"))


def merge_coverage(fact: DataFrame, dim: DataFrame, key: str, name: str, examples: int = 20) -> DataFrame:
    """Fact rows without a partner, their distinct keys and the first of them in order."""
    # rows are counted per key first, so a dominating key meets the dimension as a single row
    counts = fact.groupBy(key).agg(F.count("*").alias("_n"))
    per_key = stage(counts.join(dim.select(key).distinct(), key, "left_anti"))
    first = top_rows(per_key.select(key), [F.col(key).asc()], examples)
    listed = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda k: k.cast("string")), ",").alias("e")).scalar()
    return per_key.agg(
        F.lit(name).alias("dimension"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("missing_rows"),
        F.count("*").alias("missing_keys"),
    ).withColumn("first_missing", listed)


def reconcile_counts(metrics: DataFrame, recomputed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True positives implied by precision, recall and positives against recounted ones."""
    joined = metrics.join(recomputed.select(*keys, F.col("tp").alias("tp_counted")), list(keys), "left")
    from_recall = F.col("recall") * F.col("positive_rows")
    from_precision = F.col("precision") * F.col("predicted_positive_rows")
    return joined.withColumns(
        {
            "tp_from_recall": from_recall,
            "tp_from_precision": from_precision,
            "recall_error": F.abs(from_recall - F.col("tp_counted")),
            "precision_error": F.abs(from_precision - F.col("tp_counted")),
        }
    )


def same_row_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row-count preservation as one row (Q06)."""
    a = before.agg(F.count("*").alias("n")).scalar()
    return after.agg(F.count("*").alias("rows_after")).select(
        a.alias("rows_before"), "rows_after", (a == F.col("rows_after")).cast("int").alias("row_count_preserved")
    )


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name, columns missing in a part become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
