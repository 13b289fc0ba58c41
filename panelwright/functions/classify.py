"""Ordered rule classification as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import fixed_values as fv
from .cleaning import landuse_code, lookup, normal_text, plain_landuse_code, token


def found(text: Column, pattern: str) -> Column:
    """Pattern found anywhere in the text; literal alternatives become substring searches, which are far cheaper."""
    body = pattern[3:-1] if pattern.startswith("(?:") and pattern.endswith(")") else pattern
    if re.search(r"[(\[]", body):
        return text.rlike(pattern)
    parts = body.split("|")
    plain = [p for p in parts if re.fullmatch(r"[\w \-]+", p)]
    rest = [p for p in parts if p not in plain]
    checks = [text.contains(p) for p in plain] + ([text.rlike("|".join(rest))] if rest else [])
    return reduce(lambda a, b: a | b, checks)


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Name of the first pattern found anywhere in the text."""
    out = F
    for name, pattern in rules:
        out = out.when(found(text, pattern), F.lit(name))
    return out.otherwise(F.lit(default))


def _normal_name(name: str) -> str:
    return " ".join(name.strip().lower().replace("&", " and ").split())


def exact_names(names: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Category -> normalised names, each name only under the last category that lists it."""
    owner = {_normal_name(n): cat for cat, group in names.items() for n in group}
    return {cat: [n for n, c in owner.items() if c == cat] for cat in names}


def request_category(
    request_type: Column,
    names: Mapping[str, Sequence[str]] = fv.TYPE_NAMES,
    patterns: Sequence[tuple[str, str]] = tuple(fv.TYPE_PATTERNS),
    default: str = "other",
) -> Column:
    """Exact name first, then ordered patterns, else the default.

    The name lists become hashed IN sets, so the usual row costs a few hash probes and no regex.
    """
    return category_of_text(normal_text(request_type), names, patterns, default)


def category_of_text(
    text: Column,
    names: Mapping[str, Sequence[str]] = fv.TYPE_NAMES,
    patterns: Sequence[tuple[str, str]] = tuple(fv.TYPE_PATTERNS),
    default: str = "other",
) -> Column:
    """C01 on text that is normal already."""
    out = F.when(text == "", F.lit(default))
    for cat, group in exact_names(names).items():
        out = out.when(text.isin(group), F.lit(cat))
    return out.otherwise(first_match(text, patterns, default))


def request_category_wordwise(
    request_type: Column,
    descriptor: Column,
    patterns: Sequence[tuple[str, str]] = tuple(fv.TYPE_DESCRIPTOR_PATTERNS),
) -> Column:
    """Word-bounded patterns over type and descriptor."""
    text = F.lower(F.concat_ws(" ", F.coalesce(request_type, F.lit("")), F.coalesce(descriptor, F.lit(""))))
    return first_match(text, patterns, "other")


def with_request_category(df: DataFrame, type_col: str, out: str = "category") -> DataFrame:
    """C01 per row, normalising once: the rules refer to the text many times, which a single expression would repeat."""
    return df.withColumn("_text", normal_text(F.col(type_col))).withColumn(out, category_of_text(F.col("_text"))).drop("_text")


def on_distinct(df: DataFrame, columns: Sequence[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply `derive` to the distinct combinations of some columns and join the new columns back.

    The combinations are written once, so Spark knows their size and chooses the join by it: few are sent to every task,
    many meet their rows in a shuffle, where a dominating one is split. Reading them back also keeps a later filter on
    the derived columns from moving below the distinct step, where it would be evaluated for every row after all.
    """
    known = derive(stage(df.select(*columns).distinct())).withColumnsRenamed({c: f"_d_{c}" for c in columns})
    same = reduce(lambda x, y: x & y, [df[c].eqNullSafe(known[f"_d_{c}"]) for c in columns])
    return df.join(known, same, "left").drop(*[f"_d_{c}" for c in columns])


def classify_types(df: DataFrame, type_col: str, out: str = "category") -> DataFrame:
    """C01 for long tables: each distinct type is classified once."""
    return on_distinct(df, [type_col], lambda d: with_request_category(d, type_col, out))


def classify_poi(df: DataFrame, tags: Sequence[str], category: str = "poi_category", raw_type: str | None = "raw_type") -> DataFrame:
    """C03 and C04 for long tables: each distinct combination of tags is classified once."""
    return on_distinct(df, tags, lambda d: with_poi_category(d, tags, category, raw_type))


def tag_text(columns: Sequence[Column]) -> Column:
    """Normalised tag values joined by blanks, missing ones left out."""
    return F.concat_ws(" ", *[token(c) for c in columns])


def poi_category(columns: Sequence[Column], rules: Sequence[tuple[str, str]] = tuple(fv.POI_PATTERNS)) -> Column:
    return first_match(tag_text(columns), rules, "other")


def with_poi_category(df: DataFrame, tags: Sequence[str], category: str = "poi_category", raw_type: str | None = "raw_type") -> DataFrame:
    """C03 and C04 for a table, each tag normalised once."""
    normal = {f"_tag_{c}": token(F.col(c)) for c in tags}
    step = df.withColumns(normal).withColumn("_tags", F.concat_ws(" ", *normal))
    made = {category: first_match(F.col("_tags"), fv.POI_PATTERNS, "other")}
    if raw_type:
        made[raw_type] = F.coalesce(*[F.col(c) for c in normal])
    return step.withColumns(made).drop("_tags", *normal)


def first_tag(columns: Sequence[Column]) -> Column:
    """First non-null normalised tag in column order."""
    return F.coalesce(*[token(c) for c in columns])


def poi_group(value: Column, groups: Sequence[tuple[str, Sequence[str]]] = tuple(fv.POI_VALUE_SETS)) -> Column:
    """Exact value sets; null -> unknown, no set -> other."""
    v = F.lower(value)
    out = F.when(value.isNull(), F.lit("unknown"))
    for name, members in groups:
        out = out.when(v.isin(list(members)), F.lit(name))
    return out.otherwise(F.lit("other"))


def landuse_category(c: Column) -> Column:
    return F.coalesce(lookup(landuse_code(c), fv.LANDUSE_CATEGORY), F.lit("unknown"))


def parcel_type(c: Column) -> Column:
    """Eleven land-use types, unknown by default."""
    return F.coalesce(lookup(plain_landuse_code(c), fv.PARCEL_TYPE), F.lit("unknown"))


def parcel_group(c: Column) -> Column:
    """Nine coarse land-use groups, unknown by default."""
    return F.coalesce(lookup(plain_landuse_code(c), fv.PARCEL_GROUP), F.lit("unknown"))


def display_label(code: Column, labels: Mapping[str, str] = fv.CATEGORY_LABELS) -> Column:
    """Label of a code, the code itself when there is none."""
    return F.coalesce(lookup(code, labels), code)
