"""Column expressions for cleaning: casts, filters, normal forms, safe ratios."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv


def to_number(c: Column) -> Column:
    """Tolerant numeric cast: anything that is no number becomes null."""
    return finite(c.try_cast("double"))


def to_timestamp_any(c: Column, formats: Sequence[str]) -> Column:
    """First format that parses wins, null when none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def in_box(lat: Column, lon: Column, box: Mapping[str, float]) -> Column:
    """True when both coordinates exist and lie in the closed box."""
    inside = lat.between(box["south"], box["north"]) & lon.between(box["west"], box["east"])
    return F.coalesce(inside, F.lit(False))


def box_flag(lat: Column, lon: Column, box: Mapping[str, float]) -> Column:
    """1/0 flag of `in_box`; rows are kept by the caller."""
    return in_box(lat, lon, box).cast("int")


def in_date_range(ts: Column, start: str, end: str) -> Column:
    """From start through the whole end day (B05), as a half-open predicate that can be pushed down."""
    return (ts >= F.lit(start).cast("date")) & (ts < F.date_add(F.lit(end).cast("date"), 1))


def clean_key(c: Column, words: Iterable[str] = tuple(fv.MISSING_KEY_WORDS)) -> Column:
    """Trimmed key, null for blanks and spelled-out missing values."""
    t = F.trim(c.cast("string"))
    return F.when(~t.isin(list(words)), t)


def mask_sentinels(c: Column, limit: float = fv.SENTINEL_LIMIT) -> Column:
    """Placeholders far outside the physical range become null."""
    n = to_number(c)
    return F.when(F.abs(n) < limit, n)


def flag(c: Column) -> Column:
    """Nullable 0/1 from words such as yes/no, t/f, 1/0."""
    w = F.lower(F.trim(c.cast("string")))
    return F.when(w.isin(fv.TRUE_WORDS), 1).when(w.isin(fv.FALSE_WORDS), 0)


def flag_or_zero(c: Column) -> Column:
    return F.coalesce(flag(c), F.lit(0))


def normal_text(c: Column) -> Column:
    """Lower case, `&` as the word and, plain hyphens, single blanks; null as '' (B09)."""
    steps = [
        (r"(?U)^\s+|\s+$", ""),
        ("&", " and "),
        ("[‐-―]", "-"),
        (r"(?U)\s+", " "),
    ]
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, F.lower(F.coalesce(c, F.lit(""))))


def token(c: Column) -> Column:
    """snake_case token of a free value, null for missing words."""
    t = F.regexp_replace(F.regexp_replace(F.lower(c.cast("string")), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(~t.isin(fv.MISSING_TOKEN_WORDS), t)


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def ratio(num: Column, den: Column) -> Column:
    """Null when the denominator is 0 or null (B15, land-use and momentum convention)."""
    return num / F.nullif(den, F.lit(0).cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """0 when the denominator is 0 or null (B15, point-of-interest convention)."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def drop_missing_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Normalise the keys and keep only rows where all of them are present."""
    cleaned = df.withColumns({k: clean_key(F.col(k)) for k in keys})
    return cleaned.dropna(subset=list(keys))


def missing_key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows kept and dropped by `drop_missing_keys`, one pass."""
    ok = reduce(lambda a, b: a & b, [clean_key(F.col(k)).isNotNull() for k in keys])
    return df.agg(
        F.count("*").alias("rows_read"),
        F.count_if(ok).alias("rows_kept"),
        F.count_if(~ok).alias("rows_dropped"),
    )


def landuse_code(c: Column) -> Column:
    """'1', '01', '1.0', '01 Family' -> '01'; null and blank -> 'unknown' (B14)."""
    s = F.trim(c.cast("string"))
    single = F.regexp_replace(s, r"(?s)^0*(\d)(?!\d).*$", "0$1")
    code = F.regexp_replace(single, r"(?s)^(\d+).*$", "$1")
    return F.coalesce(F.nullif(code, F.lit("")), F.lit("unknown"))


def plain_landuse_code(c: Column) -> Column:
    """Whole number text of a land-use code; texts without one (words, 'nan', infinite or huge numbers) unchanged."""
    s = F.trim(c.cast("string"))
    n = s.try_cast("double").try_cast("long")
    return F.when(s.isNull(), None).otherwise(F.coalesce(n.cast("string"), s))


def borough_name(c: Column) -> Column:
    """Codes and abbreviations to names; other values in title case; null -> unknown."""
    key = F.upper(F.trim(c.cast("string")))
    known = lookup(key, fv.BOROUGH_NAMES)
    return F.when(c.isNull(), F.lit("unknown")).otherwise(F.coalesce(known, F.initcap(F.lower(key))))


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """Small literal map lookup, null where the key is unknown."""
    m = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.element_at(m, key)


def parcel_ratios(df: DataFrame) -> DataFrame:
    """Row-wise area ratios of a parcel."""
    pairs = {
        "building_to_lot_area_ratio": ("bldgarea", "lotarea"),
        "residential_area_ratio": ("resarea", "bldgarea"),
        "commercial_area_ratio": ("comarea", "bldgarea"),
        "office_area_ratio": ("officearea", "bldgarea"),
        "retail_area_ratio": ("retailarea", "bldgarea"),
    }
    made = {
        name: ratio(to_number(F.col(a)), to_number(F.col(b)))
        for name, (a, b) in pairs.items()
        if a in df.columns and b in df.columns
    }
    return df.withColumns(made)
