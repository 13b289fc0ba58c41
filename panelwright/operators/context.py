"""Area context from points of interest and parcels."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fv
from ..functions.classify import display_label
from ..functions.cleaning import ratio, ratio_or_zero, to_number
from ..session import stage
from .joins import align_to_universe
from .ordered import distribution, melt, profile_of, top_rows


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


# ---- points of interest ----------------------------------------------------------------


def poi_totals(poi: DataFrame, key: str, named: Column, tagged: Column, located: Column) -> DataFrame:
    """Points, named, tagged and located points per area."""
    return poi.groupBy(key).agg(
        F.count("*").alias("poi_total_count"),
        F.count_if(named).alias("poi_named_count"),
        F.count_if(tagged).alias("poi_tagged_count"),
        F.count_if(located).alias("poi_located_count"),
    )


def category_counts(df: DataFrame, key: str, category: str, domain: Sequence[str], pattern: str) -> DataFrame:
    """One count column per category of a fixed domain (E14), spread from (key, category) counts."""
    cells = df.groupBy(key, F.col(category).alias("_c")).agg(F.count("*").alias("_n"))
    return cells.groupBy(key).agg(*[_spread("_n", c).alias(pattern.format(c)) for c in domain])


def _spread(measure: str, category: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("_c") == category, F.col(measure))), F.lit(0))


def tag_family_counts(poi: DataFrame, key: str, families: Sequence[str]) -> DataFrame:
    """Rows per area and tag family; a row counts in every family it carries."""
    present = poi.groupBy(key).agg(*[F.count(f).alias(f) for f in families])
    return present.unpivot([key], list(families), "tag_family", "n").where("n > 0")


def tag_family_shares(poi: DataFrame, families: Sequence[str]) -> DataFrame:
    """City-wide family counts and shares of all rows."""
    counts = poi.agg(F.count("*").alias("_all"), *[F.count(f).alias(f) for f in families])
    long = counts.unpivot(["_all"], list(families), "tag_family", "n")
    return long.select("tag_family", "n", (F.col("n") / F.nullif(F.col("_all"), F.lit(0))).alias("share"))


def raw_type_richness(poi: DataFrame, key: str, raw_type: str) -> DataFrame:
    """Distinct raw types per area."""
    return poi.groupBy(key).agg(F.count_distinct(raw_type).alias("unique_raw_types"))


def top_raw_types(poi: DataFrame, raw_type: str, k: int = 200) -> DataFrame:
    """City-wide most frequent raw types with their share of all typed rows."""
    counts = poi.where(F.col(raw_type).isNotNull()).groupBy(F.col(raw_type).alias("raw_type")).agg(F.count("*").alias("n"))
    counts = stage(counts)
    everything = counts.agg(F.sum("n").alias("t")).scalar()
    return top_rows(counts.withColumn("share", F.col("n") / everything), [F.desc("n"), F.asc("raw_type")], k)


def add_group_sums(df: DataFrame, groups: Mapping[str, Sequence[str]], source: str, target: str) -> DataFrame:
    """Composite groups as sums of member columns."""
    return df.withColumns({target.format(g): total([F.col(source.format(m)) for m in members]) for g, members in groups.items()})


def add_densities(df: DataFrame, columns: Sequence[str], area: str = "area_km2", zero: bool = False, suffix: str = "_density_per_km2") -> DataFrame:
    """Columns per square kilometre."""
    div = ratio_or_zero if zero else ratio
    return df.withColumns({f"{c}{suffix}": div(F.col(c).cast("double"), F.col(area)) for c in columns})


def diversity(counts: Sequence[Column]) -> dict[str, Column]:
    """Shannon entropy, its share of ln k, HHI, and richness of a composition (E24); all 0 for no rows.

    Written over one array of counts, as ln t - sum(c ln c) / t and sum(c * c) / t^2: repeating every
    share as its own expression would exceed the size limit of generated code.
    """
    arr = F.array(*[c.cast("double") for c in counts])
    fold = lambda f: F.aggregate(arr, F.lit(0.0), lambda s, c: s + f(c))
    t = fold(lambda c: c)
    entropy = F.when(t > 0, F.log(t) - fold(lambda c: F.when(c > 0, c * F.log(c)).otherwise(0.0)) / t).otherwise(0.0)
    top = math.log(len(counts)) if len(counts) > 1 else 1.0
    return {
        "entropy": entropy,
        "entropy_norm": entropy / top,
        "hhi": F.when(t > 0, fold(lambda c: c * c) / (t * t)).otherwise(0.0),
        "richness": F.size(F.filter(arr, lambda c: c > 0)),
    }


def mixed_use(hhi: Column, rows: Column, empty: float) -> Column:
    """1 - HHI; areas without rows get `empty` (0 for points of interest, 1 for land use)."""
    return F.when(rows > 0, 1 - hhi).otherwise(F.lit(float(empty)))


def dominant(counts: Sequence[Column], names: Sequence[str]) -> tuple[Column, Column]:
    """Largest category, first in the declared order on ties, with its share; null when all are 0."""
    arr = F.array(*counts)
    best = F.array_max(arr)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(arr, best).cast("int"))
    return F.when(best > 0, name), F.when(best > 0, best / total(counts))


def poi_features(
    poi: DataFrame,
    areas: DataFrame,
    key: str = "area",
    category: str = "poi_category",
    domain: Sequence[str] = tuple(fv.POI_CATEGORIES),
    groups: Mapping[str, Sequence[str]] = fv.POI_GROUPS,
) -> DataFrame:
    """All point-of-interest features per area of the reference universe.

    `areas` brings the key and area_km2. Rows are first counted per area, category and raw type, which
    is all the features need; distinct types and category columns then come from that small table.
    """
    pattern = "poi_{}_count"
    cells = poi.groupBy(key, F.col(category).alias("_c"), "raw_type").agg(F.count("*").alias("_n"), F.count("name").alias("_named"))
    n = F.col("_n")
    count_where = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    base = cells.groupBy(key).agg(
        F.sum(n).alias("poi_total_count"),
        F.sum("_named").alias("poi_named_count"),
        count_where(F.col("raw_type").isNotNull()).alias("poi_tagged_count"),
        F.count_distinct("raw_type").alias("poi_unique_raw_type_count"),
        *[count_where(F.col("_c") == c).alias(pattern.format(c)) for c in domain],
    )
    counts = [c for c in base.columns if c != key]
    out = align_to_universe(areas, base, key, counts)
    all_rows = F.col("poi_total_count").cast("double")
    cat = [F.col(pattern.format(c)) for c in domain]
    d = diversity(cat)
    best, best_share = dominant(cat, domain)
    out = add_group_sums(out, groups, pattern, "poi_group_{}_count")
    out = out.withColumns(
        {
            "poi_entropy": d["entropy"],
            "poi_hhi": d["hhi"],
            **{f"poi_{c}_share": ratio_or_zero(F.col(pattern.format(c)).cast("double"), all_rows) for c in domain},
            **{f"poi_group_{g}_share": ratio_or_zero(F.col(f"poi_group_{g}_count").cast("double"), all_rows) for g in groups},
            "poi_named_share": ratio_or_zero(F.col("poi_named_count").cast("double"), all_rows),
            "poi_tagged_share": ratio_or_zero(F.col("poi_tagged_count").cast("double"), all_rows),
            "poi_log1p_total_count": F.log1p(all_rows),
            "poi_density_per_km2": ratio_or_zero(all_rows, F.col("area_km2")),
            "poi_entropy_norm": d["entropy_norm"],
            "poi_richness": d["richness"],
            "poi_mixed_use_index": mixed_use(d["hhi"], all_rows, 0.0),
            "poi_dominant_category": best,
            "poi_dominant_share": F.coalesce(best_share, F.lit(0.0)),
        }
    )
    return out.withColumn("poi_log1p_density_per_km2", F.log1p("poi_density_per_km2"))


# ---- parcels ---------------------------------------------------------------------------


def valid_year(c: Column, latest: int) -> Column:
    return F.coalesce(c.between(1600, latest), F.lit(False))


ERAS = [("built_pre_1940", 0, 1939), ("built_1940_1979", 1940, 1979), ("built_1980_1999", 1980, 1999), ("built_2000_plus", 2000, 9999)]


def sum_columns(parcels: DataFrame, sums: Mapping[str, str] = fv.PARCEL_SUMS) -> list[Column]:
    """Sums which stay null when nothing was recorded."""
    return [F.sum(to_number(F.col(c))).alias(n) for c, n in sums.items() if c in parcels.columns]


def unique_ids(df: DataFrame, key: str, ids: str, out: str) -> DataFrame:
    """Distinct ids per key. Kept apart from other aggregates: together they would shuffle every row with all its sums."""
    return df.select(key, ids).distinct().groupBy(key).agg(F.count(ids).alias(out))


def parcel_sums(parcels: DataFrame, key: str, sums: Mapping[str, str] = fv.PARCEL_SUMS) -> DataFrame:
    """Parcels, distinct ids and sums per area."""
    base = parcels.groupBy(key).agg(F.count("*").alias("parcel_count"), *sum_columns(parcels, sums))
    return base.join(unique_ids(parcels, key, "bbl", "unique_bbl_count"), key, "left")


def parcel_statistics(parcels: DataFrame, key: str, measures: Mapping[str, str] = fv.PARCEL_STATS) -> DataFrame:
    """Mean, exact median and maximum of several measures.

    All measures share one long table; medians come from value histograms, so a dominating area
    never has to fit into one task.
    """
    used = {c: n for c, n in measures.items() if c in parcels.columns}
    long = melt(parcels.select(key, *[to_number(F.col(c)).alias(n) for c, n in used.items()]), [key], list(used.values()), "measure")
    joined = profile_of(distribution(long, [key, "measure"], "value"), [key, "measure"], "value", {"median": 0.5})
    pick = lambda n, s: F.max(F.when(F.col("measure") == n, F.col(s))).alias(f"{n}_{s}")
    return joined.groupBy(key).agg(*[pick(n, s) for n in used.values() for s in ("mean", "median", "max")])


def age_columns(year: str, reference_year: int) -> list[Column]:
    """Summed age, valid-year count and construction-era counts, all of which add up over parts."""
    y = to_number(F.col(year))
    ok = valid_year(y, reference_year)
    return [
        F.sum(F.when(ok, reference_year - y)).alias("building_age_sum"),
        F.count_if(ok).alias("yearbuilt_valid_count"),
        *[F.count_if(ok & y.between(lo, hi)).alias(f"{name}_count") for name, lo, hi in ERAS],
    ]


def building_age(parcels: DataFrame, key: str, year: str, reference_year: int) -> DataFrame:
    """Mean age, valid years and eras per area."""
    base = parcels.groupBy(key).agg(*age_columns(year, reference_year))
    return base.withColumn("building_age_mean", ratio(F.col("building_age_sum"), F.col("yearbuilt_valid_count").cast("double")))


def landuse_pivot(parcels: DataFrame, key: str, category: str, domain: Sequence[str] = tuple(fv.LANDUSE_CATEGORIES)) -> DataFrame:
    """Parcel counts and lot-area sums per land-use category (E20); sums are 0 where nothing matches."""
    cells = parcels.groupBy(key, F.col(category).alias("_c")).agg(
        F.count("*").alias("parcel_count"), F.sum(to_number(F.col("lotarea"))).alias("lot_area_sqft_sum")
    )
    return cells.groupBy(key).agg(*_landuse_columns(domain))


def _landuse_columns(domain: Sequence[str]) -> list[Column]:
    out = []
    for c in domain:
        out.append(_spread("parcel_count", c).alias(f"landuse_{c}_parcel_count"))
        out.append(_spread("lot_area_sqft_sum", c).cast("double").alias(f"landuse_{c}_lot_area"))
    return out


def parcel_features(
    parcels: DataFrame,
    areas: DataFrame,
    key: str = "area",
    category: str = "landuse_category",
    reference_year: int = 2026,
    domain: Sequence[str] = tuple(fv.LANDUSE_CATEGORIES),
    groups: Mapping[str, Sequence[str]] = fv.LANDUSE_GROUPS,
) -> DataFrame:
    """All land-use features per area.

    Parcels are summed per area and category once; area totals and category columns come from that
    small table, medians from value histograms, distinct ids from a narrow pass of their own.
    """
    cells = parcels.groupBy(key, F.col(category).alias("_c")).agg(
        F.count("*").alias("parcel_count"), *sum_columns(parcels), *age_columns("yearbuilt", reference_year)
    )
    added = [c for c in cells.columns if c not in (key, "_c")]
    base = cells.groupBy(key).agg(*_landuse_columns(domain), *[F.sum(c).alias(c) for c in added])
    base = base.join(unique_ids(parcels, key, "bbl", "unique_bbl_count"), key, "left")
    stats = parcel_statistics(parcels, key)
    wide = base.join(stats, key, "left")
    wide = add_group_sums(wide, groups, "landuse_{}_parcel_count", "group_{}_parcel_count")
    wide = add_group_sums(wide, groups, "landuse_{}_lot_area", "group_{}_lot_area")
    n, lot = F.col("parcel_count").cast("double"), F.col("lot_area_sqft_sum")
    cat = [F.col(f"landuse_{c}_parcel_count") for c in domain]
    d = diversity(cat)
    best, best_share = dominant(cat, domain)
    made: dict[str, Column] = {
        "building_age_mean": ratio(F.col("building_age_sum"), F.col("yearbuilt_valid_count").cast("double")),
        "yearbuilt_invalid_share": 1 - ratio(F.col("yearbuilt_valid_count").cast("double"), n),
        "landuse_entropy": d["entropy"],
        "landuse_entropy_norm": d["entropy_norm"],
        "landuse_hhi": d["hhi"],
        "landuse_mixed_use_index": mixed_use(d["hhi"], n, 1.0),
        "dominant_landuse": best,
        "dominant_landuse_share": best_share,
        "dominant_landuse_label": display_label(best, fv.LANDUSE_LABELS),
    }
    for name, _, _ in ERAS:
        made[f"{name}_share"] = ratio(F.col(f"{name}_count").cast("double"), n)
    for prefix, names in (("landuse", domain), ("group", list(groups))):
        for c in names:
            made[f"{prefix}_{c}_parcel_share"] = ratio(F.col(f"{prefix}_{c}_parcel_count").cast("double"), n)
            made[f"{prefix}_{c}_lot_area_share"] = ratio(F.col(f"{prefix}_{c}_lot_area"), lot)
    made.update(composition_ratios(wide.columns))
    wide = wide.withColumns(made)
    zero = [c for c in wide.columns if c.endswith(("_count", "_sum", "_lot_area"))]
    out = align_to_universe(areas, wide, key, zero)
    dense = [c for c in ["parcel_count", "building_count_sum", "total_units_sum", "building_area_sqft_sum"] if c in out.columns]
    return add_densities(out, dense)


def composition_ratios(columns: Sequence[str]) -> dict[str, Column]:
    """Floor-area ratio and the shares of floor area and units."""
    pairs = {
        "observed_built_far": ("building_area_sqft_sum", "lot_area_sqft_sum"),
        "commercial_area_share": ("commercial_area_sqft_sum", "building_area_sqft_sum"),
        "residential_area_share": ("residential_area_sqft_sum", "building_area_sqft_sum"),
        "office_area_share": ("office_area_sqft_sum", "building_area_sqft_sum"),
        "retail_area_share": ("retail_area_sqft_sum", "building_area_sqft_sum"),
        "factory_area_share": ("factory_area_sqft_sum", "building_area_sqft_sum"),
        "residential_unit_share": ("residential_units_sum", "total_units_sum"),
    }
    have = set(columns)
    return {n: ratio(F.col(a), F.col(b)) for n, (a, b) in pairs.items() if {a, b} <= have}


def simple_landuse(
    parcels: DataFrame,
    key: str = "area",
    group: str = "landuse_group",
    domain: Sequence[str] = tuple(fv.PARCEL_GROUPS),
    totals: Mapping[str, str] = fv.PARCEL_TOTALS,
) -> DataFrame:
    """Totals, mean floors, ratios and group pivots of counts and lot areas (E26); an empty sum is 0."""
    used = {c: n for c, n in totals.items() if c in parcels.columns}
    floors = "numfloors" in parcels.columns
    cells = parcels.groupBy(key, F.col(group).alias("_c")).agg(
        F.count("bbl").alias("lot_count"),
        *[F.sum(to_number(F.col(c))).alias(n) for c, n in used.items()],
        *([F.sum(to_number(F.col("numfloors"))).alias("_floors"), F.count(to_number(F.col("numfloors"))).alias("_floor_rows")] if floors else []),
    )
    aggs = [F.sum("lot_count").alias("lot_count"), *[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in used.values()]]
    if floors:
        aggs.append(ratio(F.sum("_floors"), F.sum("_floor_rows").cast("double")).alias("avg_num_floors"))
    for g in domain:
        aggs.append(_spread("lot_count", g).alias(f"lot_count_{g}"))
        aggs.append(_spread("total_lot_area", g).cast("double").alias(f"lot_area_{g}"))
    out = cells.groupBy(key).agg(*aggs)
    pairs = {
        "residential_area_ratio": ("total_residential_area", "total_building_area"),
        "commercial_area_ratio": ("total_commercial_area", "total_building_area"),
        "office_area_ratio": ("total_office_area", "total_building_area"),
        "retail_area_ratio": ("total_retail_area", "total_building_area"),
        "building_area_to_lot_area_ratio": ("total_building_area", "total_lot_area"),
        **{f"lot_area_ratio_{g}": (f"lot_area_{g}", "total_lot_area") for g in domain},
    }
    return out.withColumns({n: ratio(F.col(a), F.col(b)) for n, (a, b) in pairs.items() if {a, b} <= set(out.columns)})


def is_one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """Non-null keys, distinct keys and whether they agree."""
    return df.agg(F.count(key).alias("keyed_rows"), F.count_distinct(key).alias("distinct_keys")).withColumn(
        "preaggregated", (F.col("keyed_rows") == F.col("distinct_keys")).cast("int")
    )


def standardise_preaggregated(df: DataFrame, areas: DataFrame, key: str, prefix: str, count: str) -> DataFrame:
    """Prefix feature columns, align to the universe and add the density of `count`."""
    renamed = df.select(key, *[F.col(c).alias(c if c.startswith(prefix) else f"{prefix}{c}") for c in df.columns if c != key])
    joined = areas.join(renamed, key, "left")
    n = F.col(f"{prefix}{count}").cast("double")
    return joined.withColumn(f"{prefix}{count}_density_per_km2", ratio(n, F.col("area_km2")))


def dominant_of_long(long: DataFrame, key: str, category: str, n: str, domain: Sequence[str] = ()) -> DataFrame:
    """E25 over a long table of counts, for domains too wide for columns.

    Ties go to the level that `domain` lists first, then to other levels in their own order, a null level last.
    """
    w = Window.partitionBy(key)
    listed = F.array_position(F.array(*[F.lit(d) for d in domain]).cast("array<string>"), F.col(category)) if domain else F.lit(0)
    order = F.struct(F.col(category).isNull(), F.coalesce(listed, F.lit(0)) == 0, listed, F.col(category))
    ranked = long.withColumn("_t", F.sum(n).over(w))
    return ranked.where(F.col(n) > 0).groupBy(key).agg(
        F.min_by(category, F.struct(-F.col(n), order)).alias("dominant"),
        (F.max(n) / F.max("_t")).alias("dominant_share"),
    )
