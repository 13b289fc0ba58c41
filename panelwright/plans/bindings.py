"""How the driver's tables play the roles of requests, points of interest, parcels, weather and scores.

Each role is a Spark expression and, next to it, the same as an SQL common table expression.
All derived measures are whole numbers stored as doubles, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import target_week, time_split
from ..operators.features import add_temporal_features
from ..operators.panel import densify, weekly_counts
from .registry import Tables

SPLIT = {
    "train_end": "1998-12-31",
    "validation_start": "1999-01-01",
    "validation_end": "1999-12-31",
    "test_start": "2000-01-01",
}
FLAGS = ["A", "N", "R"]

REQUEST_TYPES = [
    "Noise - Residential", "Plant", "Drinking", "Police Report", "Street X", "Heat & Hot Water",
    " HEAT/HOT  WATER ", "Rodent", None, "", "Taxi Complaint", "Unknown Thing", "Sewer", "Illegal–Parking Lot",
    "Blocked Driveway", "Found Property", "Ferry Question",
]
DESCRIPTORS = ["loud music", "hydrant leak", None, "pothole on road", "dog off leash", "heat", "misc"]
AMENITY = ["restaurant", "school", "hospital", "Bus Station", "police", "bank", "cafe", "library", "place_of_worship", None, "none", "townhall", " Fast-Food "]
SHOP = ["supermarket", None, "bakery", None, "books", "", None]
TOURISM = [None, "museum", None, "hotel", None, None, "Art Gallery"]
LEISURE = [None, "park", None, None, "garden"]
LANDUSE = ["1", "01", "2.0", "03", "4", "05 Office", "6", "07", "8", "9", "10", "11", None]
BOROUGHS = ["1", "bx", " Brooklyn ", "QN", "5", "new york", None]
FLAG_WORDS = ["true", "No", " Y ", "0", "1", "maybe", None, "F"]
NUMBER_WORDS = ["12", " 7.5 ", "abc", "", None, "-3", "1e3"]


def pick(values: Sequence[str | None], index: Column) -> Column:
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (index % len(values) + 1).cast("int"))


def pick_sql(values: Sequence[str | None], index: str) -> str:
    items = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{items}], CAST(({index}) % {len(values)} + 1 AS INTEGER))"


# ---- requests --------------------------------------------------------------------------

REQ = f"""req AS (
  SELECT l.l_orderkey AS order_key, l.l_linenumber AS line_no, l.l_shipdate AS ts, n.n_name AS area,
         n.n_regionkey AS region_key, l.l_returnflag AS category, l.l_quantity AS qty, l.l_partkey AS part_key,
         l.l_suppkey AS supp_key,
         {pick_sql(REQUEST_TYPES, 'l.l_partkey')} AS request_type,
         {pick_sql(DESCRIPTORS, 'l.l_suppkey')} AS descriptor
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey)"""


def requests(t: Tables) -> DataFrame:
    area = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("n_name").alias("area"), F.col("n_regionkey").alias("region_key")
    )
    return t.lineitem.join(area, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_shipdate").alias("ts"),
        "area",
        "region_key",
        F.col("l_returnflag").alias("category"),
        F.col("l_quantity").alias("qty"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        pick(REQUEST_TYPES, F.col("l_partkey")).alias("request_type"),
        pick(DESCRIPTORS, F.col("l_suppkey")).alias("descriptor"),
    )


OBS = """obs AS (
  SELECT area, CAST(date_trunc('week', ts) AS DATE) AS week_start, category, count(*) AS n FROM req GROUP BY ALL)"""
DENSE = """dense AS (
  SELECT a.area, CAST(w.wk AS DATE) AS week_start, c.category, COALESCE(o.n, 0) AS n
  FROM (SELECT DISTINCT n_name AS area FROM nation) a
  CROSS JOIN (SELECT unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY)) AS wk FROM obs) w
  CROSS JOIN (VALUES ('A'), ('N'), ('R')) c(category)
  LEFT JOIN obs o ON o.area = a.area AND o.week_start = CAST(w.wk AS DATE) AND o.category = c.category)"""
PANEL = (REQ, OBS, DENSE)


def observed(t: Tables) -> DataFrame:
    return weekly_counts(requests(t))


def areas(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_name").alias("area"), "n_nationkey", "n_regionkey")


def dense(t: Tables) -> DataFrame:
    return densify(observed(t), areas(t), FLAGS)


FEAT = """feat AS (
  SELECT *, n - lag_1w_count AS diff_1w_count, n - lag_4w_count AS diff_4w_count,
    CASE WHEN lag_1w_count > 0 THEN (n - lag_1w_count) / lag_1w_count END AS pct_change_1w,
    CASE WHEN rolling_8w_mean > 0 THEN n / rolling_8w_mean END AS ratio_to_8w_mean,
    CASE WHEN rolling_12w_mean > 0 THEN n / rolling_12w_mean END AS ratio_to_12w_mean,
    rolling_8w_mean + 1.5 * rolling_8w_std AS abnormal_threshold,
    CASE WHEN c8 >= 8 AND nxt IS NOT NULL THEN
      CASE WHEN 8 * nxt - s8 > 0 AND 28 * (8 * nxt - s8) * (8 * nxt - s8) > 72 * (8 * q8 - s8 * s8) THEN 1 ELSE 0 END
    END AS is_abnormal_next_week,
    CASE WHEN history_weeks >= 12 THEN 1 ELSE 0 END AS has_min_history,
    CASE WHEN nxt IS NOT NULL THEN 1 ELSE 0 END AS has_target_next_week,
    CAST(nxt AS DOUBLE) AS next_week_count,
    CASE WHEN history_weeks >= 12 AND nxt IS NOT NULL THEN 1 ELSE 0 END AS is_train_ready
  FROM (SELECT area, week_start, category, n,
      row_number() OVER w - 1 AS history_weeks, lead(n) OVER w AS nxt,
      CAST(lag(n, 1) OVER w AS DOUBLE) AS lag_1w_count, CAST(lag(n, 2) OVER w AS DOUBLE) AS lag_2w_count,
      CAST(lag(n, 4) OVER w AS DOUBLE) AS lag_4w_count, CAST(lag(n, 8) OVER w AS DOUBLE) AS lag_8w_count,
      CAST(lag(n, 12) OVER w AS DOUBLE) AS lag_12w_count, CAST(lag(n, 52) OVER w AS DOUBLE) AS lag_52w_count,
      count(n) OVER f8 AS c8, sum(n) OVER f8 AS s8, sum(n * n) OVER f8 AS q8,
      CASE WHEN count(n) OVER f4 >= 4 THEN avg(n) OVER f4 END AS rolling_4w_mean,
      CASE WHEN count(n) OVER f4 >= 4 THEN stddev_samp(n) OVER f4 END AS rolling_4w_std,
      CASE WHEN count(n) OVER f4 >= 4 THEN sum(n) OVER f4 END AS rolling_4w_sum,
      CASE WHEN count(n) OVER f8 >= 8 THEN avg(n) OVER f8 END AS rolling_8w_mean,
      CASE WHEN count(n) OVER f8 >= 8 THEN stddev_samp(n) OVER f8 END AS rolling_8w_std,
      CASE WHEN count(n) OVER f8 >= 8 THEN sum(n) OVER f8 END AS rolling_8w_sum,
      CASE WHEN count(n) OVER f12 >= 12 THEN avg(n) OVER f12 END AS rolling_12w_mean,
      CASE WHEN count(n) OVER f12 >= 12 THEN stddev_samp(n) OVER f12 END AS rolling_12w_std,
      CASE WHEN count(n) OVER f12 >= 12 THEN sum(n) OVER f12 END AS rolling_12w_sum
    FROM dense
    WINDOW w AS (PARTITION BY area, category ORDER BY week_start),
      f4 AS (PARTITION BY area, category ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
      f8 AS (PARTITION BY area, category ORDER BY week_start ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING),
      f12 AS (PARTITION BY area, category ORDER BY week_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) x)"""
SPLIT_CASE = """CASE WHEN target_week IS NULL THEN 'bad_date' WHEN target_week >= DATE '2000-01-01' THEN 'test'
    WHEN target_week BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'validation'
    WHEN target_week <= DATE '1998-12-31' THEN 'train' ELSE 'out_of_range' END"""
TABLE = f"""tab AS (
  SELECT *, year(target_week) AS target_year, {SPLIT_CASE} AS time_split, year(week_start) AS year
  FROM (SELECT *, CASE WHEN has_target_next_week = 1 THEN CAST(week_start + INTERVAL 7 DAY AS DATE) END AS target_week FROM feat) z)"""
FEATURES = (*PANEL, FEAT)
FULL = (*FEATURES, TABLE)


def features(t: Tables, panel: DataFrame | None = None) -> DataFrame:
    return add_temporal_features(dense(t) if panel is None else panel)


def table(t: Tables, panel: DataFrame | None = None) -> DataFrame:
    df = features(t, panel)
    target = target_week(F.col("week_start"), F.col("has_target_next_week"))
    df = df.withColumn("target_week", target)
    return df.withColumns(
        {
            "target_year": F.year("target_week"),
            "time_split": time_split(F.col("target_week"), SPLIT),
            "year": F.year("week_start"),
        }
    )


# ---- points of interest and parcels ----------------------------------------------------

POI = f"""poi AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS osm_id, n.n_name AS area,
    {pick_sql(AMENITY, 'l.l_partkey')} AS amenity, {pick_sql(SHOP, 'l.l_suppkey')} AS shop,
    {pick_sql(TOURISM, 'l.l_linenumber')} AS tourism, {pick_sql(LEISURE, 'l.l_orderkey')} AS leisure,
    CASE WHEN l.l_tax > 0.02 THEN 'n' || l.l_partkey END AS name, l.l_discount AS disc
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey)"""


def poi(t: Tables) -> DataFrame:
    area = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("area"))
    return t.lineitem.join(area, F.col("l_suppkey") == F.col("s_suppkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("osm_id"),
        "area",
        pick(AMENITY, F.col("l_partkey")).alias("amenity"),
        pick(SHOP, F.col("l_suppkey")).alias("shop"),
        pick(TOURISM, F.col("l_linenumber")).alias("tourism"),
        pick(LEISURE, F.col("l_orderkey")).alias("leisure"),
        F.when(F.col("l_tax") > 0.02, F.concat(F.lit("n"), F.col("l_partkey"))).alias("name"),
        F.col("l_discount").alias("disc"),
    )


PARCEL = f"""parcel AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS bbl, n.n_name AS area, {pick_sql(LANDUSE, 'l.l_partkey')} AS landuse,
    CASE WHEN l.l_suppkey % 11 = 0 THEN 0.0 ELSE round(l.l_extendedprice) END AS lotarea, l.l_quantity * 100 AS bldgarea,
    l.l_quantity * 40 AS resarea, l.l_quantity * 30 AS comarea,
    CASE WHEN l.l_partkey % 4 <> 0 THEN l.l_quantity * 10 END AS officearea, l.l_quantity * 5 AS retailarea,
    CAST(l.l_linenumber AS DOUBLE) AS numfloors, l.l_quantity AS unitsres, l.l_quantity + l.l_linenumber AS unitstotal,
    CAST(CASE WHEN l.l_partkey % 9 = 0 THEN 0 ELSE 1890 + l.l_partkey % 140 END AS DOUBLE) AS yearbuilt,
    CAST(l.l_linenumber AS DOUBLE) AS numbldgs
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey)"""


def parcels(t: Tables) -> DataFrame:
    area = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("area"))
    q, line, part = F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_partkey")
    return t.lineitem.join(area, F.col("l_suppkey") == F.col("s_suppkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("bbl"),
        "area",
        pick(LANDUSE, part).alias("landuse"),
        F.when(F.col("l_suppkey") % 11 == 0, 0.0).otherwise(F.round("l_extendedprice")).alias("lotarea"),
        (q * 100).alias("bldgarea"),
        (q * 40).alias("resarea"),
        (q * 30).alias("comarea"),
        F.when(part % 4 != 0, q * 10).alias("officearea"),
        (q * 5).alias("retailarea"),
        line.alias("numfloors"),
        q.alias("unitsres"),
        (q + line).alias("unitstotal"),
        F.when(part % 9 == 0, 0.0).otherwise((part % 140 + 1890).cast("double")).alias("yearbuilt"),
        line.alias("numbldgs"),
    )


# area in square kilometres: nation 7 has none, nation 3 is missing from no table
AREA = """areas AS (
  SELECT n_name AS area, CASE WHEN n_nationkey <> 7 THEN CAST(n_nationkey + 2 AS DOUBLE) END AS area_km2 FROM nation)"""


def area_sizes(t: Tables) -> DataFrame:
    return t.nation.select(
        F.col("n_name").alias("area"), F.when(F.col("n_nationkey") != 7, (F.col("n_nationkey") + 2).cast("double")).alias("area_km2")
    )


# ---- weather ---------------------------------------------------------------------------

DATATYPES = ["TMAX", "TMIN", "PRCP", "SNOW", "SNWD", "AWND"]
LONG = f"""wlong AS (
  SELECT CAST(o_orderdate AS DATE) AS date, 'S' || (o_custkey % 5) AS station, {pick_sql(DATATYPES, 'o_orderkey')} AS datatype,
    CASE WHEN o_orderkey % 97 = 0 THEN 9999.0 ELSE CAST((o_custkey * 37 + o_orderkey * 11) % 431 - 60 AS DOUBLE) END AS value
  FROM orders)"""
WIDE = """wwide AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
    CASE WHEN o_orderkey % 97 = 0 THEN 9999.0 ELSE CAST((o_custkey * 37 + o_orderkey * 11) % 50 - 8 AS DOUBLE) END AS tmax_a,
    CASE WHEN o_orderkey % 2 = 0 THEN CAST((o_custkey * 13) % 48 - 6 AS DOUBLE) END AS tmax_b,
    CAST((o_custkey * 37 + o_orderkey * 11) % 40 - 14 AS DOUBLE) AS tmin_a,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST((o_custkey * 7) % 60 AS DOUBLE) ELSE 0.0 END AS prcp_a,
    CASE WHEN month(o_orderdate) NOT IN (6, 7, 8) THEN CAST((o_orderkey * 3) % 45 AS DOUBLE) END AS snow_a
  FROM orders)"""
FAMILIES = {"tmax": ["tmax_a", "tmax_b"], "tmin": ["tmin_a"], "prcp": ["prcp_a"], "snow": ["snow_a"]}


def weather_long(t: Tables) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        F.to_date("o_orderdate").alias("date"),
        F.concat(F.lit("S"), c % 5).alias("station"),
        pick(DATATYPES, o).alias("datatype"),
        F.when(o % 97 == 0, 9999.0).otherwise(((c * 37 + o * 11) % 431 - 60).cast("double")).alias("value"),
    )


def weather_wide(t: Tables) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        F.to_date("o_orderdate").alias("date"),
        F.when(o % 97 == 0, 9999.0).otherwise(((c * 37 + o * 11) % 50 - 8).cast("double")).alias("tmax_a"),
        F.when(o % 2 == 0, ((c * 13) % 48 - 6).cast("double")).alias("tmax_b"),
        ((c * 37 + o * 11) % 40 - 14).cast("double").alias("tmin_a"),
        F.when(o % 3 == 0, ((c * 7) % 60).cast("double")).otherwise(0.0).alias("prcp_a"),
        F.when(~F.month("o_orderdate").isin(6, 7, 8), ((o * 3) % 45).cast("double")).alias("snow_a"),
    )


# ---- scores ----------------------------------------------------------------------------

SCORED = f"""scored AS (
  SELECT *, {SPLIT_CASE.replace('target_week', 'd')} AS split FROM (
    SELECT l_orderkey AS order_key, l_linenumber AS line_no, l_returnflag AS category, CAST(l_shipdate AS DATE) AS d,
      year(l_shipdate) AS year,
      l_quantity / 50.0 AS first_score,
      (l_quantity * 10 + (l_orderkey * 7919 + l_linenumber * 104729) % 500) / 1000.0 AS second_score,
      CASE WHEN l_quantity + (l_orderkey * 31 + l_linenumber * 17) % 30 > 50 THEN 1 ELSE 0 END AS y
    FROM lineitem) q)"""


def scored(t: Tables) -> DataFrame:
    o, n, q = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")
    d = F.to_date("l_shipdate")
    return t.lineitem.select(
        o.alias("order_key"),
        n.alias("line_no"),
        F.col("l_returnflag").alias("category"),
        d.alias("d"),
        F.year("l_shipdate").alias("year"),
        (q / 50.0).alias("first_score"),
        ((q * 10 + (o * 7919 + n * 104729) % 500) / 1000.0).alias("second_score"),
        F.when(q + (o * 31 + n * 17) % 30 > 50, 1).otherwise(0).alias("y"),
        time_split(d, SPLIT).alias("split"),
    )


