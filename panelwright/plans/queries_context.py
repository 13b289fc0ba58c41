"""Sources, joins, space, weather, points of interest, parcels and assembly (A, D, E, Q series)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar as cal
from ..functions import classify as cl
from ..functions import cleaning as cln
from ..functions import fixed_values as fv
from ..operators import context as ctx
from ..operators import joins, profile, quality, report, spatial
from ..operators import observed as obs
from ..operators import weather as wx
from ..operators.ordered import top_rows
from ..session import stage, staging_dir
from ..sources import columns as src_columns
from ..sources import files as src_files
from ..sources import isolate
from ..streaming import weekly
from . import bindings as b
from .queries_panel import CODE, POI_TYPED, TAGS
from .registry import query

# ---- sources ---------------------------------------------------------------------------


@query(
    "a01_scan_parts",
    "l_orderkey:i l_linenumber:i l_quantity:f source_file",
    "SELECT l_orderkey, l_linenumber, l_quantity, 'lineitem.parquet' AS source_file FROM lineitem",
)
def _(t):
    return src_files.scan_parts(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], ["not_there"], fmt="parquet")


@query(
    "a01_csv_parts",
    "o_orderkey:i o_orderstatus o_custkey:i o_clerk",
    "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 <> 1 THEN o_custkey END AS o_custkey, NULL AS o_clerk FROM orders",
)
def _(t):
    here = f"{staging_dir(t.spark)}/parts-{uuid.uuid4().hex}"
    third = lambda k, *c: src_files.write_table(t.orders.where(F.col("o_orderkey") % 3 == k).select(*c), f"{here}/part-{k}", "csv", options={"compression": "gzip"})
    parts = [third(0, "o_orderkey", "o_custkey", "o_orderstatus"), third(1, "o_orderstatus", "o_orderkey"), third(2, "o_orderstatus", "o_custkey", "o_orderkey")]
    return src_files.scan_parts(t.spark, parts, ["o_orderkey", "o_orderstatus"], ["o_custkey"]).withColumn("o_clerk", F.lit(None))


@query("a02_projection", "o_orderkey:i o_orderstatus", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    return src_columns.project(t.orders, ["o_orderkey"], ["o_orderstatus", "missing_column"], "orders")


@query("a03_normalise_headers", "order_key:i order_key_2:i customer:i", "SELECT o_orderkey AS order_key, o_custkey AS order_key_2, o_custkey AS customer FROM orders")
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_custkey").toDF(" Order Key ", "order-key", "CUSTOMER")
    return src_columns.normalise_headers(o)


@query("a04_resolve_columns", "request_id:i created:d", "SELECT l_orderkey AS request_id, l_shipdate AS created FROM lineitem")
def _(t):
    aliases = {"request_id": ["unique_key", "L-OrderKey"], "created": ["created_date", "lShipDate"]}
    return src_columns.rename_resolved(t.lineitem, aliases, "lineitem", ["request_id", "created"]).select("request_id", "created")


@query(
    "a04_request_table",
    "unique_key:i created_date:d complaint_type nta2020:i",
    "SELECT l_orderkey * 10 + l_linenumber AS unique_key, l_shipdate AS created_date, l_returnflag AS complaint_type, l_suppkey AS nta2020 FROM lineitem",
)
def _(t):
    named = {"NTA Code": "l_suppkey", "ComplaintType": "l_returnflag", "Complaint.Kind": "l_linestatus", "unique_key": "l_partkey", "Created Date": "l_shipdate"}
    raw = t.lineitem.select(*[F.col(c).alias(n) for n, c in named.items()], (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("Unique-Key"))
    return src_columns.RESOLVERS["requests"].apply(raw, "requests")


@query(
    "a04_poi_table",
    "osm_id:i nta2020 latitude:f longitude:f name",
    "SELECT o_orderkey AS osm_id, o_orderstatus AS nta2020, (o_custkey % 90) / 8.0 AS latitude, (o_orderkey % 90) / 8.0 AS longitude, o_orderpriority AS name FROM orders",
)
def _(t):
    raw = t.orders.select(
        F.col("o_orderstatus").alias("NTA"), F.col("o_orderkey").alias("Element ID"), ((F.col("o_custkey") % 90) / 8.0).alias("LAT"),
        ((F.col("o_orderkey") % 90) / 8.0).alias("lng"), F.col("o_orderpriority").alias("osm name"), F.col("o_custkey").alias("y"), F.col("o_totalprice").alias("unused"),
    )
    return src_columns.RESOLVERS["poi"].apply(raw, "poi")


@query(
    "a04_parcel_table",
    "bbl:i lotarea:f numfloors:f yearbuilt:i",
    "SELECT p_partkey AS bbl, p_retailprice AS lotarea, p_size AS numfloors, 1900 + p_size AS yearbuilt FROM part",
)
def _(t):
    raw = t.part.select(F.lit("q").alias("NTA"), F.col("p_partkey").alias("BBL 10"), F.col("p_retailprice").alias("LotSqFt"), F.col("p_size").alias("Number of Floors"), (F.col("p_size") + 1900).alias("Yr-Built"), F.lit(1).alias("unused"))
    return src_columns.RESOLVERS["parcels"].apply(raw, "parcels")


@query(
    "a04_weather_columns",
    "family column_name valid_share:f",
    """SELECT * FROM (SELECT 'tmax' AS family, 'Max Temp' AS column_name, avg(CASE WHEN abs(tmax_a) < 9990 THEN 1.0 ELSE 0.0 END) AS valid_share FROM wwide
       UNION ALL SELECT 'tmin', 'TMIN', avg(CASE WHEN abs(tmin_a) < 9990 THEN 1.0 ELSE 0.0 END) FROM wwide
       UNION ALL SELECT 'prcp', 'daily-precip', avg(CASE WHEN abs(prcp_a) < 9990 THEN 1.0 ELSE 0.0 END) FROM wwide) z""",
    (b.WIDE,),
)
def _(t):
    w = b.weather_wide(t).select(
        F.col("tmax_a").alias("Max Temp"), F.col("tmin_a").alias("TMIN"), F.col("prcp_a").alias("daily-precip"),
        F.lit(1).alias("rain_day"), F.lit("x").alias("TMAX_attributes"),
    )
    found = src_columns.weather_columns(w)
    shares = src_columns.valid_shares(w, [c for cols in found.values() for c in cols])
    return t.spark.createDataFrame([(f, c, shares[c]) for f, cols in found.items() for c in cols], "family string, column_name string, valid_share double")


@query("a06_flatten_poi", "osm_id:i osm_type lat:f lon:f name amenity matched_tag_value",
    """SELECT * FROM (SELECT o_orderkey AS osm_id, CASE WHEN o_custkey % 3 = 0 THEN 'node' ELSE 'way' END AS osm_type,
       CASE WHEN o_custkey % 3 < 2 THEN (o_custkey % 90) / 8.0 END AS lat, CASE WHEN o_custkey % 3 < 2 THEN (o_orderkey % 90) / 8.0 END AS lon,
       o_orderpriority AS name, o_orderstatus AS amenity, o_orderstatus AS matched_tag_value FROM orders) z WHERE lat IS NOT NULL""")
def _(t):
    k = F.col("o_custkey") % 3
    lat, lon = (F.col("o_custkey") % 90) / 8.0, (F.col("o_orderkey") % 90) / 8.0
    # serialised and parsed again, as the nested part files are
    text = F.to_json(
        F.struct(
            F.when(k == 0, "node").otherwise("way").alias("type"),
            F.col("o_orderkey").alias("id"),
            F.when(k == 0, lat).alias("lat"),
            F.when(k == 0, lon).alias("lon"),
            F.when(k == 1, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("center"),
            F.create_map(F.lit("name"), F.col("o_orderpriority"), F.lit("amenity"), F.col("o_orderstatus")).alias("tags"),
        )
    )
    return src_files.flatten_poi(t.orders.select(F.from_json(text, src_files.ELEMENT).alias("e")), "amenity", "all")


@query(
    "a07_union_parts",
    "part_no:i l_returnflag n:i extra:i",
    """SELECT * FROM (SELECT 1 AS part_no, l_returnflag, count(*) AS n, NULL AS extra FROM lineitem GROUP BY ALL
       UNION ALL SELECT 2, o_orderstatus, count(*), max(o_custkey) FROM orders GROUP BY ALL) z""",
)
def _(t):
    one = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n")).withColumn("part_no", F.lit(1))
    two = t.orders.groupBy(F.col("o_orderstatus").alias("l_returnflag")).agg(F.count("*").alias("n"), F.max("o_custkey").alias("extra")).withColumn("part_no", F.lit(2))
    return joins.union_parts([one, two])


@query(
    "a09_unseen_files",
    "file_name",
    "SELECT DISTINCT 'orders.parquet' AS file_name FROM orders UNION ALL SELECT DISTINCT 'lineitem.parquet' FROM lineitem",
)
def _(t):
    available = src_files.list_files(t.spark, t.folder, "*{orders,lineitem,events}*.parquet")
    done = t.events.select(F.col("_metadata.file_path").alias("path")).distinct()
    # directory listings and file metadata may spell the scheme differently
    plain = lambda df: df.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    left = src_files.unseen_files(plain(available), plain(done))
    return left.select(F.element_at(F.split("path", "/"), -1).alias("file_name"))


@query(
    "a10_file_report",
    "source_file rows_read:i rows_used:i bad_date_rows:i missing_key_rows:i matched_rows:i",
    """SELECT 'lineitem.parquet' AS source_file, count(*) AS rows_read, count(*) FILTER (WHERE l_linenumber <> 3 AND l_quantity <> 5) AS rows_used,
       count(*) FILTER (WHERE l_linenumber = 3) AS bad_date_rows, count(*) FILTER (WHERE l_quantity = 5) AS missing_key_rows,
       count(*) FILTER (WHERE l_returnflag = 'R') AS matched_rows FROM lineitem""",
)
def _(t):
    li = t.lineitem.select("*", F.col("_metadata.file_name").alias("source_file"))
    return src_files.file_report(li, "source_file", F.col("l_linenumber") == 3, F.col("l_quantity") == 5, F.col("l_returnflag") == "R")


@query(
    "a10_file_errors",
    "file_group status files:i rows_read:i corrupt_rows:i with_error:i",
    """SELECT 'orders' AS file_group, 'read' AS status, 1 AS files, count(*) AS rows_read, 0 AS corrupt_rows, 0 AS with_error FROM orders
       UNION ALL SELECT 'customer', 'read', 1, count(*), count(*) FILTER (WHERE c_custkey % 7 = 0), 0 FROM customer
       UNION ALL SELECT DISTINCT 'other header', 'unreadable', 1, NULL, NULL, 1 FROM nation
       UNION ALL SELECT DISTINCT 'no archive', 'unreadable', 1, NULL, NULL, 1 FROM nation""",
)
def _(t):
    here = f"{staging_dir(t.spark)}/isolated-{uuid.uuid4().hex}"
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    plain = {"compression": "none"}
    src_files.write_table(t.orders.select(key.alias("key"), status.alias("state")).coalesce(1), f"{here}/orders", "csv", options={"compression": "gzip"})
    # lines written as they are: every seventh customer opens a quote and never closes it, or lacks a field
    k = F.col("c_custkey")
    line = F.when(k % 14 == 0, F.concat(k.cast("string"), F.lit(',"open'))).when(k % 7 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit(",ok")))
    lines = t.customer.select(F.lit(1).alias("o"), line.alias("value")).unionByName(t.spark.createDataFrame([(0, "key,state")], "o int, value string"))
    lines.coalesce(1).sortWithinPartitions("o").select("value").write.text(f"{here}/customer")
    src_files.write_table(t.nation.select(F.col("n_name").alias("name"), F.lit("x").alias("state")).coalesce(1), f"{here}/header", "csv", options=plain)
    t.nation.select(F.lit("PAR1 is no archive").alias("value")).coalesce(1).write.text(f"{here}/archive")
    csv = isolate.scan_isolated(t.spark, [f"{here}/orders", f"{here}/customer", f"{here}/header"], T.StructType.fromDDL("key string, state string"), pattern="part-*")
    parquet = isolate.scan_isolated(t.spark, f"{here}/archive", T.StructType.fromDDL("key string"), "parquet", pattern="part-*")
    group = F.regexp_extract("path", "/(orders|customer|header|archive)/", 1)
    named = F.when(group == "header", "other header").when(group == "archive", "no archive").otherwise(group)
    both = csv.status.unionByName(parquet.status).withColumn("file_group", named)
    return both.groupBy("file_group", "status").agg(
        F.count("*").alias("files"), F.sum("rows_read").alias("rows_read"), F.sum("corrupt_rows").alias("corrupt_rows"), F.count("error").alias("with_error")
    )


@query(
    "a11_date_ranges",
    "column_name n:i first last",
    """SELECT column_name, n, strftime(a, '%Y-%m-%d %H:%M:%S') AS first, strftime(z, '%Y-%m-%d %H:%M:%S') AS last FROM (
       SELECT 'created_date' AS column_name, count(*) AS n, min(l_shipdate) AS a, max(l_shipdate) AS z FROM lineitem
       UNION ALL SELECT 'closed_date', count(*), min(CAST(l_shipdate AS DATE) + INTERVAL 3 DAY), max(CAST(l_shipdate AS DATE) + INTERVAL 3 DAY) FROM lineitem WHERE l_linenumber <> 2) y""",
)
def _(t):
    ship, n = F.col("l_shipdate"), F.col("l_linenumber")
    raw = t.lineitem.select(
        ship.alias("created_date"),
        F.when(n == 1, F.date_format(F.date_add(ship, 3), "MM/dd/yyyy")).when(n == 2, "not a date").otherwise(F.date_format(F.date_add(ship, 3), "yyyy-MM-dd")).alias("closed_date"),
        F.lit(None).cast("string").alias("version"), n,
    )
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return profile.date_ranges(raw, formats=["MM/dd/yyyy"]).select("column_name", "n", stamp("first"), stamp("last"))


@query(
    "a11_schema_report",
    "column_name found:i n:i min:f max:f mean:f",
    """SELECT column_name, found, n, min, max, mean FROM (
       SELECT 'l_quantity' AS column_name, 1 AS found, count(l_quantity) AS n, min(l_quantity) AS min, max(l_quantity) AS max, avg(l_quantity) AS mean FROM lineitem
       UNION ALL SELECT 'l_linenumber', 1, count(l_linenumber), min(l_linenumber), max(l_linenumber), avg(l_linenumber) FROM lineitem
       UNION ALL SELECT 'no_such_column', 0, NULL, NULL, NULL, NULL) z""",
)
def _(t):
    return profile.raw_schema_report(t.lineitem, ["l_quantity", "no_such_column"], ["l_quantity", "l_linenumber"])


@query(
    "a11_top_values",
    "column_name level n:i rank:i",
    """SELECT * FROM (SELECT column_name, level, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, level) AS rank FROM (
       SELECT 'brand' AS column_name, p_brand AS level, count(*) AS n FROM part GROUP BY ALL UNION ALL
       SELECT 'kind', p_type, count(*) FROM part GROUP BY ALL) a) z WHERE rank <= 20""",
)
def _(t):
    return profile.top_values(t.part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")), ["brand", "kind"])


@query(
    "a12_month_ranges",
    "range_start:d range_end:d n:i",
    """SELECT CASE WHEN m < DATE '1996-01-15' THEN DATE '1996-01-15' ELSE m END AS range_start,
       CASE WHEN m = DATE '1997-03-01' THEN DATE '1997-03-11' ELSE CAST(m + INTERVAL 1 MONTH AS DATE) END AS range_end, count(*) AS n
       FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders WHERE o_orderdate >= DATE '1996-01-15' AND o_orderdate < DATE '1997-03-11') z GROUP BY ALL""",
)
def _(t):
    ranges = cal.month_ranges(t.spark, "1996-01-15", "1997-03-10").withColumn("m", F.trunc("range_start", "month"))
    orders = t.orders.where(cln.in_date_range(F.col("o_orderdate"), "1996-01-15", "1997-03-10"))
    per_month = orders.groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("m")).agg(F.count("*").alias("n"))
    return ranges.join(per_month, "m")


@query(
    "a08_partitioned_sink",
    "month n:i total:m",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM orders GROUP BY 1",
)
def _(t):
    orders = t.orders.withColumn("month", src_files.month_key(F.col("o_orderdate")))
    path = src_files.land(orders, f"{staging_dir(t.spark)}/orders-{uuid.uuid4().hex}", ["month"])
    back = t.spark.read.parquet(path)
    return back.groupBy("month").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))


@query("a09_incremental_ingest", "event_id:i event_type", "SELECT event_id, event_type FROM events")
def _(t):
    here = f"{staging_dir(t.spark)}/ingest-{uuid.uuid4().hex}"
    stream = weekly.stream_parts(t.spark, f"{t.folder}/events*.parquet", t.events.schema)
    for _ in range(2):  # the second run finds nothing new
        weekly.ingest_available(stream.select("event_id", "event_type"), f"{here}/data", f"{here}/state")
    return t.spark.read.schema("event_id long, event_type string").parquet(f"{here}/data")


@query(
    "e01_incremental_weekly_counts",
    "week_start:d l_returnflag n:i",
    "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL",
)
def _(t):
    here = f"{staging_dir(t.spark)}/weekly-{uuid.uuid4().hex}"
    stream = weekly.stream_parts(t.spark, f"{t.folder}/lineitem*.parquet", t.lineitem.schema)
    weekly.weekly_totals_available(stream, "l_shipdate", ["l_returnflag"], f"{here}/data", f"{here}/state")
    return weekly.read_weekly_totals(t.spark, f"{here}/data", ["l_returnflag"])


# ---- space -----------------------------------------------------------------------------

POINTS = """pts AS (SELECT c_custkey, CASE WHEN c_custkey % 19 <> 0 THEN (c_custkey * 37 % 1000) / 200.0 + 0.0013 END AS lon,
  (c_custkey * 53 % 1000) / 200.0 + 0.0017 AS lat FROM customer)"""
# nation k covers a rectangle of 0.9 x 0.9 on a 5 x 5 grid, minus a hole in its middle for even k
HOLE = "(n_nationkey % 2 = 0 AND lon > n_nationkey % 5 + 0.3 AND lon < n_nationkey % 5 + 0.6 AND lat > n_nationkey // 5 + 0.3 AND lat < n_nationkey // 5 + 0.6)"
LOCATED = f"""located AS (SELECT p.c_custkey, n.n_name AS area FROM pts p LEFT JOIN nation n
  ON p.lon > n_nationkey % 5 AND p.lon < n_nationkey % 5 + 0.9 AND p.lat > n_nationkey // 5 AND p.lat < n_nationkey // 5 + 0.9 AND NOT {HOLE})"""


def points(t):
    c = F.col("c_custkey")
    lon = F.when(c % 19 != 0, (c * 37 % 1000) / 200.0 + 0.0013)
    return t.customer.select("c_custkey", lon.alias("lon"), ((c * 53 % 1000) / 200.0 + 0.0017).alias("lat"))


def _square(x, y, low, high):
    corner = lambda dx, dy: F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))
    return F.array(corner(low, low), corner(high, low), corner(high, high), corner(low, high), corner(low, low))


def polygons(t):
    k = F.col("n_nationkey")
    x, y = (k % 5).cast("double"), F.floor(k / 5).cast("double")
    outer, hole = _square(x, y, 0.0, 0.9), _square(x, y, 0.3, 0.6)
    rings = F.when(k % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    return t.nation.select(F.col("n_name").alias("area"), F.array(rings).alias("polygons"))


@query("d01_point_in_polygon", "c_custkey:i area", "SELECT * FROM located", (POINTS, LOCATED))
def _(t):
    return spatial.assign_areas(points(t), polygons(t), "area", 0.7)


@query(
    "d01_match_rate",
    "row_count:i matched_rows:i match_rate:f",
    "SELECT count(*) AS row_count, count(area) AS matched_rows, count(area) / count(*) AS match_rate FROM located",
    (POINTS, LOCATED),
)
def _(t):
    return spatial.match_rate(spatial.assign_areas(points(t), polygons(t), "area", 0.7), "area")


@query(
    "a05_polygon_attributes",
    "area polygon_count:i ring_count:i",
    "SELECT n_name AS area, 1 AS polygon_count, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS ring_count FROM nation",
)
def _(t):
    return polygons(t).select("area", F.size("polygons").alias("polygon_count"), F.size(F.flatten("polygons")).alias("ring_count"))


@query(
    "a05_geojson_file",
    "area code boundary_points:i hole_points:i",
    "SELECT n_name AS area, 'N' || n_nationkey AS code, 5 AS boundary_points, CASE WHEN n_nationkey % 2 = 0 THEN 5 ELSE 0 END AS hole_points FROM nation",
)
def _(t):
    # written as a feature collection, half of it as multi polygons, and parsed again
    shapes = polygons(t).join(t.nation.select(F.col("n_name").alias("area"), "n_nationkey"), "area")
    pairs = F.transform("polygons", lambda p: F.transform(p, lambda ring: F.transform(ring, lambda x: F.array(x["lon"], x["lat"]))))
    props = F.struct(F.col("area").alias("Name"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("CODE"))
    whole = lambda kind, c: F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit(kind).alias("type"), c.alias("coordinates")).alias("geometry")))
    feature = F.when(F.col("n_nationkey") % 4 < 2, whole("Polygon", pairs[0])).otherwise(whole("MultiPolygon", pairs))
    text = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.concat_ws(", ", F.collect_list("f")), F.lit("]}"))
    path = f"{staging_dir(t.spark)}/areas-{uuid.uuid4().hex}"
    shapes.select(feature.alias("f")).agg(text.alias("value")).write.text(path)
    read = src_files.read_polygons(t.spark, path, ["name", "code"])
    ring = lambda i: F.coalesce(F.size(F.get(F.col("polygons")[0], F.lit(i))), F.lit(0))
    return read.select(F.col("name").alias("area"), "code", ring(0).alias("boundary_points"), F.when(ring(1) > 0, ring(1)).otherwise(0).alias("hole_points"))


@query(
    "d02_polygon_area",
    "area area_km2:f",
    """SELECT n_name AS area, cos(radians(40.7128)) * pow(radians(1) * 6371008.8, 2) / 1e6 * (0.81 - CASE WHEN n_nationkey % 2 = 0 THEN 0.09 ELSE 0 END) AS area_km2
       FROM nation""",
)
def _(t):
    return spatial.area_km2(polygons(t), "area", 40.7128)


@query(
    "d02_polygon_area_mean_latitude",
    "area area_km2:f",
    """SELECT n_name AS area, pow(radians(1) * 6371008.8, 2) / 1e6 * (0.81 * cos(radians(y + 0.36)) - CASE WHEN n_nationkey % 2 = 0 THEN 0.09 * cos(radians(y + 0.42)) ELSE 0 END) AS area_km2
       FROM (SELECT *, n_nationkey // 5 AS y FROM nation) z""",
)
def _(t):
    return spatial.area_km2(polygons(t), "area")


# ---- key contracts and dimension joins -------------------------------------------------


@query(
    "d03_dimension_joins",
    "order_key:i line_no:i area region_name supplier_name",
    """SELECT req.order_key, req.line_no, req.area, r_name AS region_name, s_name AS supplier_name FROM req
       LEFT JOIN region ON r_regionkey = region_key LEFT JOIN supplier ON s_suppkey = supp_key""",
    (b.REQ,),
)
def _(t):
    region = t.region.select(F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("region_name"))
    supplier = t.supplier.select(F.col("s_suppkey").alias("supp_key"), F.col("s_name").alias("supplier_name"))
    return joins.attach_dimensions(b.requests(t), {"region": (region, ["region_key"]), "supplier": (supplier, ["supp_key"])})


@query(
    "d04_duplicate_keys",
    "table_name row_count:i unique_keys:i duplicate_rows_involved:i duplicate_extra_rows:i",
    """SELECT 'lineitem' AS table_name, sum(c) AS row_count, count(*) AS unique_keys, coalesce(sum(c) FILTER (WHERE c > 1), 0) AS duplicate_rows_involved,
       coalesce(sum(c - 1) FILTER (WHERE c > 1), 0) AS duplicate_extra_rows FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) z""",
)
def _(t):
    return joins.duplicate_key_report(t.lineitem, ["l_orderkey", "l_linenumber"], "lineitem")


@query(
    "d05_compare_attribute",
    "key:i left_value:f right_value:f abs_difference:f",
    """SELECT key, left_value, right_value, abs(left_value - right_value) AS abs_difference FROM
       (SELECT c_nationkey AS key, count(*) AS left_value FROM customer WHERE c_nationkey <> 3 GROUP BY 1) a FULL JOIN
       (SELECT s_nationkey AS key, count(*) AS right_value FROM supplier WHERE s_nationkey <> 5 GROUP BY 1) c USING (key)""",
)
def _(t):
    a = t.customer.where("c_nationkey <> 3").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("x"))
    c = t.supplier.where("s_nationkey <> 5").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("x"))
    return joins.compare_attribute(a, c, ["key"], "x")


@query(
    "d06_merge_attributes",
    "key:i label n:i",
    """SELECT key, coalesce(a.label, c.label) AS label, n FROM (SELECT c_nationkey AS key, CASE WHEN c_nationkey % 2 = 0 THEN min(c_name) END AS label,
       count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS key, min(s_name) AS label FROM supplier GROUP BY 1) c USING (key)""",
)
def _(t):
    a = t.customer.where("c_nationkey <> 3").groupBy(F.col("c_nationkey").alias("key")).agg(
        F.when(F.col("key") % 2 == 0, F.min("c_name")).alias("label"), F.count("*").alias("n")
    )
    c = t.supplier.groupBy(F.col("s_nationkey").alias("key")).agg(F.min("s_name").alias("label"))
    return joins.merge_attributes(a, c, ["key"], ["label"])


@query(
    "d07_align_to_universe",
    "area n:i share:f",
    """SELECT a.area, coalesce(n, 0) AS n, share FROM (SELECT n_name AS area FROM nation) a LEFT JOIN
       (SELECT area, count(*) AS n, count(*) / 10.0 AS share FROM req WHERE area < 'NATION_3' GROUP BY 1) z ON a.area = z.area""",
    (b.REQ,),
)
def _(t):
    part = b.requests(t).where(F.col("area") < "NATION_3").groupBy("area").agg(F.count("*").alias("n"))
    return joins.align_to_universe(b.areas(t).select("area"), part.withColumn("share", F.col("n") / 10.0), "area", ["n"])


@query(
    "d10_align_scores",
    "left_rows:i right_rows:i aligned_rows:i label_mismatches:i",
    """SELECT (SELECT count(*) FROM scored) AS left_rows, (SELECT count(*) FROM scored WHERE category <> 'N') AS right_rows, count(*) AS aligned_rows,
       count(*) FILTER (WHERE y <> CASE WHEN line_no = 2 THEN 1 ELSE y END) AS label_mismatches FROM scored WHERE category <> 'N'""",
    (b.SCORED,),
)
def _(t):
    # the generator repeats some (order, line) pairs, so the key holds every column that tells rows apart
    key = F.concat_ws("|", "split", "order_key", "line_no", "category", "d", "first_score", "second_score")
    left = b.scored(t).withColumn("row_key", key)
    right = left.where("category <> 'N'").withColumn("y", F.when(F.col("line_no") == 2, 1).otherwise(F.col("y")))
    return joins.alignment_report(left, right, ["row_key"], "y")


@query(
    "d10_aligned_rows",
    "area week_start:d category y_left:i y_right:i lag_1w_count:f lag_4w_count:f",
    """SELECT area, week_start, category, is_abnormal_next_week AS y_left, CASE WHEN n > 3 THEN 1 ELSE is_abnormal_next_week END AS y_right, lag_1w_count, lag_4w_count FROM tab WHERE category <> 'N' AND is_train_ready = 1""",
    b.FULL,
)
def _(t):
    rows = stage(b.table(t).select("area", "week_start", "category", "n", "is_train_ready", "is_abnormal_next_week", "lag_1w_count", "lag_4w_count"))
    right = rows.where("category <> 'N'").withColumn("is_abnormal_next_week", F.when(F.col("n") > 3, 1).otherwise(F.col("is_abnormal_next_week")))
    keys = ["area", "week_start", "category"]
    return joins.align_scores(rows.where("is_train_ready = 1"), right, keys, "is_abnormal_next_week", {"left": "lag_1w_count", "right": "lag_4w_count"})


@query(
    "d11_threshold_lookup",
    "order_key:i line_no:i category threshold:f alert:i",
    "SELECT order_key, line_no, category, CASE category WHEN 'A' THEN 0.6 WHEN 'R' THEN 0.8 ELSE 0.5 END AS threshold, CASE WHEN first_score >= CASE category WHEN 'A' THEN 0.6 WHEN 'R' THEN 0.8 ELSE 0.5 END THEN 1 ELSE 0 END AS alert FROM scored",
    (b.SCORED,),
)
def _(t):
    thresholds = t.spark.createDataFrame([("A", 0.6), ("R", 0.8)], "category string, threshold double")
    return joins.apply_thresholds(b.scored(t), thresholds, ["category"], "first_score", F.lit(0.5))


@query(
    "d12_merge_coverage",
    "dimension missing_rows:i missing_keys:i first_missing",
    """SELECT 'small' AS dimension, sum(c) AS missing_rows, count(*) AS missing_keys, array_to_string(list(area ORDER BY area)[:20], ',') AS first_missing
       FROM (SELECT area, count(*) AS c FROM req WHERE area >= 'NATION_2' GROUP BY 1) z
       UNION ALL SELECT 'parts', sum(c), count(*), array_to_string(list(CAST(part_key AS VARCHAR) ORDER BY part_key)[:20], ',') FROM (SELECT part_key, count(*) AS c FROM req WHERE part_key % 3 = 0 GROUP BY 1) y""",
    (b.REQ,),
)
def _(t):
    dim = b.areas(t).where(F.col("area") < "NATION_2")
    parts = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("part_key"))
    return joins.merge_coverage(b.requests(t), dim, "area", "small").unionByName(joins.merge_coverage(b.requests(t), parts, "part_key", "parts"))


@query(
    "d04_duplicate_examples",
    "l_suppkey:i l_partkey:i copies:i",
    "SELECT l_suppkey, l_partkey, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(t):
    return joins.duplicate_keys(t.lineitem, ["l_suppkey", "l_partkey"])


# ---- weather ---------------------------------------------------------------------------


@query(
    "e08_pivot_daily",
    "date:d station TMAX:f TMIN:f PRCP:f SNOW:f SNWD:f AWND:f TAVG_est:f hot_day_30c:i hot_day_35c:i cold_day_0c:i rain_day:i heavy_rain_day_25mm:i snow_day:i",
    """SELECT *, ("TMAX" + "TMIN") / 2 AS "TAVG_est", CASE WHEN "TMAX" >= 30 THEN 1 ELSE 0 END AS hot_day_30c, CASE WHEN "TMAX" >= 35 THEN 1 ELSE 0 END AS hot_day_35c,
       CASE WHEN "TMIN" <= 0 THEN 1 ELSE 0 END AS cold_day_0c, CASE WHEN "PRCP" > 0 THEN 1 ELSE 0 END AS rain_day,
       CASE WHEN "PRCP" >= 25 THEN 1 ELSE 0 END AS heavy_rain_day_25mm, CASE WHEN "SNOW" > 0 THEN 1 ELSE 0 END AS snow_day FROM (
       SELECT date, station, """
    + ", ".join(f"min(value) FILTER (WHERE datatype = '{d}') AS \"{d}\"" for d in b.DATATYPES)
    + " FROM wlong GROUP BY 1, 2) z",
    (b.LONG,),
)
def _(t):
    return wx.pivot_daily(b.weather_long(t), ["date", "station"])


UNITS = {"TMAX": ("tmax", "auto"), "TMIN": ("tmin", "celsius"), "PRCP": ("prcp", "auto"), "SNOW": ("snow", "tenths_mm"), "SNWD": ("snwd", "inches"), "AWND": ("awnd", "auto")}
DECIDED = (
    b.LONG,
    "lim AS (SELECT lower(datatype) AS family, value FROM wlong WHERE abs(value) < 9990)",
    "dec AS (SELECT family, count(*) AS n_valid, min(value) AS min_value, max(value) AS max_value, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99, "
    + "CASE family WHEN 'tmin' THEN 'celsius' WHEN 'snow' THEN 'tenths_mm' WHEN 'snwd' THEN 'inches' "
    + "WHEN 'tmax' THEN CASE WHEN max(value) > 80 THEN 'tenths_c' WHEN quantile_cont(value, 0.99) > 45 THEN 'fahrenheit' ELSE 'celsius' END "
    + "WHEN 'prcp' THEN CASE WHEN quantile_cont(value, 0.99) <= 20 AND max(value) <= 80 THEN 'mm' WHEN quantile_cont(value, 0.99) > 300 OR max(value) > 600 THEN 'tenths_mm' ELSE 'mm' END "
    + "ELSE CASE WHEN quantile_cont(value, 0.99) > 50 THEN 'tenths_mps' ELSE 'mps' END END AS unit FROM lim GROUP BY 1)",
)


def _decisions(t):
    long = b.weather_long(t).withColumn("family", F.lower("datatype"))
    return long, wx.unit_decisions(long, {f: u for f, u in UNITS.values()})


@query("b13_unit_decisions", "family n_valid:i min_value:f p50:f p99:f max_value:f unit", "SELECT * FROM dec", DECIDED)
def _(t):
    return _decisions(t)[1]


@query(
    "b13_converted_values",
    "date:d station family unit value:f",
    """SELECT date, station, lower(datatype) AS family, unit, CASE WHEN abs(value) < 9990 THEN CASE WHEN unit LIKE 'tenths%' THEN value * 0.1
       WHEN unit = 'fahrenheit' THEN (value - 32) * 5.0 / 9 WHEN unit = 'inches' THEN value * 25.4 ELSE value END END AS value
       FROM wlong LEFT JOIN dec ON dec.family = lower(datatype)""",
    DECIDED,
)
def _(t):
    return wx.apply_units(*_decisions(t))


def _fam(name, cols):
    ok = [f"CASE WHEN abs({c}) < 9990 THEN {c} END" for c in cols]
    n = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in ok)
    s = " + ".join(f"coalesce({c}, 0)" for c in ok)
    low = f"least({', '.join(ok)})" if len(ok) > 1 else ok[0]
    high = f"greatest({', '.join(ok)})" if len(ok) > 1 else ok[0]
    return f"({s}) / nullif({n}, 0) AS r_{name}, {low} AS lo_{name}, {high} AS hi_{name}, {n} AS k_{name}"


ROWS = "wrow AS (SELECT date, " + ", ".join(_fam(n, c) for n, c in b.FAMILIES.items()) + " FROM wwide)"
DAILY = (
    "daily AS (SELECT *, (daily_tmax_mean + daily_tmin_mean) / 2 AS daily_tavg_mean, CAST(date_trunc('week', date) AS DATE) AS week_start FROM (SELECT date, count(*) AS source_rows, "
    + ", ".join(
        f"avg(r_{n}) AS daily_{n}_mean, min(lo_{n}) AS daily_{n}_min, max(hi_{n}) AS daily_{n}_max, count(r_{n}) AS daily_{n}_rows, sum(k_{n}) AS daily_{n}_obs"
        for n in b.FAMILIES
    )
    + " FROM wrow GROUP BY 1) z)"
)
DAYS = (b.WIDE, ROWS, DAILY)


def daily(t):
    return wx.daily_city(b.weather_wide(t), "date", b.FAMILIES)


@query(
    "e09_daily_city",
    "date:d week_start:d source_rows:i daily_tavg_mean:f "
    + " ".join(f"daily_{n}_mean:f daily_{n}_min:f daily_{n}_max:f daily_{n}_rows:i daily_{n}_obs:i" for n in b.FAMILIES),
    "SELECT * FROM daily",
    DAYS,
)
def _(t):
    return daily(t)


MEASURES = {k: v for k, v in wx.WEEKLY_MEASURES.items() if not any(x in v[1] for x in ("snwd", "awnd"))}
WEEKLY_SQL = (
    "SELECT week_start, count(DISTINCT date) AS weather_days_observed, sum(source_rows) AS weather_source_rows, "
    + ", ".join(f"{how}({c}) AS {n}" for n, (how, c) in MEASURES.items())
    + " FROM daily GROUP BY 1"
)


@query("e10_weekly_measures", "week_start:d weather_days_observed:i weather_source_rows:i " + " ".join(f"{n}:f" for n in MEASURES), WEEKLY_SQL, DAYS)
def _(t):
    d = daily(t)
    return d.groupBy("week_start").agg(*wx.weekly_measures(d))


@query(
    "e11_event_days",
    "week_start:d " + " ".join(f"{n}:i" for n, *_ in fv.WEATHER_EVENTS),
    "SELECT week_start, "
    + ", ".join(f"sum(CASE WHEN daily_{f}_mean {op} {v} THEN 1 WHEN daily_{f}_mean IS NOT NULL THEN 0 END) AS {n}" for n, f, op, v in fv.WEATHER_EVENTS)
    + " FROM daily GROUP BY 1",
    DAYS,
)
def _(t):
    d = daily(t)
    return d.groupBy("week_start").agg(*wx.event_day_counts(d))


COVER = "CASE WHEN weather_days_observed >= 7 THEN 1 ELSE 0 END AS weather_complete_week_flag, CASE WHEN weather_days_observed >= 4 THEN 1 ELSE 0 END AS weather_min_days_ok_flag, greatest(7 - weather_days_observed, 0) AS weather_days_missing_in_week"


@query(
    "e12_week_coverage",
    "week_start:d weather_days_observed:i weather_complete_week_flag:i weather_min_days_ok_flag:i weather_days_missing_in_week:i",
    f"SELECT *, {COVER} FROM (SELECT week_start, count(DISTINCT date) AS weather_days_observed FROM daily WHERE dayofmonth(date) <> 5 GROUP BY 1) z",
    DAYS,
)
def _(t):
    d = daily(t).where(F.dayofmonth("date") != 5)
    return wx.add_coverage(d.groupBy("week_start").agg(*wx.weekly_measures(d)))


@query(
    "d09_densify_weeks",
    "week_start:d week_end:d weather_days_observed:i weather_tmax_mean:f hot_day_30c_count:i weather_complete_week_flag:i weather_iso_year:i weather_week_of_year:i",
    """SELECT a.week_start, a.week_start + INTERVAL 6 DAY AS week_end, coalesce(d, 0) AS weather_days_observed, m AS weather_tmax_mean, h AS hot_day_30c_count,
       CASE WHEN coalesce(d, 0) >= 7 THEN 1 ELSE 0 END AS weather_complete_week_flag, isoyear(a.week_start) AS weather_iso_year, week(a.week_start) AS weather_week_of_year FROM
       (SELECT CAST(unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY)) AS DATE) AS week_start FROM daily WHERE month(date) <> 4) a LEFT JOIN
       (SELECT week_start, count(DISTINCT date) AS d, avg(daily_tmax_mean) AS m, sum(CASE WHEN daily_tmax_mean >= 30 THEN 1 WHEN daily_tmax_mean IS NOT NULL THEN 0 END) AS h
        FROM daily WHERE month(date) <> 4 GROUP BY 1) w ON a.week_start = w.week_start""",
    DAYS,
)
def _(t):
    return wx.weekly_weather(daily(t).where(F.month("date") != 4), densify=True)


@query(
    "e31_weather_profile",
    "feature n:i mean:f std:f min:f p50:f p95:f max:f",
    "SELECT feature, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, max(v) AS max FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM wk" for c in ("weather_tmax_max", "weather_prcp_max", "weather_snow_max"))
    + ") z WHERE v IS NOT NULL GROUP BY 1",
    (*DAYS, f"wk AS ({WEEKLY_SQL})"),
)
def _(t):
    return profile.numeric_profile(wx.weekly_weather(daily(t)), ["weather_tmax_max", "weather_prcp_max", "weather_snow_max"])


# ---- points of interest ----------------------------------------------------------------

POIS = (b.POI, POI_TYPED)


def typed_poi(t):
    return cl.classify_poi(b.poi(t), TAGS)


@query(
    "e13_poi_totals",
    "area poi_total_count:i poi_named_count:i poi_tagged_count:i poi_located_count:i",
    "SELECT area, count(*) AS poi_total_count, count(name) AS poi_named_count, count(raw_type) AS poi_tagged_count, count(*) FILTER (WHERE disc > 0.03) AS poi_located_count FROM ptyped GROUP BY 1",
    POIS,
)
def _(t):
    return ctx.poi_totals(typed_poi(t), "area", F.col("name").isNotNull(), F.col("raw_type").isNotNull(), F.col("disc") > 0.03)


POI_COUNTS = ", ".join(f"count(*) FILTER (WHERE poi_category = '{c}') AS poi_{c}_count" for c in fv.POI_CATEGORIES)


@query("e14_category_counts", "area " + " ".join(f"poi_{c}_count:i" for c in fv.POI_CATEGORIES), f"SELECT area, {POI_COUNTS} FROM ptyped GROUP BY 1", POIS)
def _(t):
    return ctx.category_counts(typed_poi(t), "area", "poi_category", fv.POI_CATEGORIES, "poi_{}_count")


def tokens(t):
    return b.poi(t).select("area", *[cln.token(F.col(c)).alias(c) for c in TAGS])


@query(
    "e15_tag_family_counts",
    "area tag_family n:i",
    "SELECT area, tag_family, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT area, '{c}' AS tag_family FROM ptyped WHERE k_{c} IS NOT NULL" for c in TAGS) + ") z GROUP BY ALL",
    POIS,
)
def _(t):
    return ctx.tag_family_counts(tokens(t), "area", TAGS)


@query(
    "e15_tag_family_shares",
    "tag_family n:i share:f",
    " UNION ALL ".join(f"SELECT '{c}' AS tag_family, count(k_{c}) AS n, count(k_{c}) / count(*) AS share FROM ptyped" for c in TAGS),
    POIS,
)
def _(t):
    return ctx.tag_family_shares(tokens(t), TAGS)


@query("e16_raw_type_richness", "area unique_raw_types:i", "SELECT area, count(DISTINCT raw_type) AS unique_raw_types FROM ptyped GROUP BY 1", POIS)
def _(t):
    return ctx.raw_type_richness(typed_poi(t), "area", "raw_type")


@query(
    "e16_top_raw_types",
    "raw_type n:i share:f",
    "SELECT raw_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM ptyped WHERE raw_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, raw_type LIMIT 200",
    POIS,
)
def _(t):
    return ctx.top_raw_types(typed_poi(t), "raw_type")


def _sum(cols):
    return "(" + " + ".join(cols) + ")"


POI_WIDE = (
    "pw AS (SELECT a.area, area_km2, "
    + ", ".join(f"coalesce(poi_{c}_count, 0) AS poi_{c}_count" for c in fv.POI_CATEGORIES)
    + ", coalesce(tot, 0) AS tot FROM areas a LEFT JOIN (SELECT area, count(*) AS tot, "
    + POI_COUNTS
    + " FROM ptyped WHERE area <> 'NATION_4' GROUP BY 1) p ON a.area = p.area)"
)
POI_LONG = (
    "pl AS (SELECT area, tot, cat, ord, c, CASE WHEN tot > 0 THEN c / tot ELSE 0 END AS s FROM ("
    + " UNION ALL ".join(f"SELECT area, tot, '{c}' AS cat, {i} AS ord, poi_{c}_count AS c FROM pw" for i, c in enumerate(fv.POI_CATEGORIES))
    + ") z)"
)
POI_DIV = f"""pd AS (SELECT area, sum(CASE WHEN s > 0 THEN -s * ln(s) ELSE 0 END) AS entropy, sum(CASE WHEN s > 0 THEN -s * ln(s) ELSE 0 END) / ln({len(fv.POI_CATEGORIES)}) AS entropy_norm,
  sum(s * s) AS hhi, CASE WHEN max(tot) > 0 THEN 1 - sum(s * s) ELSE 0 END AS mixed_use, count(*) FILTER (WHERE c > 0) AS richness,
  CASE WHEN max(c) > 0 THEN arg_max(cat, c * 100 - ord) END AS dominant, CASE WHEN max(tot) > 0 THEN max(c) / max(tot) ELSE 0 END AS dominant_share FROM pl GROUP BY 1)"""
POI_ALL = (*POIS, b.AREA, POI_WIDE, POI_LONG, POI_DIV)


def poi_table(t):
    return ctx.poi_features(typed_poi(t).where("area <> 'NATION_4'"), b.area_sizes(t))


@query(
    "e21_poi_groups",
    "area " + " ".join(f"poi_group_{g}_count:i poi_group_{g}_share:f" for g in fv.POI_GROUPS),
    "SELECT area, " + ", ".join(f"{_sum([f'poi_{m}_count' for m in ms])} AS poi_group_{g}_count, coalesce({_sum([f'poi_{m}_count' for m in ms])} / nullif(tot, 0), 0) AS poi_group_{g}_share" for g, ms in fv.POI_GROUPS.items()) + " FROM pw",
    (*POIS, b.AREA, POI_WIDE),
)
def _(t):
    return poi_table(t)


@query(
    "e22_poi_shares",
    "area " + " ".join(f"poi_{c}_share:f" for c in fv.POI_CATEGORIES),
    "SELECT area, " + ", ".join(f"coalesce(poi_{c}_count / nullif(tot, 0), 0) AS poi_{c}_share" for c in fv.POI_CATEGORIES) + " FROM pw",
    (*POIS, b.AREA, POI_WIDE),
)
def _(t):
    return poi_table(t)


@query(
    "e23_poi_density",
    "area poi_total_count:i poi_density_per_km2:f poi_log1p_total_count:f poi_log1p_density_per_km2:f",
    "SELECT area, tot AS poi_total_count, coalesce(tot / area_km2, 0) AS poi_density_per_km2, ln(1 + tot) AS poi_log1p_total_count, ln(1 + coalesce(tot / area_km2, 0)) AS poi_log1p_density_per_km2 FROM pw",
    (*POIS, b.AREA, POI_WIDE),
)
def _(t):
    return poi_table(t)


@query(
    "e24_poi_diversity",
    "area poi_entropy:f poi_entropy_norm:f poi_hhi:f poi_mixed_use_index:f poi_richness:i",
    "SELECT area, entropy AS poi_entropy, entropy_norm AS poi_entropy_norm, hhi AS poi_hhi, mixed_use AS poi_mixed_use_index, richness AS poi_richness FROM pd",
    POI_ALL,
)
def _(t):
    return poi_table(t)


@query(
    "e25_poi_dominant",
    "area poi_dominant_category poi_dominant_share:f",
    "SELECT area, dominant AS poi_dominant_category, dominant_share AS poi_dominant_share FROM pd",
    POI_ALL,
)
def _(t):
    return poi_table(t)


@query(
    "e25_dominant_long",
    "source dominant dominant_share:f",
    "SELECT source, lang AS dominant, share AS dominant_share FROM (SELECT source, lang, count(*) / sum(count(*)) OVER (PARTITION BY source) AS share, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) z WHERE r = 1",
)
def _(t):
    counts = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return ctx.dominant_of_long(counts, "source", "lang", "n")


@query(
    "e39_area_coverage",
    "metric value:i",
    """SELECT metric, value FROM (SELECT count(*) AS rows_total, count(area_km2) AS rows_with_area, count(*) FILTER (WHERE area_km2 IS NULL) AS rows_missing_area,
       count(*) FILTER (WHERE area_km2 > 0) AS rows_positive_area, count(*) FILTER (WHERE tot = 0) AS rows_zero_measure FROM pw) z
       UNPIVOT (value FOR metric IN (rows_total, rows_with_area, rows_missing_area, rows_positive_area, rows_zero_measure))""",
    (*POIS, b.AREA, POI_WIDE),
)
def _(t):
    return profile.area_coverage(poi_table(t), "area_km2", "poi_total_count")


# ---- parcels ---------------------------------------------------------------------------

PTYPED = f"""par AS (SELECT *, CASE {CODE} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.LANDUSE_CATEGORY.items())} ELSE 'unknown' END AS landuse_category
  FROM (SELECT *, trim(landuse) AS s, replace(regexp_extract(trim(landuse), '^(\\d+(?:\\.0)?)', 1), '.0', '') AS dg FROM parcel) z)"""
PARS = (b.PARCEL, PTYPED)
SUMS = {c: n for c, n in fv.PARCEL_SUMS.items() if c not in ("assesstot", "assessland", "garagearea", "strgearea", "factryarea", "otherarea")}


def typed_parcels(t):
    return b.parcels(t).withColumn("landuse_category", cl.landuse_category(F.col("landuse")))


@query(
    "e17_parcel_sums",
    "area parcel_count:i unique_bbl_count:i " + " ".join(f"{n}:f" for n in SUMS.values()),
    "SELECT area, count(*) AS parcel_count, count(DISTINCT bbl) AS unique_bbl_count, " + ", ".join(f"sum({c}) AS {n}" for c, n in SUMS.items()) + " FROM par GROUP BY 1",
    PARS,
)
def _(t):
    return ctx.parcel_sums(b.parcels(t), "area")


STATS = {c: n for c, n in fv.PARCEL_STATS.items() if c in ("lotarea", "bldgarea", "numfloors", "yearbuilt")}


@query(
    "e18_parcel_statistics",
    "area " + " ".join(f"{n}_mean:f {n}_median:f {n}_max:f" for n in STATS.values()),
    "SELECT area, " + ", ".join(f"avg({c}) AS {n}_mean, quantile_cont({c}, 0.5) AS {n}_median, max({c}) AS {n}_max" for c, n in STATS.items()) + " FROM par GROUP BY 1",
    PARS,
)
def _(t):
    return ctx.parcel_statistics(b.parcels(t), "area")


@query(
    "e19_building_age",
    "area building_age_mean:f yearbuilt_valid_count:i built_pre_1940_count:i built_1940_1979_count:i built_1980_1999_count:i built_2000_plus_count:i",
    """SELECT area, avg(2026 - yearbuilt) FILTER (WHERE ok) AS building_age_mean, count(*) FILTER (WHERE ok) AS yearbuilt_valid_count,
       count(*) FILTER (WHERE ok AND yearbuilt < 1940) AS built_pre_1940_count, count(*) FILTER (WHERE ok AND yearbuilt BETWEEN 1940 AND 1979) AS built_1940_1979_count,
       count(*) FILTER (WHERE ok AND yearbuilt BETWEEN 1980 AND 1999) AS built_1980_1999_count, count(*) FILTER (WHERE ok AND yearbuilt >= 2000) AS built_2000_plus_count
       FROM (SELECT *, yearbuilt BETWEEN 1600 AND 2026 AS ok FROM par) z GROUP BY 1""",
    PARS,
)
def _(t):
    return ctx.building_age(b.parcels(t), "area", "yearbuilt", 2026)


LU = fv.LANDUSE_CATEGORIES
LU_SQL = ", ".join(f"count(*) FILTER (WHERE landuse_category = '{c}') AS landuse_{c}_parcel_count, coalesce(sum(lotarea) FILTER (WHERE landuse_category = '{c}'), 0) AS landuse_{c}_lot_area" for c in LU)


@query("e20_landuse_pivot", "area " + " ".join(f"landuse_{c}_parcel_count:i landuse_{c}_lot_area:f" for c in LU), f"SELECT area, {LU_SQL} FROM par GROUP BY 1", PARS)
def _(t):
    return ctx.landuse_pivot(typed_parcels(t), "area", "landuse_category")


PW = (
    "paw AS (SELECT a.area, area_km2, p.* EXCLUDE (area) FROM areas a LEFT JOIN (SELECT area, count(*) AS tot, "
    + ", ".join(f"sum({c}) AS {n}" for c, n in SUMS.items())
    + f", {LU_SQL} FROM par WHERE area <> 'NATION_4' GROUP BY 1) p ON a.area = p.area)"
)
PLONG = (
    "pal AS (SELECT *, c / tot AS s FROM ("
    + " UNION ALL ".join(f"SELECT area, tot, '{c}' AS cat, {i} AS ord, landuse_{c}_parcel_count AS c FROM paw" for i, c in enumerate(LU))
    + ") z)"
)
PARCELS = (*PARS, b.AREA, PW)


def parcel_table(t):
    return ctx.parcel_features(typed_parcels(t).where("area <> 'NATION_4'"), b.area_sizes(t))


@query(
    "e20_landuse_shares",
    "area " + " ".join(f"landuse_{c}_parcel_share:f landuse_{c}_lot_area_share:f" for c in LU),
    "SELECT area, " + ", ".join(f"landuse_{c}_parcel_count / tot AS landuse_{c}_parcel_share, landuse_{c}_lot_area / nullif(lot_area_sqft_sum, 0) AS landuse_{c}_lot_area_share" for c in LU) + " FROM paw",
    PARCELS,
)
def _(t):
    return parcel_table(t)


@query(
    "e21_landuse_groups",
    "area " + " ".join(f"group_{g}_parcel_count:i group_{g}_parcel_share:f" for g in fv.LANDUSE_GROUPS),
    "SELECT area, " + ", ".join(f"coalesce({_sum([f'landuse_{m}_parcel_count' for m in ms])}, 0) AS group_{g}_parcel_count, {_sum([f'landuse_{m}_parcel_count' for m in ms])} / tot AS group_{g}_parcel_share" for g, ms in fv.LANDUSE_GROUPS.items()) + " FROM paw",
    PARCELS,
)
def _(t):
    return parcel_table(t)


@query(
    "e22_composition_ratios",
    "area observed_built_far:f commercial_area_share:f residential_area_share:f office_area_share:f retail_area_share:f residential_unit_share:f",
    """SELECT area, building_area_sqft_sum / nullif(lot_area_sqft_sum, 0) AS observed_built_far, commercial_area_sqft_sum / nullif(building_area_sqft_sum, 0) AS commercial_area_share,
       residential_area_sqft_sum / nullif(building_area_sqft_sum, 0) AS residential_area_share, office_area_sqft_sum / nullif(building_area_sqft_sum, 0) AS office_area_share,
       retail_area_sqft_sum / nullif(building_area_sqft_sum, 0) AS retail_area_share, residential_units_sum / nullif(total_units_sum, 0) AS residential_unit_share FROM paw""",
    PARCELS,
)
def _(t):
    return parcel_table(t)


@query(
    "e23_parcel_density",
    "area parcel_count:i parcel_count_density_per_km2:f total_units_sum_density_per_km2:f",
    "SELECT area, coalesce(tot, 0) AS parcel_count, coalesce(tot, 0) / area_km2 AS parcel_count_density_per_km2, coalesce(total_units_sum, 0) / area_km2 AS total_units_sum_density_per_km2 FROM paw",
    PARCELS,
)
def _(t):
    return parcel_table(t)


@query(
    "e24_landuse_diversity",
    "area landuse_entropy:f landuse_entropy_norm:f landuse_hhi:f landuse_mixed_use_index:f dominant_landuse dominant_landuse_share:f",
    f"""SELECT area, sum(CASE WHEN s > 0 THEN -s * ln(s) WHEN tot IS NOT NULL THEN 0 END) AS landuse_entropy, sum(CASE WHEN s > 0 THEN -s * ln(s) WHEN tot IS NOT NULL THEN 0 END) / ln({len(LU)}) AS landuse_entropy_norm,
        sum(s * s) AS landuse_hhi, 1 - sum(s * s) AS landuse_mixed_use_index, arg_max(cat, c * 100 - ord) AS dominant_landuse, max(c) / max(tot) AS dominant_landuse_share FROM pal GROUP BY 1""",
    (*PARCELS, PLONG),
)
def _(t):
    return parcel_table(t)


PG = ["residential", "mixed_use", "commercial", "industrial", "transportation_utility", "public_facility", "open_space", "parking", "vacant", "unknown"]
PTOT = {c: n for c, n in fv.PARCEL_TOTALS.items() if c in SUMS}


@query(
    "e26_simple_landuse",
    "area lot_count:i avg_num_floors:f residential_area_ratio:f building_area_to_lot_area_ratio:f " + " ".join(f"{n}:f" for n in PTOT.values()) + " " + " ".join(f"lot_count_{g}:i lot_area_{g}:f lot_area_ratio_{g}:f" for g in PG),
    "SELECT *, total_residential_area / nullif(total_building_area, 0) AS residential_area_ratio, total_building_area / nullif(total_lot_area, 0) AS building_area_to_lot_area_ratio, "
    + ", ".join(f"lot_area_{g} / nullif(total_lot_area, 0) AS lot_area_ratio_{g}" for g in PG)
    + " FROM (SELECT area, count(bbl) AS lot_count, avg(numfloors) AS avg_num_floors, "
    + ", ".join(f"coalesce(sum({c}), 0) AS {n}" for c, n in PTOT.items())
    + ", "
    + ", ".join(f"count(bbl) FILTER (WHERE g = '{g}') AS lot_count_{g}, coalesce(sum(lotarea) FILTER (WHERE g = '{g}'), 0) AS lot_area_{g}" for g in PG)
    + " FROM (SELECT *, CASE c "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.PARCEL_GROUP.items())
    + " ELSE 'unknown' END AS g FROM (SELECT *, CASE WHEN TRY_CAST(trim(landuse) AS DOUBLE) IS NOT NULL THEN CAST(CAST(TRY_CAST(trim(landuse) AS DOUBLE) AS INTEGER) AS VARCHAR) ELSE trim(landuse) END AS c FROM parcel) y) x GROUP BY 1) z",
    (b.PARCEL,),
)
def _(t):
    return ctx.simple_landuse(b.parcels(t).withColumn("landuse_group", cl.parcel_group(F.col("landuse"))))


@query(
    "e27_preaggregated_check",
    "table_name keyed_rows:i distinct_keys:i preaggregated:i",
    """SELECT 'supplier' AS table_name, count(s_suppkey) AS keyed_rows, count(DISTINCT s_suppkey) AS distinct_keys, CASE WHEN count(s_suppkey) = count(DISTINCT s_suppkey) THEN 1 ELSE 0 END AS preaggregated FROM supplier
       UNION ALL SELECT 'lineitem', count(l_suppkey), count(DISTINCT l_suppkey), CASE WHEN count(l_suppkey) = count(DISTINCT l_suppkey) THEN 1 ELSE 0 END FROM lineitem""",
)
def _(t):
    one = ctx.is_one_row_per_key(t.supplier, "s_suppkey").withColumn("table_name", F.lit("supplier"))
    return one.unionByName(ctx.is_one_row_per_key(t.lineitem, "l_suppkey").withColumn("table_name", F.lit("lineitem")))


@query(
    "e27_standardised",
    "area lu_lots:i lu_size:f lu_lots_density_per_km2:f",
    "SELECT a.area, lots AS lu_lots, size AS lu_size, lots / area_km2 AS lu_lots_density_per_km2 FROM areas a LEFT JOIN (SELECT area, count(*) AS lots, sum(qty) AS size FROM req WHERE area <> 'NATION_9' GROUP BY 1) z ON z.area = a.area",
    (b.REQ, b.AREA),
)
def _(t):
    pre = b.requests(t).where("area <> 'NATION_9'").groupBy("area").agg(F.count("*").alias("lots"), F.sum("qty").alias("lu_size"))
    return ctx.standardise_preaggregated(pre, b.area_sizes(t), "area", "lu_", "lots")


@query(
    "f13_top_areas",
    "measure area value:f rank:i",
    "SELECT * FROM (SELECT measure, area, value, row_number() OVER (PARTITION BY measure ORDER BY value DESC, area) AS rank FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS measure, area, CAST({e} AS DOUBLE) AS value FROM paw WHERE {e} IS NOT NULL" for n, e in {"parcel_count": "coalesce(tot, 0)", "lot_area_sqft_sum": "coalesce(lot_area_sqft_sum, 0)", "observed_built_far": "building_area_sqft_sum / nullif(lot_area_sqft_sum, 0)"}.items())
    + ") y) z WHERE rank <= 20",
    PARCELS,
)
def _(t):
    return report.top_areas(parcel_table(t), "area", ["parcel_count", "lot_area_sqft_sum", "observed_built_far"])


# ---- assembly --------------------------------------------------------------------------


def dimensions(t):
    """Weekly weather without April days, points of interest and parcels without one area each."""
    weather = wx.weekly_weather(daily(t).where(F.month("date") != 4)).select("week_start", "weather_tmax_mean", "weather_prcp_max", "weather_complete_week_flag")
    poi = typed_poi(t).where("area <> 'NATION_4'").groupBy("area").agg(F.count("*").alias("poi_total_count"))
    land = b.parcels(t).where("area <> 'NATION_9'").groupBy("area").agg(
        F.count("*").alias("parcel_count"), F.avg("numfloors").alias("num_floors_mean"), (F.sum("resarea") / F.sum("bldgarea")).alias("residential_share")
    )
    # each is written once: the join, the medians and the flags then read a small table with known size
    return {"weather": (stage(weather), ["week_start"]), "poi": (stage(poi), ["area"]), "landuse": (stage(land), ["area"])}


DIMS = (
    "dw AS (SELECT week_start, avg(daily_tmax_mean) AS weather_tmax_mean, max(daily_prcp_mean) AS weather_prcp_max, CASE WHEN count(DISTINCT date) >= 7 THEN 1 ELSE 0 END AS weather_complete_week_flag FROM daily WHERE month(date) <> 4 GROUP BY 1)",
    "dp AS (SELECT area, count(*) AS poi_total_count FROM poi WHERE area <> 'NATION_4' GROUP BY 1)",
    "dl AS (SELECT area, count(*) AS parcel_count, avg(numfloors) AS num_floors_mean, sum(resarea) / sum(bldgarea) AS residential_share FROM parcel WHERE area <> 'NATION_9' GROUP BY 1)",
)
JOINED = """joined AS (SELECT tab.*, dw.* EXCLUDE (week_start), dp.* EXCLUDE (area), dl.* EXCLUDE (area), dw.week_start IS NOT NULL AS hw, dp.area IS NOT NULL AS hp, dl.area IS NOT NULL AS hl
  FROM tab LEFT JOIN dw ON dw.week_start = tab.week_start LEFT JOIN dp ON dp.area = tab.area LEFT JOIN dl ON dl.area = tab.area)"""
ASSEMBLY = (*b.FULL, *DAYS, b.POI, b.PARCEL, *DIMS, JOINED)


def joined(t, dims=None, fact=None):
    """Every dimension above is grouped by its key, so the uniqueness check would only repeat that."""
    return joins.attach_dimensions(b.table(t) if fact is None else fact, dims or dimensions(t), check=False)


@query(
    "q01_imputation_defaults",
    "source column_name strategy value:f",
    """SELECT 'weather' AS source, 'weather_tmax_mean' AS column_name, 'median' AS strategy, median(weather_tmax_mean) AS value FROM dw
       UNION ALL SELECT 'weather', 'weather_prcp_max', 'median', median(weather_prcp_max) FROM dw
       UNION ALL SELECT 'weather', 'weather_complete_week_flag', 'median', median(weather_complete_week_flag) FROM dw
       UNION ALL SELECT 'poi', 'poi_total_count', 'zero', 0 UNION ALL SELECT 'landuse', 'parcel_count', 'zero', 0
       UNION ALL SELECT 'landuse', 'num_floors_mean', 'median', median(num_floors_mean) FROM dl
       UNION ALL SELECT 'landuse', 'residential_share', 'zero', 0""",
    (*DAYS, b.PARCEL, *[d for d in DIMS if not d.startswith("dp")]),
)
def _(t):
    return quality.imputation_defaults(dimensions(t))


@query(
    "q02_apply_defaults",
    "area week_start:d category weather_tmax_mean:f poi_total_count:i num_floors_mean:f residential_share:f parcel_count:i",
    """SELECT area, week_start, category, coalesce(weather_tmax_mean, (SELECT median(weather_tmax_mean) FROM dw)) AS weather_tmax_mean, coalesce(poi_total_count, 0) AS poi_total_count,
       coalesce(num_floors_mean, (SELECT median(num_floors_mean) FROM dl)) AS num_floors_mean, coalesce(residential_share, 0) AS residential_share, coalesce(parcel_count, 0) AS parcel_count FROM joined""",
    ASSEMBLY,
)
def _(t):
    dims = dimensions(t)
    return quality.apply_defaults(joined(t, dims), quality.imputation_defaults(dims))


QF = ["weather_missing_flag", "poi_missing_flag", "landuse_table_missing_flag", "landuse_source_missing_flag", "zero_poi_flag", "weather_incomplete_week_flag", "all_merged_flag", "final_train_ready_flag"]
FLAGS_SQL = """SELECT *, CAST(NOT hw AS INTEGER) AS weather_missing_flag, CAST(NOT hp AS INTEGER) AS poi_missing_flag, CAST(NOT hl AS INTEGER) AS landuse_table_missing_flag,
    CAST(NOT hl AS INTEGER) AS landuse_source_missing_flag, CASE WHEN coalesce(poi_total_count, 0) = 0 THEN 1 ELSE 0 END AS zero_poi_flag,
    CASE WHEN coalesce(weather_complete_week_flag, 0) <> 1 THEN 1 ELSE 0 END AS weather_incomplete_week_flag, CAST(hw AND hp AND hl AS INTEGER) AS all_merged_flag,
    CASE WHEN hw AND hp AND hl AND is_train_ready = 1 AND is_abnormal_next_week IS NOT NULL THEN 1 ELSE 0 END AS final_train_ready_flag FROM joined"""


@query("q03_quality_flags", "area week_start:d category " + " ".join(f"{c}:i" for c in QF), FLAGS_SQL, ASSEMBLY)
def _(t):
    return quality.add_quality_flags(joined(t))


@query(
    "q03_quality_flag_counts",
    "flag flag_value:i n:i share:f",
    "SELECT flag, flag_value, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY flag) AS share FROM (SELECT * FROM flagged UNPIVOT (flag_value FOR flag IN (" + ", ".join(QF) + "))) z GROUP BY 1, 2",
    (*ASSEMBLY, f"flagged AS (SELECT {', '.join(QF)} FROM ({FLAGS_SQL}) y)"),
)
def _(t):
    return profile.flag_counts(quality.add_quality_flags(joined(t)), QF)


@query(
    "q04_source_missing",
    "order_key:i line_no:i source_missing:i",
    "SELECT order_key, line_no, CASE WHEN request_type IS NULL AND descriptor IS NULL THEN 1 ELSE 0 END AS source_missing FROM req",
    (b.REQ,),
)
def _(t):
    return b.requests(t).withColumn("source_missing", quality.source_missing(["request_type", "descriptor"]))


@query(
    "q05_binary_columns",
    "column_name has_other_values:i",
    """SELECT 'first_line' AS column_name, 0 AS has_other_values UNION ALL SELECT 'with_null', 0 UNION ALL
       SELECT 'l_linenumber', max(CASE WHEN l_linenumber NOT IN (0, 1) THEN 1 ELSE 0 END) FROM lineitem""",
)
def _(t):
    n = F.col("l_linenumber")
    li = t.lineitem.select((n == 1).cast("int").alias("first_line"), F.when(n != 2, (n == 1).cast("int")).alias("with_null"), n)
    return quality.binary_report(li, ["first_line", "with_null", "l_linenumber"])


@query(
    "q06_row_count",
    "rows_before:i rows_after:i row_count_preserved:i",
    "SELECT count(*) AS rows_before, (SELECT count(*) FROM joined) AS rows_after, CASE WHEN count(*) = (SELECT count(*) FROM joined) THEN 1 ELSE 0 END AS row_count_preserved FROM tab",
    ASSEMBLY,
)
def _(t):
    return obs.row_counts(b.table(t), lambda fact: joined(t, fact=fact))


def audit_sql(tab: str) -> str:
    lag = lambda k: f"""SELECT 'lag_{k}w_count equals the count {k} weeks earlier', coalesce(sum(CASE WHEN wrong > 0 THEN n END), 0) FROM (
         SELECT count(*) AS n, count(*) FILTER (WHERE a.lag_{k}w_count IS DISTINCT FROM CAST(p.n AS DOUBLE)) AS wrong FROM {tab} a
         LEFT JOIN dense p ON p.area = a.area AND p.category = a.category AND p.week_start = a.week_start - INTERVAL {7 * k} DAY GROUP BY a.area, a.category, a.week_start) c{k}"""  # noqa: E731
    return f"""SELECT "check", violations, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
       SELECT 'target years stay inside their split' AS "check", count(*) FILTER (WHERE (time_split = 'train' AND NOT coalesce(target_year <= 1998, false)) OR (time_split = 'validation' AND NOT coalesce(target_year = 1999, false))
         OR (time_split = 'test' AND NOT coalesce(target_year >= 2000, false))) AS violations FROM {tab}
       UNION ALL SELECT 'one split and one row per key', count(*) FROM (SELECT 1 FROM {tab} GROUP BY area, category, week_start HAVING count(*) > 1) r
       UNION ALL SELECT 'the target week follows the feature week', count(*) FILTER (WHERE target_week <> week_start + INTERVAL 7 DAY) FROM {tab}
       UNION ALL {lag(1)} UNION ALL {lag(52)} UNION ALL SELECT 'no forbidden feature names', {{names}}) z"""


TAMPERED = """bent AS (SELECT * FROM (SELECT * REPLACE (CASE WHEN history_weeks % 10 = 3 THEN lag_1w_count + 1 ELSE lag_1w_count END AS lag_1w_count, CASE WHEN history_weeks % 60 = 59 THEN NULL ELSE lag_52w_count END AS lag_52w_count,
  CAST(CASE WHEN history_weeks % 50 = 7 THEN target_week + INTERVAL 7 DAY ELSE target_week END AS DATE) AS target_week, CASE WHEN time_split = 'test' AND history_weeks % 9 = 0 THEN 'train' ELSE time_split END AS time_split) FROM tab) b0
  UNION ALL SELECT * REPLACE ('validation' AS time_split) FROM tab WHERE history_weeks = 100)"""


def audited(t, bend=lambda df: df, names=()):
    panel = stage(b.dense(t))  # the only evaluation of the panel
    return quality.leakage_audit(
        bend(b.table(t, panel)),
        panel,
        ["area", "category"],
        {"train": (1900, 1998), "validation": (1999, 1999), "test": (2000, 2100)},
        {"lag_1w_count": 1, "lag_52w_count": 52},
        ["lag_1w_count", "rolling_8w_mean", "week_of_year", *names],
    )


@query("q10_leakage_audit", "check violations:i status", audit_sql("tab").format(names=0), b.FULL)
def _(t):
    return audited(t)


@query("q10_tampered_audit", "check violations:i status", audit_sql("bent").format(names=2), (*b.FULL, TAMPERED))
def _(t):
    h = F.col("history_weeks")

    def bend(df):
        bent = df.withColumns(
            {
                "lag_1w_count": F.when(h % 10 == 3, F.col("lag_1w_count") + 1).otherwise(F.col("lag_1w_count")),
                "lag_52w_count": F.when(h % 60 != 59, F.col("lag_52w_count")),
                "target_week": F.when(h % 50 == 7, F.date_add("target_week", 7)).otherwise(F.col("target_week")),
                "time_split": F.when((F.col("time_split") == "test") & (h % 9 == 0), "train").otherwise(F.col("time_split")),
            }
        )
        return bent.unionByName(df.where(h == 100).withColumn("time_split", F.lit("validation")))

    return audited(t, bend, ["next_week_count", "future_mean"])


