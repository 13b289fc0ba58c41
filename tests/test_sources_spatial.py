import json
import math
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import context, spatial
from panelwright.sources import columns, files
from panelwright.streaming import weekly


def square(low, high):
    return [[low, low], [high, low], [high, high], [low, high], [low, low]]


@pytest.fixture()
def geojson(tmp_path):
    holed = {"type": "Polygon", "coordinates": [square(0, 4), square(1, 2)]}
    pair = {"type": "MultiPolygon", "coordinates": [[square(10, 11)], [square(12, 13)]]}
    features = [{"type": "Feature", "properties": {"Code": c, "Name": c * 2}, "geometry": g} for c, g in (("h", holed), ("m", pair))]
    path = tmp_path / "areas.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    return str(path)


def test_points_in_holed_and_multi_polygons(spark, geojson):
    areas = files.read_polygons(spark, geojson, ["code", "name"])
    assert {r["code"]: r["name"] for r in areas.collect()} == {"h": "hh", "m": "mm"}
    points = {1: (0.5, 0.5), 2: (1.5, 1.5), 3: (3.9, 2.2), 4: (10.5, 10.5), 5: (12.5, 12.2), 6: (11.5, 11.5), 7: (None, 1.0), 8: (-1.0, -1.0)}
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in points.items()], "i int, lon double, lat double")
    for step in (0.7, 3.3):
        got = {r["i"]: r["code"] for r in spatial.assign_areas(df, areas, "code", step).collect()}
        assert got == {1: "h", 2: None, 3: "h", 4: "m", 5: "m", 6: None, 7: None, 8: None}
    plan = spatial.assign_areas(df, areas, "code", 0.7)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_beyond_the_broadcast_limit_a_shuffle_join_gives_the_same(spark, geojson, monkeypatch):
    areas = files.read_polygons(spark, geojson, ["code"])
    df = spark.createDataFrame([(i, i % 140 / 10, i % 130 / 10) for i in range(500)], "i int, lon double, lat double")
    small = sorted(map(str, spatial.assign_areas(df, areas, "code", 0.7).collect()))
    monkeypatch.setattr(spatial, "BROADCAST_BYTES", 3)
    assert sorted(map(str, spatial.assign_areas(df, areas, "code", 0.7).collect())) == small


def wild_areas(spark, seed=7):
    """Overlapping stars with holes, two parts, level edges, and corners that lie on cell borders."""
    rnd = random.Random(seed)

    def star(x, y, low, high, n):
        ring = [(x + rnd.uniform(low, high) * math.cos(2 * math.pi * i / n), y + rnd.uniform(low, high) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        ring = [(round(a * 4) / 4, round(b * 4) / 4) if rnd.random() < 0.2 else (a, b) for a, b in ring]
        return [*ring, ring[0]]

    rows = [(f"s{i}", [[star(rnd.uniform(-9, 9), rnd.uniform(-9, 9), 2, 5, 60), star(0, 0, 0.2, 1, 9)], [star(rnd.uniform(-9, 9), 12, 1, 2, 25)]]) for i in range(6)]
    rows += [("box", [[[(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]]), ("s0", [[[(-1.0, -1.0), (1.0, -1.0), (0.0, 1.0), (-1.0, -1.0)]]]), ("none", [])]
    return spark.createDataFrame(rows, f"code string, polygons {spatial.RINGS}")


@pytest.mark.parametrize("step", [0.25, 0.7, 5.0, 100.0])
def test_cells_decide_like_whole_rings(spark, step):
    areas = wild_areas(spark)
    rnd = random.Random(1)
    corners = [(p["lon"], p["lat"]) for r in areas.collect() for poly in r.polygons for ring in poly for p in ring][:150]
    spots = [(rnd.uniform(-15, 15), rnd.uniform(-15, 15)) for _ in range(1500)] + corners + [(x / 4, y / 4) for x in range(-20, 20) for y in range(-8, 8)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)], "i int, lon double, lat double")
    want = df.crossJoin(areas).where(spatial.inside(F.col("lon"), F.col("lat"), F.col("polygons"))).select("i", "code")
    got = spatial.assign_areas(df, areas, "code", step).where("code is not null").select("i", "code")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_cell_row_holds_its_own_edges_only(spark):
    areas = wild_areas(spark)
    cells = spatial.polygon_cells(areas, "code", 0.25)
    assert dict(cells.dtypes)["_edges"].startswith("array<struct<a:") and "polygons" not in cells.columns
    sizes = cells.select(F.size("_edges").alias("e"), F.size("_flips").alias("f")).collect()
    assert max(r.e for r in sizes) < 20 and max(r.f for r in sizes) < 20  # of 94 edges in an area
    assert sum(r.e == 0 and r.f == 1 for r in sizes) > 100  # cells wholly inside


def test_polygon_area_counts_holes_and_parts(spark, geojson):
    areas = files.read_polygons(spark, geojson, ["code"])
    got = {r["code"]: r["area_km2"] for r in spatial.area_km2(areas, "code", 0.0).collect()}
    degree = (3.141592653589793 / 180 * 6371008.8) ** 2 / 1e6
    assert got["h"] == pytest.approx(15 * degree) and got["m"] == pytest.approx(2 * degree)
    assert {r["code"] for r in spatial.area_km2(areas, "code").collect()} == {"h", "m"}


def test_poi_json(spark, tmp_path):
    elements = [
        {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"amenity": "cafe", "addr:city": "X", "odd key": "v"}},
        {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"name": "N"}},
        {"type": "relation", "id": 3, "tags": {"amenity": "bar"}},
    ]
    path = tmp_path / "poi.json"
    path.write_text(json.dumps({"elements": elements}))
    got = {r["osm_id"]: r for r in files.read_poi(spark, str(path), "amenity", "box").collect()}
    assert set(got) == {1, 2} and got[2]["lat"] == 3.0 and got[1]["addr_city"] == "X"
    assert json.loads(got[1]["all_tags"])["odd key"] == "v" and got[2]["matched_tag_value"] is None


def test_csv_parts_headers_and_guards(spark, tmp_path):
    part = tmp_path / "parts"
    df = spark.createDataFrame([("1", "x"), ("2", "y")], ["Unique Key", "Complaint-Type"])
    files.write_table(df.coalesce(1), str(part), "csv", options={"compression": "gzip"})
    with pytest.raises(Exception, match="(?i)already exists"):
        files.write_table(df, str(part), "csv")
    (tmp_path / "summary_part.csv").write_text("unique_key,complaint_type\n9,z\n")
    got = files.scan_parts(spark, [str(part), str(tmp_path / "summary_part.csv")], ["unique_key"], ["complaint_type", "absent"])
    assert sorted((r["unique_key"], r["complaint_type"]) for r in got.collect()) == [("1", "x"), ("2", "y")]
    with pytest.raises(ValueError, match="lacks required"):
        files.scan_parts(spark, str(part), ["no_such"])


def test_partitioned_landing_prunes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2020-{1 + i % 3:02d}") for i in range(30)], "i int, month string")
    path = files.land(df, str(tmp_path / "landed"), ["month"])
    one = spark.read.parquet(path).where("month = '2020-02'")
    assert one.count() == 10
    assert "PartitionFilters: [isnotnull(month" in one._jdf.queryExecution().executedPlan().toString()


def test_header_rules_and_resolution(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("My Col", "my-col", "??")
    assert columns.normalise_headers(df).columns == ["my_col", "my_col_2", "unnamed"]
    assert columns.resolve(["Lat", "LON"], {"latitude": ["latitude", "lat"], "x": ["zzz"]}) == {"latitude": "Lat", "x": None}


def test_weather_columns_skip_flags_and_derived(spark):
    df = spark.createDataFrame([("1.5", "x", 1, "q", None)], "`Max Temp` string, prcp_attributes string, rain_day int, note string, snow string")
    assert columns.weather_columns(df) == {"tmax": ["Max Temp"]}


def test_only_new_files_are_ingested(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(5).coalesce(1).write.parquet(source)
    stream = weekly.stream_parts(spark, source, spark.range(1).schema)
    weekly.ingest_available(stream, target, state)
    weekly.ingest_available(stream, target, state)
    assert spark.read.parquet(target).count() == 5
    spark.range(3).coalesce(1).write.mode("append").parquet(source)
    weekly.ingest_available(stream, target, state)
    assert spark.read.parquet(target).count() == 8
    seen = files.list_files(spark, source, "*.parquet")
    assert files.unseen_files(seen, seen.limit(1)).count() == seen.count() - 1


def test_incremental_weekly_counts_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(source)
        stream = weekly.stream_parts(spark, source, events.schema)
        weekly.weekly_totals_available(stream, "ts", ["event_type"], target, state)
    got = sorted(map(tuple, weekly.read_weekly_totals(spark, target, ["event_type"]).collect()))
    from panelwright.functions.calendar import week_start

    want = sorted(map(tuple, events.groupBy(week_start(F.col("ts")).alias("w"), "event_type").count().collect()))
    assert got == want


def test_watermarked_stream_emits_closed_weeks(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    stream = weekly.stream_parts(spark, source, spark.read.parquet(source).schema)
    counts = weekly.weekly_counts_stream(stream, "ts", ["event_type"], "1 day")
    weekly.ingest_available(counts, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() > 0 and got.where(F.weekday("week_start") != 0).count() == 0


def test_diversity_and_dominance(spark):
    df = spark.createDataFrame([(2, 2, 0), (0, 0, 0), (5, 0, 0)], "a int, b int, c int")
    cols = [F.col(c) for c in "abc"]
    d = context.diversity(cols)
    name, share = context.dominant(cols, ["a", "b", "c"])
    rows = df.select(d["entropy"].alias("e"), d["hhi"].alias("h"), d["richness"].alias("r"), name.alias("n"), share.alias("s")).collect()
    assert rows[0]["e"] == pytest.approx(0.6931471805599453) and rows[0]["h"] == 0.5 and rows[0]["n"] == "a"
    assert (rows[1]["e"], rows[1]["h"], rows[1]["n"], rows[1]["s"]) == (0.0, 0.0, None, None)
    assert rows[2]["r"] == 1 and rows[2]["e"] == pytest.approx(0.0, abs=1e-12)


def test_csv_parts_are_bound_by_name(spark, tmp_path):
    part = tmp_path / "parts"
    part.mkdir()
    (part / "A_Summary.csv").write_text("rows,file\n2,x\n")
    (part / "b.csv").write_text("unique_key,borough,latitude\n1,X,40.5\n")
    (part / "c.csv").write_text("borough,unique_key\nY,2\n")
    (part / "d.csv").write_text("unique_key,latitude\n3,41.5\n")
    (part / "e.csv").write_text("")
    got = files.scan_parts(spark, str(part), ["unique_key"], ["borough", "latitude"])
    assert sorted((r["unique_key"], r["borough"] or "", r["latitude"] or "") for r in got.collect()) == [("1", "X", "40.5"), ("2", "Y", ""), ("3", "", "41.5")]
    with pytest.raises(FileNotFoundError):
        files.scan_parts(spark, str(part / "A_Summary.csv"), ["rows"])
