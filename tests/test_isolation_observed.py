import gzip
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators import observed, panel, profile
from panelwright.plans import bindings
from panelwright.plans.registry import Tables
from panelwright.sources import columns, isolate

KINDS = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("state", T.StringType())])


def write_parts(folder):
    folder.mkdir()
    good = "key,state\n" + "".join(f"{i},s{i}\n" for i in range(3000))
    (folder / "a good.csv").write_text(good)
    (folder / "b+good.csv.gz").write_bytes(gzip.compress(good.encode()))
    (folder / "cut.csv.gz").write_bytes(gzip.compress(good.encode())[:-4000])
    (folder / "garbage.csv.gz").write_bytes(b"\x1f\x8b\x08 no archive at all")
    (folder / "header.csv").write_text("state,key\nx,1\n")
    (folder / "empty.csv").write_text("")
    (folder / "only_header.csv").write_text('﻿"key",state\n')
    (folder / "records.csv").write_text('key,state\n1,ok\n2,"open\n3\n4,"closed"\n\n5,a,more\nsix,ok\n"7,ok\n8,ok\n')


def test_each_broken_file_is_named_and_the_others_are_whole(spark, tmp_path):
    write_parts(tmp_path / "parts")
    got = isolate.scan_isolated(spark, str(tmp_path / "parts"), KINDS)
    status = {r.path.rsplit("/", 1)[1].replace("%20", " "): r for r in got.status.collect()}
    assert len(status) == 7  # a file of no bytes holds nothing to read
    for name, rows, corrupt in (("a good.csv", 3000, 0), ("b+good.csv.gz", 3000, 0), ("only_header.csv", 0, 0), ("records.csv", 8, 5)):
        r = status[name]
        assert (r.status, r.rows_read, r.corrupt_rows, r.error) == ("read", rows, corrupt, None), name
    for name, why in (("cut.csv.gz", "(?i)end of input|EOF"), ("garbage.csv.gz", "."), ("header.csv", "no header line key,state")):
        r = status[name]
        assert (r.status, r.rows_read, r.corrupt_rows) == ("unreadable", None, None)
        assert re.search(why, r.error)
    rows = got.rows.groupBy("source_file").count().collect()
    assert {r.source_file.replace("%20", " "): r["count"] for r in rows} == {"a good.csv": 3000, "b+good.csv.gz": 3000, "records.csv": 3}
    assert sorted(r.key for r in got.rows.where("source_file = 'records.csv'").collect()) == [1, 4, 8]
    assert {r._corrupt_record for r in got.corrupt.collect()} == {'2,"open', "3", "5,a,more", "six,ok", '"7,ok'}


def test_no_file_only_broken_files_and_other_formats(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        isolate.scan_isolated(spark, str(tmp_path / "none"), KINDS)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.csv.gz").write_bytes(b"\x1f\x8b\x08 nothing")
    bad = isolate.scan_isolated(spark, str(tmp_path / "bad"), KINDS)
    assert bad.rows.collect() == [] and bad.corrupt.collect() == [] and bad.status.first().status == "unreadable"
    spark.range(50).select(F.col("id").cast("int").alias("key"), F.lit("s").alias("state")).coalesce(1).write.parquet(str(tmp_path / "pq"))
    (tmp_path / "pq/part-broken.parquet").write_text("PAR1 and no more")
    pq = isolate.scan_isolated(spark, str(tmp_path / "pq"), KINDS, "parquet", pattern="part-*.parquet")
    assert sorted((r.status, r.rows_read) for r in pq.status.collect()) == [("read", 50), ("unreadable", None)]
    assert pq.rows.count() == 50
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.csv").write_text('key,state\n1,"two\nlines"\n2\n')
    multi = isolate.scan_isolated(spark, str(tmp_path / "m"), KINDS, options={"multiLine": True})
    assert [r.state for r in multi.rows.collect()] == ["two\nlines"] and multi.status.first().corrupt_rows == 1


def test_a_sound_list_of_files_takes_one_attempt(spark):
    asked = []
    files_ = [f"f{i}" for i in range(100)]

    def run(group):
        asked.append(len(group))
        if "f37" in group:
            from pyspark.errors import PySparkException

            raise PySparkException("broken")
        return spark.range(1)

    results, broken = isolate.attempt([f for f in files_ if f != "f37"], run)
    assert asked == [99] and len(results) == 1 and not broken
    asked.clear()
    results, broken = isolate.attempt(files_, run)
    assert list(broken) == ["f37"] and "broken" in broken["f37"] and len(asked) <= 3 * isolate.WAYS + 1


def test_removed_rows_and_row_counts_ride_on_one_scan(spark):
    df = spark.createDataFrame([(1.0, 1.0), (9.0, 1.0), (None, 1.0), (2.0, None), (1.5, 1.5)], "lat double, lon double")
    seen = Observation()
    kept = observed.keep_in_box(df, "lat", "lon", {"south": 0, "north": 2, "west": 0, "east": 2}, seen)
    assert kept.count() == 2
    assert seen.get == {"rows_read": 5, "missing_rows": 2, "outside_rows": 1, "removed_rows": 3}
    grown = observed.row_counts(df, lambda x: x.withColumn("i", F.explode(F.array(F.lit(1), F.lit(2))))).first()
    assert tuple(grown) == (5, 10, 0)
    assert tuple(observed.row_counts(df, lambda x: x.withColumn("i", F.lit(1))).first()) == (5, 5, 1)


def test_densify_reports_what_has_no_cell_and_reads_the_requests_once(spark, monkeypatch):
    rows = [("a", "2020-01-06", "p", 3), ("a", "2020-01-20", "q", 4), ("zz", "2020-01-13", "p", 5), ("b", "2020-01-13", "odd", 6), (None, "2020-01-13", "p", 7)]
    obs = spark.createDataFrame(rows, "area string, week_start string, category string, n long").withColumn("week_start", F.to_date("week_start"))
    ledger = Observation()
    dense = panel.densify(obs, spark.createDataFrame([("a",), ("b",)], "area string"), ["p", "q"], ledger=ledger)
    assert dense.count() == 2 * 3 * 2
    assert ledger.get == {"grid_cells": 12, "grid_count": 7, "off_grid_cells": 3, "off_grid_count": 18}
    plans = []
    real = panel.stage
    monkeypatch.setattr(panel, "stage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    whole = bindings.dense(Tables(spark, "/root/testdata/sf0.001"))
    plans.append(whole._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("lineitem.parquet") for p in plans) == 1


def test_resolvers_follow_the_rules_of_their_table(spark):
    find = lambda kind, *names: {n: c for n, c in columns.RESOLVERS[kind].find(names).items() if c}
    assert find("requests", "Created Date", "complaint-type", "NTA", "nta_code", "Borough Name") == {"created_date": "Created Date", "complaint_type": "complaint-type", "nta2020": "NTA", "boroname": "Borough Name"}
    assert find("requests", "unique_key", "Unique Key") == {"unique_key": "Unique Key"}  # the later one
    assert find("parcels", "Lot Area", "lot_area", "N.T.A.") == {"lotarea": "Lot Area", "nta2020": "N.T.A."}  # the first, by letters alone
    assert find("poi", "Y", "X", "id", "element_id", "N.T.A.") == {"latitude": "Y", "longitude": "X", "osm_id": "id"}
    df = spark.createDataFrame([(1, 2)], "`odd``name` int, `BBL` int")
    with pytest.raises(ValueError, match="nta2020"):
        columns.RESOLVERS["parcels"].apply(df)
    ok = columns.RESOLVERS["parcels"].apply(df.withColumn("nta", F.lit("q")))
    assert sorted(ok.columns) == ["bbl", "nta2020"]


def test_date_ranges(spark):
    df = spark.createDataFrame([("2020-01-05T10:00:00", "x", None), ("01/31/2021", "y", None), ("junk", "z", None), (None, None, None)], "created_date string, date string, version string")
    got = profile.date_ranges(df, formats=["MM/dd/yyyy"]).collect()
    assert [(r.column_name, r.n, str(r["first"]), str(r["last"])) for r in got] == [("created_date", 2, "2020-01-05 10:00:00", "2021-01-31 00:00:00")]
    assert profile.date_ranges(df, ["absent"]).collect() == []
