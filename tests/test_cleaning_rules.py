from datetime import date

import pytest
from pyspark.sql import functions as F

from panelwright.functions import calendar as cal
from panelwright.functions import classify as cl
from panelwright.functions import cleaning as cln


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_numbers_keys_and_flags(spark):
    assert one(spark, ["12", "abc", None, "1e3", "NaN", "inf"], cln.to_number) == [12.0, None, None, 1000.0, None, None]
    assert one(spark, [" a ", "", "nan", "None", None], cln.clean_key) == ["a", None, None, None, None]
    assert one(spark, ["Yes", "F", "0", "maybe", None], cln.flag) == [1, 0, 0, None, None]
    assert one(spark, ["9999", "-9999", "-40", "9989"], cln.mask_sentinels) == [None, None, -40.0, 9989.0]


def test_text_forms(spark):
    assert one(spark, ["  A & B\t c ", None, "a—b", "x y"], cln.normal_text) == ["a and b c", "", "a-b", "x y"]
    assert one(spark, ["Fast-Food!", "none", " ", None, "Été x"], cln.token) == ["fast_food", None, None, None, "t_x"]


def test_landuse_codes(spark):
    raw = ["1", "01", "1.0", "10", "01 Family", None, "", "007", "11 x", "abc"]
    assert one(spark, raw, cln.landuse_code) == ["01", "01", "01", "10", "01", "unknown", "unknown", "07", "11", "abc"]
    assert one(spark, ["1.0", "01", "x", None], cln.plain_landuse_code) == ["1", "1", "x", None]
    assert one(spark, ["nan", "Infinity", "1e30"], cln.plain_landuse_code) == ["nan", "Infinity", "1e30"]
    assert one(spark, ["mn", "5", "new york", None], cln.borough_name) == ["Manhattan", "Staten Island", "New York", "unknown"]


def test_two_ratio_conventions(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, None)], "a double, b double")
    got = df.select(cln.ratio(F.col("a"), F.col("b")).alias("n"), cln.ratio_or_zero(F.col("a"), F.col("b")).alias("z")).collect()
    assert [(r["n"], r["z"]) for r in got] == [(0.5, 0.5), (None, 0.0), (None, 0.0)]


def test_clip_keeps_nulls(spark):
    assert one(spark, [-1.0, 0.5, 2.0, None], cln.clip, "double") == [0.0, 0.5, 1.0, None]


def test_category_order_and_repeats(spark):
    # later exact names win, patterns are not anchored and infrastructure precedes public safety
    raw = ["Plant", "Drinking", "Police Report", "Street X", "HEAT/HOT  WATER", None, " ", "Homeless thing", "nothing"]
    want = ["environment", "public_safety", "infrastructure", "infrastructure", "housing", "other", "other", "public_safety", "other"]
    assert one(spark, raw, cl.request_category) == want
    df = spark.createDataFrame([(v,) for v in raw], "x string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (kept, "-1"):  # the distinct values are sent to every task, or meet their rows in a shuffle
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = {r["x"]: r["category"] for r in cl.classify_types(df, "x").collect()}
            assert got == dict(zip(raw, want))
            assert cl.classify_types(df, "x").count() == len(raw)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_poi_rules(spark):
    df = spark.createDataFrame([("Fast-Food", None), (None, None), ("none", "Hospital"), ("x", "y")], "a string, b string")
    got = cl.classify_poi(df, ["a", "b"]).collect()
    assert len(got) == 4
    assert {(r["poi_category"], r["raw_type"]) for r in got} == {
        ("food_drink", "fast_food"), ("other", None), ("healthcare", "hospital"), ("other", "x"),
    }
    assert one(spark, ["Cafe", None, "zzz"], cl.poi_group) == ["food_nightlife", "unknown", "other"]


def test_weeks_and_iso_years(spark):
    days = [date(2025, 1, 5), date(2025, 1, 6), date(2014, 12, 29)]
    assert one(spark, days, cal.week_start, "date") == [date(2024, 12, 30), date(2025, 1, 6), date(2014, 12, 29)]
    df = spark.createDataFrame([(date(2014, 12, 29),)], "week_start date")
    r = cal.add_calendar(df).first()
    assert (r["year"], r["iso_year"], r["week_of_year"], r["is_year_start"]) == (2014, 2015, 1, 1)
    assert one(spark, [2014, 2015, 2020, 2022, None], lambda c: cal.period_type(c, 2015), "int") == [
        "unknown", "pre_covid", "covid_disruption", "post_covid", "unknown",
    ]


def test_split_and_month_ranges(spark):
    days = [None, date(2022, 12, 31), date(2023, 1, 1), date(2023, 12, 31), date(2024, 1, 1)]
    assert one(spark, days, cal.time_split, "date") == ["bad_date", "train", "validation", "validation", "test"]
    got = [(r["range_start"], r["range_end"]) for r in cal.month_ranges(spark, "2020-01-15", "2020-03-10").orderBy("range_start").collect()]
    assert got == [(date(2020, 1, 15), date(2020, 2, 1)), (date(2020, 2, 1), date(2020, 3, 1)), (date(2020, 3, 1), date(2020, 3, 11))]


def test_date_range_is_pushed_to_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where(cln.in_date_range(F.col("o_orderdate"), "1996-01-01", "1996-02-01"))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in df._jdf.queryExecution().executedPlan().toString()


def test_bad_label_multiplier_is_refused(spark):
    from panelwright.operators.features import add_temporal_features

    df = spark.createDataFrame([("a", date(2020, 1, 6), "c", 1)], "area string, week_start date, category string, n long")
    with pytest.raises(ValueError):
        add_temporal_features(df, multiplier=1.333)


def test_label_multipliers_are_exact():
    from fractions import Fraction

    from panelwright.operators.features import exact_multiplier

    assert exact_multiplier(1.25) == Fraction(5, 4) and exact_multiplier(1.3) == Fraction(13, 10) and exact_multiplier(2) == 2
    with pytest.raises(ValueError):
        exact_multiplier(-1.0)
