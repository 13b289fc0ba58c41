from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelwright.operators import features, joins, panel, quality
from panelwright.operators.weather import daily_city, unit_decisions, weekly_weather

START = date(2020, 1, 6)
SCHEMA = "area string, week_start date, category string, n long"


def series(spark, counts, area="x", category="c"):
    return spark.createDataFrame([(area, START + timedelta(weeks=i), category, n) for i, n in enumerate(counts)], SCHEMA)


def test_densify_covers_the_product_and_keeps_totals(spark):
    obs = spark.createDataFrame([("a", START, "p", 3), ("b", START + timedelta(weeks=3), "q", 5)], SCHEMA)
    areas = spark.createDataFrame([("a",), ("b",), ("silent",)], "area string")
    dense = panel.densify(obs, areas, ["p", "q"])
    assert dense.count() == 3 * 4 * 2
    assert dense.agg(F.sum("n")).first()[0] == 8
    assert panel.find_gaps(dense).count() == 0 and panel.panel_summary(dense).first()["missing_cells"] == 0
    plan = dense._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_exact_tie_is_not_abnormal(spark):
    # mean 2, std 2: the threshold 5 equals the next count
    tie = features.add_temporal_features(series(spark, [0, 0, 0, 1, 3, 3, 4, 5, 9, 5])).orderBy("week_start").collect()
    assert tie[8]["rolling_8w_mean"] == 2.0 and tie[8]["rolling_8w_std"] == 2.0
    assert tie[8]["is_abnormal_next_week"] == 0
    above = features.add_temporal_features(series(spark, [0, 0, 0, 1, 3, 3, 4, 5, 9, 6])).orderBy("week_start").collect()
    assert above[8]["is_abnormal_next_week"] == 1


def test_label_uses_neither_the_current_week_nor_short_history(spark):
    rows = features.add_temporal_features(series(spark, [1] * 8 + [1000, 2])).orderBy("week_start").collect()
    assert [r["is_abnormal_next_week"] for r in rows] == [None] * 8 + [1, None]
    assert rows[-1]["has_target_next_week"] == 0 and rows[-1]["is_train_ready"] == 0


def test_constant_series_and_large_counts(spark):
    flat = features.add_temporal_features(series(spark, [7] * 12)).orderBy("week_start").collect()
    assert flat[9]["is_abnormal_next_week"] == 0 and flat[9]["rolling_8w_std"] == 0.0
    big = 10**9
    rows = features.add_temporal_features(series(spark, [big] * 9 + [big + 1])).orderBy("week_start").collect()
    assert rows[8]["is_abnormal_next_week"] == 1


def test_min_periods_modes(spark):
    w = features.series_window()
    part = series(spark, [1, 2, 3]).withColumns(features.rolling("n", w, [4], full_window=False)).orderBy("week_start").collect()
    assert [r["rolling_4w_mean"] for r in part] == [None, 1.0, 1.5]
    assert [r["rolling_4w_std"] for r in part][1] is None
    full = series(spark, [1, 2, 3, 4, 5]).withColumns(features.rolling("n", w, [4])).orderBy("week_start").collect()
    assert [r["rolling_4w_mean"] for r in full] == [None, None, None, None, 2.5]


def test_lags_compose_and_one_exchange_serves_all_features(spark):
    df = features.add_temporal_features(panel.densify(series(spark, range(30)), spark.createDataFrame([("x",)], "area string"), ["c"]))
    rows = df.orderBy("week_start").collect()
    assert all(r["lag_12w_count"] == (rows[i - 8]["lag_4w_count"] if i >= 8 else None) for i, r in enumerate(rows) if i >= 12)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") + plan.count("Window(") >= 1
    assert plan.count("Exchange hashpartitioning(area#") <= 2  # distinct areas, and one layout by series


def test_integrity_guards(spark):
    bad = spark.createDataFrame([("a", START, "c", -1), (None, START, "c", 2)], SCHEMA)
    with pytest.raises(ValueError, match="negative_counts"):
        panel.require_integrity(bad, ["area"], "n")
    good = spark.createDataFrame([("a", START, "c", 1)], SCHEMA)
    assert panel.require_integrity(good, ["area"], "n") is good
    with pytest.raises(ValueError, match="not unique"):
        joins.require_unique(good.union(good), ["area"], "dims")


def test_representative_skips_blanks(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("k", 3, "  "), ("none", 1, None)], "k string, t int, v string")
    got = {r["k"]: r["v"] for r in panel.representative(df, ["k"], ["v"], ["t"]).collect()}
    assert got == {"k": "new", "none": None}


def test_gap_is_found(spark):
    df = series(spark, [1, 2, 3]).where(F.col("week_start") != START + timedelta(weeks=1))
    assert panel.find_gaps(df).first()["gap_days"] == 14


def test_weather_week_without_values_stays_null(spark):
    days = [(START + timedelta(days=i), 31.0 if i < 3 else 9999.0, 5.0, None if i < 7 else 2.0) for i in range(14)]
    df = spark.createDataFrame(days, "date date, tx double, tn double, rain double")
    weekly = weekly_weather(daily_city(df, "date", {"tmax": ["tx"], "tmin": ["tn"], "prcp": ["rain"]})).orderBy("week_start").collect()
    first, second = weekly
    assert first["hot_day_30c_count"] == 3 and second["hot_day_30c_count"] is None
    assert first["weather_prcp_sum"] is None and first["rain_day_count"] is None
    assert second["rain_day_count"] == 7 and second["weather_prcp_sum"] == 14.0
    assert first["snow_day_count"] is None and first["weather_complete_week_flag"] == 1
    assert first["weather_tavg_mean"] == 18.0


def test_units(spark):
    tenths = [("tmax", float(v)) for v in (100, 250, 310)] + [("tmin", float(v)) for v in (50, 60, 70)]
    df = spark.createDataFrame(tenths + [("snow", 693.0), ("prcp", 12.0)], "family string, value double")
    got = {r["family"]: r["unit"] for r in unit_decisions(df, {f: "auto" for f in ("tmax", "tmin", "snow", "prcp", "awnd")}).collect()}
    assert got == {"tmax": "tenths_c", "tmin": "fahrenheit", "snow": "tenths_mm", "prcp": "mm", "awnd": "unknown"}


def test_leakage_audit_reports_a_shifted_lag(spark):
    counts = series(spark, range(20))
    table = features.add_temporal_features(counts).withColumns(
        {"time_split": F.lit("train"), "target_week": F.date_add("week_start", 7), "target_year": F.lit(2020)}
    )
    wrong = table.withColumn("lag_1w_count", F.col("n").cast("double"))
    status = {r["check"]: r["status"] for r in quality.leakage_audit(
        wrong, counts, ["area", "category"], {"train": (2020, 2020)}, {"lag_1w_count": 1, "lag_2w_count": 2}, ["lag_1w_count", "next_week_count"]
    ).collect()}
    assert status["lag_1w_count equals the count 1 weeks earlier"] == "FAIL"
    assert status["lag_2w_count equals the count 2 weeks earlier"] == "PASS"
    assert status["no forbidden feature names"] == "FAIL"
    assert status["target years stay inside their split"] == "PASS"


def test_coverage_and_alignment(spark):
    fact = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "area string")
    dim = spark.createDataFrame([("a", 1)], "area string, v int")
    r = joins.merge_coverage(fact, dim, "area", "d").first()
    assert (r["missing_rows"], r["missing_keys"], r["first_missing"]) == (3, 2, "b,c")
    full = joins.align_to_universe(fact.distinct(), dim.withColumn("share", F.lit(0.5)), "area", ["v"]).orderBy("area").collect()
    assert [(x["v"], x["share"]) for x in full] == [(1, 0.5), (0, None), (0, None)]


def test_audit_reads_the_panel_once_and_finds_what_is_bent(spark, monkeypatch):
    from panelwright.plans import queries_context as q
    from panelwright.plans.registry import Tables

    plans = []
    real = panel.stage
    monkeypatch.setattr(panel, "stage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    audit = q.audited(Tables(spark, "/root/testdata/sf0.001"))
    plans.append(audit._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("lineitem.parquet") for p in plans) == 1
    assert {r["status"] for r in audit.collect()} == {"PASS"}


def test_audit_counts_every_row_of_a_cell_that_does_not_agree(spark):
    rows = [("a", "2020-01-06", 5, None, "train", 2020, "2020-01-13"), ("a", "2020-01-13", 7, 5.0, "train", 2020, "2020-01-20"), ("a", "2020-01-20", 1, 7.0, "train", 2020, None), ("a", "2020-01-20", 1, 8.0, "test", 2020, None)]
    df = spark.createDataFrame(rows, "area string, week_start string, n long, lag double, time_split string, target_year int, target_week string")
    df = df.withColumns({"week_start": F.to_date("week_start"), "target_week": F.to_date("target_week")})
    counts = df.select("area", "week_start", "n").distinct()
    ask = lambda table, lags: {r["check"]: r["violations"] for r in quality.leakage_audit(table, counts, ["area"], {"train": (2020, 2020), "test": (2020, 2020)}, lags, []).collect()}
    assert list(ask(df, {"lag": 1}).values()) == [0, 1, 0, 2, 0]
    assert list(ask(df.where("time_split = 'train'"), {"lag": 1}).values()) == [0, 0, 0, 0, 0]
    assert list(ask(df.withColumn("lag", F.lit(None).cast("double")), {"lag": 1}).values())[3] == 3  # a missing lag, where there is a count
    assert list(ask(df.limit(0), {}).values()) == [0, 0, 0, 0]


def test_alignment_counts_pairs_without_making_them(spark):
    left = spark.createDataFrame([("a", 1), ("a", 0), ("b", None), ("c", 1), (None, 1)], "k string, y int")
    right = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", None), ("d", 0), (None, 1)], "k string, y int")
    got = joins.alignment_report(left, right, ["k"], "y").first()
    pairs = joins.align_scores(left.withColumn("s", F.lit(0)), right.withColumn("r", F.lit(0)), ["k"], "y", {"left": "s", "right": "r"})
    assert tuple(got) == (5, 6, pairs.count(), pairs.where("not (y_left <=> y_right)").count())
