import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import ordered


def sample(n=400, seed=1, heavy="a"):
    rnd = random.Random(seed)
    # one group holds most rows, many ties
    return [(heavy if rnd.random() < 0.7 else rnd.choice("bcd"), float(rnd.randint(0, 60)), i) for i in range(n)]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_in_ranges_equal_brute_force(spark, many_ranges, descending):
    rows = sample()
    df = spark.createDataFrame(rows, "k string, v double, i long").withColumn("one", F.lit(1).cast("long"))
    got = ordered.running_totals(df, ["k"], "v", {"one": "rank", "i": "total"}, descending, ["i"])
    sign = -1 if descending else 1
    for k in "abcd":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (sign * r[1], r[2]))
        found = sorted(((r["rank"], r["i"], r["total"]) for r in got.where(F.col("k") == k).collect()))
        assert [f[1] for f in found] == [m[2] for m in mine]
        assert [f[0] for f in found] == list(range(1, len(mine) + 1))
        assert [f[2] for f in found] == list(np.cumsum([m[2] for m in mine]))


def test_running_totals_without_keys_and_with_null_keys(spark, many_ranges):
    rows = [(None if i % 3 else "x", float(i % 17), i) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, v double, i long").withColumn("one", F.lit(1).cast("long"))
    whole = ordered.running_totals(df, [], "v", {"one": "rank"}, then=["i"]).orderBy("rank").collect()
    assert [r["i"] for r in whole] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    by_key = ordered.running_totals(df, ["k"], "v", {"one": "rank"}, then=["i"])
    assert by_key.count() == 90
    assert by_key.where("k is null").agg(F.max("rank")).first()[0] == 60


def test_range_path_is_really_used(spark, many_ranges):
    df = spark.createDataFrame(sample(), "k string, v double, i long")
    assert ordered.range_count(df) > 5


@pytest.mark.parametrize("crowd", ["null", "nan", "3.0"])
def test_no_range_grows_with_ties_nulls_or_a_hot_group(spark, crowd):
    rows = [("hot" if i % 10 < 8 else f"g{i % 50}", float(crowd) if crowd != "null" and i % 10 < 7 else None if i % 10 < 7 else i * 0.37 % 11, i) for i in range(10_000)]
    df = spark.createDataFrame(rows, "k string, v double, i long").withColumn("v", ordered.ordered_value(spark.createDataFrame([], "v double"), "v"))
    laid = ordered.laid_out(df, ["k"], [F.asc_nulls_last("v"), F.asc("i")], 20)
    sizes = [r["count"] for r in laid.groupBy("_range").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 1_000 and len(sizes) >= 15
    no_ties = ordered.laid_out(df, [], [F.asc_nulls_last("v")], 20)  # ties told apart by the hash of the row alone
    assert max(r["count"] for r in no_ties.groupBy("_range").count().collect()) <= 1_000
    got = ordered.running_totals(df.withColumn("one", F.lit(1).cast("long")), ["k"], "v", {"one": "rank"}, then=["i"], ranges=20).collect()
    clean = lambda v: None if v is None or v != v else v
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (clean(r[1]) is None, clean(r[1]) or 0, r[2]))
        assert [r["i"] for r in sorted((g for g in got if g["k"] == k), key=lambda g: g["rank"])] == [r[2] for r in mine]
        assert sorted(g["rank"] for g in got if g["k"] == k) == list(range(1, len(mine) + 1))


def test_positions_in_ranges_and_in_one(spark):
    rows = [("hot" if i % 3 else None, i * 7919 % 501, i) for i in range(501)]
    df = spark.createDataFrame(rows, "k string, v long, i long")
    for ranges in (1, 9):
        got = ordered.positions(df, ["k"], [F.desc("v")], "at", ranges).collect()
        for k in ("hot", None):
            mine = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1])
            assert [g["i"] for g in sorted((g for g in got if g["k"] == k), key=lambda g: g["at"])] == [r[2] for r in mine]


def test_steps_never_fall_and_reach_infinity(spark):
    values = sorted([float("-inf"), -1e308, -5.0, 0.0, 1e-300, 2.0, 2.0, 1e308, float("inf")])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    low, high = df.agg(F.min(ordered.finite(F.col("v"))), F.max(ordered.finite(F.col("v")))).first()
    steps = [r[0] for r in df.select(ordered.step_of(F.col("v"), F.lit(low), F.lit(high))).collect()]
    assert steps == sorted(steps) and steps[0] == -1 and steps[-1] == ordered.STEPS
    assert spark.range(1).select(ordered.step_of(F.lit(None).cast("double"), F.lit(0), F.lit(1)), ordered.step_of(F.lit(3), F.lit(3), F.lit(3))).first()[:] == (None, 0)


@pytest.mark.parametrize("ranged", [False, True])
def test_quantiles_interpolate_like_numpy(spark, request, ranged):
    if ranged:
        request.getfixturevalue("many_ranges")
    rows = [*sample(301), ("solo", 3.5, 0), ("pair", 1.0, 0), ("pair", 2.0, 1)]
    df = spark.createDataFrame(rows, "k string, v double, i long")
    probs = [0.01, 0.25, 0.5, 0.99, 0.0, 1.0]
    got = {(r["k"], r["prob"]): r["quantile"] for r in ordered.quantiles(df, ["k"], "v", probs).collect()}
    for k in {r[0] for r in rows}:
        values = [r[1] for r in rows if r[0] == k]
        for p in probs:
            assert got[k, p] == pytest.approx(np.quantile(values, p), abs=1e-9)
    assert len(got) == len({r[0] for r in rows}) * len(probs)


def test_summary_matches_numpy_and_single_rows_have_no_std(spark):
    df = spark.createDataFrame([("a", 1e9 + x, 0) for x in (1.0, 2.0, 4.0)] + [("b", 5.0, 0)], "k string, v double, i long")
    got = {r["k"]: r for r in ordered.summary(ordered.histogram(df, ["k"], "v"), ["k"], "v").collect()}
    assert got["a"]["std"] == pytest.approx(np.std([1.0, 2.0, 4.0], ddof=1))
    assert got["b"]["std"] is None and got["b"]["n"] == 1


def test_keep_first_and_top_per_group(spark):
    df = spark.createDataFrame(sample(50), "k string, v double, i long")
    first = ordered.keep_first(df, ["k"], [F.asc("v"), F.asc("i")])
    assert first.count() == df.select("k").distinct().count()
    plan = ordered.top_per_group(df, ["k"], [F.desc("v"), F.asc("i")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("ranged", [False, True])
def test_nulls_nan_and_ties_are_counted_and_come_last(spark, request, ranged, descending):
    if ranged:
        request.getfixturevalue("many_ranges")
    rnd = random.Random(4)
    values = [None, float("nan"), -1e9, 3.0, 2.5, float("inf")]
    rows = [(rnd.choice(["a", None]), rnd.choice([-1e9, -1e9, *values]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, v double, i long").withColumn("one", F.lit(1).cast("long"))
    got = ordered.running_totals(df, ["k"], "v", {"one": "rank"}, descending, ["i"]).collect()
    assert len(got) == len(rows)
    sign = -1 if descending else 1
    for k in ("a", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None or r[1] != r[1], sign * (r[1] if r[1] is not None and r[1] == r[1] else 0), r[2]))
        assert [r["i"] for r in sorted((g for g in got if g["k"] == k), key=lambda g: g["rank"])] == [r[2] for r in mine]
    clean = sorted(r[1] for r in rows if r[1] is not None and r[1] == r[1] and r[0] == "a")
    found = {r["prob"]: r["quantile"] for r in ordered.quantiles(df.where("k = 'a'"), ["k"], "v", [0.0, 0.3, 1.0]).collect()}
    assert found[0.0] == clean[0] and found[1.0] == clean[-1]
