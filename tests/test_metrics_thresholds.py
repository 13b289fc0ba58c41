import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import metrics, modeling, thresholds
from panelwright.operators.thresholds import Grid


def scored(spark, n=600, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if rnd.random() < 0.7 else rnd.choice("ab")
        y = int(rnd.random() < 0.3)
        rows.append((group, y, round(min(1.0, max(0.0, rnd.gauss(0.4 + 0.2 * y, 0.2))), 2), i))
    return rows, spark.createDataFrame(rows, "g string, y int, score double, i long")


def brute_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return np.mean([1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg])


def brute_ap(y, s):
    out, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        picked = [a for a, b in zip(y, s) if b >= t]
        recall, precision = sum(picked) / sum(y), sum(picked) / len(picked)
        out += (recall - last) * precision
        last = recall
    return out


@pytest.mark.parametrize("ranged", [False, True])
def test_rank_metrics_with_ties(spark, request, ranged):
    if ranged:
        request.getfixturevalue("many_ranges")
    rows, df = scored(spark)
    got = {r["g"]: r for r in metrics.rank_metrics(metrics.score_histogram(df, ["g"]), ["g"]).collect()}
    for g in ("hot", "a", "b"):
        y, s = [r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g]
        assert got[g]["roc_auc"] == pytest.approx(brute_auc(y, s))
        assert got[g]["pr_auc"] == pytest.approx(brute_ap(y, s))


def test_rank_metrics_do_not_change_under_monotone_maps_and_need_two_classes(spark):
    _, df = scored(spark)
    a = metrics.rank_metrics(metrics.score_histogram(df, []), []).first()
    b = metrics.rank_metrics(metrics.score_histogram(df.withColumn("score", F.exp("score") * 3), []), []).first()
    assert a["roc_auc"] == pytest.approx(b["roc_auc"]) and a["pr_auc"] == pytest.approx(b["pr_auc"])
    c = metrics.rank_metrics(metrics.score_histogram(df.where("y = 1"), []), []).first()
    assert c["roc_auc"] is None and c["pr_auc"] is None


def f1_at(rows, t):
    tp = sum(1 for r in rows if r[2] >= t and r[1])
    alerts, pos = sum(1 for r in rows if r[2] >= t), sum(r[1] for r in rows)
    return 2 * tp / (alerts + pos) if alerts + pos else 0.0


@pytest.mark.parametrize("ranged", [False, True])
def test_threshold_grid_equals_brute_force(spark, request, ranged):
    if ranged:
        request.getfixturevalue("many_ranges")
    rows, df = scored(spark)
    hist = metrics.score_histogram(df, ["g"])
    grid = thresholds.threshold_grid(hist, ["g"], thresholds.candidates(hist, ["g"], Grid(quantiles=20))).collect()
    assert len(grid) > 500
    for r in grid:
        mine = [x for x in rows if x[0] == r["g"]]
        assert r["f1"] == pytest.approx(f1_at(mine, r["threshold"]))
        assert r["tp"] + r["fn"] == sum(x[1] for x in mine)


def test_candidates_match_numpy(spark):
    rows, df = scored(spark)
    grid = Grid(0.05, 0.95, 0.05, 10)
    got = sorted(r["threshold"] for r in thresholds.candidates(metrics.score_histogram(df, []), [], grid).collect())
    base = np.arange(0.05, 0.95 + 1e-12, 0.05)
    q = np.quantile([r[2] for r in rows], np.linspace(0.01, 0.99, 10))
    want = np.unique(np.round(np.concatenate([base, [0.5], q]), 6))
    assert got == pytest.approx(list(want))


def test_strategies_and_ties(spark):
    _, df = scored(spark)
    hist = metrics.score_histogram(df, [])
    grid = thresholds.threshold_grid(hist, [], thresholds.candidates(hist, [], Grid(quantiles=0)))
    best = grid.agg(F.max("f1")).first()[0]
    tied = [r["threshold"] for r in grid.where(F.col("f1") == best).collect()]
    low = thresholds.pick_thresholds(grid, [], strategies=["best_f1"]).first()["threshold"]
    high = thresholds.pick_thresholds(grid, [], strategies=["best_f1"], highest_on_ties=True).first()["threshold"]
    assert (low, high) == (min(tied), max(tied))
    picks = {r["strategy"]: r for r in thresholds.pick_thresholds(grid, [], min_recall=0.8, min_precision=1.5).collect()}
    assert picks["best_precision_at_min_recall"]["recall"] >= 0.8
    assert picks["best_recall_at_min_precision"]["threshold"] == low  # infeasible, so best F1
    assert picks["default_0_5"]["threshold"] == 0.5


def test_thin_categories_fall_back(spark):
    rows = [("s", "big", i % 2, (i % 2) * 0.5 + (i % 40) / 100, 1) for i in range(200)]
    rows += [("s", "one_class", 0, 0.3, 1)] * 50 + [("s", "thin", int(i < 29), i / 100, 1) for i in range(60)]
    rows += [("s", "enough", int(i < 30), i / 100, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "score_col string, category string, y int, score double, w int")
    got = {r["category"]: r for r in thresholds.category_thresholds(metrics.score_histogram(df, ["score_col", "category"])).collect()}
    assert {c: r["is_fallback"] for c, r in got.items()} == {"big": 0, "one_class": 1, "thin": 1, "enough": 0}
    assert got["thin"]["threshold"] == got["thin"]["global_threshold"]


def test_confusion_by_category_adds_up(spark):
    _, df = scored(spark)
    s = df.withColumn("alert", (F.col("score") >= 0.5).cast("int"))
    parts = metrics.evaluate_sets(s, [["g"], []]).collect()
    whole = next(r for r in parts if r["g"] is None)
    for c in ("tp", "fp", "fn", "tn"):
        assert whole[c] == sum(r[c] for r in parts if r["g"] is not None)


@pytest.mark.parametrize("ranged", [False, True])
def test_lift(spark, request, ranged):
    if ranged:
        request.getfixturevalue("many_ranges")
    rows, df = scored(spark)
    got = {r["fraction"]: r for r in metrics.lift_at(df, [], ["i"]).collect()}
    order = sorted(rows, key=lambda r: (-r[2], r[3]))
    for f, r in got.items():
        n = max(1, int(np.ceil(len(rows) * f)))
        assert r["tp"] == sum(x[1] for x in order[:n]) and r["rows_or_alerts"] == n


def test_known_ratios():
    # published counts: 17059 hits among 58165 alerts, base rate 31570 of 247590
    precision = 17059 / 58165
    assert round(precision, 4) == 0.2933
    assert round(17059 / 31570, 4) == 0.5404
    assert round(precision / (31570 / 247590), 2) == 2.3


@pytest.mark.parametrize("ranged", [False, True])
def test_stratified_sample_is_exact(spark, request, ranged):
    if ranged:
        request.getfixturevalue("many_ranges")
    rows = [("one", 0)] + [("ten", i) for i in range(10)] + [("many", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "s string, i long")
    order = F.xxhash64("s", "i")
    got = modeling.stratified_sample(df, ["s"], 50, order, ["i"])
    counts = {r["s"]: r["count"] for r in got.groupBy("s").count().collect()}
    assert sum(counts.values()) <= 50 and counts["many"] >= 48
    again = modeling.stratified_sample(df, ["s"], 50, order, ["i"])
    assert sorted(got.collect()) == sorted(again.collect())
    assert modeling.stratified_sample(df, ["s"], 5000, order, ["i"]).count() == len(rows)


def test_preprocessor_levels(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", None), (None, 3.0)], "c string, x double")
    test = spark.createDataFrame([("c", None), (None, float("nan")), ("b", 5.0)], "c string, x double")
    pre = modeling.fit_preprocessor(train, ["x"], ["c"])
    assert pre.levels["c"] == ["__MISSING__", "a", "b"] and pre.medians == {"x": 2.0}
    hot = [tuple(r) for r in pre.one_hot(test, []).collect()]
    assert hot == [(2.0, 0.0, 0.0, 0.0), (2.0, 1.0, 0.0, 0.0), (5.0, 0.0, 0.0, 1.0)]
    assert [r["c_code"] for r in pre.ordinal(test, []).collect()] == [-1.0, 0.0, 2.0]


def test_positive_weight_modes():
    assert modeling.positive_weight("balanced", 10, 40) == 4.0
    assert modeling.positive_weight("sqrt", 10, 40) == 2.0
    assert modeling.positive_weight("half", 10, 15) == 1.0
    assert modeling.positive_weight("p2.5", 10, 40) == 2.5


def test_permutation_keeps_every_value(spark):
    from panelwright.operators.explain import permuted

    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(200)], "k long, a double, b double")
    got = permuted(df, ["k"], ["a"], 7).collect()
    assert sorted(r["a"] for r in got) == [float(i) for i in range(200)]
    assert all(r["b"] == -float(r["k"]) for r in got) and sum(r["a"] != r["k"] for r in got) > 150


@pytest.mark.parametrize("ranged", [False, True])
@pytest.mark.parametrize("tied", [0.0, 0.7, 1.0])
def test_lift_equals_a_full_ranking(spark, request, ranged, tied):
    if ranged:
        request.getfixturevalue("many_ranges")
    rnd = random.Random(8)
    odd = [None, float("nan"), float("inf"), float("-inf"), 1e308]
    rows = [(rnd.choice(["hot", "hot", None]), int(rnd.random() < 0.4), 0.25 if rnd.random() < tied else rnd.choice([*odd, *[rnd.random() for _ in range(20)]]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, y int, score double, i long")
    fractions = (0.01, 0.1, 0.5, 1.0)
    for keys in (["g"], []):
        got = {(r["g"] if keys else 0, r["fraction"]): r for r in metrics.lift_at(df, keys, ["i"], fractions).collect()}
        groups = {}
        for g, y, v, i in rows:
            if v is not None and v == v:
                groups.setdefault(g if keys else 0, []).append((-v, i, y))
        assert len(got) == len(groups) * len(fractions)
        for g, mine in groups.items():
            mine.sort()
            for f in fractions:
                k = max(1, int(np.ceil(len(mine) * f)))
                tp = sum(m[2] for m in mine[:k])
                r = got[g, f]
                assert (r["rows_or_alerts"], r["tp"]) == (k, tp)
                assert r["lift"] == pytest.approx(tp / k / (sum(m[2] for m in mine) / len(mine)))


def test_lift_ranks_the_crossing_step_only(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000 / 20_000).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("y"), "id")
    seen = []
    keep = metrics.running_sums
    metrics.running_sums = lambda df, *a, **k: (seen.append(df.count()), keep(df, *a, **k))[1]
    try:
        assert metrics.lift_at(df, [], ["id"]).count() == 3
    finally:
        metrics.running_sums = keep
    assert len(seen) == 1 and seen[0] < 60


def test_unscored_rows_are_counted_apart(spark):
    rows = [("a", 1, 0.9), ("a", 0, None), ("a", 1, float("nan")), ("a", 0, 0.1), ("b", 1, None)]
    df = spark.createDataFrame(rows, "g string, y int, score double")
    got = {r["g"]: r for r in metrics.rank_metrics(metrics.score_histogram(df, ["g"], unscored=True), ["g"]).collect()}
    assert (got["a"]["row_count"], got["a"]["unscored_rows"], got["a"]["roc_auc"]) == (2, 2, 1.0)
    assert (got["b"]["row_count"], got["b"]["unscored_rows"], got["b"]["roc_auc"]) == (0, 1, None)
    by = {r["g"]: r for r in thresholds.metrics_by(df, 0.5, ["g"]).collect()}
    assert by["a"]["predicted_positive_rows"] == 1  # NaN is no alert


def test_sample_writes_and_ranks_survivors_only(spark):
    df = spark.range(50_000).select((F.col("id") % 2).alias("s"), "id", F.xxhash64("id").alias("h"))
    ranked = []
    keep = modeling.positions
    modeling.positions = lambda df, *a, **k: (ranked.append(df.count()), keep(df, *a, **k))[1]
    try:
        got = modeling.stratified_sample(df, ["s"], 100, F.col("h"), ["id"])
        assert got.count() == 100
    finally:
        modeling.positions = keep
    assert max(ranked) < 200
    want = sorted(r["id"] for s in (0, 1) for r in df.where(F.col("s") == s).orderBy("h").limit(50).collect())
    assert sorted(r["id"] for r in got.collect()) == want
