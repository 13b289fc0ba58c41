import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelwright.operators import explain, modeling


def test_many_levels_become_sparse_places(spark):
    n = 50_000
    train = spark.range(n).select(F.concat(F.lit("v"), F.col("id")).alias("c"), (F.col("id") % 7).alias("x"))
    encoder = modeling.fit_encoder(train, ["x"], ["c"])
    assert encoder.sizes == {"c": n} and encoder.medians == {"x": 3.0}
    rows = spark.createDataFrame([(1, "v0", 2.0), (2, "v49999", None), (3, "unseen", 1.0), (4, None, 0.0)], "i int, c string, x double")
    got = {r.i: r.raw_features for r in encoder.encode(rows, ["i"]).collect()}
    order = sorted(f"v{i}" for i in range(n))
    assert all(type(v).__name__ == "SparseVector" and v.size == n + 1 for v in got.values())
    assert dict(zip(got[1].indices, got[1].values)) == {0: 2.0, 1 + order.index("v0"): 1.0}
    assert dict(zip(got[2].indices, got[2].values)) == {0: 3.0, 1 + order.index("v49999"): 1.0}
    assert dict(zip(got[3].indices, got[3].values)) == {0: 1.0} and got[4].numNonzeros() == 0
    assert {r.i: r.c_code for r in encoder.positions(rows, ["i"]).collect()} == {1: 0.0, 2: float(order.index("v49999")), 3: -1.0, 4: -1.0}
    names = encoder.names()
    assert names.where("place = 0").first().feature == "x" and names.where("feature = 'c=v0'").first().place == 1 and names.count() == n + 1


def test_missing_is_a_level_and_empty_columns_do_no_harm(spark):
    train = spark.createDataFrame([("a", None), ("b", None), (None, None)], "c string, x double")
    encoder = modeling.fit_encoder(train, ["x"], ["c"])
    assert encoder.medians == {"x": 0.0} and sorted(r.level for r in encoder.levels.collect()) == [modeling.MISSING, "a", "b"]
    assert modeling.fit_encoder(train, ["x"], []).encode(train, ["c"]).count() == 3
    wide = modeling.fit_preprocessor(train, [], ["c"])
    assert wide.one_hot_names == [f"c={modeling.MISSING}", "c=a", "c=b"]


@pytest.fixture(scope="module")
def linear(spark):
    rows = [(i, float(i % 11), [None, "p", "q", "r"][i % 4], float((i * 7 + i % 4) % 5 < 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, x double, c string, label double").withColumn("x", F.when(F.col("i") % 9 != 0, F.col("x")))
    encoder = modeling.fit_encoder(df, ["x"], ["c"])
    matrix = encoder.encode(df, ["i", "c", "label"]).cache()
    model = modeling.logistic([], 1.0, 400.0, "label").fit(modeling.with_class_weight(matrix, "label", 1.5))
    return df, encoder, matrix, model


def test_contributions_add_up_to_the_log_odds_of_the_fitted_pipeline(spark, linear):
    df, encoder, matrix, model = linear
    names = [r.feature for r in encoder.names().orderBy("place").collect()]
    terms = explain.linear_terms(model, names)
    wide = matrix.select("i", vector_to_array("raw_features").alias("v")).select("i", *[F.col("v")[k].alias(n) for k, n in enumerate(names)])
    means = explain.training_means(wide, names)
    sums = explain.linear_contributions(wide, ["i"], terms.coefficients, means).groupBy("i").agg((F.sum("value") + terms.base(means)).alias("s"))
    odds = {r.i: r.o for r in modeling.detached(model).transform(matrix).select("i", vector_to_array("rawPrediction")[1].alias("o")).collect()}
    for r in sums.collect():
        assert r.s == pytest.approx(odds[r.i], rel=1e-9, abs=1e-9)


def test_search_records_what_is_finished_and_tries_again_what_failed(spark, linear, tmp_path):
    matrix, fits = linear[2], []
    fail = {"on": True}

    def build(name):
        def make(inputs, total):
            fits.append(name)
            if name == "shaky" and fail["on"]:
                raise ValueError("not today")
            return modeling.logistic(list(inputs), 1.0, total, "label", max_iter=5)

        return modeling.Candidate(name, make)

    experiments = [modeling.Experiment("all", F.lit(True), F.col("i") % 3 == 0), modeling.Experiment("late", F.col("i") > 100, F.col("i") % 3 == 0)]
    tries = [build("steady"), build("shaky")]
    ask = lambda: {(r.experiment, r.candidate, r.weight_mode): r for r in modeling.search_grid(matrix, experiments, tries, "label", str(tmp_path / "record"), ["none", "balanced"]).collect()}
    first = ask()
    assert len(first) == 8 and len(fits) == 8
    assert all((r.error is None) == (r.candidate == "steady") and (r.validation_rank is None) == (r.candidate == "shaky") for r in first.values())
    assert "not today" in first["all", "shaky", "none"].error
    fits.clear()
    fail["on"] = False
    second = ask()
    assert sorted(fits) == ["shaky"] * 4
    assert all(r.error is None and not math.isnan(r.val_f1) for r in second.values())
    assert sorted(r.validation_rank for r in second.values() if r.experiment == "all") == [1, 2, 3, 4]
    fits.clear()
    assert ask() == second and not fits


def test_a_model_scores_in_a_session_that_has_observed_something(spark, linear):
    from pyspark.sql import Observation

    from panelwright.operators import observed

    seen = Observation()
    observed.run(linear[0].observe(seen, F.count(F.lit(1)).alias("n")))
    assert seen.get == {"n": 400}
    assert len(modeling.score(linear[3], linear[2], "s").collect()) == 400
