"""Sampling, weights, preprocessing and Spark ML models."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cleaning import to_number
from ..session import stage, staging_dir
from .metrics import evaluate_weighted, rank_metrics, score_histogram
from .ordered import attach, keep_first, melt, positions, quantiles, step_of
from .report import validation_rank
from .thresholds import Grid, tune

MISSING = "__MISSING__"


def stratified_sample(
    df: DataFrame, strata: Sequence[str], n: int, order: Column, unique: Sequence[str], span: tuple[int, int] | None = None
) -> DataFrame:
    """Exact stratified sample (H01): max(1, round(n * share)) rows per stratum, n rows at most.

    `order` is a hash-like number that fixes the draw and `unique` breaks its ties, so repeated runs agree. `span` is
    the least and greatest number it can be; without it one more pass finds them. Counts by even steps of the number
    give each stratum its cut-off step; rows beyond it are never written nor ranked.
    """
    strata = list(strata)
    drawn = df.withColumn("_o", order.cast("long"))
    low, high = span or drawn.agg(F.min("_o"), F.max("_o")).first()
    stepped = drawn.withColumn("_step", step_of(F.col("_o"), F.lit(low).cast("long"), F.lit(high).cast("long")))
    counts = stage(stepped.groupBy(*strata, "_step").agg(F.count("*").alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if n >= total:
        return df
    up = Window.partitionBy(*strata).orderBy(F.col("_step").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    size = F.sum("_n").over(Window.partitionBy(*strata))
    take = F.least(F.col("_size"), F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_size") / F.lit(total)).cast("long")))
    cut = counts.select("*", F.sum("_n").over(up).alias("_seen"), size.alias("_size")).withColumn("_take", take)
    cut = stage(cut.where((F.col("_seen") >= F.col("_take")) & (F.col("_seen") - F.col("_n") < F.col("_take"))).select(*strata, F.col("_step").alias("_last"), "_take"))
    near = attach(stepped, cut, strata).where(F.col("_last").isNull() | (F.col("_step") <= F.col("_last")))
    by = [F.col("_o").asc_nulls_last(), *[F.col(u).asc() for u in unique]]
    chosen = positions(stage(near.drop("_last", "_step")), strata, by, "_place").where("_place < _take").drop("_place", "_take")
    return positions(stage(chosen), [], by, "_place").where(F.col("_place") < n).drop("_place", "_o")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced class weights and the positive-weight modes as one row."""
    p, q = F.col("positives").cast("double"), F.col("negatives").cast("double")
    balanced = F.when(p > 0, q / p).otherwise(1.0)
    return class_counts(df, label).select(
        "positives",
        "negatives",
        ((p + q) / (2 * F.nullif(p, F.lit(0.0)))).alias("weight_positive"),
        ((p + q) / (2 * F.nullif(q, F.lit(0.0)))).alias("weight_negative"),
        F.lit(1.0).alias("pos_weight_none"),
        balanced.alias("pos_weight_balanced"),
        F.sqrt(balanced).alias("pos_weight_sqrt"),
        F.greatest(F.lit(1.0), balanced * 0.5).alias("pos_weight_half"),
    )


def positive_weight(mode: str, positives: int, negatives: int) -> float:
    """Weight of a positive row for a mode: none, balanced, sqrt, half, pX or a number."""
    balanced = negatives / positives if positives else 1.0
    named = {"none": 1.0, "unweighted": 1.0, "balanced": balanced, "sqrt": math.sqrt(balanced), "half": max(1.0, balanced / 2)}
    key = mode.strip().lower()
    return named[key] if key in named else float(key.lstrip("p"))


@dataclass(frozen=True)
class Preprocessor:
    """Medians and category levels learned on training rows only."""

    medians: Mapping[str, float]
    levels: Mapping[str, list[str]]

    @property
    def one_hot_names(self) -> list[str]:
        return [*self.medians, *[f"{c}={v}" for c, vs in self.levels.items() for v in vs]]

    def one_hot(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Imputed numbers and one 0/1 column per level; an unseen level is 0 everywhere."""
        cols = self._numbers()
        for c, vs in self.levels.items():
            cols += [(_level(c) == v).cast("double").alias(f"{c}={v}") for v in vs]
        return df.select(*keep, *cols)

    def ordinal(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Imputed numbers and the position of the level, -1 when unseen."""
        cols = self._numbers()
        for c, vs in self.levels.items():
            position = F.array_position(F.array(*[F.lit(v) for v in vs]), _level(c))
            cols.append((position - 1).cast("double").alias(f"{c}_code"))
        return df.select(*keep, *cols)

    def _numbers(self) -> list[Column]:
        return [F.coalesce(to_number(F.col(c)), F.lit(float(m))).alias(c) for c, m in self.medians.items()]


def _level(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def fit_preprocessor(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Preprocessor:
    """Exact medians (0 for an all-null column) and sorted levels of training rows.

    One column per level: for a few levels that are read by people. `fit_encoder` has no such columns and is the one for
    models, whatever the number of levels.
    """
    levels = {c: [r["v"] for r in train.select(_level(c).alias("v")).distinct().orderBy("v").collect()] for c in categorical}
    return Preprocessor(fit_medians(train, numeric), levels)


def fit_medians(train: DataFrame, numeric: Sequence[str]) -> dict[str, float]:
    """Exact medians of training rows, 0 for a column without a number: one number per column reaches the driver."""
    meds = {c: 0.0 for c in numeric}
    if numeric:
        long = melt(train.select(*[to_number(F.col(c)).alias(c) for c in numeric]), [], numeric)
        meds.update({r["feature"]: r["quantile"] for r in quantiles(long, ["feature"], "value", [0.5]).collect()})
    return meds


@dataclass(frozen=True)
class Encoder:
    """Medians and a table of levels learned on training rows only; levels become sparse vectors.

    levels: (column_name, level, position), positions from 0 in the order of the levels; it is joined in and never
    collected. sizes holds the number of levels per column.
    """

    medians: Mapping[str, float]
    levels: DataFrame
    sizes: Mapping[str, int]

    @property
    def inputs(self) -> list[str]:
        """What an assembler takes, in this order: numbers, then one vector per column of levels."""
        return [*self.medians, *[f"{c}_levels" for c in self.sizes]]

    def positions(self, df: DataFrame, keep: Sequence[str | Column]) -> DataFrame:
        """Imputed numbers and `<column>_code`, the position of the level; -1 where it was not seen."""
        coded = df
        for c in self.sizes:
            own = self.levels.where(F.col("column_name") == c).select(F.col("level").alias("_v"), F.col("position").cast("double").alias("_p"))
            coded = coded.join(own, _level(c) == F.col("_v"), "left").withColumn(f"{c}_code", F.coalesce("_p", F.lit(-1.0))).drop("_v", "_p")
        numbers = [F.coalesce(to_number(F.col(c)), F.lit(float(m))).alias(c) for c, m in self.medians.items()]
        return coded.select(*keep, *numbers, *[f"{c}_code" for c in self.sizes])

    def encode(self, df: DataFrame, keep: Sequence[str | Column], vector: str = "raw_features") -> DataFrame:
        """One sparse vector per row: imputed numbers and a one for the level; an unseen level is all zeros."""
        coded = self.positions(df, keep)
        for c, n in self.sizes.items():
            # "keep" has one place more, for what was not seen, and drops it as the last: those rows are all zeros
            at = coded.withColumn("_at", F.when(F.col(f"{c}_code") < 0, F.lit(float(n))).otherwise(F.col(f"{c}_code")))
            top = df.sparkSession.createDataFrame([(float(n - 1),)], "_at double")
            hot = OneHotEncoder(inputCol="_at", outputCol=f"{c}_levels", dropLast=True, handleInvalid="keep").fit(top)
            coded = hot.transform(at).drop("_at", f"{c}_code")
        return VectorAssembler(inputCols=self.inputs, outputCol=vector, handleInvalid="error").transform(coded).drop(*self.inputs)

    def names(self) -> DataFrame:
        """(place, feature, column_name, level): what each place of the vector stands for."""
        starts, at = [], len(self.medians)
        for c, n in self.sizes.items():
            starts.append((c, at))
            at += n
        spark = self.levels.sparkSession
        numbers = spark.createDataFrame([(i, c, c, None) for i, c in enumerate(self.medians)], "place long, feature string, column_name string, level string")
        first = spark.createDataFrame(starts, "column_name string, _first long")
        feature = F.concat("column_name", F.lit("="), "level")
        return numbers.unionByName(self.levels.join(first, "column_name").select((F.col("_first") + F.col("position")).alias("place"), feature.alias("feature"), "column_name", "level"))


def fit_encoder(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Encoder:
    """Medians and levels of training rows (H03, H04). What reaches the driver is two numbers per column."""
    spark = train.sparkSession
    long = train.select(*[_level(c).alias(c) for c in categorical]).unpivot([], list(categorical), "column_name", "level").distinct() if categorical else spark.createDataFrame([], "column_name string, level string")
    levels = stage(positions(stage(long), ["column_name"], [F.col("level").asc()], "position"))
    found = {r["column_name"]: r["n"] for r in levels.groupBy("column_name").agg(F.count("*").alias("n")).collect()}
    return Encoder(fit_medians(train, numeric), levels, {c: found.get(c, 0) for c in categorical if found.get(c)})


def with_class_weight(df: DataFrame, label: str, weight: float) -> DataFrame:
    return df.withColumn("class_weight", F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))


def _assembled(inputs: Sequence[str]) -> list[VectorAssembler]:
    return [VectorAssembler(inputCols=list(inputs), outputCol="raw_features", handleInvalid="error")] if inputs else []


def logistic(
    inputs: Sequence[str], c_value: float, weight_sum: float, label: str, max_iter: int = 100, intercept: bool = True, tol: float = 1e-6
) -> Pipeline:
    """L2 logistic regression on scaled, uncentred columns (H05). Without inputs it takes a vector `raw_features`.

    The penalty is stated as C: regParam = 1 / (C * sum of weights), because Spark averages the loss; an infinite C is
    none.
    """
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=False, withStd=True)
    model = LogisticRegression(
        featuresCol="features",
        labelCol=label,
        weightCol="class_weight",
        elasticNetParam=0.0,
        regParam=1.0 / (c_value * weight_sum),
        standardization=False,
        maxIter=max_iter,
        fitIntercept=intercept,
        tol=tol,
    )
    return Pipeline(stages=[*_assembled(inputs), scaler, model])


def boosted_trees(inputs: Sequence[str], label: str, seed: int = 42, **params) -> Pipeline:
    """Gradient-boosted trees (H06); `params` are those of the Spark estimator."""
    model = GBTClassifier(featuresCol="raw_features", labelCol=label, weightCol="class_weight", seed=seed, **params)
    return Pipeline(stages=[*_assembled(inputs), model])


def random_forest(inputs: Sequence[str], label: str, seed: int = 42, **params) -> Pipeline:
    """Random forest."""
    model = RandomForestClassifier(featuresCol="raw_features", labelCol=label, weightCol="class_weight", seed=seed, **params)
    return Pipeline(stages=[*_assembled(inputs), model])


def detached(model: PipelineModel) -> PipelineModel:
    """The fitted pipeline, written and read back where a stage holds its training summary.

    A summary holds the session, and a session in which metrics were observed cannot be sent to tasks with the model.
    """
    if not any(getattr(s, "hasSummary", False) for s in model.stages):
        return model
    path = f"{staging_dir(SparkSession.active())}/model-{uuid.uuid4().hex}"
    model.save(path)
    return PipelineModel.load(path)


def score(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Probability of the positive class next to the id columns (H15): a narrow step."""
    scored = detached(model).transform(df).withColumn(name, vector_to_array("probability")[1])
    return scored.drop("raw_features", "features", "rawPrediction", "probability", "prediction")


@dataclass(frozen=True)
class Candidate:
    name: str
    build: Callable[[Sequence[str], float], Pipeline]  # of the inputs and the sum of the training weights
    weight_mode: str = "none"


def search(
    spark: SparkSession,
    train: DataFrame,
    validation: DataFrame,
    inputs: Sequence[str],
    label: str,
    candidates: Sequence[Candidate],
    grid: Grid = Grid(quantiles=50),
) -> DataFrame:
    """Fit every candidate, score validation rows and rank by F1, average precision, balanced accuracy.

    The driver loop runs over candidates, not data. A failing fit becomes a row with its error.
    """
    counts = class_counts(train, label).first()
    rows = []
    for c in candidates:
        try:
            weight = positive_weight(c.weight_mode, counts["positives"], counts["negatives"])
            model = c.build(inputs, weight * counts["positives"] + counts["negatives"]).fit(with_class_weight(train, label, weight))
            hist = stage(score_histogram(score(model, validation, "_score"), [], "_score", label))
            ranks = rank_metrics(hist, []).first()
            best = tune(hist, [], grid).first()
            rows.append((c.name, c.weight_mode, best["threshold"], best["f1"], ranks["pr_auc"], ranks["roc_auc"], best["balanced_accuracy"], None))
        except Exception as error:  # a candidate may not stop the others
            rows.append((c.name, c.weight_mode, None, None, None, None, None, f"{type(error).__name__}: {error}"))
    schema = "candidate string, weight_mode string, threshold double, val_f1 double, val_pr_auc double, val_roc_auc double, val_balanced_accuracy double, error string"
    return validation_rank(spark.createDataFrame(rows, schema), ["val_f1", "val_pr_auc", "val_balanced_accuracy"], ["candidate", "weight_mode"])


@dataclass(frozen=True)
class Experiment:
    """Which rows of the one staged matrix train and which validate."""

    name: str
    train: Column
    validation: Column


FINISHED = "experiment string, candidate string, weight_mode string, threshold double, val_f1 double, val_pr_auc double, val_roc_auc double, val_balanced_accuracy double, error string"


def search_grid(
    matrix: DataFrame,
    experiments: Sequence[Experiment],
    candidates: Sequence[Candidate],
    label: str,
    record: str,
    weight_modes: Sequence[str] = ("none",),
    workers: int = 4,
    grid: Grid = Grid(quantiles=50),
    inputs: Sequence[str] = (),
    digits: int | None = None,
) -> DataFrame:
    """Experiment x candidate x weight mode over one matrix, ranked within the experiment.

    `matrix` is a written table with the label and the model's inputs (a vector `raw_features` by default). Fits run in
    a pool of `workers` threads, each in a scheduler pool of its own, so that a long fit does not hold up the others
    where the scheduler is fair. Every finished combination is written below `record` at once; a search started again
    with the same folder skips those, and tries again those that failed. A failing fit becomes a row with its error.
    With `digits`, scores that agree to so many places tie.
    """
    spark = matrix.sparkSession
    done = {(r[0], r[1], r[2]) for r in _finished(spark, record).where("error is null").select("experiment", "candidate", "weight_mode").collect()}
    jobs = [(e, c, w) for e in experiments for c in candidates for w in weight_modes if (e.name, c.name, w) not in done]
    counts = {}
    for e in {e.name: e for e, _, _ in jobs}.values():
        counts[e.name] = class_counts(matrix.where(e.train), label).first()

    def fit(job: tuple[int, tuple[Experiment, Candidate, str]]) -> None:
        number, (e, c, mode) = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{number % workers}")
        n = counts[e.name]
        try:
            weight = positive_weight(mode, n["positives"], n["negatives"])
            model = c.build(inputs, weight * n["positives"] + n["negatives"]).fit(with_class_weight(matrix.where(e.train), label, weight))
            scored = score(model, matrix.where(e.validation), "_score")
            scored = scored if digits is None else scored.withColumn("_score", F.round("_score", digits))
            hist = stage(score_histogram(scored, [], "_score", label))
            ranks, best = rank_metrics(hist, []).first(), tune(hist, [], grid).first()
            row = (best["threshold"], best["f1"], ranks["pr_auc"], ranks["roc_auc"], best["balanced_accuracy"], None)
        except Exception as error:  # a candidate may not stop the others
            row = (None, None, None, None, None, f"{type(error).__name__}: {error}")
        spark.createDataFrame([(e.name, c.name, mode, *row)], FINISHED).coalesce(1).write.parquet(f"{record}/{uuid.uuid4().hex}")

    with ThreadPoolExecutor(workers) as pool:
        list(pool.map(fit, enumerate(jobs)))
    wanted = spark.createDataFrame([(e.name, c.name, w) for e in experiments for c in candidates for w in weight_modes], "experiment string, candidate string, weight_mode string")
    key = ["experiment", "candidate", "weight_mode"]
    # an attempt that succeeded counts before those that failed
    latest = keep_first(_finished(spark, record).join(wanted, key, "left_semi"), key, [F.col("error").asc_nulls_first()])
    order = [F.col(m).desc_nulls_last() for m in ("val_f1", "val_pr_auc", "val_balanced_accuracy")]
    rank = F.row_number().over(Window.partitionBy("experiment").orderBy(*order, "candidate", "weight_mode"))
    return latest.withColumn("validation_rank", F.when(F.col("error").isNull(), rank))


def _finished(spark: SparkSession, record: str) -> DataFrame:
    """What is written below `record`; nothing where there is no such folder."""
    try:
        return spark.read.schema(FINISHED).option("recursiveFileLookup", True).parquet(record)
    except AnalysisException:
        return spark.createDataFrame([], FINISHED)


def ablation(
    spark: SparkSession,
    splits: Mapping[str, DataFrame],
    feature_sets: Mapping[str, tuple[Sequence[str], Sequence[str]]],
    label: str,
    build: Callable[[Sequence[str], float], Pipeline],
    weight_mode: str = "sqrt",
) -> DataFrame:
    """Same protocol per feature list (H31): preprocess on train, threshold on validation, report both."""
    out = None
    for name, (numeric, categorical) in feature_sets.items():
        pre = fit_preprocessor(splits["train"], numeric, categorical)
        table = {s: pre.one_hot(d, [label]) for s, d in splits.items()}
        table = {s: _safe_names(d, label) for s, d in table.items()}
        inputs = [c for c in table["train"].columns if c != label]
        counts = class_counts(table["train"], label).first()
        weight = positive_weight(weight_mode, counts["positives"], counts["negatives"])
        model = build(inputs, weight * counts["positives"] + counts["negatives"]).fit(with_class_weight(table["train"], label, weight))
        hists = {s: stage(score_histogram(score(model, table[s], "_score"), [], "_score", label)) for s in ("validation", "test")}
        threshold = tune(hists["validation"], []).first()["threshold"]
        for s, h in hists.items():
            flagged = h.withColumns({"alert": (F.col("score") >= threshold).cast("int"), "split": F.lit(s)})
            ranks = rank_metrics(h.withColumn("split", F.lit(s)), ["split"]).select("split", "roc_auc", "pr_auc")
            part = evaluate_weighted(flagged, [["split"]]).drop("level").join(ranks, "split")
            part = part.withColumns({"feature_set": F.lit(name), "feature_count": F.lit(len(numeric) + len(categorical)), "threshold": F.lit(threshold)})
            out = part if out is None else out.unionByName(part)
    return out


def _safe_names(df: DataFrame, label: str) -> DataFrame:
    """Level names may hold dots or blanks, which Spark ML column lookups would split."""
    return df.toDF(*[c if c == label else f"x{i}" for i, c in enumerate(df.columns)])


def feature_importance(spark: SparkSession, model: Model, inputs: Sequence[str], top: int | None = None) -> DataFrame:
    """Importances of a fitted tree model or absolute coefficients of a linear one, ranked."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    pairs = sorted(zip(inputs, (float(v) for v in values)), key=lambda p: (-p[1], p[0]))[:top]
    return spark.createDataFrame([(i + 1, f, v) for i, (f, v) in enumerate(pairs)], "importance_rank int, feature string, importance double")
