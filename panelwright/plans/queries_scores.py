"""Rule scores, ranking metrics, thresholds, models and explanations (F, H series)."""

from __future__ import annotations

import math
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import explain, joins, metrics, modeling, profile, report, scoring, thresholds
from ..session import stage, staging_dir
from . import bindings as b
from .registry import query

# ---- rule scores -----------------------------------------------------------------------

RULES_SQL = """rules AS (SELECT *, coalesce(n - thr, -1e9) AS persistence_score, CASE WHEN n - thr > 0 THEN 1 ELSE 0 END AS persistence_alert,
  coalesce(n - rolling_4w_mean, -1e9) + coalesce(diff_1w_count, 0) AS momentum_score, CASE WHEN n > rolling_4w_mean AND diff_1w_count > 0 THEN 1 ELSE 0 END AS momentum_alert,
  coalesce(lag_52w_count - thr, -1e9) AS seasonal_score, coalesce((n - rolling_8w_mean) / nullif(rolling_8w_std, 0), -1e9) AS zscore_score
  FROM (SELECT *, rolling_8w_mean + 1.5 * coalesce(rolling_8w_std, 0) AS thr FROM tab) z)"""
RULES = (*b.FULL, RULES_SQL)


def ruled(t):
    return scoring.rule_scores(b.table(t))


@query("h08_majority", "area week_start:d category majority_score:f majority_alert:i",
    "SELECT area, week_start, category, (SELECT avg(is_abnormal_next_week) FROM tab WHERE time_split = 'train') AS majority_score, CASE WHEN (SELECT avg(is_abnormal_next_week) FROM tab WHERE time_split = 'train') >= 0.5 THEN 1 ELSE 0 END AS majority_alert FROM tab", b.FULL)
def _(t):
    df = stage(b.table(t).select("area", "week_start", "category", "time_split", "is_abnormal_next_week"))
    return scoring.majority_scores(df, df.where("time_split = 'train'"), "is_abnormal_next_week")


@query("h09_persistence", "area week_start:d category persistence_score:f persistence_alert:i", "SELECT * FROM rules", RULES)
def _(t):
    return ruled(t)


@query("h10_momentum", "area week_start:d category momentum_score:f momentum_alert:i", "SELECT * FROM rules", RULES)
def _(t):
    return ruled(t)


@query("h11_seasonal", "area week_start:d category seasonal_score:f", "SELECT * FROM rules", RULES)
def _(t):
    return ruled(t)


@query("h12_zscore", "area week_start:d category zscore_score:f", "SELECT * FROM rules", RULES)
def _(t):
    return ruled(t)


def auc_sql(source: str, keys: str, score: str, label: str) -> str:
    """Mid-rank AUC and step-sum average precision from distinct scores."""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"{keys}, " if keys else ""
    end = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {group}sum(n) AS row_count, sum(pos) AS positive_rows,
      CASE WHEN sum(pos) > 0 AND sum(n) > sum(pos) THEN sum(CAST(n - pos AS DOUBLE) * (hits - pos / 2.0)) / (sum(pos) * CAST(sum(n) - sum(pos) AS DOUBLE)) END AS roc_auc,
      CASE WHEN sum(pos) > 0 AND sum(n) > sum(pos) THEN sum(pos * (hits / seen)) / sum(pos) END AS pr_auc FROM (
      SELECT *, sum(n) OVER ({part}ORDER BY score DESC) AS seen, sum(pos) OVER ({part}ORDER BY score DESC) AS hits FROM (
      SELECT {group}{score} AS score, count(*) AS n, sum({label}) AS pos FROM {source} GROUP BY {group}{score}) a) c{end}"""


@query(
    "h18_rank_metrics",
    "split category row_count:i positive_rows:i roc_auc:f pr_auc:f",
    auc_sql("scored", "split, category", "first_score", "y"),
    (b.SCORED,),
)
def _(t):
    hist = stage(metrics.score_histogram(b.scored(t), ["split", "category"], "first_score"))
    return metrics.rank_metrics(hist, ["split", "category"])


@query("h18_rank_metrics_global", "row_count:i positive_rows:i roc_auc:f pr_auc:f", auc_sql("scored", "", "second_score", "y"), (b.SCORED,))
def _(t):
    return metrics.rank_metrics(stage(metrics.score_histogram(b.scored(t), [], "second_score")), [])


@query(
    "h18_rule_rank_metrics",
    "score_col time_split row_count:i positive_rows:i roc_auc:f pr_auc:f",
    auc_sql(
        "(SELECT 'persistence_score' AS score_col, time_split, is_abnormal_next_week AS y, round(persistence_score, 6) AS s FROM rules WHERE is_train_ready = 1 UNION ALL SELECT 'zscore_score', time_split, is_abnormal_next_week, round(zscore_score, 6) FROM rules WHERE is_train_ready = 1)",
        "score_col, time_split", "s", "y",
    ),
    RULES,
)
def _(t):
    ready = ruled(t).where("is_train_ready = 1").withColumns({c: F.round(c, 6) for c in ("persistence_score", "zscore_score")})
    long = thresholds.long_scores(ready, ["time_split"], ["persistence_score", "zscore_score"], "is_abnormal_next_week")
    hist = stage(metrics.score_histogram(long, ["score_col", "time_split"]))
    return metrics.rank_metrics(hist, ["score_col", "time_split"])


CONF = """positive_rows / CAST(row_count AS DOUBLE) AS positive_share, predicted_positive_rows / CAST(row_count AS DOUBLE) AS predicted_positive_share,
  (tp + tn) / CAST(row_count AS DOUBLE) AS accuracy, coalesce(tp / CAST(nullif(predicted_positive_rows, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(positive_rows, 0) AS DOUBLE), 0) AS recall,
  CASE WHEN positive_rows = 0 THEN tn / CAST(row_count AS DOUBLE) WHEN positive_rows = row_count THEN tp / CAST(row_count AS DOUBLE) ELSE (tp / CAST(positive_rows AS DOUBLE) + tn / CAST(row_count - positive_rows AS DOUBLE)) / 2 END AS balanced_accuracy,
  tn / CAST(nullif(row_count - positive_rows, 0) AS DOUBLE) AS specificity, tn / CAST(nullif(tn + fn, 0) AS DOUBLE) AS npv,
  coalesce(2 * tp / CAST(nullif(positive_rows + predicted_positive_rows, 0) AS DOUBLE), 0) AS f1, coalesce(5 * tp / CAST(nullif(4 * positive_rows + predicted_positive_rows, 0) AS DOUBLE), 0) AS f2"""
CONF_SPEC = "row_count:i positive_rows:i predicted_positive_rows:i tp:i fp:i fn:i tn:i positive_share:f predicted_positive_share:f accuracy:f balanced_accuracy:f precision:f recall:f specificity:f npv:f f1:f f2:f"


def conf_sql(counted: str) -> str:
    """Confusion metrics over a query that yields row_count, positive_rows, predicted_positive_rows and tp."""
    return f"SELECT *, {CONF} FROM (SELECT *, predicted_positive_rows - tp AS fp, positive_rows - tp AS fn, row_count - predicted_positive_rows - positive_rows + tp AS tn FROM ({counted}) c0) c1"


def counted(keys: str, alert: str, source: str, label: str = "y", group: str = "ALL") -> str:
    return f"SELECT {keys}, count(*) AS row_count, sum({label}) AS positive_rows, sum({alert}) AS predicted_positive_rows, sum({label} * {alert}) AS tp FROM {source} GROUP BY {group}"


AT = "CASE WHEN first_score >= 0.7 THEN 1 ELSE 0 END"


@query("h17_confusion", f"split category {CONF_SPEC}", conf_sql(counted("split, category", AT, "scored")), (b.SCORED,))
def _(t):
    s = b.scored(t).withColumn("alert", (F.col("first_score") >= 0.7).cast("int"))
    return metrics.evaluate(s, ["split", "category"])


@query(
    "h26_metrics_by",
    f"level category year:i split {CONF_SPEC}",
    conf_sql(
        counted(
            "concat_ws('+', CASE WHEN grouping(category) = 0 THEN 'category' END, CASE WHEN grouping(split) = 0 THEN 'split' END, CASE WHEN grouping(year) = 0 THEN 'year' END) AS level, category, year, split",
            AT, "scored", group="GROUPING SETS ((category), (year), (split))",
        )
    ),
    (b.SCORED,),
)
def _(t):
    return thresholds.metrics_by(b.scored(t), 0.7, ["category", "year", "split"], "first_score")


# ---- thresholds ------------------------------------------------------------------------

GRID = thresholds.Grid()


def candidate_sql(source: str, keys: str, score: str, grid=GRID, name: str = "cand") -> str:
    cols = f"{keys}, " if keys else ""
    end = f" GROUP BY {keys}" if keys else ""
    even = f"unnest({grid.even()!r}::DOUBLE[])"
    rounded = f"round(t, {grid.digits})" if grid.digits is not None else "t"
    keep = " WHERE t BETWEEN 0 AND 1" if grid.bounded else ""
    return f"""{name} AS (SELECT DISTINCT {cols}t AS threshold FROM (SELECT {cols}{rounded} AS t FROM (SELECT {cols}{even} AS t FROM {source}{end}
      UNION ALL SELECT {cols}unnest(quantile_cont({score}, {grid.probs()!r})) AS t FROM {source}{end}) q0) q1{keep})"""


def grid_sql(source: str, keys: list[str], score: str, label: str, cand: str = "cand", name: str = "grid") -> str:
    k = "".join(f"{c}, " for c in keys)
    on = " AND ".join(f"h.{c} = k.{c}" for c in keys) or "true"
    tot = " AND ".join(f"o.{c} = k.{c}" for c in keys) or "true"
    kk = "".join(f"k.{c}, " for c in keys)
    by = f" GROUP BY {', '.join(keys)}" if keys else ""
    inner = f"""SELECT {kk}k.threshold, o.row_count, o.positive_rows, coalesce(sum(h.n), 0) AS predicted_positive_rows, coalesce(sum(h.pos), 0) AS tp FROM {cand} k
      JOIN (SELECT {k}count(*) AS row_count, sum({label}) AS positive_rows FROM {source}{by}) o ON {tot}
      LEFT JOIN (SELECT {k}{score} AS s, count(*) AS n, sum({label}) AS pos FROM {source} GROUP BY {k}{score}) h ON {on} AND h.s >= k.threshold GROUP BY ALL"""
    return f"{name} AS ({conf_sql(inner)})"


VAL = "val AS (SELECT * FROM scored WHERE split = 'validation')"
VALIDATION = (b.SCORED, VAL)


def validation_hist(t, keys, score="first_score"):
    return stage(metrics.score_histogram(b.scored(t).where("split = 'validation'"), keys, score))


@query("h19_candidates", "category threshold:f", "SELECT * FROM cand", (*VALIDATION, candidate_sql("val", "category", "second_score")))
def _(t):
    return thresholds.candidates(validation_hist(t, ["category"], "second_score"), ["category"])


BY_CATEGORY = (*VALIDATION, candidate_sql("val", "category", "second_score"), grid_sql("val", ["category"], "second_score", "y"))
OVERALL = (*VALIDATION, candidate_sql("val", "", "second_score"), grid_sql("val", [], "second_score", "y"))


@query("h20_threshold_grid", f"category threshold:f {CONF_SPEC}", "SELECT * FROM grid", BY_CATEGORY)
def _(t):
    hist = validation_hist(t, ["category"], "second_score")
    return thresholds.threshold_grid(hist, ["category"], thresholds.candidates(hist, ["category"]))


ORDERS = {
    "default_0_5": "abs(threshold - 0.5), threshold",
    "best_f1": "f1 DESC, threshold",
    "best_f2": "f2 DESC, threshold",
    "best_balanced_accuracy": "balanced_accuracy DESC, threshold",
    "best_precision_at_min_recall": "(recall >= 0.5)::INT DESC, CASE WHEN recall >= 0.5 THEN precision END DESC NULLS LAST, f1 DESC, CASE WHEN recall >= 0.5 THEN balanced_accuracy END DESC NULLS LAST, threshold",
    "best_recall_at_min_precision": "(precision >= 0.3)::INT DESC, CASE WHEN precision >= 0.3 THEN recall END DESC NULLS LAST, f1 DESC, CASE WHEN precision >= 0.3 THEN balanced_accuracy END DESC NULLS LAST, threshold",
}


@query(
    "h21_threshold_strategies",
    "category strategy threshold:f precision:f recall:f f1:f f2:f balanced_accuracy:f",
    " UNION ALL ".join(f"SELECT * FROM (SELECT *, '{s}' AS strategy, row_number() OVER (PARTITION BY category ORDER BY {o}) AS r FROM grid) g_{s} WHERE r = 1" for s, o in ORDERS.items()),
    BY_CATEGORY,
)
def _(t):
    hist = validation_hist(t, ["category"], "second_score")
    grid = thresholds.threshold_grid(hist, ["category"], thresholds.candidates(hist, ["category"]))
    return thresholds.pick_thresholds(stage(grid), ["category"])


@query("h22_global_threshold", "threshold:f f1:f precision:f recall:f", "SELECT * FROM grid ORDER BY f1 DESC, threshold LIMIT 1", OVERALL)
def _(t):
    return thresholds.tune(validation_hist(t, [], "second_score"), [])


@query(
    "h13_rule_threshold",
    "threshold:f f1:f",
    "SELECT * FROM grid ORDER BY f1 DESC, threshold LIMIT 1",
    (
        *RULES,
        "rv AS (SELECT is_abnormal_next_week AS y, round(zscore_score, 6) AS s FROM rules WHERE is_train_ready = 1 AND time_split = 'validation')",
        candidate_sql("rv", "", "s", thresholds.RULE_GRID),
        grid_sql("rv", [], "s", "y"),
    ),
)
def _(t):
    val = ruled(t).where("is_train_ready = 1 AND time_split = 'validation'").withColumn("zscore_score", F.round("zscore_score", 6))
    return thresholds.rule_threshold(stage(metrics.score_histogram(val, [], "zscore_score", "is_abnormal_next_week")), [])


SCORES = ["first_score", "second_score"]
LONG_SQL = "longs AS (SELECT split, category, y, 'first_score' AS score_col, first_score AS score FROM scored UNION ALL SELECT split, category, y, 'second_score', second_score FROM scored)"
LVAL = "lval AS (SELECT * FROM longs WHERE split = 'validation')"
CAT_SQL = """cats AS (SELECT c.score_col, c.category, rows_ AS validation_rows, pos_ AS validation_positive_rows, g.threshold AS global_threshold,
  CASE WHEN pos_ = 0 OR pos_ = rows_ OR pos_ < 30 THEN g.threshold ELSE l.threshold END AS threshold, CASE WHEN pos_ = 0 OR pos_ = rows_ OR pos_ < 30 THEN 1 ELSE 0 END AS is_fallback
  FROM (SELECT score_col, category, count(*) AS rows_, sum(y) AS pos_ FROM lval GROUP BY 1, 2) c
  JOIN (SELECT score_col, threshold FROM ggrid QUALIFY row_number() OVER (PARTITION BY score_col ORDER BY f1 DESC, threshold) = 1) g ON g.score_col = c.score_col
  LEFT JOIN (SELECT score_col, category, threshold FROM lgrid QUALIFY row_number() OVER (PARTITION BY score_col, category ORDER BY f1 DESC, threshold) = 1) l ON l.score_col = c.score_col AND l.category = c.category)"""
CATS = (
    b.SCORED, LONG_SQL, LVAL,
    candidate_sql("lval", "score_col", "score", name="gcand"), grid_sql("lval", ["score_col"], "score", "y", "gcand", "ggrid"),
    candidate_sql("lval", "score_col, category", "score", name="lcand"), grid_sql("lval", ["score_col", "category"], "score", "y", "lcand", "lgrid"),
    CAT_SQL,
)


def long_scored(t):
    return thresholds.long_scores(b.scored(t), ["split", "category"], SCORES)


def tuned(t):
    val = long_scored(t).where("split = 'validation'")
    return thresholds.category_thresholds(metrics.score_histogram(val, ["score_col", "category"]))


@query(
    "h23_category_thresholds",
    "score_col category validation_rows:i validation_positive_rows:i global_threshold:f threshold:f is_fallback:i",
    "SELECT * FROM cats",
    CATS,
)
def _(t):
    return tuned(t)




@query(
    "h23_thin_category_fallback",
    "score_col category validation_positive_rows:i threshold:f is_fallback:i",
    "SELECT * FROM cats",
    (
        b.SCORED,
        "lval AS (SELECT category, CASE WHEN category = 'A' THEN 0 ELSE y END AS y, 'first_score' AS score_col, first_score AS score FROM scored WHERE split = 'validation')",
        *CATS[3:],
    ),
)
def _(t):
    val = b.scored(t).where("split = 'validation'").withColumn("y", F.when(F.col("category") == "A", 0).otherwise(F.col("y")))
    long = thresholds.long_scores(val, ["category"], ["first_score"])
    return thresholds.category_thresholds(metrics.score_histogram(long, ["score_col", "category"]))


METHODS_SQL = "methods AS (SELECT m.*, roc_auc, pr_auc, replace(m.score_col, '_score', '') || '_' || threshold_mode AS method_id FROM (" + conf_sql(
    counted(
        "score_col, threshold_mode, split, category", "alert",
        """(SELECT s.*, mode.threshold_mode, CASE WHEN score >= CASE WHEN mode.threshold_mode = 'global' THEN c.global_threshold ELSE c.threshold END THEN 1 ELSE 0 END AS alert
            FROM longs s JOIN cats c ON c.score_col = s.score_col AND c.category = s.category CROSS JOIN (VALUES ('global'), ('per_category')) mode(threshold_mode))""",
        group="GROUPING SETS ((score_col, threshold_mode, split), (score_col, threshold_mode, split, category))",
    )
) + f""") m LEFT JOIN (SELECT score_col, split, category, roc_auc, pr_auc FROM ({auc_sql('longs', 'score_col, split, category', 'score', 'y')}) u1
  UNION ALL SELECT score_col, split, NULL, roc_auc, pr_auc FROM ({auc_sql('longs', 'score_col, split', 'score', 'y')}) u2) r
  ON r.score_col = m.score_col AND r.split = m.split AND r.category IS NOT DISTINCT FROM m.category)"""
METHODS = (*CATS, METHODS_SQL)


def methods(t):
    return thresholds.evaluate_methods(long_scored(t), tuned(t))


@query("h24_method_metrics", f"method_id score_col threshold_mode split category roc_auc:f pr_auc:f {CONF_SPEC}", "SELECT * FROM methods", METHODS)
def _(t):
    return methods(t)


WIDE_SPEC = "method_id validation_rank:i " + " ".join(f"{p}_{m}:{'i' if m in ('row_count', 'positive_rows', 'predicted_positive_rows', 'tn', 'fp', 'fn', 'tp') else 'f'}" for p in ("val", "test") for m in report.WIDE)


@query(
    "h25_wide_comparison",
    WIDE_SPEC,
    "SELECT *, row_number() OVER (ORDER BY val_f1 DESC, val_pr_auc DESC, val_balanced_accuracy DESC, method_id) AS validation_rank FROM (SELECT method_id, "
    + ", ".join(f"max({m}) FILTER (WHERE split = '{s}') AS {p}_{m}" for s, p in (("validation", "val"), ("test", "test")) for m in report.WIDE)
    + " FROM methods WHERE category IS NULL GROUP BY 1) z",
    METHODS,
)
def _(t):
    return report.wide_comparison(stage(methods(t).where("category is null")))


@query(
    "f10_validation_rank",
    "method_id validation_rank:i val_f1:f",
    "SELECT method_id, f1 AS val_f1, row_number() OVER (ORDER BY pr_auc DESC, f1 DESC, balanced_accuracy DESC, roc_auc DESC, method_id) AS validation_rank FROM methods WHERE category IS NULL AND split = 'validation'",
    METHODS,
)
def _(t):
    val = methods(t).where("category is null AND split = 'validation'").withColumn("val_f1", F.col("f1"))
    return report.validation_rank(val, ["pr_auc", "f1", "balanced_accuracy", "roc_auc"], ["method_id"])


@query(
    "h27_macro_table",
    "method_id category_count:i macro_f1:f worst_category_f1:f macro_precision:f macro_recall:f macro_pr_auc:f macro_roc_auc:f mean_alert_rate:f",
    """SELECT method_id, count(DISTINCT category) AS category_count, avg(f1) AS macro_f1, min(f1) AS worst_category_f1, avg(precision) AS macro_precision, avg(recall) AS macro_recall,
       avg(pr_auc) AS macro_pr_auc, avg(roc_auc) AS macro_roc_auc, avg(predicted_positive_share) AS mean_alert_rate FROM methods WHERE split = 'test' AND category IS NOT NULL GROUP BY 1""",
    METHODS,
)
def _(t):
    return report.macro_table(methods(t).where("category is not null"))


@query(
    "d13_reconciliation",
    "method_id split tp_from_recall:f tp_from_precision:f recall_error:f precision_error:f",
    "SELECT method_id, split, tp AS tp_from_recall, CASE WHEN predicted_positive_rows > 0 THEN tp ELSE 0 END AS tp_from_precision, 0 AS recall_error, 0 AS precision_error FROM methods WHERE category IS NULL",
    METHODS,
)
def _(t):
    m = stage(methods(t))
    overall = m.where("category is null").drop("tp")
    recount = m.where("category is not null").groupBy("method_id", "split").agg(F.sum("tp").alias("tp"))
    return joins.reconcile_counts(overall, recount, ["method_id", "split"])


@query(
    "h16_ensemble",
    "order_key:i line_no:i first_score:f second_score:f ensemble_30_score:f ensemble_70_score:f",
    """SELECT order_key, line_no, greatest(0, least(1, first_score)) AS first_score, greatest(0, least(1, second_score)) AS second_score,
       0.3 * greatest(0, least(1, first_score)) + 0.7 * greatest(0, least(1, second_score)) AS ensemble_30_score,
       0.7 * greatest(0, least(1, first_score)) + 0.3 * greatest(0, least(1, second_score)) AS ensemble_70_score FROM scored""",
    (b.SCORED,),
)
def _(t):
    return scoring.ensemble(b.scored(t), "first_score", "second_score", [0.3, 0.7])


@query(
    "h18_unscored_rows",
    "split row_count:i positive_rows:i unscored_rows:i roc_auc:f",
    """SELECT split, count(v) AS row_count, sum(y) FILTER (WHERE v IS NOT NULL) AS positive_rows, count(*) - count(v) AS unscored_rows,
       (sum(r) FILTER (WHERE v IS NOT NULL AND y = 1) - sum(y) FILTER (WHERE v IS NOT NULL) * (sum(y) FILTER (WHERE v IS NOT NULL) + 1) / 2.0)
         / (sum(y) FILTER (WHERE v IS NOT NULL) * (count(v) - sum(y) FILTER (WHERE v IS NOT NULL))) AS roc_auc
       FROM (SELECT *, rank() OVER (PARTITION BY split, v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY split, v) - 1) / 2.0 AS r
             FROM (SELECT split, y, CASE WHEN line_no % 5 = 0 THEN NULL ELSE second_score END AS v FROM scored) a) z GROUP BY split""",
    (b.SCORED,),
)
def _(t):
    gaps = b.scored(t).withColumn("second_score", F.when(F.col("line_no") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("second_score")))
    return metrics.rank_metrics(metrics.score_histogram(gaps, ["split"], "second_score", unscored=True), ["split"])


@query(
    "f12_lift_at_k",
    "split fraction:f rows_or_alerts:i tp:i precision:f recall:f lift:f base_rate:f",
    """SELECT split, f AS fraction, k AS rows_or_alerts, sum(y) FILTER (WHERE r <= k) AS tp, sum(y) FILTER (WHERE r <= k) / k AS precision, sum(y) FILTER (WHERE r <= k) / sum(y) AS recall,
       sum(y) FILTER (WHERE r <= k) / k / (sum(y) / total) AS lift, sum(y) / total AS base_rate FROM (
         SELECT *, greatest(1, CAST(ceil(total * f) AS BIGINT)) AS k FROM (
           SELECT split, y, row_number() OVER (PARTITION BY split ORDER BY second_score DESC, order_key, line_no, category, d, first_score) AS r, count(*) OVER (PARTITION BY split) AS total FROM scored) a
         CROSS JOIN (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) v(f)) z GROUP BY split, f, k, total""",
    (b.SCORED,),
)
def _(t):
    return metrics.lift_at(b.scored(t), ["split"], ["order_key", "line_no", "category", "d", "first_score"], score="second_score")


@query(
    "f12_lift_global_with_alerts",
    "fraction:f rows_or_alerts:i tp:i precision:f recall:f lift:f",
    """SELECT f AS fraction, k AS rows_or_alerts, sum(y) FILTER (WHERE r <= k) AS tp, sum(y) FILTER (WHERE r <= k) / k AS precision, sum(y) FILTER (WHERE r <= k) / sum(y) AS recall,
       sum(y) FILTER (WHERE r <= k) / k / (sum(y) / total) AS lift FROM (
         SELECT *, greatest(1, CAST(ceil(total * f) AS BIGINT)) AS k FROM (
           SELECT y, row_number() OVER (ORDER BY second_score DESC, order_key, line_no, category, d, first_score) AS r, count(*) OVER () AS total FROM scored) a
         CROSS JOIN (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) v(f)) z GROUP BY f, k, total
       UNION ALL SELECT NULL, sum(a), sum(y * a), sum(y * a) / sum(a), sum(y * a) / sum(y), sum(y * a) / sum(a) / (sum(y) / count(*)) FROM (SELECT y, CASE WHEN second_score >= 0.7 THEN 1 ELSE 0 END AS a FROM scored) q""",
    (b.SCORED,),
)
def _(t):
    s = b.scored(t)
    top = metrics.lift_at(s, [], ["order_key", "line_no", "category", "d", "first_score"], score="second_score")
    alerts = metrics.evaluate(s.withColumns({"alert": (F.col("second_score") >= 0.7).cast("int"), "all": F.lit("all")}), ["all"])
    return top.unionByName(metrics.alert_row(alerts, []))


@query(
    "e38_score_distribution",
    "split score_col n:i mean:f std:f min:f p01:f p05:f p25:f p50:f p75:f p95:f p99:f max:f",
    "SELECT split, score_col, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS std, min(score) AS min, max(score) AS max, "
    + ", ".join(f"quantile_cont(score, {p}) AS {n}" for n, p in profile.PROFILE_PROBS.items())
    + " FROM longs GROUP BY 1, 2",
    (b.SCORED, LONG_SQL),
)
def _(t):
    return profile.score_distribution(b.scored(t), SCORES)


@query(
    "h30_seed_stability",
    "metric n:i mean:f std:f min:f max:f",
    """SELECT metric, count(*) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, min(v) AS min, max(v) AS max FROM (
       SELECT 'f1' AS metric, f1 AS v FROM methods WHERE category IS NOT NULL AND split = 'test' UNION ALL SELECT 'pr_auc', pr_auc FROM methods WHERE category IS NOT NULL AND split = 'test') z GROUP BY 1""",
    METHODS,
)
def _(t):
    runs = methods(t).where("category is not null AND split = 'test'")
    return report.stability(runs, ["f1", "pr_auc"])


CASE = """CASE WHEN y = 1 AND second_score >= 0.7 THEN 'true_positive_high_score' WHEN y = 0 AND second_score >= 0.7 THEN 'false_positive_high_score'
   WHEN y = 1 THEN 'false_negative_low_score' ELSE 'true_negative_low_score' END"""
CASES_SQL = f"""cases AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_type ORDER BY CASE WHEN case_type = 'true_negative_low_score' THEN second_score ELSE -second_score END,
  order_key, line_no, category, d, first_score) AS case_rank FROM (SELECT *, {CASE} AS case_type FROM scored) q) z WHERE case_rank <= 10)"""


@query("f14_case_selection", "case_type case_rank:i order_key:i line_no:i second_score:f y:i", "SELECT * FROM cases", (b.SCORED, CASES_SQL))
def _(t):
    return explain.select_cases(b.scored(t), 0.7, 10, ["order_key", "line_no", "category", "d", "first_score"], "second_score")


# ---- sampling, weights, preprocessing --------------------------------------------------


@query(
    "h01_stratified_sample",
    "category y:i order_key:i line_no:i second_score:f",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, y ORDER BY h, order_key, line_no, d, first_score, split) AS r, count(*) OVER (PARTITION BY category, y) AS c, count(*) OVER () AS total
       FROM (SELECT *, (order_key * 7919 + line_no * 104729) % 1000003 AS h FROM scored) q) z WHERE r <= least(c, greatest(1, round_even(1000.0 * c / total, 0)))
       ORDER BY h, order_key, line_no, d, first_score, split LIMIT 1000""",
    (b.SCORED,),
)
def _(t):
    order = (F.col("order_key") * 7919 + F.col("line_no") * 104729) % 1000003
    return modeling.stratified_sample(b.scored(t), ["category", "y"], 1000, order, ["order_key", "line_no", "d", "first_score", "split"], (0, 1000002))


@query(
    "h02_class_weights",
    "positives:i negatives:i weight_positive:f weight_negative:f pos_weight_none:f pos_weight_balanced:f pos_weight_sqrt:f pos_weight_half:f",
    """SELECT p AS positives, q AS negatives, (p + q) / (2.0 * p) AS weight_positive, (p + q) / (2.0 * q) AS weight_negative, 1 AS pos_weight_none, q / p AS pos_weight_balanced,
       sqrt(q / p) AS pos_weight_sqrt, greatest(1.0, 0.5 * q / p) AS pos_weight_half FROM (SELECT CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) - sum(y) AS DOUBLE) AS q FROM scored WHERE split = 'train') z""",
    (b.SCORED,),
)
def _(t):
    return modeling.class_weights(b.scored(t).where("split = 'train'"), "y")


NUMERIC = ["n", "lag_1w_count", "lag_4w_count", "rolling_8w_mean", "rolling_8w_std"]


def splits(t):
    ready = stage(b.table(t).where("is_train_ready = 1"))
    ready = ready.withColumns({"label": F.col("is_abnormal_next_week").cast("double"), "level": F.when(F.col("history_weeks") % 5 != 0, F.col("category"))})
    return {s: ready.where(F.col("time_split") == s) for s in ("train", "validation", "test")}


TRAINED = """tr AS (SELECT *, CASE WHEN history_weeks % 5 <> 0 THEN category END AS level FROM tab WHERE is_train_ready = 1)"""


@query(
    "h03_one_hot",
    "area week_start:d category lag_1w_count:f is_A:i is_R:i is_missing:i",
    """SELECT area, week_start, category, coalesce(CASE WHEN n <> 2 THEN lag_1w_count END, (SELECT median(CASE WHEN n <> 2 THEN lag_1w_count END) FROM tr WHERE time_split = 'train' AND category <> 'N')) AS lag_1w_count,
       CASE WHEN level = 'A' THEN 1 ELSE 0 END AS "is_A", CASE WHEN level = 'R' THEN 1 ELSE 0 END AS "is_R", CASE WHEN level IS NULL THEN 1 ELSE 0 END AS is_missing FROM tr WHERE time_split = 'test'""",
    (*b.FULL, TRAINED),
)
def _(t):
    # training rows never show level N, so it becomes all zeros; some numbers are made missing
    parts = {k: v.withColumn("lag_1w_count", F.when(F.col("n") != 2, F.col("lag_1w_count"))) for k, v in splits(t).items()}
    pre = modeling.fit_preprocessor(parts["train"].where("category <> 'N'"), ["lag_1w_count"], ["level"])
    out = pre.one_hot(parts["test"], ["area", "week_start", "category"])
    return out.withColumnsRenamed({"level=A": "is_A", "level=R": "is_R", f"level={modeling.MISSING}": "is_missing"})


@query(
    "h04_ordinal",
    "area week_start:d category level_code:i",
    """SELECT area, week_start, category, CASE WHEN level IS NULL THEN 2 WHEN level = 'A' THEN 0 WHEN level = 'R' THEN 1 ELSE -1 END AS level_code FROM tr WHERE time_split = 'test'""",
    (*b.FULL, TRAINED),
)
def _(t):
    parts = splits(t)
    pre = modeling.fit_preprocessor(parts["train"].where("category <> 'N'"), [], ["level"])
    return pre.ordinal(parts["test"], ["area", "week_start", "category"])


# ---- models: rows are checked, values depend on the optimiser ---------------------------

ID = ["area", "week_start", "category", "time_split", "label"]
METRIC_SPEC = "split row_count:i positive_rows:i roc_auc:f pr_auc:f"


def prepared(t):
    """Training-fitted columns x0.. of all splits, written once for the fits."""
    parts = splits(t)
    pre = modeling.fit_preprocessor(parts["train"], NUMERIC, ["category"])
    names = pre.one_hot_names
    ready = joins.union_parts(list(parts.values()))
    encoded = pre.one_hot(ready, ["area", "week_start", F.col("category").alias("_c"), "time_split", "label"])
    flat = encoded.toDF("area", "week_start", "category", "time_split", "label", *[f"x{i}" for i in range(len(names))])
    data = stage(flat)
    inputs = [f"x{i}" for i in range(len(names))]
    return {s: data.where(F.col("time_split") == s) for s in ("train", "validation", "test")}, inputs, names


def fitted(t, build):
    parts, inputs, names = prepared(t)
    counts = modeling.class_counts(parts["train"], "label").first()
    weight = modeling.positive_weight("balanced", counts["positives"], counts["negatives"])
    train = modeling.with_class_weight(parts["train"], "label", weight)
    total = counts["positives"] * weight + counts["negatives"]
    return build(inputs, total).fit(train), parts, inputs, names


def logit(inputs, total):
    return modeling.logistic(inputs, 1.0, total, "label")


def trees(inputs, total):
    return modeling.boosted_trees(inputs, "label", maxIter=5, maxDepth=3, stepSize=0.3)


def forest(inputs, total):
    return modeling.random_forest(inputs, "label", numTrees=8, maxDepth=5)


def held_out(t, build):
    model, parts, _, _ = fitted(t, build)
    both = parts["validation"].unionByName(parts["test"]).withColumnRenamed("time_split", "split")
    scored = modeling.score(model, both, "score")
    return metrics.rank_metrics(stage(metrics.score_histogram(scored, ["split"], "score", "label")), ["split"])


@query("h05_logistic_regression", METRIC_SPEC)
def _(t):
    return held_out(t, logit)


@query("h06_boosted_trees", METRIC_SPEC)
def _(t):
    return held_out(t, trees)


@query("h07_random_forest", METRIC_SPEC)
def _(t):
    return held_out(t, forest)


@query("h14_candidate_search", "candidate weight_mode validation_rank:i threshold:f val_f1:f val_pr_auc:f val_roc_auc:f error")
def _(t):
    parts, inputs, _ = prepared(t)
    tries = [
        modeling.Candidate("logistic", lambda i, w: modeling.logistic(i, 1.0, w, "label"), "balanced"),
        modeling.Candidate("trees_small", lambda i, w: modeling.boosted_trees(i, "label", maxIter=2, maxDepth=2), "sqrt"),
        modeling.Candidate("broken", lambda i, w: modeling.boosted_trees(["no_such_column"], "label", maxIter=2), "none"),
    ]
    return modeling.search(t.spark, parts["train"], parts["validation"], inputs, "label", tries)


@query("h15_batch_scores", "area week_start:d category time_split label:i score:f")
def _(t):
    model, parts, _, _ = fitted(t, logit)
    return modeling.score(model, parts["validation"].unionByName(parts["test"]), "score")


@query("h31_feature_set_ablation", "feature_set split feature_count:i threshold:f f1:f precision:f recall:f roc_auc:f pr_auc:f")
def _(t):
    parts = splits(t)
    sets = {"history": (["n", "lag_1w_count", "rolling_8w_mean"], []), "history_and_category": (NUMERIC, ["category"])}
    return modeling.ablation(t.spark, parts, sets, "label", lambda i, w: modeling.logistic(i, 1.0, w, "label"))


@query("h32_feature_importance", "importance_rank:i feature importance:f")
def _(t):
    model, _, inputs, names = fitted(t, forest)
    found = modeling.feature_importance(t.spark, model, inputs)
    labels = t.spark.createDataFrame(list(zip(inputs, names)), "feature string, label string")
    return found.join(labels, "feature").select("importance_rank", F.col("label").alias("feature"), "importance")


# ---- models of one column of levels: their fits have a closed form that SQL can state ----

LEVELS = (
    *b.FULL,
    "lv AS (SELECT *, category || '-' || CAST(quarter(week_start) AS VARCHAR) AS lev FROM tab WHERE is_train_ready = 1)",
    "lw AS (SELECT lev, CAST(sum(is_abnormal_next_week) AS DOUBLE) AS p, CAST(count(*) - sum(is_abnormal_next_week) AS DOUBLE) AS q FROM lv WHERE time_split = 'train' GROUP BY lev)",
    "lt AS (SELECT sum(q) / sum(p) AS w, sum(p + q) AS c FROM lw)",
    "ls AS (SELECT lev, p, q, w, w * p / (w * p + q) AS s, (p + q) / c AS mean, ln(w * p / q) AS coef FROM lw, lt)",
)
ROUNDS, STEP = 10, 0.3


def boosted_sql(source: str, keys: str, name: str, step: float = STEP) -> str:
    """Log odds / 2 of every boosting round by level: the first tree is the mean label, the others add the mean gradient times the step."""
    return f"""{name} AS (SELECT {keys}, s, 1 AS k, 2 * s - 1 AS f FROM {source}
      UNION ALL SELECT {keys}, s, k + 1, f + {step} * (4 * s / (1 + exp(2 * f)) - 4 * (1 - s) / (1 + exp(-2 * f))) FROM {name} WHERE k < {ROUNDS})"""


def level_matrix(t):
    """Ready rows of all splits with their level as a sparse vector fitted on training rows, written once."""
    parts = {k: v.withColumn("lev", F.concat_ws("-", "category", F.quarter("week_start"))) for k, v in splits(t).items()}
    encoder = modeling.fit_encoder(parts["train"], [], ["lev"])
    keep = ["area", "week_start", "category", "time_split", "target_year", "label", "lev"]
    return stage(encoder.encode(joins.union_parts(list(parts.values())), keep)), encoder


def level_model(t, build, weighted=True):
    matrix, encoder = level_matrix(t)
    train = matrix.where("time_split = 'train'")
    n = modeling.class_counts(train, "label").first()
    weight = modeling.positive_weight("balanced" if weighted else "none", n["positives"], n["negatives"])
    return build(weight * n["positives"] + n["negatives"]).fit(modeling.with_class_weight(train, "label", weight)), matrix, encoder


def plain_logit(total):
    return modeling.logistic([], math.inf, total, "label", max_iter=500, intercept=False, tol=1e-15)


def boosting(total, step=STEP):
    return modeling.boosted_trees([], "label", maxIter=ROUNDS, maxDepth=12, stepSize=step)


def single_tree(total):
    return modeling.random_forest([], "label", numTrees=1, maxDepth=12, bootstrap=False)


def level_scores(t, build):
    model, matrix, _ = level_model(t, build)
    scored = modeling.score(model, matrix, "score")
    return scored.groupBy("time_split", "lev").agg(F.count("*").alias("n"), F.round(F.min("score"), 4).alias("least"), F.round(F.max("score"), 4).alias("greatest"))


SCORES_SPEC = "time_split lev n:i least:f greatest:f"
LEVEL_SCORES = "SELECT time_split, lev, count(*) AS n, round(any_value(s), 4) AS least, round(any_value(s), 4) AS greatest FROM lv JOIN {} USING (lev) GROUP BY 1, 2"


@query("h05_logistic_levels", SCORES_SPEC, LEVEL_SCORES.format("ls"), LEVELS)
def _(t):
    return level_scores(t, plain_logit)


@query("h06_boosted_levels", SCORES_SPEC, LEVEL_SCORES.format(f"(SELECT lev, 1 / (1 + exp(-2 * f)) AS s FROM boosted WHERE k = {ROUNDS}) e"), ("RECURSIVE " + LEVELS[0], *LEVELS[1:], boosted_sql("ls", "lev", "boosted")))
def _(t):
    return level_scores(t, boosting)


@query("h07_tree_levels", "time_split lev n:i alerts:i", "SELECT time_split, lev, count(*) AS n, count(*) FILTER (WHERE s > 0.5) AS alerts FROM lv JOIN ls USING (lev) GROUP BY 1, 2", LEVELS)
def _(t):
    # leaves side by side with the same verdict are merged, so the verdict has a closed form and the share has none
    model, matrix, _ = level_model(t, single_tree)
    return modeling.score(model, matrix, "score").groupBy("time_split", "lev").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0.5).alias("alerts"))


@query(
    "h15_level_scores",
    "area week_start:d category time_split label:i score:f",
    "SELECT area, week_start, category, time_split, is_abnormal_next_week AS label, round(s, 4) AS score FROM lv JOIN ls USING (lev) WHERE time_split <> 'train'",
    LEVELS,
)
def _(t):
    model, matrix, _ = level_model(t, plain_logit)
    return modeling.score(model, matrix.where("time_split <> 'train'"), "score").withColumn("score", F.round("score", 4))


@query(
    "h32_split_gain",
    "importance_rank:i feature importance:f",
    """SELECT row_number() OVER (ORDER BY best DESC, lev) AS importance_rank, 'lev=' || lev AS feature, CASE WHEN best THEN 1.0 ELSE 0.0 END AS importance FROM (
         SELECT lev, gain = max(gain) OVER () AS best FROM (SELECT lev, -(wp + q) * (wp * q) / ((wp + q) * (wp + q)) - (tp - wp + tq - q) * ((tp - wp) * (tq - q)) / ((tp - wp + tq - q) * (tp - wp + tq - q)) AS gain
         FROM (SELECT lev, w * p AS wp, q, sum(w * p) OVER () AS tp, sum(q) OVER () AS tq FROM ls) a) y) z""",
    LEVELS,
)
def _(t):
    # a tree of one split: all importance goes to the level whose split lowers the impurity most
    model, _, encoder = level_model(t, lambda total: modeling.random_forest([], "label", numTrees=1, maxDepth=1, bootstrap=False))
    names = [r["feature"] for r in encoder.names().orderBy("place").collect()]
    return modeling.feature_importance(t.spark, model, names)


SEARCH = (
    "RECURSIVE " + LEVELS[0], *LEVELS[1 : len(b.FULL) + 1],
    """sw AS (SELECT e AS experiment, m AS weight_mode, lev, CAST(sum(is_abnormal_next_week) AS DOUBLE) AS p, CAST(count(*) - sum(is_abnormal_next_week) AS DOUBLE) AS q FROM lv,
      (VALUES ('all_years', 1900), ('recent_years', 1997)) x(e, y), (VALUES ('none'), ('balanced')) v(m) WHERE time_split = 'train' AND target_year >= y GROUP BY ALL)""",
    "ss AS (SELECT experiment, weight_mode, lev, w * p / (w * p + q) AS s FROM (SELECT *, CASE weight_mode WHEN 'none' THEN 1.0 ELSE sum(q) OVER g / sum(p) OVER g END AS w FROM sw WINDOW g AS (PARTITION BY experiment, weight_mode)) a)",
    boosted_sql("ss", "experiment, weight_mode, lev", "fast"),
    boosted_sql("ss", "experiment, weight_mode, lev", "slow", 0.1),
    f"""sc AS (SELECT experiment || '|boosting_slow|' || weight_mode AS combo, lev, 1 / (1 + exp(-2 * f)) AS s FROM slow WHERE k = {ROUNDS}
      UNION ALL SELECT experiment || '|boosting_fast|' || weight_mode, lev, 1 / (1 + exp(-2 * f)) FROM fast WHERE k = {ROUNDS})""",
    "sv AS (SELECT combo, round(s, 4) AS s, is_abnormal_next_week AS y FROM lv JOIN sc USING (lev) WHERE time_split = 'validation')",
    candidate_sql("sv", "combo", "s", thresholds.Grid(quantiles=50)),
    grid_sql("sv", ["combo"], "s", "y"),
    "best AS (SELECT * FROM grid QUALIFY row_number() OVER (PARTITION BY combo ORDER BY f1 DESC, threshold) = 1)",
    f"ranks AS ({auc_sql('sv', 'combo', 's', 'y')})",
)


@query(
    "h14_grid_search",
    "experiment candidate weight_mode validation_rank:i threshold:f val_f1:f val_pr_auc:f val_roc_auc:f",
    """SELECT split_part(combo, '|', 1) AS experiment, split_part(combo, '|', 2) AS candidate, split_part(combo, '|', 3) AS weight_mode, threshold, f1 AS val_f1, pr_auc AS val_pr_auc, roc_auc AS val_roc_auc,
       row_number() OVER (PARTITION BY split_part(combo, '|', 1) ORDER BY f1 DESC, pr_auc DESC, balanced_accuracy DESC, combo) AS validation_rank FROM best JOIN ranks USING (combo)""",
    SEARCH,
)
def _(t):
    matrix, _ = level_matrix(t)
    train, validation = F.col("time_split") == "train", F.col("time_split") == "validation"
    experiments = [modeling.Experiment("all_years", train, validation), modeling.Experiment("recent_years", train & (F.col("target_year") >= 1997), validation)]
    candidates = [modeling.Candidate("boosting_fast", lambda _, w: boosting(w)), modeling.Candidate("boosting_slow", lambda _, w: boosting(w, 0.1))]
    return modeling.search_grid(matrix, experiments, candidates, "label", f"{staging_dir(t.spark)}/search-{uuid.uuid4().hex}", ["none", "balanced"], digits=4)


@query(
    "h04_many_levels",
    "order_key:i line_no:i level_code:i",
    """SELECT order_key, line_no, coalesce(code, -1) AS level_code FROM (SELECT *, 'part ' || part_key AS level FROM req WHERE line_no > 2) r
       LEFT JOIN (SELECT level, row_number() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT 'part ' || part_key AS level FROM req WHERE line_no <= 2) a) k USING (level)""",
    (b.REQ,),
)
def _(t):
    rows = b.requests(t).select("order_key", "line_no", F.concat(F.lit("part "), "part_key").alias("level"))
    return modeling.fit_encoder(rows.where("line_no <= 2"), [], ["level"]).positions(rows.where("line_no > 2"), ["order_key", "line_no"])


# ---- contributions of the fitted linear model -------------------------------------------

IDS = ["area", "week_start", "category"]
CONTRIB_SQL = """contrib AS (SELECT area, week_start, category, 'lev=' || k.lev AS feature, split_part(k.lev, '-', 1) AS feature_group,
  round((CASE WHEN r.lev = k.lev THEN 1 ELSE 0 END - mean) * coef, 3) AS value FROM lv r CROSS JOIN ls k WHERE time_split = 'test')"""
CONTRIB = (*LEVELS, CONTRIB_SQL)


def explained(t):
    """Test rows with one column per level, the model's terms, and the training means."""
    model, matrix, encoder = level_model(t, plain_logit)
    names = [r["feature"] for r in encoder.names().orderBy("place").collect()]
    wide = matrix.drop("raw_features").select("*", *[(F.concat(F.lit("lev="), "lev") == n).cast("double").alias(n) for n in names])
    means = explain.training_means(wide.where("time_split = 'train'"), names)
    return model, wide.where("time_split = 'test'"), matrix, explain.linear_terms(model, names), means


def contributions(t, cases=None):
    _, rows, _, terms, means = explained(t)
    if cases is not None:
        rows = rows.join(F.broadcast(cases.select(*IDS)), IDS, "left_semi")  # a few rows of each kind of case
    return explain.linear_contributions(rows, IDS, terms.coefficients, means).withColumn("value", F.round("value", 3))


@query(
    "h37_log_odds",
    "area week_start:d category log_odds:f",
    "SELECT area, week_start, category, round(coef, 4) AS log_odds FROM lv JOIN ls USING (lev) WHERE time_split = 'test'",
    LEVELS,
)
def _(t):
    # what the contributions of a row add up to
    _, rows, _, terms, means = explained(t)
    long = explain.linear_contributions(rows, IDS, terms.coefficients, means)
    return long.groupBy(*IDS).agg(F.round(F.sum("value") + F.lit(terms.base(means)), 4).alias("log_odds"))


@query(
    "h37_sum_of_contributions",
    "time_split row_count:i rows_off:i",
    "SELECT time_split, count(*) AS row_count, 0 AS rows_off FROM tab WHERE is_train_ready = 1 AND time_split IN ('validation', 'test') GROUP BY 1",
    b.FULL,
)
def _(t):
    # the model of numbers and levels: contributions and base against the log odds that the model itself gives
    model, parts, inputs, _ = fitted(t, logit)
    terms, means = explain.linear_terms(model, inputs), explain.training_means(parts["train"], inputs)
    rows = parts["validation"].unionByName(parts["test"])
    total = explain.linear_contributions(rows, [*IDS, "time_split"], terms.coefficients, means).groupBy(*IDS, "time_split").agg((F.sum("value") + F.lit(terms.base(means))).alias("sum"))
    own = modeling.detached(model).transform(rows).select(*IDS, vector_to_array("rawPrediction")[1].alias("odds"))
    off = F.abs(F.col("sum") - F.col("odds")) > 1e-9 * (1 + F.abs("odds"))
    return total.join(own, IDS).groupBy("time_split").agg(F.count("*").alias("row_count"), F.count_if(off).alias("rows_off"))


@query("h37_linear_contributions", "area week_start:d category feature value:f", "SELECT * FROM contrib", CONTRIB)
def _(t):
    return contributions(t)


IMP_SQL = """imp AS (SELECT *, mean_abs / sum(mean_abs) OVER () AS share, row_number() OVER (ORDER BY round(mean_abs, 9) DESC, feature) AS importance_rank FROM (
  SELECT feature, any_value(feature_group) AS feature_group, avg(abs(value)) AS mean_abs, avg(value) AS mean_signed, count(*) AS row_count FROM contrib GROUP BY 1) z)"""


@query("h33_global_importance", "feature mean_abs:f mean_signed:f row_count:i share:f importance_rank:i", "SELECT * FROM imp", (*CONTRIB, IMP_SQL))
def _(t):
    return explain.global_importance(contributions(t))


@query(
    "h34_group_importance",
    "feature_group mean_abs_sum:f feature_count:i share:f importance_rank:i",
    """SELECT *, mean_abs_sum / sum(mean_abs_sum) OVER () AS share, row_number() OVER (ORDER BY round(mean_abs_sum, 9) DESC, feature_group) AS importance_rank FROM (
       SELECT feature_group, sum(mean_abs) AS mean_abs_sum, count(*) AS feature_count FROM imp GROUP BY 1) z""",
    (*CONTRIB, IMP_SQL),
)
def _(t):
    importance = stage(explain.global_importance(contributions(t)).drop("share", "importance_rank"))
    groups = importance.select("feature", F.regexp_extract("feature", "^lev=([^-]*)", 1).alias("feature_group"))
    return explain.group_importance(importance, groups)


@query(
    "h35_category_importance",
    "category category_rank:i feature mean_abs:f row_count:i",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY mean_abs DESC, feature) AS category_rank FROM (
       SELECT category, feature, avg(abs(value)) AS mean_abs, count(*) AS row_count FROM contrib GROUP BY 1, 2) y) z WHERE category_rank <= 3""",
    CONTRIB,
)
def _(t):
    return explain.category_importance(contributions(t), 3)


PCASES = """pcases AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_type ORDER BY CASE WHEN case_type = 'true_negative_low_score' THEN s ELSE -s END, area, week_start, category) AS case_rank FROM (
  SELECT area, week_start, category, round(zscore_score, 6) AS s, CASE WHEN is_abnormal_next_week = 1 AND round(zscore_score, 6) >= 1 THEN 'true_positive_high_score'
  WHEN is_abnormal_next_week = 0 AND round(zscore_score, 6) >= 1 THEN 'false_positive_high_score' WHEN is_abnormal_next_week = 1 THEN 'false_negative_low_score' ELSE 'true_negative_low_score' END AS case_type
  FROM rules WHERE time_split = 'test' AND is_train_ready = 1) y) z WHERE case_rank <= 5)"""
LOCAL = (*CONTRIB, RULES_SQL, PCASES)


def panel_cases(t):
    test = ruled(t).where("time_split = 'test' AND is_train_ready = 1").withColumn("score", F.round("zscore_score", 6))
    return explain.select_cases(test, 1.0, 5, IDS, label="is_abnormal_next_week")


@query(
    "h36_local_contributions",
    "case_type case_rank:i contribution_rank:i feature value:f",
    """SELECT * FROM (SELECT case_type, case_rank, feature, value, row_number() OVER (PARTITION BY case_type, case_rank ORDER BY abs(value) DESC, feature) AS contribution_rank
       FROM contrib JOIN pcases USING (area, week_start, category)) z WHERE contribution_rank <= 3""",
    LOCAL,
)
def _(t):
    cases = stage(panel_cases(t))
    return explain.local_contributions(cases, contributions(t, cases), IDS, 3)


@query(
    "h36_local_summary",
    "case_type case_rank:i contribution_sum:f top_positive top_negative",
    """SELECT case_type, case_rank, sum(value) AS contribution_sum, string_agg(feature, ';' ORDER BY value DESC, feature) FILTER (WHERE p <= 2) AS top_positive,
       string_agg(feature, ';' ORDER BY value, feature) FILTER (WHERE q <= 2) AS top_negative FROM (SELECT *, row_number() OVER (PARTITION BY case_type, case_rank ORDER BY value DESC, feature) AS p,
       row_number() OVER (PARTITION BY case_type, case_rank ORDER BY value, feature) AS q FROM contrib JOIN pcases USING (area, week_start, category)) z GROUP BY 1, 2""",
    LOCAL,
)
def _(t):
    cases = stage(panel_cases(t))
    return explain.local_summary(cases, contributions(t, cases), IDS, 2)


@query("h37_permutation_importance", "feature_group pr_auc:f roc_auc:f pr_auc_loss:f")
def _(t):
    model, parts, inputs, names = fitted(t, trees)
    groups = {"history": inputs[: len(NUMERIC)], "category": inputs[len(NUMERIC) :]}
    return explain.permutation_importance(
        parts["validation"], IDS, groups, lambda df: modeling.score(model, df, "score"), "label"
    )
