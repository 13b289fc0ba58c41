"""Panel, features, labels, splits and quality (B, D, E, F, T, Q series)."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import classify as cl
from ..functions import cleaning as cln
from ..functions import fixed_values as fv
from ..operators import features as feat
from ..operators import joins, panel, profile
from ..operators import observed as obs
from ..operators.ordered import keep_first, top_per_group, top_rows
from ..session import stage
from . import bindings as b
from .registry import query

# ---- weekly counts and the dense panel -------------------------------------------------


@query("e01_weekly_counts", "area week_start:d category n:i", "SELECT * FROM obs", (b.REQ, b.OBS))
def _(t):
    return b.observed(t)


@query(
    "e01_event_week_counts",
    "event_type week_start:d n:i",
    "SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS n FROM events GROUP BY ALL",
)
def _(t):
    w = F.window(F.col("ts").cast("timestamp"), "7 days", "7 days", "4 days")
    return t.events.groupBy(w, "event_type").agg(F.count("*").alias("n")).select("event_type", F.to_date("window.start").alias("week_start"), "n")


def _in(words):
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


NORMAL = r"""regexp_replace(regexp_replace(replace(regexp_replace(lower(coalesce({0}, '')), '^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+$', '', 'g'), '&', ' and '), '[\x{{2010}}-\x{{2015}}]', '-', 'g'), '[\s\x{{85}}\p{{Z}}]+', ' ', 'g')"""


# classify the distinct types once, as a lookup
TYPES = f"""types AS (SELECT request_type AS rt, CASE WHEN t = '' THEN 'other' {' '.join(f"WHEN t IN {_in(n)} THEN '{c}'" for c, n in cl.exact_names(fv.TYPE_NAMES).items())} {' '.join(f"WHEN regexp_matches(t, '{p}') THEN '{c}'" for c, p in fv.TYPE_PATTERNS)} ELSE 'other' END AS rule_category
  FROM (SELECT DISTINCT request_type, {NORMAL.format('request_type')} AS t FROM req))"""
TYPED = """typed AS (SELECT req.*, types.rule_category FROM req JOIN types ON req.request_type IS NOT DISTINCT FROM types.rt)"""
RULED = (b.REQ, TYPES, TYPED)


@query(
    "e01_weekly_counts_by_rules",
    "area week_start:d category n:i",
    "SELECT area, CAST(date_trunc('week', ts) AS DATE) AS week_start, rule_category AS category, count(*) AS n FROM typed GROUP BY ALL",
    RULED,
)
def _(t):
    return panel.weekly_counts_by_rules(b.requests(t))


@query(
    "e02_type_category_counts",
    "request_type category n:i",
    "SELECT request_type, rule_category AS category, count(*) AS n FROM typed WHERE request_type IS NOT NULL GROUP BY ALL",
    RULED,
)
def _(t):
    return panel.type_category_counts(b.requests(t), "request_type")


@query(
    "e02_type_counts_with_missing",
    "request_type n:i",
    "SELECT coalesce(request_type, '__MISSING__') AS request_type, count(*) AS n FROM req GROUP BY ALL",
    (b.REQ,),
)
def _(t):
    return panel.type_category_counts(b.requests(t), "request_type", "__MISSING__")


DOMAIN = "(VALUES " + ", ".join(f"('{c}')" for c in fv.CATEGORIES) + ") d(category)"


@query(
    "e03_category_shares",
    "category total:i share:f",
    f"SELECT category, total, total / sum(total) OVER () AS share FROM (SELECT d.category, count(typed.area) AS total FROM {DOMAIN} LEFT JOIN typed ON typed.rule_category = d.category GROUP BY 1) z",
    RULED,
)
def _(t):
    return panel.category_shares(panel.weekly_counts_by_rules(b.requests(t)), fv.CATEGORIES)


@query(
    "e04_top_unclassified",
    "request_type n:i",
    "SELECT request_type, count(*) AS n FROM typed WHERE rule_category = 'other' AND request_type IS NOT NULL GROUP BY ALL ORDER BY n DESC, request_type LIMIT 200",
    RULED,
)
def _(t):
    counts = panel.type_category_counts(b.requests(t), "request_type")
    return panel.top_unclassified(counts)


@query(
    "e05_last_attribute",
    "c_nationkey:i c_mktsegment c_name",
    "SELECT c_nationkey, arg_max(c_mktsegment, c_custkey) AS c_mktsegment, arg_max(c_name, c_custkey) AS c_name FROM customer GROUP BY 1",
)
def _(t):
    return panel.representative(t.customer, ["c_nationkey"], ["c_mktsegment", "c_name"], ["c_custkey"])


@query(
    "e05_first_attribute",
    "c_nationkey:i c_mktsegment",
    "SELECT c_nationkey, arg_min(c_mktsegment, c_custkey) AS c_mktsegment FROM customer WHERE c_mktsegment <> '' GROUP BY 1",
)
def _(t):
    return panel.representative(t.customer, ["c_nationkey"], ["c_mktsegment"], ["c_custkey"], last=False)


@query(
    "e05_most_common_attribute",
    "source lang",
    "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) z WHERE r = 1",
)
def _(t):
    return panel.most_common(t.documents, ["source"], "lang")


@query(
    "e06_collapse_duplicates",
    "area week_start:d n:i category",
    "SELECT area, week_start, sum(n) AS n, min(category) AS category FROM obs GROUP BY 1, 2",
    (b.REQ, b.OBS),
)
def _(t):
    return panel.collapse_duplicates(b.observed(t), ["area", "week_start"], "n", ["category"])


@query(
    "e07_keep_first",
    "l_partkey:i l_suppkey:i l_orderkey:i l_linenumber:i",
    "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) = 1",
)
def _(t):
    return keep_first(t.lineitem, ["l_partkey", "l_suppkey"], [F.col(c).asc() for c in ("l_shipdate", "l_orderkey", "l_linenumber")])


@query("d08_densify", "area week_start:d category n:i", "SELECT * FROM dense", b.PANEL)
def _(t):
    return b.dense(t)


@query(
    "d08_off_grid",
    "grid_cells:i grid_count:i off_grid_cells:i off_grid_count:i",
    """SELECT (SELECT count(*) FROM dense WHERE category <> 'N' AND area NOT LIKE '%A') AS grid_cells, (SELECT sum(n) FROM dense WHERE category <> 'N' AND area NOT LIKE '%A') AS grid_count,
       count(*) FILTER (WHERE category = 'N' OR area LIKE '%A') AS off_grid_cells, coalesce(sum(n) FILTER (WHERE category = 'N' OR area LIKE '%A'), 0) AS off_grid_count FROM obs""",
    b.PANEL,
)
def _(t):
    ledger = Observation()
    some = b.areas(t).where(~F.endswith("area", F.lit("A")))
    obs.run(panel.densify(b.observed(t), some, ["A", "R"], ledger=ledger))
    return obs.observed_row(some, ledger, "grid_cells long, grid_count long, off_grid_cells long, off_grid_count long")


@query(
    "e36_panel_summary",
    "row_count:i total_count:i areas:i categories:i weeks:i min_week:d max_week:d expected_cells:i missing_cells:i",
    """SELECT *, areas * categories * (datediff('day', min_week, max_week) // 7 + 1) AS expected_cells,
       areas * categories * (datediff('day', min_week, max_week) // 7 + 1) - row_count AS missing_cells FROM (
       SELECT count(*) AS row_count, sum(n) AS total_count, count(DISTINCT area) AS areas, count(DISTINCT category) AS categories,
       count(DISTINCT week_start) AS weeks, min(week_start) AS min_week, max(week_start) AS max_week FROM obs) z""",
    (b.REQ, b.OBS),
)
def _(t):
    return panel.panel_summary(b.observed(t))


# ---- windows ---------------------------------------------------------------------------


@query(
    "f01_lags",
    "area week_start:d category n:i lag_1w_count:f lag_2w_count:f lag_4w_count:f lag_8w_count:f lag_12w_count:f lag_52w_count:f",
    "SELECT * FROM feat",
    b.FEATURES,
)
def _(t):
    w = feat.series_window()
    return b.dense(t).withColumns(feat.lags("n", w))


@query(
    "f02_shifted_rolling",
    "area week_start:d category rolling_4w_mean:f rolling_4w_std:f rolling_4w_sum:f rolling_8w_mean:f rolling_8w_std:f rolling_8w_sum:f rolling_12w_mean:f rolling_12w_std:f rolling_12w_sum:f",
    "SELECT * FROM feat",
    b.FEATURES,
)
def _(t):
    return b.dense(t).withColumns(feat.rolling("n", feat.series_window()))


@query(
    "f02_rolling_short_history",
    "area week_start:d category rolling_8w_mean:f rolling_8w_std:f rolling_8w_sum:f",
    """SELECT area, week_start, category, avg(n) OVER f AS rolling_8w_mean, stddev_samp(n) OVER f AS rolling_8w_std, sum(n) OVER f AS rolling_8w_sum
       FROM dense WINDOW f AS (PARTITION BY area, category ORDER BY week_start ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""",
    b.PANEL,
)
def _(t):
    return b.dense(t).withColumns(feat.rolling("n", feat.series_window(), [8], full_window=False))


@query("f03_history_length", "area week_start:d category history_weeks:i", "SELECT * FROM feat", b.FEATURES)
def _(t):
    return b.dense(t).withColumn("history_weeks", F.row_number().over(feat.series_window()) - 1)


@query("f04_next_week", "area week_start:d category next_week_count:f", "SELECT * FROM feat", b.FEATURES)
def _(t):
    return b.dense(t).withColumn("next_week_count", F.lead("n", 1).over(feat.series_window()))


@query(
    "f05_momentum",
    "area week_start:d category diff_1w_count:f diff_4w_count:f pct_change_1w:f ratio_to_8w_mean:f ratio_to_12w_mean:f",
    "SELECT * FROM feat",
    b.FEATURES,
)
def _(t):
    return b.features(t)


@query(
    "f06_abnormal_label",
    "area week_start:d category is_abnormal_next_week:i abnormal_threshold:f",
    "SELECT * FROM feat",
    b.FEATURES,
)
def _(t):
    return b.features(t)


DEFINITIONS = [(8, 1.0), (8, 1.5), (8, 2.0), (4, 1.5), (12, 1.5)]


def _variant(n, halves):
    d = f"({n} * nxt - s{n})"
    return f"CASE WHEN c{n} >= {n} AND nxt IS NOT NULL AND {d} > 0 AND {4 * (n - 1)} * {d} * {d} > {halves * halves * n} * ({n} * q{n} - s{n} * s{n}) THEN 1 ELSE 0 END"


@query(
    "f07_label_sensitivity",
    "definition row_count:i positive_rows:i positive_share:f",
    "SELECT definition, count(*) AS row_count, sum(y) AS positive_rows, avg(y) AS positive_share FROM ("
    + " UNION ALL ".join(
        f"SELECT 'label_{n}w_{str(m).replace('.', '_')}' AS definition, {_variant(n, round(2 * m))} AS y FROM win WHERE nxt IS NOT NULL"
        for n, m in DEFINITIONS
    )
    + ") z GROUP BY 1",
    (
        *b.PANEL,
        "win AS (SELECT lead(n) OVER w AS nxt, "
        + ", ".join(f"count(n) OVER f{k} AS c{k}, sum(n) OVER f{k} AS s{k}, sum(n * n) OVER f{k} AS q{k}" for k in (4, 8, 12))
        + " FROM dense WINDOW w AS (PARTITION BY area, category ORDER BY week_start), "
        + ", ".join(f"f{k} AS (PARTITION BY area, category ORDER BY week_start ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (4, 8, 12))
        + ")",
    ),
)
def _(t):
    return feat.label_sensitivity(b.dense(t), DEFINITIONS)


@query(
    "f08_readiness",
    "area week_start:d category has_min_history:i has_target_next_week:i is_train_ready:i",
    "SELECT * FROM feat",
    b.FEATURES,
)
def _(t):
    return b.features(t)


@query(
    "f09_gaps",
    "area category previous_week:d week_start:d gap_days:i",
    """SELECT * FROM (SELECT area, category, lag(week_start) OVER w AS previous_week, week_start,
       datediff('day', lag(week_start) OVER w, week_start) AS gap_days FROM obs WINDOW w AS (PARTITION BY area, category ORDER BY week_start)) z
       WHERE gap_days <> 7""",
    (b.REQ, b.OBS),
)
def _(t):
    return panel.find_gaps(b.observed(t))


@query(
    "f11_top_per_group",
    "l_returnflag rank:i l_orderkey:i l_linenumber:i l_extendedprice:m",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) z WHERE rank <= 10",
)
def _(t):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return top_per_group(t.lineitem, ["l_returnflag"], order, 10)


# ---- calendar, splits, experiments -----------------------------------------------------


@query(
    "t01_week_start",
    "event_id:i week_start:d",
    "SELECT event_id, CAST(date_trunc('week', ts) AS DATE) AS week_start FROM events",
)
def _(t):
    return t.events.select("event_id", cal.week_start(F.col("ts")).alias("week_start"))


@query(
    "t02_calendar",
    "week_start:d year:i month:i quarter:i week_of_year:i iso_year:i week_end:d is_year_start:i is_year_end:i",
    """SELECT week_start, year(week_start) AS year, month(week_start) AS month, quarter(week_start) AS quarter,
       week(week_start) AS week_of_year, isoyear(week_start) AS iso_year, week_start + INTERVAL 6 DAY AS week_end,
       CASE WHEN week(week_start) <= 2 THEN 1 ELSE 0 END AS is_year_start, CASE WHEN week(week_start) >= 51 THEN 1 ELSE 0 END AS is_year_end
       FROM (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start FROM lineitem) z""",
)
def _(t):
    weeks = t.lineitem.select(cal.week_start(F.col("l_shipdate")).alias("week_start")).distinct()
    return cal.add_calendar(weeks)


@query(
    "t03_period_type",
    "period_type is_covid_period:i n:i",
    """SELECT CASE WHEN y <= 2019 THEN 'pre_covid' WHEN y <= 2021 THEN 'covid_disruption' ELSE 'post_covid' END AS period_type,
       CASE WHEN y IN (2020, 2021) THEN 1 ELSE 0 END AS is_covid_period, count(*) AS n
       FROM (SELECT year(o_orderdate + INTERVAL 20 YEAR) AS y FROM orders) z GROUP BY ALL""",
)
def _(t):
    shifted = t.orders.select(F.add_months(F.to_date("o_orderdate"), 240).alias("week_start"))
    return cal.add_calendar(shifted).groupBy("period_type", "is_covid_period").agg(F.count("*").alias("n"))


@query("t04_target_week", "area week_start:d category target_week:d target_year:i", "SELECT * FROM tab", b.FULL)
def _(t):
    return b.table(t)


@query("t05_time_split", "time_split row_count:i first_week:d last_week:d", "SELECT time_split, count(*) AS row_count, min(week_start) AS first_week, max(week_start) AS last_week FROM tab GROUP BY 1", b.FULL)
def _(t):
    return b.table(t).groupBy("time_split").agg(
        F.count("*").alias("row_count"), F.min("week_start").alias("first_week"), F.max("week_start").alias("last_week")
    )


@query(
    "t05_year_split",
    "split n:i",
    "SELECT CASE WHEN y <= 1998 THEN 'train' WHEN y = 1999 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM (SELECT year(o_orderdate) AS y FROM orders) z GROUP BY 1",
)
def _(t):
    return t.orders.groupBy(cal.year_split(F.year("o_orderdate"), 1998, 1999).alias("split")).agg(F.count("*").alias("n"))


EXPERIMENTS = dict(gap_years=(1996, 1997), pre_until=1997, post_validation=(1998, 1999), post_test_from=2000)


def masks():
    return cal.experiment_masks(F.col("is_train_ready"), F.col("is_abnormal_next_week"), F.col("target_year"), F.col("time_split"), **EXPERIMENTS)


MASK_SQL = {
    **{("E1", s): f"time_split = '{s}'" for s in ("train", "validation", "test")},
    **{("E2", s): f"time_split = '{s}' AND target_year NOT BETWEEN 1996 AND 1997" for s in ("train", "validation", "test")},
    **{("E3", s): f"time_split = '{s}'" for s in ("train", "validation", "test")},
    ("E4", "train"): "target_year <= 1997",
    ("E4", "validation"): "target_year BETWEEN 1998 AND 1999",
    ("E4", "test"): "target_year >= 2000",
}


@query(
    "t06_experiment_rows",
    "experiment split row_count:i",
    "SELECT experiment, split, count(*) AS row_count FROM ("
    + " UNION ALL ".join(f"SELECT '{e}' AS experiment, '{s}' AS split FROM tab WHERE is_train_ready = 1 AND is_abnormal_next_week IS NOT NULL AND {c}" for (e, s), c in MASK_SQL.items())
    + ") z GROUP BY ALL",
    b.FULL,
)
def _(t):
    return profile.experiment_balance(b.table(t), masks(), "is_abnormal_next_week")


@query(
    "e35_experiment_balance",
    "experiment split row_count:i positive_rows:i positive_share:f",
    "SELECT experiment, split, count(*) AS row_count, sum(y) AS positive_rows, avg(y) AS positive_share FROM ("
    + " UNION ALL ".join(f"SELECT '{e}' AS experiment, '{s}' AS split, is_abnormal_next_week AS y FROM tab WHERE is_train_ready = 1 AND is_abnormal_next_week IS NOT NULL AND {c}" for (e, s), c in MASK_SQL.items())
    + ") z GROUP BY ALL",
    b.FULL,
)
def _(t):
    return profile.experiment_balance(b.table(t), masks(), "is_abnormal_next_week")


@query(
    "t07_infer_core_fields",
    "area week_start:d category target_week:d target_year:i time_split period_type final_train_ready_flag:i",
    f"""SELECT *, year(target_week) AS target_year, {b.SPLIT_CASE} AS time_split, 'pre_covid' AS period_type,
        CASE WHEN is_abnormal_next_week IS NOT NULL THEN 1 ELSE 0 END AS final_train_ready_flag
        FROM (SELECT *, CAST(week_start + INTERVAL 7 DAY AS DATE) AS target_week FROM feat) z""",
    b.FEATURES,
)
def _(t):
    return cal.infer_core_fields(b.features(t), bounds=b.SPLIT)


# ---- balances and profiles of the panel ------------------------------------------------


@query(
    "e28_target_balance",
    "level category year:i valid_rows:i positive_rows:i negative_rows:i positive_share:f mean_target:f median_target:f",
    """SELECT concat_ws('+', CASE WHEN grouping(category) = 0 THEN 'category' END, CASE WHEN grouping(year) = 0 THEN 'year' END) AS level,
       category, year, count(*) AS valid_rows, sum(is_abnormal_next_week) AS positive_rows, count(*) - sum(is_abnormal_next_week) AS negative_rows,
       avg(is_abnormal_next_week) AS positive_share, avg(next_week_count) AS mean_target, quantile_cont(next_week_count, 0.5) AS median_target
       FROM tab WHERE is_abnormal_next_week IS NOT NULL GROUP BY GROUPING SETS ((category), (year), (category, year))""",
    b.FULL,
)
def _(t):
    return profile.target_balance(b.table(t), "is_abnormal_next_week", "next_week_count", [["category"], ["year"], ["category", "year"]])


@query(
    "e29_category_profile",
    "category row_count:i total_count:i mean_count:f median_count:f max_count:i areas:i weeks:i ready_rows:i total_share:f",
    """SELECT *, total_count / sum(total_count) OVER () AS total_share FROM (SELECT category, count(*) AS row_count, sum(n) AS total_count,
       avg(n) AS mean_count, quantile_cont(n, 0.5) AS median_count, max(n) AS max_count, count(DISTINCT area) AS areas,
       count(DISTINCT week_start) AS weeks, sum(is_train_ready) AS ready_rows FROM feat GROUP BY 1) z""",
    b.FEATURES,
)
def _(t):
    return profile.category_profile(b.features(t))


@query(
    "e30_missing_values",
    "column_name missing_count:i missing_share:f",
    "SELECT column_name, sum(m) AS missing_count, avg(m) AS missing_share FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS m FROM feat" for c in ("area", "n", "lag_52w_count", "rolling_8w_std", "pct_change_1w", "is_abnormal_next_week"))
    + ") z GROUP BY 1",
    b.FEATURES,
)
def _(t):
    return profile.missing_values(b.features(t).select("area", "n", "lag_52w_count", "rolling_8w_std", "pct_change_1w", "is_abnormal_next_week"))


def _profile_sql(columns, source, keys=""):
    q = ", ".join(f"quantile_cont(v, {p}) AS {n}" for n, p in profile.PROFILE_PROBS.items())
    union = " UNION ALL ".join(f"SELECT {keys}'{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {source}" for c in columns)
    return f"SELECT {keys}feature, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, {q} FROM ({union}) z WHERE v IS NOT NULL GROUP BY ALL"


PROFILED = ["n", "lag_4w_count", "rolling_8w_sum", "next_week_count"]


@query(
    "e31_numeric_profile",
    "feature n:i mean:f std:f min:f p01:f p05:f p25:f p50:f p75:f p95:f p99:f max:f",
    _profile_sql(PROFILED, "feat"),
    b.FEATURES,
)
def _(t):
    return profile.numeric_profile(b.features(t), PROFILED)


FLAGGED = ["has_min_history", "is_train_ready", "is_abnormal_next_week"]


@query(
    "e32_flag_counts",
    "flag flag_value:i n:i share:f",
    "SELECT flag, flag_value, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY flag) AS share FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS flag, {c} AS flag_value FROM feat" for c in FLAGGED)
    + ") z GROUP BY 1, 2",
    b.FEATURES,
)
def _(t):
    return profile.flag_counts(b.features(t), FLAGGED)


@query(
    "e33_balance_counts",
    "level time_split category year:i is_abnormal_next_week:i n:i",
    """SELECT concat_ws('+', CASE WHEN grouping(category) = 0 THEN 'category' END, CASE WHEN grouping(time_split) = 0 THEN 'time_split' END,
       CASE WHEN grouping(year) = 0 THEN 'year' END) AS level, time_split, category, year, is_abnormal_next_week, count(*) AS n FROM tab
       GROUP BY GROUPING SETS ((time_split, is_abnormal_next_week), (category, is_abnormal_next_week), (year, is_abnormal_next_week),
       (time_split, category, is_abnormal_next_week))""",
    b.FULL,
)
def _(t):
    return profile.balance_counts(b.table(t), "is_abnormal_next_week", [["time_split"], ["category"], ["year"], ["time_split", "category"]])


@query(
    "e34_rows_by_split",
    "time_split year:i is_train_ready:i n:i",
    "SELECT time_split, year, is_train_ready, count(*) AS n FROM tab GROUP BY ALL",
    b.FULL,
)
def _(t):
    return profile.rows_by(b.table(t), ["time_split", "year", "is_train_ready"])


@query(
    "e37_level_preview",
    "column_name levels:i first_levels",
    """SELECT column_name, count(*) AS levels, string_agg(v, '|' ORDER BY v) FILTER (WHERE r <= 100) AS first_levels FROM (
       SELECT column_name, v, row_number() OVER (PARTITION BY column_name ORDER BY v) AS r FROM (
         SELECT DISTINCT 'source' AS column_name, source AS v FROM documents UNION SELECT DISTINCT 'lang', lang FROM documents
         UNION SELECT DISTINCT 'n_chars', CAST(n_chars AS VARCHAR) FROM documents) a) z GROUP BY 1""",
)
def _(t):
    return profile.level_preview(t.documents, ["source", "lang", "n_chars"])


# ---- sorts, limits, set operations -----------------------------------------------------


@query("g01_total_order", "area week_start:d category n:i", "SELECT * FROM obs ORDER BY area, category, week_start", (b.REQ, b.OBS))
def _(t):
    return b.observed(t).orderBy("area", "category", "week_start")


@query(
    "g02_top_k",
    "o_orderkey:i o_totalprice:m",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)
def _(t):
    return top_rows(t.orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 50)


@query(
    "g03_union_all",
    "source_table event_day:d n:i",
    """SELECT source_table, event_day, count(*) AS n FROM (SELECT 'orders' AS source_table, CAST(o_orderdate AS DATE) AS event_day FROM orders
       UNION ALL SELECT 'lineitem', CAST(l_shipdate AS DATE) FROM lineitem UNION ALL SELECT 'events', CAST(ts AS DATE) FROM events) z GROUP BY ALL""",
)
def _(t):
    parts = [
        df.select(F.lit(name).alias("source_table"), F.to_date(c).alias("event_day")).groupBy("source_table", "event_day").agg(F.count("*").alias("n"))
        for name, df, c in (("orders", t.orders, "o_orderdate"), ("lineitem", t.lineitem, "l_shipdate"), ("events", t.events, "ts"))
    ]
    return joins.union_parts(parts)


@query("g04_distinct", "l_suppkey:i l_returnflag", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _(t):
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()


# ---- cleaning --------------------------------------------------------------------------


@query(
    "b01_tolerant_number",
    "order_key:i x:f",
    f"SELECT o_orderkey AS order_key, TRY_CAST(trim({b.pick_sql(b.NUMBER_WORDS, 'o_custkey')}) AS DOUBLE) AS x FROM orders",
)
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("order_key"), cln.to_number(b.pick(b.NUMBER_WORDS, F.col("o_custkey"))).alias("x"))


@query(
    "b02_mixed_timestamps",
    "order_key:i d:d",
    "SELECT o_orderkey AS order_key, CASE WHEN o_custkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS d FROM orders",
)
def _(t):
    texts = [F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy", "yyyyMMdd")]
    k = F.col("o_custkey") % 4
    text = F.when(k == 0, texts[0]).when(k == 1, texts[1]).when(k == 2, texts[2]).otherwise("not a date")
    parsed = cln.to_timestamp_any(text, ["yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy", "yyyyMMdd"])
    return t.orders.select(F.col("o_orderkey").alias("order_key"), parsed.alias("d"))


GEO = "(c_custkey * 37 % 1000) / 200.0"
GEO2 = "(c_custkey * 53 % 1000) / 200.0"
BOX = {"south": 1.0, "north": 3.5, "west": 0.5, "east": 4.0}


def _coordinates(t):
    c = F.col("c_custkey")
    lon = F.when(c % 17 != 0, (c * 37 % 1000) / 200.0)
    return t.customer.select("c_custkey", lon.alias("lon"), ((c * 53 % 1000) / 200.0).alias("lat"))


@query(
    "b03_bounding_box",
    "c_custkey:i lon:f lat:f",
    f"SELECT c_custkey, {GEO} AS lon, {GEO2} AS lat FROM customer WHERE c_custkey % 17 <> 0 AND {GEO2} BETWEEN 1.0 AND 3.5 AND {GEO} BETWEEN 0.5 AND 4.0",
)
def _(t):
    return _coordinates(t).where(cln.in_box(F.col("lat"), F.col("lon"), BOX))


@query(
    "b03_removed_count",
    "rows_read:i missing_rows:i outside_rows:i removed_rows:i rows_kept:i",
    f"""SELECT count(*) AS rows_read, count(*) FILTER (WHERE c_custkey % 17 = 0) AS missing_rows, count(*) FILTER (WHERE c_custkey % 17 <> 0 AND NOT inside) AS outside_rows,
        count(*) FILTER (WHERE c_custkey % 17 = 0 OR NOT inside) AS removed_rows, count(*) FILTER (WHERE c_custkey % 17 <> 0 AND inside) AS rows_kept
        FROM (SELECT c_custkey, {GEO2} BETWEEN 1.0 AND 3.5 AND {GEO} BETWEEN 0.5 AND 4.0 AS inside FROM customer) z""",
)
def _(t):
    seen = Observation()
    kept = stage(obs.keep_in_box(_coordinates(t), "lat", "lon", BOX, seen))
    counts = obs.observed_row(kept, seen, "rows_read long, missing_rows long, outside_rows long, removed_rows long")
    return counts.withColumn("rows_kept", kept.agg(F.count("*").alias("n")).scalar())


@query(
    "b04_coordinate_flag",
    "c_custkey:i has_valid_coord:i",
    f"SELECT c_custkey, CASE WHEN c_custkey % 17 <> 0 AND {GEO2} BETWEEN 1.0 AND 3.5 AND {GEO} BETWEEN 0.5 AND 4.0 THEN 1 ELSE 0 END AS has_valid_coord FROM customer",
)
def _(t):
    return _coordinates(t).withColumn("has_valid_coord", cln.box_flag(F.col("lat"), F.col("lon"), BOX))


@query(
    "b05_date_range",
    "event_id:i",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'",
)
def _(t):
    return t.events.where(cln.in_date_range(F.col("ts"), "2024-01-05", "2024-01-19"))


@query(
    "b06_missing_keys",
    "rows_read:i rows_kept:i rows_dropped:i",
    """SELECT count(*) AS rows_read, count(*) FILTER (WHERE ok) AS rows_kept, count(*) FILTER (WHERE NOT ok) AS rows_dropped
       FROM (SELECT request_type IS NOT NULL AND trim(request_type) NOT IN ('', 'nan', 'None') AS ok FROM req) z""",
    (b.REQ,),
)
def _(t):
    return cln.missing_key_counts(b.requests(t), ["request_type", "area"])


@query(
    "b06_drop_missing_keys",
    "order_key:i line_no:i request_type",
    "SELECT order_key, line_no, trim(request_type) AS request_type FROM req WHERE trim(request_type) NOT IN ('', 'nan', 'None')",
    (b.REQ,),
)
def _(t):
    return cln.drop_missing_keys(b.requests(t), ["request_type"])


@query(
    "b07_mask_sentinels",
    "date:d station datatype value:f",
    "SELECT date, station, datatype, CASE WHEN abs(value) < 9990 THEN value END AS value FROM wlong",
    (b.LONG,),
)
def _(t):
    return b.weather_long(t).withColumn("value", cln.mask_sentinels(F.col("value")))


@query(
    "b08_flags",
    "order_key:i flag:i flag_or_zero:i",
    f"""SELECT order_key, flag, coalesce(flag, 0) AS flag_or_zero FROM (SELECT o_orderkey AS order_key,
        CASE WHEN w IN ('true', 't', 'yes', 'y', '1') THEN 1 WHEN w IN ('false', 'f', 'no', 'n', '0') THEN 0 END AS flag
        FROM (SELECT o_orderkey, lower(trim({b.pick_sql(b.FLAG_WORDS, 'o_custkey')})) AS w FROM orders) a) z""",
)
def _(t):
    w = b.pick(b.FLAG_WORDS, F.col("o_custkey"))
    return t.orders.select(F.col("o_orderkey").alias("order_key"), cln.flag(w).alias("flag"), cln.flag_or_zero(w).alias("flag_or_zero"))


@query(
    "b09_normal_text",
    "doc_id:i normal_length:i normal_hash",
    f"SELECT doc_id, length(t) AS normal_length, md5(t) AS normal_hash FROM (SELECT doc_id, {NORMAL.format('text')} AS t FROM documents) z",
)
def _(t):
    text = cln.normal_text(F.col("text"))
    return t.documents.select("doc_id", F.char_length(text).alias("normal_length"), F.md5(text).alias("normal_hash"))


@query(
    "b10_token",
    "doc_id:i token_length:i token_hash",
    """SELECT doc_id, length(k) AS token_length, md5(k) AS token_hash FROM (SELECT doc_id, CASE WHEN k NOT IN ('', 'nan', 'none', 'null') THEN k END AS k
       FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS k FROM documents) a) z""",
)
def _(t):
    k = cln.token(F.col("text"))
    return t.documents.select("doc_id", F.char_length(k).alias("token_length"), F.md5(k).alias("token_hash"))


@query(
    "b11_finite_and_clip",
    "order_key:i line_no:i x:f clipped:f",
    """SELECT l_orderkey AS order_key, l_linenumber AS line_no, x, CASE WHEN x IS NOT NULL THEN greatest(0.0, least(1.0, x)) END AS clipped FROM (SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linenumber IN (1, 2) THEN NULL ELSE (l_quantity - 10) / 20.0 END AS x FROM lineitem) z""",
)
def _(t):
    q = F.col("l_quantity")
    bad = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(float("-inf"))).otherwise((q - 10) / 20.0)
    x = cln.finite(bad)
    return t.lineitem.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"), x.alias("x"), cln.clip(x).alias("clipped"))


@query(
    "b12_integrity",
    "row_count:i negative_counts:i fractional_counts:i missing_counts:i missing_area:i missing_category:i",
    """SELECT count(*) AS row_count, count(*) FILTER (WHERE c < 0) AS negative_counts, count(*) FILTER (WHERE c <> floor(c)) AS fractional_counts,
       count(*) FILTER (WHERE c IS NULL) AS missing_counts, count(*) FILTER (WHERE area IS NULL) AS missing_area, 0 AS missing_category
       FROM (SELECT CASE WHEN qty = 7 THEN NULL WHEN qty = 9 THEN -1.0 WHEN qty = 11 THEN 0.5 ELSE qty END AS c,
       CASE WHEN qty <> 13 THEN area END AS area FROM req) z""",
    (b.REQ,),
)
def _(t):
    q = F.col("qty")
    dirty = b.requests(t).withColumns(
        {"c": F.when(q == 7, None).when(q == 9, -1.0).when(q == 11, 0.5).otherwise(q), "area": F.when(q != 13, F.col("area"))}
    )
    return panel.integrity_report(dirty, ["area", "category"], "c")


CODE = "CASE WHEN s IS NULL OR s = '' THEN 'unknown' WHEN dg = '' THEN s WHEN CAST(dg AS INTEGER) < 10 THEN lpad(CAST(CAST(dg AS INTEGER) AS VARCHAR), 2, '0') ELSE dg END"


@query(
    "b14_codes",
    "bbl:i landuse_code plain_code borough_name",
    f"""SELECT bbl, {CODE} AS landuse_code, CASE WHEN TRY_CAST(s AS DOUBLE) IS NOT NULL THEN CAST(CAST(TRY_CAST(s AS DOUBLE) AS INTEGER) AS VARCHAR) ELSE s END AS plain_code,
        CASE bx WHEN '1' THEN 'Manhattan' WHEN 'bx' THEN 'Bronx' WHEN ' Brooklyn ' THEN 'Brooklyn' WHEN 'QN' THEN 'Queens' WHEN '5' THEN 'Staten Island'
        WHEN 'new york' THEN 'New York' ELSE 'unknown' END AS borough_name
        FROM (SELECT bbl, trim(landuse) AS s, replace(regexp_extract(trim(landuse), '^(\\d+(?:\\.0)?)', 1), '.0', '') AS dg,
              {b.pick_sql(b.BOROUGHS, 'bbl')} AS bx FROM parcel) z""",
    (b.PARCEL,),
)
def _(t):
    return b.parcels(t).select(
        "bbl",
        cln.landuse_code(F.col("landuse")).alias("landuse_code"),
        cln.plain_landuse_code(F.col("landuse")).alias("plain_code"),
        cln.borough_name(b.pick(b.BOROUGHS, F.col("bbl"))).alias("borough_name"),
    )


@query(
    "b15_safe_ratios",
    "bbl:i null_ratio:f zero_ratio:f",
    "SELECT bbl, bldgarea / nullif(lotarea, 0) AS null_ratio, coalesce(bldgarea / nullif(lotarea, 0), 0) AS zero_ratio FROM parcel",
    (b.PARCEL,),
)
def _(t):
    a, c = F.col("bldgarea"), F.col("lotarea")
    return b.parcels(t).select("bbl", cln.ratio(a, c).alias("null_ratio"), cln.ratio_or_zero(a, c).alias("zero_ratio"))


@query(
    "b16_parcel_ratios",
    "bbl:i building_to_lot_area_ratio:f residential_area_ratio:f commercial_area_ratio:f office_area_ratio:f retail_area_ratio:f",
    """SELECT bbl, bldgarea / nullif(lotarea, 0) AS building_to_lot_area_ratio, resarea / nullif(bldgarea, 0) AS residential_area_ratio,
       comarea / nullif(bldgarea, 0) AS commercial_area_ratio, officearea / nullif(bldgarea, 0) AS office_area_ratio,
       retailarea / nullif(bldgarea, 0) AS retail_area_ratio FROM parcel""",
    (b.PARCEL,),
)
def _(t):
    return cln.parcel_ratios(b.parcels(t))


# ---- rules -----------------------------------------------------------------------------


@query("c01_type_category", "order_key:i line_no:i request_type rule_category", "SELECT * FROM typed", RULED)
def _(t):
    return cl.classify_types(b.requests(t), "request_type", "rule_category")


@query(
    "c01_text_category",
    "doc_id:i category",
    f"SELECT doc_id, CASE WHEN t = '' THEN 'other' {' '.join(f'''WHEN regexp_matches(t, '{p}') THEN '{c}' ''' for c, p in fv.TYPE_PATTERNS)} ELSE 'other' END AS category FROM (SELECT doc_id, {NORMAL.format('text')} AS t FROM documents) z",
)
def _(t):
    return cl.with_request_category(t.documents.select("doc_id", "text"), "text")


@query(
    "c02_type_descriptor_category",
    "order_key:i line_no:i category",
    f"SELECT order_key, line_no, CASE {' '.join(f'''WHEN regexp_matches(t, '{p}') THEN '{c}' ''' for c, p in fv.TYPE_DESCRIPTOR_PATTERNS)} ELSE 'other' END AS category FROM (SELECT order_key, line_no, lower(coalesce(request_type, '') || ' ' || coalesce(descriptor, '')) AS t FROM req) z",
    (b.REQ,),
)
def _(t):
    rows = b.requests(t).select("order_key", "line_no", "request_type", "descriptor")
    rule = cl.request_category_wordwise(F.col("request_type"), F.col("descriptor"))
    return cl.on_distinct(rows, ["request_type", "descriptor"], lambda d: d.withColumn("category", rule))


def tok(c: str) -> str:
    k = f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"CASE WHEN {k} NOT IN ('', 'nan', 'none', 'null') THEN {k} END"


TAGS = ["amenity", "shop", "tourism", "leisure"]
POI_TYPED = f"""ptyped AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(tags, '{p}') THEN '{c}'" for c, p in fv.POI_PATTERNS)} ELSE 'other' END AS poi_category
  FROM (SELECT osm_id, area, name, amenity, disc, {', '.join(f'{tok(c)} AS k_{c}' for c in TAGS)}, concat_ws(' ', {', '.join(tok(c) for c in TAGS)}) AS tags,
  coalesce({', '.join(tok(c) for c in TAGS)}) AS raw_type FROM poi) z)"""


@query("c03_poi_category", "osm_id:i tags poi_category", "SELECT * FROM ptyped", (b.POI, POI_TYPED))
def _(t):
    tagged = lambda d: cl.with_poi_category(d, TAGS).withColumn("tags", cl.tag_text([F.col(c) for c in TAGS]))
    return cl.on_distinct(b.poi(t), TAGS, tagged)


@query("c04_first_tag", "osm_id:i raw_type", "SELECT * FROM ptyped", (b.POI, POI_TYPED))
def _(t):
    return b.poi(t).select("osm_id", cl.first_tag([F.col(c) for c in TAGS]).alias("raw_type"))


@query(
    "c05_poi_group",
    "osm_id:i poi_group",
    f"SELECT osm_id, CASE WHEN amenity IS NULL THEN 'unknown' {' '.join(f'WHEN lower(amenity) IN {_in(m)} THEN ' + repr(g) for g, m in fv.POI_VALUE_SETS)} ELSE 'other' END AS poi_group FROM poi",
    (b.POI,),
)
def _(t):
    return b.poi(t).select("osm_id", cl.poi_group(F.col("amenity")).alias("poi_group"))


def _case(expr, mapping):
    return f"CASE {expr} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in mapping.items())} ELSE 'unknown' END"


PLAIN = "CASE WHEN TRY_CAST(trim(landuse) AS DOUBLE) IS NOT NULL THEN CAST(CAST(TRY_CAST(trim(landuse) AS DOUBLE) AS INTEGER) AS VARCHAR) ELSE trim(landuse) END"


@query(
    "c06_landuse_mapping",
    "bbl:i land_use_type land_use_group",
    f"SELECT bbl, {_case('c', fv.PARCEL_TYPE)} AS land_use_type, {_case('c', fv.PARCEL_GROUP)} AS land_use_group FROM (SELECT bbl, {PLAIN} AS c FROM parcel) z",
    (b.PARCEL,),
)
def _(t):
    return b.parcels(t).select("bbl", cl.parcel_type(F.col("landuse")).alias("land_use_type"), cl.parcel_group(F.col("landuse")).alias("land_use_group"))


@query(
    "c07_display_label",
    "l_orderkey:i l_linenumber:i label",
    "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' ELSE l_returnflag END AS label FROM lineitem",
)
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", cl.display_label(F.col("l_returnflag"), {"A": "Accepted", "R": "Returned"}).alias("label"))
