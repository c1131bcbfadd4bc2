"""Queries that profile a panel: aggregates, top-k, splits, scaling, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.catalog.features import SAMPLE_SQL
from panelcast.catalog.registry import Data, define_cte, query
from panelcast.operators import clean, profile, rollup
from panelcast.operators import features as FE
from panelcast.operators.joins import lookup_join
from panelcast.operators.quantiles import exact_quantiles
from panelcast.session import stage
from panelcast.sources import panel as P
from panelcast.spec import DEFAULT

KEY = ["store", "dept", "date"]
PROMOS = DEFAULT.promos
PANEL_COLUMNS = (
    "store dept date weekly_sales is_holiday temperature fuel_price cpi unemployment "
    "markdown1 markdown2 markdown3 markdown4 markdown5 type size"
).split()


# --- overview and quality ----------------------------------------------------


@query(
    "a1_overview",
    """SELECT 'train' AS "table", 5::BIGINT AS n_columns, count(*) AS n_rows, min(date) AS "first", max(date) AS "last",
      count(DISTINCT store) AS n_store, count(DISTINCT dept) AS n_dept FROM train
    UNION ALL SELECT 'features', 11, count(*), min(date), max(date), count(DISTINCT store), NULL FROM features
    UNION ALL SELECT 'stores', 3, count(*), NULL, NULL, count(DISTINCT store), NULL FROM stores""",
)
def overview(data: Data) -> DataFrame:
    fact, covariates = P.tables(data.spark, data.folder, data.site)
    return profile.overview({"train": fact, "features": covariates, "stores": data.stores()})


@query(
    "a2_target_quality",
    """SELECT count(*) AS n, sum(weekly_sales) AS total,
    CAST(count_if(weekly_sales < 0) AS BIGINT) AS n_negative, 100.0::DOUBLE * count_if(weekly_sales < 0) / count(*) AS pct_negative,
    CAST(count_if(weekly_sales = 0) AS BIGINT) AS n_zero, 100.0::DOUBLE * count_if(weekly_sales = 0) / count(*) AS pct_zero,
    CAST(count_if(weekly_sales > 0) AS BIGINT) AS n_positive, 100.0::DOUBLE * count_if(weekly_sales > 0) / count(*) AS pct_positive,
    min(weekly_sales) FILTER (weekly_sales < 0) AS lowest_negative,
    max(weekly_sales) FILTER (weekly_sales < 0) AS highest_negative FROM train""",
    r4="total",
    r6="pct_negative pct_zero pct_positive",
)
def target_quality(data: Data) -> DataFrame:
    return profile.target_quality(data.train())


DESCRIBED = (DEFAULT.target, *DEFAULT.covariates, *DEFAULT.promos, DEFAULT.size)


@query(
    "a3_describe",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
    min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50,
    quantile_cont({c}, 0.75) AS q75 FROM panel"""
        for c in DESCRIBED
    ),
    r4="mean std min max q25 q50 q75",
)
def describe(data: Data) -> DataFrame:
    return profile.describe(data.staged_panel(), DESCRIBED)


@query(
    "a4_missing",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS n_missing,
    100.0::DOUBLE * (count(*) - count({c})) / count(*) AS pct_missing FROM panel"""
        for c in PANEL_COLUMNS
    ),
    r6="pct_missing",
)
def missing(data: Data) -> DataFrame:
    return profile.missing_report(data.panel())


def _summary_sql(table: str, columns: list[str]) -> str:
    cells = "\nUNION ALL ".join(
        f"SELECT '{c}' AS c, count(*) - count({c}) AS n, 100.0::DOUBLE * (count(*) - count({c})) / count(*) AS pct FROM {table}"
        for c in columns
    )
    return f"""SELECT '{table}' AS "table", CAST(sum(n) AS BIGINT) AS n_missing, CAST(count_if(n > 0) AS BIGINT) AS n_columns,
    max_by(c, (n, c)) AS worst_column, max(pct) AS worst_pct FROM ({cells}) AS m_{table}"""


_TABLES = {
    "train": PANEL_COLUMNS[:5],
    "features": ["store", "date", *DEFAULT.covariates, *DEFAULT.promos],
    "stores": ["store", "type", "size"],
    "panel": PANEL_COLUMNS,
}


@query("a4_missing_summary", "\nUNION ALL ".join(_summary_sql(t, c) for t, c in _TABLES.items()), r6="worst_pct")
def missing_summary(data: Data) -> DataFrame:
    """Missing cells of the input tables and of the panel made of them."""
    fact, covariates = P.tables(data.spark, data.folder, data.site)
    return profile.missing_summary({"train": fact, "features": covariates, "stores": data.stores(), "panel": data.panel()})


# --- events, groups, leagues -----------------------------------------------------


@query(
    "a5_event_impact",
    """SELECT avg(weekly_sales) FILTER (is_holiday) AS event_mean, sum(weekly_sales) FILTER (is_holiday) AS event_total,
    count(*) FILTER (is_holiday) AS event_rows, stddev_samp(weekly_sales) FILTER (is_holiday) AS event_std,
    avg(weekly_sales) FILTER (NOT is_holiday) AS regular_mean, sum(weekly_sales) FILTER (NOT is_holiday) AS regular_total,
    count(*) FILTER (NOT is_holiday) AS regular_rows, stddev_samp(weekly_sales) FILTER (NOT is_holiday) AS regular_std,
    avg(weekly_sales) FILTER (is_holiday) / avg(weekly_sales) FILTER (NOT is_holiday) AS multiplier,
    (avg(weekly_sales) FILTER (is_holiday) / avg(weekly_sales) FILTER (NOT is_holiday) - 1) * 100 AS boost_pct FROM train""",
    r4="event_mean event_total event_std regular_mean regular_total regular_std boost_pct",
    r6="multiplier",
)
def event_impact(data: Data) -> DataFrame:
    return profile.event_impact(data.train())


@query(
    "a5_event_medians",
    "SELECT is_holiday, quantile_cont(weekly_sales, 0.5) AS median FROM train GROUP BY is_holiday",
    r4="median",
)
def event_medians(data: Data) -> DataFrame:
    return profile.event_medians(data.staged_train())


_GROUP_SQL = (
    "avg(weekly_sales) AS mean, sum(weekly_sales) AS total, count(*) AS n, stddev_samp(weekly_sales) AS std"
)


@query(
    "a6_store_types", f"SELECT type, {_GROUP_SQL} FROM panel GROUP BY type", r4="mean total std"
)
def store_types(data: Data) -> DataFrame:
    return profile.group_profile(data.panel(), ["type"])


def _departments(data: Data) -> DataFrame:
    return profile.group_profile(data.train(), ["dept"])


@query(
    "a7_department_league", f"SELECT dept, {_GROUP_SQL} FROM train GROUP BY dept", r2="mean total std"
)
def department_league(data: Data) -> DataFrame:
    return _departments(data)


@query(
    "a7_k2_top_departments",
    """SELECT dept, sum(weekly_sales) AS total FROM train GROUP BY dept ORDER BY total DESC, dept LIMIT 3""",
    r4="total",
)
def top_departments(data: Data) -> DataFrame:
    return profile.top_k(_departments(data).select("dept", "total"), "total", "dept", 3)


@query(
    "a7_k2_bottom_departments",
    """SELECT dept, sum(weekly_sales) AS total FROM train GROUP BY dept ORDER BY total, dept LIMIT 3""",
    r4="total",
)
def bottom_departments(data: Data) -> DataFrame:
    return profile.top_k(_departments(data).select("dept", "total"), "total", "dept", 3, bottom=True)


@query(
    "a7_extreme_departments",
    """WITH d AS (SELECT dept, avg(weekly_sales) AS m, stddev_samp(weekly_sales) AS s FROM train GROUP BY dept)
    SELECT (SELECT dept FROM d ORDER BY m DESC, dept LIMIT 1) AS best_mean,
    (SELECT dept FROM d ORDER BY s DESC, dept LIMIT 1) AS most_volatile""",
)
def extreme_departments(data: Data) -> DataFrame:
    return _departments(data).agg(
        F.max_by("dept", "mean").alias("best_mean"), F.max_by("dept", "std").alias("most_volatile")
    )


@query(
    "a8_promo_effect",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS promo, 100.0::DOUBLE * count({c}) / count(*) AS availability_pct, avg({c}) AS mean_value,
    avg(weekly_sales) FILTER ({c} IS NOT NULL) AS sales_with, avg(weekly_sales) FILTER ({c} IS NULL) AS sales_without,
    CASE WHEN avg(weekly_sales) FILTER ({c} IS NULL) > 0 THEN avg(weekly_sales) FILTER ({c} IS NOT NULL)
      / avg(weekly_sales) FILTER ({c} IS NULL) ELSE 0 END AS ratio FROM panel"""
        for c in PROMOS
    ),
    r4="availability_pct mean_value sales_with sales_without",
    r6="ratio",
)
def promo_effect(data: Data) -> DataFrame:
    return profile.promo_effect(data.panel())


@query(
    "a9_totals_by_date",
    "SELECT date, sum(weekly_sales) AS total, avg(weekly_sales) AS mean FROM train GROUP BY date",
    r4="total mean",
)
def totals_by_date(data: Data) -> DataFrame:
    return profile.totals_by_time(data.train())


@query(
    "a10_months",
    """SELECT CAST(month(date) AS INTEGER) AS month, avg(weekly_sales) AS mean, sum(weekly_sales) AS total,
    count(*) AS n, stddev_samp(weekly_sales) AS std FROM train GROUP BY 1""",
    r4="mean total std",
)
def months(data: Data) -> DataFrame:
    return profile.group_profile(data.train().withColumn("month", F.month("date")), ["month"])


@query(
    "a10_year_growth",
    """WITH y AS (SELECT CAST(year(date) AS INTEGER) AS year, sum(weekly_sales) AS total, avg(weekly_sales) AS mean
    FROM train GROUP BY 1)
    SELECT *, 100 * (total - lag(total) OVER (ORDER BY year)) / lag(total) OVER (ORDER BY year) AS growth_pct FROM y""",
    r4="total mean growth_pct",
)
def year_growth(data: Data) -> DataFrame:
    return profile.yearly_growth(data.train())


@query(
    "a10_first_to_last_growth",
    """WITH y AS (SELECT CAST(year(date) AS INTEGER) AS year, sum(weekly_sales) AS t FROM train GROUP BY 1)
    SELECT min(year) AS first_year, max(year) AS last_year,
    100 * (arg_max(t, year) - arg_min(t, year)) / arg_min(t, year) AS growth_pct FROM y""",
    r4="growth_pct",
)
def first_to_last(data: Data) -> DataFrame:
    return profile.first_to_last_growth(data.train())


@query(
    "a10_k3_best_month",
    """WITH m AS (SELECT CAST(month(date) AS INTEGER) AS month, avg(weekly_sales) AS v FROM train GROUP BY 1)
    SELECT (SELECT month FROM m ORDER BY v DESC, month LIMIT 1) AS best, (SELECT month FROM m ORDER BY v, month LIMIT 1) AS worst,
    max(v) AS best_value, min(v) AS worst_value, 100 * (max(v) - min(v)) / min(v) AS variation_pct FROM m""",
    r4="best_value worst_value variation_pct",
)
def best_month(data: Data) -> DataFrame:
    means = data.train().groupBy(F.month("date").alias("month")).agg(F.avg("weekly_sales").alias("v"))
    return profile.best_and_worst(means, "month", "v")


@query(
    "a11_store_profile",
    f"SELECT store, type, size, {_GROUP_SQL} FROM panel GROUP BY store, type, size",
    r4="mean total std",
)
def store_profile(data: Data) -> DataFrame:
    return profile.store_profile(data.panel())


@query(
    "a11_volatile_stores",
    """SELECT store, stddev_samp(weekly_sales) AS std FROM train GROUP BY store ORDER BY std DESC NULLS LAST, store LIMIT 10""",
    r4="std",
)
def volatile_stores(data: Data) -> DataFrame:
    by_store = profile.group_profile(data.train(), ["store"])
    return profile.top_k(by_store.select("store", "std"), "std", "store", 10)


@query(
    "a12_headline",
    """SELECT sum(weekly_sales) AS total, avg(weekly_sales) AS mean, count(DISTINCT store) AS n_sites,
    count(DISTINCT dept) AS n_departments, min(date) AS "first", max(date) AS "last",
    avg(weekly_sales) FILTER (is_holiday) AS event_mean, avg(weekly_sales) FILTER (NOT is_holiday) AS regular_mean,
    (SELECT store FROM panel GROUP BY store ORDER BY sum(weekly_sales) DESC, store LIMIT 1) AS top_site,
    (SELECT dept FROM panel GROUP BY dept ORDER BY sum(weekly_sales) DESC, dept LIMIT 1) AS top_department,
    (SELECT type FROM panel GROUP BY type ORDER BY sum(weekly_sales) DESC, type LIMIT 1) AS top_type FROM panel""",
    r4="total mean event_mean regular_mean",
)
def headline(data: Data) -> DataFrame:
    return profile.headline(data.staged_panel())


@query(
    "a13_promo_counts",
    """SELECT date, CAST(sum(CAST(markdown1 IS NOT NULL AS INT) + CAST(markdown2 IS NOT NULL AS INT)
    + CAST(markdown3 IS NOT NULL AS INT) + CAST(markdown4 IS NOT NULL AS INT)
    + CAST(markdown5 IS NOT NULL AS INT)) AS BIGINT) AS promo_cells FROM panel GROUP BY date""",
)
def promo_counts(data: Data) -> DataFrame:
    return profile.promo_counts(data.panel())


# --- roll-ups ----------------------------------------------------------------------


_ROLL = """sum(weekly_sales) AS weekly_sales, max(CAST(is_holiday AS INTEGER)) AS is_holiday,
    avg(temperature) AS temperature, avg(fuel_price) AS fuel_price, avg(cpi) AS cpi, avg(unemployment) AS unemployment"""
_ROLL_ROUND = "weekly_sales temperature fuel_price cpi unemployment markdown1 markdown2 markdown3 markdown4 markdown5"


@query(
    "a15_rollup_date",
    f"SELECT date, {_ROLL}, {', '.join(f'sum({c}) AS {c}' for c in PROMOS)}, max(size) AS size FROM panel GROUP BY date",
    r8=_ROLL_ROUND,
)
def rollup_date(data: Data) -> DataFrame:
    return rollup.rollup_panel(data.panel(), ["date"])


@query(
    "a15_rollup_store_date",
    f"SELECT store, date, {_ROLL}, {', '.join(f'avg({c}) AS {c}' for c in PROMOS)}, max(size) AS size "
    "FROM panel GROUP BY store, date",
    r8=_ROLL_ROUND,
)
def rollup_store_date(data: Data) -> DataFrame:
    return rollup.rollup_panel(data.panel(), ["store", "date"], promo="mean")


_RESAMPLED = [*DEFAULT.covariates, DEFAULT.event]


@query(
    "a16_weekly_resample",
    f"""WITH x AS (SELECT store, dept, date + (7 - isodow(date))::INT AS date, sum(weekly_sales) AS y,
      {", ".join(f"avg({c}) AS {c}" for c in DEFAULT.covariates)}, max(CAST(is_holiday AS DOUBLE)) AS is_holiday FROM panel GROUP BY 1, 2, 3),
    g AS (SELECT store, dept, CAST(unnest(generate_series(min(date), max(date), INTERVAL 7 DAY)) AS DATE) AS date
      FROM x GROUP BY store, dept),
    j AS (SELECT g.*, x.* EXCLUDE (store, dept, date) FROM g LEFT JOIN x USING (store, dept, date)),
    f AS (SELECT store, dept, date, coalesce(y, 0) AS weekly_sales,
      {", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER a, first_value({c} IGNORE NULLS) OVER b) AS {c}" for c in _RESAMPLED)}
      FROM j WINDOW a AS (PARTITION BY store, dept ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      b AS (PARTITION BY store, dept ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT store, dept, date, weekly_sales,
      {", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM x)) AS {c}" for c in _RESAMPLED)} FROM f""",
    r4=" ".join(DEFAULT.covariates),
)
def weekly_resample(data: Data) -> DataFrame:
    return rollup.resample_weekly(
        data.staged_panel(), DEFAULT, ["store", "dept"], ["weekly_sales"], list(DEFAULT.covariates), ["is_holiday"]
    )


@query(
    "a17_hierarchy_totals",
    """WITH d AS (SELECT DISTINCT date FROM train),
    t AS (SELECT store, dept, date, sum(weekly_sales) AS y, grouping(store, dept) AS g FROM train
      GROUP BY GROUPING SETS ((date), (store, date), (store, dept, date))),
    n AS (SELECT DISTINCT g, store, dept FROM t)
    SELECT CASE n.g WHEN 3 THEN 'Total' WHEN 1 THEN 'Store' ELSE 'Store_Department' END AS level, n.store, n.dept, d.date,
      coalesce(t.y, 0) AS y
    FROM n CROSS JOIN d LEFT JOIN t ON t.g = n.g AND t.date = d.date AND t.store IS NOT DISTINCT FROM n.store
      AND t.dept IS NOT DISTINCT FROM n.dept""",
    r4="y",
)
def hierarchy_totals(data: Data) -> DataFrame:
    return rollup.hierarchy_totals(data.staged_train())


@query("a18_series_list", "SELECT DISTINCT store, dept FROM train")
def series_list(data: Data) -> DataFrame:
    return data.train().select("store", "dept").distinct()


@query(
    "a19_value_counts",
    "SELECT type, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM panel) AS pct FROM panel GROUP BY type",
    r6="pct",
)
def value_counts(data: Data) -> DataFrame:
    return profile.value_counts(data.staged_panel(), "type")


@query(
    "a20_pivot_means",
    """WITH d AS (SELECT dept FROM train GROUP BY dept ORDER BY sum(weekly_sales) DESC, dept LIMIT 15),
    s AS (SELECT store FROM train GROUP BY store ORDER BY sum(weekly_sales) DESC, store LIMIT 8),
    m AS (SELECT store, dept, avg(weekly_sales) AS mean FROM train SEMI JOIN d USING (dept) SEMI JOIN s USING (store)
      GROUP BY store, dept)
    SELECT s.store, d.dept, coalesce(m.mean, 0) AS mean FROM s CROSS JOIN d LEFT JOIN m ON m.store = s.store AND m.dept = d.dept""",
    r4="mean",
)
def pivot_means(data: Data) -> DataFrame:
    return profile.pivot_means(data.staged_train(), {"store": 8, "dept": 15})


@query(
    "a21_pivot_date_flag",
    """SELECT date, sum(weekly_sales) FILTER (is_holiday) AS event, sum(weekly_sales) FILTER (NOT is_holiday) AS regular
    FROM train GROUP BY date""",
    r4="event regular",
)
def pivot_date_flag(data: Data) -> DataFrame:
    return profile.pivot_by_event(data.train(), "date")


@query(
    "a21_pivot_type_flag",
    """SELECT type, avg(weekly_sales) FILTER (is_holiday) AS event, avg(weekly_sales) FILTER (NOT is_holiday) AS regular
    FROM panel GROUP BY type""",
    r4="event regular",
)
def pivot_type_flag(data: Data) -> DataFrame:
    return profile.pivot_by_event(data.panel(), "type", F.avg)


def histogram_sql(source: str, col: str, bins: int) -> str:
    return f"""WITH h AS (SELECT {col} AS v FROM {source} WHERE {col} IS NOT NULL),
    s AS (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM h),
    b AS (SELECT CAST(least(coalesce(floor((v - lo) / nullif(hi - lo, 0) * {bins}), 0), {bins - 1}) AS INTEGER) AS bin,
      count(*) AS n FROM h, s GROUP BY 1)
    SELECT CAST(g.bin AS INTEGER) AS bin, lo + g.bin * ((hi - lo) / {bins}) AS left_edge, coalesce(n, 0) AS n
    FROM range(0, {bins}) g(bin) CROSS JOIN s LEFT JOIN b ON b.bin = g.bin"""


@query("a22_histogram_target", histogram_sql("train", "weekly_sales", 50), r4="left_edge")
def histogram_target(data: Data) -> DataFrame:
    return profile.histogram(data.staged_train(), "weekly_sales", 50)


@query(
    "a22_histogram_log",
    histogram_sql("(SELECT ln(1 + weekly_sales) AS l FROM train WHERE weekly_sales > 0)", "l", 30),
    r4="left_edge",
)
def histogram_log(data: Data) -> DataFrame:
    logs = data.staged_train().where("weekly_sales > 0").select(F.log1p("weekly_sales").alias("l"))
    return profile.histogram(logs, "l", 30)


for _column in DEFAULT.covariates:

    def _histogram(data: Data, column: str = _column) -> DataFrame:
        return profile.histogram(data.staged_panel(), column, 30)

    query(f"a22_histogram_{_column}", histogram_sql("panel", _column, 30), r4="left_edge")(_histogram)


@query(
    "a22_histogram_departments",
    histogram_sql("(SELECT sum(weekly_sales) AS total FROM train GROUP BY dept)", "total", 20),
    r4="left_edge",
)
def histogram_departments(data: Data) -> DataFrame:
    totals = data.train().groupBy("dept").agg(F.sum("weekly_sales").alias("total"))
    return profile.histogram(stage(totals, "totals"), "total", 20)


@query("a22_histogram_size", histogram_sql("panel", "size", 20), r4="left_edge")
def histogram_size(data: Data) -> DataFrame:
    return profile.histogram(data.staged_panel(), "size", 20)


@query(
    "a23_box_plot",
    """WITH q AS (SELECT type, quantile_cont(weekly_sales, 0.25) AS q25, quantile_cont(weekly_sales, 0.5) AS median,
      quantile_cont(weekly_sales, 0.75) AS q75 FROM panel GROUP BY type),
    f AS (SELECT *, q25 - 1.5 * (q75 - q25) AS low_fence, q75 + 1.5 * (q75 - q25) AS high_fence FROM q)
    SELECT f.*, min(weekly_sales) AS min, max(weekly_sales) AS max,
      CAST(count_if(weekly_sales < low_fence OR weekly_sales > high_fence) AS BIGINT) AS n_outside
    FROM panel JOIN f USING (type) GROUP BY ALL""",
    r4="q25 median q75 low_fence high_fence min max",
)
def box_plot(data: Data) -> DataFrame:
    return profile.box_plot(data.staged_panel(), "weekly_sales", "type")


@query(
    "a23_exact_quantiles",
    "\nUNION ALL ".join(
        f"SELECT store, {p}::DOUBLE AS prob, quantile_cont(weekly_sales, {p}) AS value FROM train GROUP BY store"
        for p in (0.05, 0.5, 0.95)
    ),
    site="supplier",
    r4="value",
)
def quantiles_by_supplier(data: Data) -> DataFrame:
    return exact_quantiles(data.staged_train(), "weekly_sales", [0.05, 0.5, 0.95], ["store"])


@query(
    "a24_monthly_promo",
    """SELECT CAST(date_trunc('month', date) AS DATE) AS month, avg(markdown1) AS mean_promo,
    avg(weekly_sales) AS mean_sales FROM panel WHERE markdown1 IS NOT NULL GROUP BY 1""",
    r4="mean_promo mean_sales",
)
def monthly_promo(data: Data) -> DataFrame:
    return profile.monthly_promo(data.panel(), "markdown1")


# --- sorts, limits, sets --------------------------------------------------------------


@query(
    "k4_abs_order",
    """SELECT store, dept, date, weekly_sales FROM train ORDER BY abs(weekly_sales) DESC, store, dept, date""",
)
def abs_order(data: Data) -> DataFrame:
    order = [F.abs("weekly_sales").desc(), *KEY]
    return data.train().orderBy(*order).select(*KEY, "weekly_sales")


@query(
    "k5_validation_start",
    'SELECT min(date) AS "start" FROM (SELECT DISTINCT date FROM train ORDER BY date DESC LIMIT 8)',
)
def validation_start(data: Data) -> DataFrame:
    return clean.validation_start(data.train())


# --- splits, scaling, imputation ----------------------------------------------------------


@query(
    "c4_time_split",
    """SELECT CASE WHEN date < start THEN 'train' ELSE 'validation' END AS part, count(*) AS n, min(date) AS "first",
    max(date) AS "last", sum(weekly_sales) AS total FROM train, cut GROUP BY 1""",
    r4="total",
)
def time_split(data: Data) -> DataFrame:
    fit, val = clean.time_split(data.staged_train())
    both = fit.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("validation")))
    return both.groupBy("part").agg(
        F.count("*").alias("n"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        F.sum("weekly_sales").alias("total"),
    )


@query(
    "c5_folds",
    """WITH d AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS back FROM (SELECT DISTINCT date FROM train)),
    f AS (SELECT CAST(3 - back // 8 AS INTEGER) AS fold, min(date) AS val_start, max(date) AS val_end FROM d
      WHERE back < 24 GROUP BY 1),
    r AS (SELECT f.fold, CASE WHEN t.date < f.val_start THEN 'train' ELSE 'validation' END AS role, t.*
      FROM train t, f WHERE t.date <= f.val_end)
    SELECT fold, role, count(*) AS n, max(date) AS "last", sum(weekly_sales) AS total FROM r GROUP BY fold, role""",
    r4="total",
)
def folds(data: Data) -> DataFrame:
    fact = data.staged_train()
    rows = clean.assign_folds(fact, clean.walk_forward_folds(fact))
    return rows.groupBy("fold", "role").agg(
        F.count("*").alias("n"), F.max("date").alias("last"), F.sum("weekly_sales").alias("total")
    )


@query(
    "c2_mean_impute",
    """SELECT store, dept, date, coalesce(temperature, (SELECT avg(temperature) FROM panel)) AS temperature,
    coalesce(markdown1, (SELECT avg(markdown1) FROM panel)) AS markdown1 FROM panel""",
    r4="temperature markdown1",
)
def mean_impute(data: Data) -> DataFrame:
    cols = ["temperature", "markdown1"]
    return clean.mean_impute(data.staged_panel(), cols).select(*KEY, *cols)


@query(
    "c3_scale",
    """SELECT store, dept, date, (weekly_sales - ms) / ss AS weekly_sales_scaled, (temperature - mt) / st AS temperature_scaled
    FROM panel, (SELECT avg(weekly_sales) ms, stddev_pop(weekly_sales) ss, avg(temperature) mt, stddev_pop(temperature) st
      FROM panel, cut WHERE date < start) s""",
    r6="weekly_sales_scaled temperature_scaled",
)
def scale(data: Data) -> DataFrame:
    panel = data.staged_panel()
    fit, _ = clean.time_split(panel)
    out = clean.scale(panel, ["weekly_sales", "temperature"], fit_on=fit)
    return out.select(*KEY, "weekly_sales_scaled", "temperature_scaled")


define_cte(
    "chain_lag",
    """SELECT store, dept, date, rn, temperature, coalesce(markdown1, 0) AS markdown1,
    last_value(lag4 IGNORE NULLS) OVER (PARTITION BY store, dept ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lag4
    FROM (SELECT *, lag(weekly_sales, 4) OVER w AS lag4, row_number() OVER w AS rn FROM panel
      WINDOW w AS (PARTITION BY store, dept ORDER BY date))""",
)


@query(
    "c1_impute_series",
    """SELECT c.store, c.dept, c.date, c.markdown1, coalesce(c.lag4, 0) AS weekly_sales_lag_4,
    coalesce(l.temperature, 0) AS temperature FROM chain_lag c JOIN lined l USING (store, dept, date)""",
    r6="temperature",
)
def impute_series(data: Data) -> DataFrame:
    return _imputed(data, across=False)


@query(
    "c1_impute_global",
    """WITH j AS (SELECT c.store, c.dept, c.date, c.markdown1, c.lag4, l.temperature FROM chain_lag c
      JOIN lined l USING (store, dept, date))
    SELECT store, dept, date, markdown1,
      coalesce(last_value(lag4 IGNORE NULLS) OVER a, first_value(lag4 IGNORE NULLS) OVER b, 0) AS weekly_sales_lag_4,
      coalesce(last_value(temperature IGNORE NULLS) OVER a, first_value(temperature IGNORE NULLS) OVER b, 0) AS temperature
    FROM j WINDOW a AS (ORDER BY store, dept, date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      b AS (ORDER BY store, dept, date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    r6="temperature",
)
def impute_global(data: Data) -> DataFrame:
    return _imputed(data, across=True)


def _imputed(data: Data, across: bool) -> DataFrame:
    panel = data.staged_panel() if across else data.panel()
    lagged = FE.add_lags(panel, (4,))
    out = clean.impute(lagged, ["weekly_sales_lag_4"], ["temperature"], across)
    return out.select(*KEY, "markdown1", "weekly_sales_lag_4", "temperature")


@query("c7_bounded_sample", SAMPLE_SQL.format(n=200))
def bounded_sample(data: Data) -> DataFrame:
    return clean.bounded_sample(data.train(), 200, KEY)


@query(
    "k6_keep_last",
    """WITH u AS (SELECT 1 AS run, dept, sum(weekly_sales) AS total FROM train GROUP BY dept
      UNION ALL SELECT 2, dept, sum(weekly_sales) FROM train WHERE is_holiday GROUP BY dept HAVING sum(weekly_sales) > 0)
    SELECT dept, arg_max(total, run) AS total FROM u GROUP BY dept""",
    r4="total",
)
def keep_last(data: Data) -> DataFrame:
    """Results of two runs joined by name; the later run of a name wins."""
    fact = data.staged_train()
    totals = fact.groupBy("dept").agg(F.sum("weekly_sales").alias("total"))
    events = fact.where("is_holiday").groupBy("dept").agg(F.sum("weekly_sales").alias("total"))
    runs = totals.withColumn("run", F.lit(1)).unionByName(
        events.where("total > 0").withColumn("run", F.lit(2))
    )
    return runs.groupBy("dept").agg(F.max_by("total", "run").alias("total"))


@query(
    "j5_events_by_name",
    """SELECT CASE weekofyear(date) WHEN 6 THEN 'Super Bowl' WHEN 36 THEN 'Labor Day'
    WHEN 47 THEN 'Thanksgiving' WHEN 52 THEN 'Christmas' ELSE 'Regular' END AS holiday,
    avg(weekly_sales) AS mean, sum(weekly_sales) AS total, count(*) AS n, stddev_samp(weekly_sales) AS std
    FROM train GROUP BY 1""",
    r4="mean total std",
)
def events_by_name(data: Data) -> DataFrame:
    labelled = profile.label_events(data.train(), P.event_calendar(data.train()))
    return profile.group_profile(labelled, ["holiday"])


@query(
    "j2_type_shares",
    """SELECT type, count(*) AS n, sum(weekly_sales) AS total FROM train t JOIN stores s ON t.store = s.store GROUP BY type""",
    r4="total",
)
def type_shares(data: Data) -> DataFrame:
    joined = lookup_join(data.train(), data.stores(), ["store"], "inner")
    return joined.groupBy("type").agg(F.count("*").alias("n"), F.sum("weekly_sales").alias("total"))
