"""Queries over statistics of panels and series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.catalog.registry import Data, define_cte, query, tail_sql
from panelcast.operators import clean, insight, profile, stats
from panelcast.operators import features as FE
from panelcast.spec import DEFAULT

COVARIATES = list(DEFAULT.covariates)
PROMOS = list(DEFAULT.promos)
ANALYSED = list(insight.FEATURES)

define_cte(
    "site_weeks",
    """SELECT store, date, sum(weekly_sales) AS weekly_sales, max(CAST(is_holiday AS INTEGER)) AS is_holiday,
    avg(temperature) AS temperature, avg(fuel_price) AS fuel_price, avg(cpi) AS cpi, avg(unemployment) AS unemployment,
    avg(coalesce(markdown1, 0) + coalesce(markdown2, 0) + coalesce(markdown3, 0) + coalesce(markdown4, 0)
      + coalesce(markdown5, 0)) AS promo_total, avg(size) AS size FROM panel GROUP BY store, date""",
)
define_cte("total_weeks", "SELECT date, sum(weekly_sales) AS y FROM train GROUP BY date")


def corr_sql(x: str, y: str) -> str:
    return (
        f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) FILTER ({y} IS NOT NULL)"
        f" * stddev_pop({y}) FILTER ({x} IS NOT NULL), 0)"
    )


def count_sql(x: str, y: str) -> str:
    return f"CAST(count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS BIGINT)"


def analysis(data: Data) -> DataFrame:
    return insight.analysis_table(data.panel())


def total_series(data: Data) -> DataFrame:
    return data.train().groupBy(F.lit("Total").alias("node"), "date").agg(F.sum("weekly_sales").alias("y"))


def store_series(data: Data) -> DataFrame:
    return data.train().groupBy("store", "date").agg(F.sum("weekly_sales").alias("y"))


@query(
    "i1_p2_w4_analysis_table",
    """SELECT *, lag(weekly_sales, 1) OVER w AS sales_lag1, lag(weekly_sales, 2) OVER w AS sales_lag2,
    CASE WHEN count(*) OVER w3 = 3 THEN avg(weekly_sales) OVER w3 END AS sales_ma3,
    CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(weekofyear(date) AS INTEGER) AS week,
    CAST(quarter(date) AS INTEGER) AS quarter, CAST(dayofyear(date) AS INTEGER) AS day_of_year FROM site_weeks
    WINDOW w AS (PARTITION BY store ORDER BY date),
      w3 AS (PARTITION BY store ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    r6="temperature fuel_price cpi unemployment promo_total size sales_ma3",
)
def analysis_table(data: Data) -> DataFrame:
    return analysis(data)


@query(
    "t1_correlations",
    "\nUNION ALL ".join(
        f"SELECT '{f}' AS feature, {count_sql(f, 'weekly_sales')} AS n, {corr_sql(f, 'weekly_sales')} AS r FROM panel"
        for f in [*COVARIATES, *PROMOS, "size"]
    ),
    r6="r",
)
def correlations(data: Data) -> DataFrame:
    return stats.correlations(data.panel(), "weekly_sales", [*COVARIATES, *PROMOS, "size"])


@query(
    "t1_strongest_features",
    "WITH c AS ("
    + "\nUNION ALL ".join(
        f"SELECT '{f}' AS feature, {corr_sql(f, 'weekly_sales')} AS r FROM panel" for f in COVARIATES
    )
    + ") SELECT feature, r FROM c WHERE r IS NOT NULL ORDER BY abs(r) DESC, feature LIMIT 3",
    r6="r",
)
def strongest_features(data: Data) -> DataFrame:
    corr = stats.correlations(data.panel(), "weekly_sales", COVARIATES)
    return stats.strongest(corr).select("feature", "r")


def matrix_sql(cols: list[str], source: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {count_sql(a, b)} AS n, {corr_sql(a, b)} AS r FROM {source}"
        for i, a in enumerate(cols)
        for b in cols[i + 1 :]
    )


@query("t2_promo_matrix", matrix_sql(PROMOS, "panel"), r6="r")
def promo_matrix(data: Data) -> DataFrame:
    return stats.correlation_matrix(data.panel(), PROMOS)


MATRIX = ["weekly_sales", *COVARIATES, "size", *PROMOS]


@query(
    "t2_imputed_matrix",
    "WITH m AS (SELECT "
    + ", ".join(f"coalesce({c}, (SELECT avg({c}) FROM panel)) AS {c}" for c in MATRIX)
    + " FROM panel) "
    + matrix_sql(MATRIX, "m"),
    r6="r",
)
def imputed_matrix(data: Data) -> DataFrame:
    return stats.correlation_matrix(clean.mean_impute(data.staged_panel(), MATRIX), MATRIX)


CLASSED = [*PROMOS, "size"]


@query(
    "t3_correlation_classes",
    f"WITH m AS ({matrix_sql(CLASSED, 'panel')}) "
    """SELECT a, b, n, r, CASE WHEN abs(r) > 0.5 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength,
    CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM m WHERE abs(r) > 0.1""",
    r6="r",
)
def correlation_classes(data: Data) -> DataFrame:
    return stats.correlation_classes(stats.correlation_matrix(data.panel(), CLASSED))


_SITE_CORR = "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, {count_sql(f, 'weekly_sales')} AS n, {corr_sql(f, 'weekly_sales')} AS r FROM site_weeks"
    for f in ANALYSED
)
define_cte("site_corr", _SITE_CORR)


@query(
    "t4_correlation_t",
    "SELECT feature, n, r, r * sqrt((n - 2) / (1 - r * r)) AS t FROM site_corr WHERE n > 10 AND r IS NOT NULL",
    r6="r t",
)
def correlation_t(data: Data) -> DataFrame:
    corr = stats.correlations(analysis(data), "weekly_sales", ANALYSED)
    return stats.with_significance(corr).select("feature", "n", "r", "t")


@query(
    "t4_significance",
    f"""WITH c AS (SELECT feature, n, r, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df FROM site_corr
      WHERE n > 10 AND r IS NOT NULL), p AS ({tail_sql("c", "feature")})
    SELECT c.feature, n, r, t, p_value, p_value < 0.05 AS significant FROM c JOIN p USING (feature)""",
    r6="r t p_value",
)
def significance(data: Data) -> DataFrame:
    return stats.with_significance(stats.correlations(analysis(data), "weekly_sales", ANALYSED))


_LAG_SQL = "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, {k} AS lag, {count_sql('x', 'weekly_sales')} AS n, {corr_sql('x', 'weekly_sales')} AS r "
    f"FROM (SELECT weekly_sales, lag({f}, {k}) OVER (PARTITION BY store ORDER BY date) AS x FROM site_weeks)"
    for f in ANALYSED
    for k in range(4)
)


def _lagged(data: Data) -> DataFrame:
    return stats.lagged_correlations(analysis(data), "weekly_sales", ANALYSED, ["store"], "date")


@query("t5_w5_lagged_correlations", _LAG_SQL, r6="r")
def lagged_correlations(data: Data) -> DataFrame:
    return _lagged(data)


@query(
    "t5_strongest_lag",
    f"WITH c AS ({_LAG_SQL}) SELECT feature, lag, r FROM c WHERE r IS NOT NULL QUALIFY row_number() OVER "
    "(PARTITION BY feature ORDER BY abs(r) DESC, lag) = 1",
    r6="r",
)
def strongest_lag(data: Data) -> DataFrame:
    return stats.strongest_lag(_lagged(data))


def _gain_sql(feature: str) -> str:
    """The covariance elimination as chained selects over one feature's matrix."""
    names = ["y", "y1", "y2", "x1", "x2"]
    cells = ", ".join(f"covar_pop({a}, {b}) AS {a}_{b}" for i, a in enumerate(names) for b in names[i:])
    spread = ", ".join(f"var_pop({v}) AS v_{v}" for v in names)
    text = f"""SELECT count(*) AS n, {cells}, {spread} FROM (SELECT weekly_sales AS y, lag(weekly_sales, 1) OVER w AS y1,
      lag(weekly_sales, 2) OVER w AS y2, lag({feature}, 1) OVER w AS x1, lag({feature}, 2) OVER w AS x2
      FROM site_weeks WHERE {feature} IS NOT NULL WINDOW w AS (PARTITION BY store ORDER BY date)) WHERE y2 IS NOT NULL"""
    rest = names
    for k in names[1:]:
        rest = [n for n in rest if n != k]

        def cell(a: str, b: str) -> str:
            return f"{a}_{b}" if names.index(a) <= names.index(b) else f"{b}_{a}"

        given = ", ".join(
            f"{cell(a, b)} - CASE WHEN {cell(k, k)} > v_{k} * 1e-9 THEN {cell(a, k)} * {cell(b, k)} / {cell(k, k)} ELSE 0 END AS {cell(a, b)}"
            for i, a in enumerate(rest)
            for b in rest[i:]
        )
        kept = "n, " + ", ".join(f"v_{v}" for v in names) + (", own" if k in ("x1", "x2") else "")
        text = f"SELECT {kept}, {given} FROM ({text})"
        if k == "y2":
            text = f"SELECT *, 1 - y_y / v_y AS own FROM ({text})"
    return f"SELECT '{feature}' AS feature, n, own AS r2_without, 1 - y_y / v_y AS r2_with FROM ({text})"


@query(
    "t6_predictive_gain",
    "WITH g AS ("
    + "\nUNION ALL ".join(_gain_sql(f) for f in ANALYSED)
    + """) SELECT *, r2_with - r2_without AS gain, greatest(r2_with - r2_without, 0) AS strength,
    r2_with - r2_without > 0.01 AS significant FROM g""",
    r6="r2_without r2_with gain strength",
)
def predictive_gain(data: Data) -> DataFrame:
    return stats.predictive_gain(analysis(data), "weekly_sales", ANALYSED, ["store"], "date")


TRENDED = ["weekly_sales", *ANALYSED]


@query(
    "t8_long_term_trend",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS feature, s AS slope, CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing'
      ELSE 'stable' END AS direction, CASE WHEN abs(s) > sd / 1000 THEN 'strong' ELSE 'weak' END AS strength
    FROM (SELECT regr_slope({c}, epoch(date) - 946684800) AS s, stddev_samp({c}) AS sd FROM site_weeks)"""
        for c in TRENDED
    ),
    r12="slope",
)
def long_term_trend(data: Data) -> DataFrame:
    return stats.long_term_trend(analysis(data), TRENDED, "date")


define_cte(
    "parts_store",
    """WITH s AS (SELECT store, date, sum(weekly_sales) AS observed FROM train GROUP BY store, date),
    b AS (SELECT *, (row_number() OVER w - 1) % 52 AS phase, count(*) OVER (PARTITION BY store) AS n,
      CASE WHEN count(*) OVER (PARTITION BY store ORDER BY date ROWS BETWEEN 26 PRECEDING AND 26 FOLLOWING) = 53
        THEN (sum(observed) OVER (PARTITION BY store ORDER BY date ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)
          + 0.5 * (lag(observed, 26) OVER w + lead(observed, 26) OVER w)) / 52 END AS trend
      FROM s WINDOW w AS (PARTITION BY store ORDER BY date)),
    p AS (SELECT store, phase, avg(observed - trend) AS m FROM b WHERE n >= 104 GROUP BY store, phase),
    c AS (SELECT store, phase, m - avg(m) OVER (PARTITION BY store) AS seasonal FROM p)
    SELECT store, date, observed, trend, seasonal, observed - trend - seasonal AS resid FROM b JOIN c USING (store, phase)""",
)


@query("t9_decompose", "SELECT * FROM parts_store", r4="trend seasonal resid")
def decompose(data: Data) -> DataFrame:
    return stats.decompose(store_series(data), ["store"], "date", "y")


@query(
    "t10_component_strengths",
    """SELECT store, stddev_samp(trend) / stddev_samp(observed) AS trend_strength,
    stddev_samp(seasonal) / stddev_samp(observed) AS seasonal_strength,
    stddev_samp(resid) / stddev_samp(observed) AS resid_strength FROM parts_store GROUP BY store""",
    r6="trend_strength seasonal_strength resid_strength",
)
def component_strengths(data: Data) -> DataFrame:
    parts = stats.decompose(store_series(data), ["store"], "date", "y")
    return stats.component_strengths(parts, ["store"])


_ACF = """WITH s AS (SELECT store, row_number() OVER (PARTITION BY store ORDER BY date) AS rn,
      sum(weekly_sales) - avg(sum(weekly_sales)) OVER (PARTITION BY store) AS d FROM train GROUP BY store, date),
    v AS (SELECT store, sum(d * d) AS q FROM s GROUP BY store),
    p AS (SELECT a.store, a.rn - b.rn AS lag, sum(a.d * b.d) AS c FROM s a JOIN s b ON a.store = b.store
      AND a.rn - b.rn BETWEEN 0 AND 52 GROUP BY 1, 2),
    f AS (SELECT v.store, CAST(g.lag AS INTEGER) AS lag, coalesce(c, 0) / nullif(q, 0) AS acf
      FROM v CROSS JOIN range(0, 53) g(lag) LEFT JOIN p ON p.store = v.store AND p.lag = g.lag)"""


@query("t11_acf", f"{_ACF} SELECT * FROM f", r6="acf")
def acf(data: Data) -> DataFrame:
    return stats.autocorrelations(store_series(data), ["store"], "date", "y")


@query(
    "t11_listed_acf",
    f"""{_ACF} SELECT store, lag, acf FROM f WHERE lag > 0 AND abs(acf) > 0.1""",
    r6="acf",
)
def listed_acf(data: Data) -> DataFrame:
    rows = stats.autocorrelations(store_series(data), ["store"], "date", "y")
    return stats.listed_autocorrelations(rows)


@query(
    "t12_pacf",
    """WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY date) AS rn, y - avg(y) OVER () AS d FROM total_weeks),
    v AS (SELECT a.rn - b.rn AS lag, sum(a.d * b.d) / (SELECT sum(d * d) FROM s) AS acf FROM s a JOIN s b
      ON a.rn - b.rn BETWEEN 0 AND 52 GROUP BY 1),
    r AS (SELECT list(acf ORDER BY lag) AS a FROM v),
    d AS (SELECT 1 AS k, [a[2]] AS phi, a[2] AS l, a FROM r
      UNION ALL SELECT k + 1, list_append([phi[i] - m * phi[k + 1 - i] for i in range(1, k + 1)], m), m, a
      FROM (SELECT *, (a[k + 2] - list_dot_product(phi, list_reverse(a[2:k + 1])))
          / (1 - list_dot_product(phi, a[2:k + 1])) AS m FROM d WHERE k < 52))
    SELECT 'Total' AS node, CAST(k AS INTEGER) AS lag, l AS pacf FROM d UNION ALL SELECT 'Total', 0, 1""",
    r6="pacf",
)
def pacf(data: Data) -> DataFrame:
    return stats.partial_autocorrelations(total_series(data), ["node"], "date", "y")


@query("t13_unit_root")
def unit_root(data: Data) -> DataFrame:
    return stats.unit_root_tests(data.train(), ["store", "dept"], "date", "weekly_sales")


SEASONAL = ["weekly_sales", *ANALYSED]
#: The event flag itself has no lift.
LIFTED = [c for c in SEASONAL if c != DEFAULT.event]


@query(
    "t14_month_seasonality",
    "WITH m AS (SELECT CAST(month(date) AS INTEGER) AS month, "
    + ", ".join(f"avg({c}) AS {c}" for c in SEASONAL)
    + " FROM site_weeks GROUP BY 1)\n"
    + "\nUNION ALL ".join(
        f"""SELECT '{c}' AS feature, (SELECT month FROM m ORDER BY {c} DESC, month LIMIT 1) AS peak_month,
      (SELECT month FROM m ORDER BY {c}, month LIMIT 1) AS lowest_month, (max({c}) - min({c})) / avg({c}) AS variation FROM m"""
        for c in SEASONAL
    ),
    r6="variation",
)
def month_seasonality(data: Data) -> DataFrame:
    return stats.month_seasonality(analysis(data), SEASONAL, "date")


@query(
    "t14_event_lift",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS feature, avg({c}) FILTER (is_holiday = 1) AS event_mean, avg({c}) FILTER (is_holiday = 0) AS regular_mean,
      100 * (avg({c}) FILTER (is_holiday = 1) - avg({c}) FILTER (is_holiday = 0)) / avg({c}) FILTER (is_holiday = 0) AS lift_pct
    FROM site_weeks"""
        for c in LIFTED
    ),
    r4="event_mean regular_mean lift_pct",
)
def event_lift(data: Data) -> DataFrame:
    return stats.event_lift(analysis(data), LIFTED)


@query(
    "t15_week_cycle",
    """WITH w AS (SELECT CAST(weekofyear(date) AS INTEGER) AS week, avg(weekly_sales) AS mean FROM site_weeks GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, week) AS t, row_number() OVER (ORDER BY mean, week) AS b,
      stddev_samp(mean) OVER () / avg(mean) OVER () AS variation FROM w)
    SELECT week, mean, CASE WHEN t <= 3 THEN 'peak' ELSE 'lowest' END AS kind, variation FROM r WHERE t <= 3 OR b <= 3""",
    r4="mean",
    r6="variation",
)
def week_cycle(data: Data) -> DataFrame:
    return stats.week_cycle(analysis(data), "weekly_sales", "date")


@query(
    "t15_quarter_cycle",
    """WITH q AS (SELECT CAST(quarter(date) AS INTEGER) AS quarter, avg(weekly_sales) AS v FROM site_weeks GROUP BY 1)
    SELECT (SELECT quarter FROM q ORDER BY v DESC, quarter LIMIT 1) AS best, (SELECT quarter FROM q ORDER BY v, quarter LIMIT 1) AS worst,
    max(v) AS best_value, min(v) AS worst_value, 100 * (max(v) - min(v)) / min(v) AS variation_pct FROM q""",
    r4="best_value worst_value variation_pct",
)
def quarter_cycle(data: Data) -> DataFrame:
    means = analysis(data).groupBy("quarter").agg(F.avg("weekly_sales").alias("v"))
    return profile.best_and_worst(means, "quarter", "v")


@query(
    "t16_temporal_profile",
    "WITH d AS (SELECT "
    + ", ".join(
        f"{c} - lag({c}) OVER (PARTITION BY store ORDER BY date) AS {c}"
        for c in ["weekly_sales", *ANALYSED]
    )
    + " FROM site_weeks)\n"
    + "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, stddev_pop({c}) AS volatility, {corr_sql(c, 'weekly_sales')} AS change_r FROM d"
        for c in ANALYSED
    ),
    r4="volatility",
    r6="change_r",
)
def temporal_profile(data: Data) -> DataFrame:
    return stats.temporal_profile(analysis(data), "weekly_sales", ANALYSED, ["store"], "date")


_C6 = [*COVARIATES, "size", *PROMOS]
_FORCED = ("size", "markdown1", "unemployment")


@query(
    "c6_top_features",
    "WITH c AS ("
    + "\nUNION ALL ".join(
        f"SELECT '{f}' AS feature, coalesce(abs({corr_sql(f, 'weekly_sales')}), 0) AS score FROM panel" for f in _C6
    )
    + """), t AS (SELECT * FROM c ORDER BY score DESC, feature LIMIT 5)
    SELECT feature, score, false AS forced FROM t
    UNION ALL SELECT feature, score, true FROM c WHERE feature IN ('size', 'markdown1', 'unemployment') AND feature NOT IN (SELECT feature FROM t)""",
    r6="score",
)
def top_features(data: Data) -> DataFrame:
    return stats.select_features(data.panel(), "weekly_sales", _C6, 5, _FORCED)


@query(
    "t7_p10_stress_by_store",
    """SELECT store, avg((unemployment - mu) / su + (fuel_price - mf) / sf) AS stress FROM panel,
    (SELECT avg(unemployment) mu, stddev_samp(unemployment) su, avg(fuel_price) mf, stddev_samp(fuel_price) sf FROM panel) s
    GROUP BY store""",
    r6="stress",
)
def stress_by_store(data: Data) -> DataFrame:
    return FE.add_stress_index(data.staged_panel()).groupBy("store").agg(F.avg("stress_index").alias("stress"))
