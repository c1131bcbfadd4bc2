"""Queries over forecasts, reconciliation, evaluation and insight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.catalog.registry import Data, define_cte, query, tail_sql
from panelcast.catalog.stats import ANALYSED, analysis
from panelcast.operators import arma, backtest, clean, evaluate, forecast, grid, hierarchy, insight, models, rollup, stats, store
from panelcast.operators import features as FE
from panelcast.plans import forecasting, interpretation, modelling
from panelcast.session import new_path, stage
from panelcast.sources import panel as P
from panelcast.sources import sinks
from panelcast.spec import DEFAULT

HORIZON = 8
# Twelve validation weeks reach an event week and the third horizon span.
SCORED = 12
MODELS = list(forecast.MODELS)
LEVEL_SQL = "CASE grouping(store, dept) WHEN 3 THEN 'Total' WHEN 1 THEN 'Store' ELSE 'Store_Department' END"


def _forecast_ctes(suffix: str, h: int, future: bool = False) -> None:
    repeated = ", ".join(
        f"coalesce(sum(weekly_sales) FILTER (back = {h - i}), 0)" for i in range(1, h + 1)
    )
    if suffix and not future:
        last = f"SELECT DISTINCT date FROM train ORDER BY date DESC LIMIT {h}"
        define_cte(f"cut{suffix}", f"SELECT min(date) AS start FROM ({last})")
    before = "" if future else f", cut{suffix} WHERE date < start"
    define_cte(
        f"fit{suffix}",
        f"""SELECT t.*, pos, n, n - 1 - pos AS back FROM train t JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos,
      count(*) OVER () AS n FROM (SELECT DISTINCT date FROM train{before})) d USING (date)""",
    )
    if future:
        steps = f"""SELECT CAST(i AS INTEGER) AS step, CAST((SELECT max(date) FROM train) + CAST(7 * i AS INTEGER) AS DATE) AS date
      FROM range(1, {h + 1}) g(i)"""
    else:
        steps = f"""SELECT CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS step, date
      FROM (SELECT DISTINCT date FROM train, cut{suffix} WHERE date >= start)"""
    define_cte(f"steps{suffix}", steps)
    define_cte(
        f"node_stats{suffix}",
        f"""SELECT {LEVEL_SQL} AS level, store, dept, max(n) AS n, sum(weekly_sales) AS total,
      coalesce(sum(weekly_sales) FILTER (back < 4), 0) AS recent,
      coalesce(sum(weekly_sales) FILTER (back BETWEEN 4 AND 7), 0) AS before,
      coalesce(sum(weekly_sales) FILTER (back < 52), 0) AS cycle,
      sum(weekly_sales * CASE WHEN pos = 0 THEN 1 ELSE 0.3::DOUBLE END * pow(0.7::DOUBLE, back)) AS smooth,
      [{repeated}] AS repeated
      FROM fit{suffix} GROUP BY GROUPING SETS ((), (store), (store, dept))""",
    )
    define_cte(
        f"node_means{suffix}",
        f"""SELECT {LEVEL_SQL} AS level, store, dept, sum(m) AS historical_mean FROM (
        SELECT store, dept, greatest(avg(weekly_sales), 0) AS m FROM fit{suffix} GROUP BY store, dept)
      GROUP BY GROUPING SETS ((), (store), (store, dept))""",
    )
    define_cte(
        f"node_models{suffix}",
        f"""SELECT s.level, s.store, s.dept, step, date,
      recent / 4 + (recent / 4 - before / 4) / 4 * step + repeated[step] - cycle / 52 AS trend_seasonal,
      greatest(smooth, 0) AS smoothing,
      recent / 4 + (recent / 4 - before / 4) / 4 * step AS moving_average,
      historical_mean
      FROM node_stats{suffix} s JOIN node_means{suffix} m ON m.level = s.level AND m.store IS NOT DISTINCT FROM s.store
        AND m.dept IS NOT DISTINCT FROM s.dept CROSS JOIN steps{suffix}""",
    )
    define_cte(
        f"node_forecasts{suffix}",
        f"""SELECT *, greatest(0.5::DOUBLE * trend_seasonal + 0.3::DOUBLE * smoothing + 0.2::DOUBLE * moving_average, 0)
      AS ensemble FROM node_models{suffix}""",
    )


_forecast_ctes("", HORIZON)
_forecast_ctes("12", SCORED)
_forecast_ctes("_next", HORIZON, future=True)
define_cte(
    "results",
    """SELECT u.model, CASE u.model WHEN 'ensemble' THEN 'Ensemble' WHEN 'historical_mean' THEN 'Baseline'
      ELSE 'Statistical' END AS model_type, u.store, u.dept, u.date, u.step, t.weekly_sales AS actual, u.predicted, w.weight
    FROM (UNPIVOT (SELECT store, dept, date, step, trend_seasonal, smoothing, moving_average, ensemble, historical_mean
        FROM node_forecasts12 WHERE level = 'Store_Department')
      ON trend_seasonal, smoothing, moving_average, ensemble, historical_mean INTO NAME model VALUE predicted) u
    JOIN train t ON t.store = u.store AND t.dept = u.dept AND t.date = u.date
    JOIN (SELECT date, CASE WHEN bool_or(is_holiday) THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM train GROUP BY date) w
      ON w.date = u.date""",
)
define_cte(
    "total_results",
    """SELECT model, model_type, date, step, sum(actual) AS actual, sum(predicted) AS predicted, max(weight) AS weight
    FROM results GROUP BY ALL""",
)


def forecasts(data: Data, horizon: int = HORIZON, staged: bool = False) -> DataFrame:
    """Base forecasts of every node; staged when a query reads them repeatedly."""
    fact = data.staged_train()
    fit, val = clean.time_split(fact, horizon)
    out = forecast.base_forecasts(fit, forecast.horizon_dates(val, horizon), horizon)
    return stage(out, "forecasts") if staged else out


def results(data: Data, staged: bool = False) -> DataFrame:
    fact = data.staged_train()
    fit, val = clean.time_split(fact, SCORED)
    base = forecast.base_forecasts(fit, forecast.horizon_dates(val, SCORED), SCORED)
    out = forecast.forecast_results(base, val)
    return stage(out, "results") if staged else out


# --- base forecasts -----------------------------------------------------------------


for _id, _model in (
    ("m1_trend_seasonal", "trend_seasonal"),
    ("m2_smoothing", "smoothing"),
    ("m3_moving_average", "moving_average"),
    ("m4_ensemble", "ensemble"),
    ("m5_historical_mean", "historical_mean"),
):

    def _base(data: Data, model: str = _model) -> DataFrame:
        return forecasts(data).select("level", "store", "dept", "step", "date", model)

    query(
        _id, f"SELECT level, store, dept, step, date, {_model} FROM node_forecasts", r4=_model
    )(_base)


@query("m4_ensemble_by_supplier", "SELECT level, store, dept, step, date, ensemble FROM node_forecasts",
       site="supplier", r4="ensemble")
def ensemble_by_supplier(data: Data) -> DataFrame:
    return forecasts(data).select("level", "store", "dept", "step", "date", "ensemble")


@query(
    "m1_trend_seasonal_aligned",
    """SELECT s.level, s.store, s.dept, d.step, recent / 4 + (recent / 4 - before / 4) / 4 * d.step
      + coalesce(a.y, 0) - cycle / 52 AS trend_seasonal
    FROM node_stats s CROSS JOIN steps d LEFT JOIN (SELECT store, dept, back, weekly_sales AS y FROM fit) a
      ON a.store = s.store AND a.dept = s.dept AND a.back = 52 - d.step WHERE s.level = 'Store_Department'""",
    r4="trend_seasonal",
)
def trend_seasonal_aligned(data: Data) -> DataFrame:
    fit, val = clean.time_split(data.staged_train(), HORIZON)
    out = forecast.base_forecasts(fit, forecast.horizon_dates(val, HORIZON), HORIZON, aligned=True)
    return forecast.leaves(out).select("level", "store", "dept", "step", "trend_seasonal")


define_cte(
    "fold_fit",
    """SELECT t.store, t.dept, t.weekly_sales, fold, pos, total_n - after AS n, total_n - 1 - pos - after AS back
    FROM train t JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS total_n
      FROM (SELECT DISTINCT date FROM train)) d USING (date)
    JOIN (SELECT i AS fold, (5 - i) * 8 AS after FROM range(1, 5) g(i)) f ON total_n - 1 - pos >= after""",
)
define_cte(
    "fold_steps",
    """SELECT i AS fold, (5 - i) * 8 - back AS step, date FROM (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS back
      FROM (SELECT DISTINCT date FROM train)) d JOIN range(1, 5) g(i) ON (5 - i) * 8 - back BETWEEN 1 AND 8""",
)
define_cte(
    "fold_forecasts",
    """SELECT fold, store, dept, step, date, trend_seasonal, smoothing, moving_average,
      greatest(0.5::DOUBLE * trend_seasonal + 0.3::DOUBLE * smoothing + 0.2::DOUBLE * moving_average, 0) AS ensemble, historical_mean
    FROM (SELECT s.fold, store, dept, step, date, greatest(smooth, 0) AS smoothing, historical_mean,
        recent / 4 + (recent / 4 - before / 4) / 4 * step AS moving_average,
        recent / 4 + (recent / 4 - before / 4) / 4 * step + repeated[step] - cycle / 52 AS trend_seasonal
      FROM (SELECT fold, store, dept, greatest(avg(weekly_sales), 0) AS historical_mean,
          coalesce(sum(weekly_sales) FILTER (back < 4), 0) AS recent,
          coalesce(sum(weekly_sales) FILTER (back BETWEEN 4 AND 7), 0) AS before,
          coalesce(sum(weekly_sales) FILTER (back < 52), 0) AS cycle,
          sum(weekly_sales * CASE WHEN pos = 0 THEN 1 ELSE 0.3::DOUBLE END * pow(0.7::DOUBLE, back)) AS smooth,
          ["""
    + ", ".join(f"coalesce(sum(weekly_sales) FILTER (back = {8 - i}), 0)" for i in range(1, 9))
    + """] AS repeated FROM fold_fit GROUP BY fold, store, dept) s JOIN fold_steps USING (fold))""",
)


@query("c5_rolling_forecasts", "SELECT CAST(fold AS INTEGER) AS fold, store, dept, CAST(step AS INTEGER) AS step, date, trend_seasonal,"
       " smoothing, moving_average, ensemble, historical_mean FROM fold_forecasts", r4=" ".join(MODELS))
def rolling_forecasts(data: Data) -> DataFrame:
    """Forecasts of every series from four origins, eight weeks apart."""
    return forecast.leaves(backtest.rolling_forecasts(data.staged_train(), 4, HORIZON)).drop("level")


@query(
    "c5_backtest",
    """SELECT CAST(fold AS INTEGER) AS fold, model, CASE model WHEN 'ensemble' THEN 'Ensemble' WHEN 'historical_mean' THEN 'Baseline'
      ELSE 'Statistical' END AS model_type, count(*) AS n, sqrt(avg((weekly_sales - predicted) ^ 2)) AS rmse,
      avg(abs(weekly_sales - predicted)) AS mae, sqrt(sum(w * (weekly_sales - predicted) ^ 2) / sum(w)) AS weighted_rmse,
      sum(w * abs(weekly_sales - predicted)) / sum(w) AS weighted_mae
    FROM (UNPIVOT fold_forecasts ON trend_seasonal, smoothing, moving_average, ensemble, historical_mean
      INTO NAME model VALUE predicted) JOIN train USING (store, dept, date)
    JOIN (SELECT date, CASE WHEN bool_or(is_holiday) THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM train GROUP BY date) USING (date)
    GROUP BY fold, model""",
    r4="rmse mae weighted_rmse weighted_mae",
)
def rolling_scores(data: Data) -> DataFrame:
    """Walk-forward errors of the base models per fold."""
    scored = backtest.rolling_results(data.staged_train(), 4, HORIZON)
    kept = ["fold", "model", "model_type", "n", "rmse", "mae", "weighted_rmse", "weighted_mae"]
    return evaluate.accuracy(scored, ["fold", "model", "model_type"]).select(*kept)


def _modelling(data: Data) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of the modelling plan."""
    sets = modelling.run(data.panel())
    return sets.train, sets.validation


#: One or more of each kind of engineered feature; where several say nearly the same
#: (lags, windows, parts of the date, products), those that span the kind.
FOREST_FEATURES = [
    *["is_holiday", "pre_event", "week_sin", "week_cos", "year", "promo_total", "size"],
    *DEFAULT.covariates,
    *[f"weekly_sales_lag_{n}" for n in (1, 4, 52)],
    *["weekly_sales_mean_4", "weekly_sales_std_4", "weekly_sales_mean_52"],
    *["type_mean", "dept_mean", "series_mean", "trend_slope"],
]


@query("m6_forest_forecast")
def forest_forecast(data: Data, trees: int = 100, depth: int = 15) -> DataFrame:
    train, val = _modelling(data)
    model = models.fit_forest(train, FOREST_FEATURES, "weekly_sales", trees=trees, depth=depth)
    scored = model.transform(models.assemble(val, FOREST_FEATURES))
    return scored.select(
        "store", "dept", "date", F.col("weekly_sales").alias("actual"), F.col("prediction").alias("predicted")
    )


@query(
    "m7_forecast_cells",
    "SELECT store, dept, date, weekly_sales AS actual, true AS forecast FROM train, cut WHERE date >= start"
    " AND (store, dept) IN (SELECT (store, dept) FROM train, cut WHERE date < start)"
    " UNION ALL SELECT store, dept, date, weekly_sales, false FROM train, cut WHERE date >= start"
    " AND (store, dept) NOT IN (SELECT (store, dept) FROM train, cut WHERE date < start)",
)
def seasonal_cells(data: Data) -> DataFrame:
    """The cells that ``m7_seasonal_regression`` answers, with a forecast where
    the series has history."""
    known = F.col("predicted").isNotNull() & (F.col("lower") <= F.col("upper"))
    return seasonal_regression(data).select("store", "dept", "date", "actual", known.alias("forecast"))


@query("m7_seasonal_regression")
def seasonal_regression(data: Data) -> DataFrame:
    panel = FE.add_promos(data.staged_panel())
    covariates = [*DEFAULT.covariates, "promo_total"]
    return models.SeasonalRegression().run(panel, P.event_calendar(panel), covariates)


@query("m7_multiplicative")
def multiplicative_regression(data: Data) -> DataFrame:
    """The product form, with limits by the number of steps ahead."""
    panel = FE.add_promos(data.staged_panel())
    covariates = [*DEFAULT.covariates, "promo_total"]
    return models.MultiplicativeRegression().run(panel, P.event_calendar(panel), covariates)


@query(
    "m7_multiplicative_cells",
    """WITH s AS (SELECT CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS step, date FROM (SELECT DISTINCT date FROM train, cut WHERE date >= start)),
    k AS (SELECT DISTINCT store, dept FROM train, cut WHERE date < start)
    SELECT t.store, t.dept, t.date, s.step, t.weekly_sales AS actual, k.store IS NOT NULL AS forecast
    FROM train t JOIN s ON s.date = t.date LEFT JOIN k ON k.store = t.store AND k.dept = t.dept""",
)
def multiplicative_cells(data: Data) -> DataFrame:
    """The cells that ``m7_multiplicative`` answers, their steps and limits in order."""
    known = F.col("predicted").isNotNull() & (F.col("lower") <= F.col("upper"))
    return multiplicative_regression(data).select("store", "dept", "date", "step", "actual", known.alias("forecast"))


@query("m8_differenced_autoregression")
def differenced_autoregression(data: Data) -> DataFrame:
    covariates = list(DEFAULT.covariates)
    weekly = rollup.resample_weekly(
        data.staged_panel(), DEFAULT, ["store"], ["weekly_sales"], covariates, ["is_holiday"]
    )
    return models.differenced_autoregression(stage(weekly, "weekly"), ["store"], [*covariates, "is_holiday"])


def _eliminated(columns: list[str], source: str) -> str:
    """SQL for the least-squares coefficients of the last column on a constant and
    the others, a list in that order: normal equations, then elimination."""
    cells = ["1.0::DOUBLE", *columns]
    rows = ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in cells) + "]" for a in cells[:-1])
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    n = len(cells) - 1
    step = f"""[[CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END
        FOR j IN range(1, {n + 2})] FOR i IN range(1, {n + 1})]"""
    return f"""(WITH RECURSIVE g AS (SELECT 1 AS k, [{rows}] AS m FROM {source} WHERE fit AND {known}
      UNION ALL SELECT k + 1, {step} FROM g WHERE k <= {n})
    SELECT [r[{n + 1}] FOR r IN m] FROM g WHERE k = {n + 1})"""


_LONG = [f"z_{k}" for k in arma.long_lags(52)]
_LATE = ["z_1", "z_52", "z_53", "e_1", "e_52", "e_53"]
define_cte(
    "arma_weeks",
    """SELECT g.store, g.date, coalesce(y, 0) AS y FROM (SELECT store, CAST(unnest(generate_series(min(date), max(date), INTERVAL 7 DAY)) AS DATE) AS date
      FROM (SELECT store, date + (7 - isodow(date))::INT AS date FROM train) GROUP BY store) g
    LEFT JOIN (SELECT store, date + (7 - isodow(date))::INT AS date, sum(weekly_sales) AS y FROM train GROUP BY 1, 2) x
      ON x.store = g.store AND x.date = g.date""",
)
define_cte(
    "site_moves",
    """SELECT store, date, fit, z / sqrt(avg(z * z) FILTER (fit) OVER (PARTITION BY store)) AS z FROM (
      SELECT store, date, date < (SELECT min(date) FROM (SELECT DISTINCT date FROM arma_weeks ORDER BY date DESC LIMIT 8)) AS fit,
        y - lag(y, 1) OVER w - lag(y, 52) OVER w + lag(y, 53) OVER w AS z
      FROM arma_weeks WINDOW w AS (PARTITION BY store ORDER BY date))""",
)
define_cte(
    "site_lags",
    "SELECT *, " + ", ".join(f"lag(z, {k}) OVER w AS z_{k}" for k in arma.long_lags(52))
    + " FROM site_moves WINDOW w AS (PARTITION BY store ORDER BY date)",
)
define_cte("long_terms", f"SELECT {_eliminated([*_LONG, 'z'], 'site_lags')} AS b")
define_cte(
    "site_residuals",
    """SELECT *, lag(e, 1) OVER w AS e_1, lag(e, 52) OVER w AS e_52, lag(e, 53) OVER w AS e_53 FROM (SELECT l.*, z - b[1] - """
    + " - ".join(f"b[{i + 2}] * {c}" for i, c in enumerate(_LONG))
    + " AS e FROM site_lags l, long_terms) WINDOW w AS (PARTITION BY store ORDER BY date)",
)
define_cte("late_terms", f"SELECT {_eliminated([*_LATE, 'z'], 'site_residuals')} AS b")


def site_weeks(data: Data, covariates: list[str], flags: list[str]) -> DataFrame:
    """Gap-free weeks of each site, written once."""
    panel = data.staged_panel() if covariates or flags else data.staged_train()
    return stage(rollup.resample_weekly(panel, DEFAULT, ["store"], ["weekly_sales"], covariates, flags), "weekly")


@query(
    "m8_hannan_rissanen",
    "SELECT 'long autoregression' AS stage, unnest(['constant', " + ", ".join(f"'{c}'" for c in _LONG) + "]) AS term, unnest(b) AS value FROM long_terms"
    " UNION ALL SELECT 'with residuals', unnest(['constant', " + ", ".join(f"'{c}'" for c in _LATE) + "]), unnest(b) FROM late_terms",
    r6="value",
)
def first_coefficients(data: Data) -> DataFrame:
    """The two regressions that start the seasonal model with moving averages."""
    rows = arma.twice_differenced(site_weeks(data, [], []), ["store"])
    return arma.hannan_rissanen(stage(rows, "differenced"), ["store"])[1]


@query("m8_seasonal_arma")
def seasonal_arma(data: Data) -> DataFrame:
    """Forecasts of the seasonal model with moving averages and covariates."""
    covariates = [*DEFAULT.covariates, DEFAULT.event]
    weekly = site_weeks(data, list(DEFAULT.covariates), [DEFAULT.event])
    return arma.seasonal_arma(weekly, ["store"], covariates)[1]


@query("m8_arma_coefficients")
def arma_coefficients(data: Data) -> DataFrame:
    """Its coefficients without covariates, of the least conditional squares."""
    model, _ = arma.seasonal_arma(site_weeks(data, [], []), ["store"])
    return arma.coefficients(model, data.spark)


_SEQUENCE_FEATURES = ["weekly_sales", "is_holiday", *DEFAULT.covariates, *DEFAULT.promos]


def _sequence_sql(keys: str, features: list[str], source: str) -> str:
    """Scaled lags 1 to 5 of all features, per series."""
    scale = ", ".join(f"avg({f}) AS m_{f}, coalesce(nullif(stddev_pop({f}), 0), 1) AS s_{f}" for f in features)
    lags = ", ".join(f"coalesce((lag({f}, {k}) OVER w - m_{f}) / s_{f}, 0) AS {f}_{k}" for f in features for k in range(5, 0, -1))
    return f"""WITH r AS ({source}), m AS (SELECT {scale} FROM r, cut WHERE date < start)
    SELECT {keys}, date, weekly_sales AS label, CASE WHEN is_holiday = 1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
      CASE WHEN date < start THEN 'train' ELSE 'validation' END AS part, {lags}
    FROM r, m, cut WINDOW w AS (PARTITION BY {keys} ORDER BY date) QUALIFY row_number() OVER w > 5"""


def _sequence_round(features: list[str]) -> str:
    return " ".join(f"{f}_{k}" for f in features for k in range(1, 6))


_MEANS = ", ".join(f"avg({c}) AS {c}" for c in DEFAULT.covariates) + ", " + ", ".join(f"sum({c}) AS {c}" for c in DEFAULT.promos)
_ROLLED = f"SELECT {{keys}}, date, sum(weekly_sales) AS weekly_sales, max(CAST(is_holiday AS INTEGER)) AS is_holiday, {_MEANS} FROM panel GROUP BY {{keys}}, date"


def _sequence_cells(data: Data, keys: list[str]) -> DataFrame:
    """The sets written as a training data set and read back, cell by cell."""
    sets = models.sequence_sets(data.staged_panel(), _SEQUENCE_FEATURES, keys=keys)
    path = new_path(data.spark, "sequences")
    models.write_sequence_sets(sets, path)
    back = data.spark.read.schema(sets.schema).parquet(path)
    return models.cells(back, _SEQUENCE_FEATURES)


@query("m9_sequence_sets", _sequence_sql("store", _SEQUENCE_FEATURES, _ROLLED.format(keys="store")), r6=_sequence_round(_SEQUENCE_FEATURES))
def sequence_sets(data: Data) -> DataFrame:
    return _sequence_cells(data, ["store"])


@query(
    "m9_sequence_sets_by_series", _sequence_sql("store, dept", _SEQUENCE_FEATURES, _ROLLED.format(keys="store, dept")),
    r6=_sequence_round(_SEQUENCE_FEATURES),
)
def series_sequence_sets(data: Data) -> DataFrame:
    return _sequence_cells(data, ["store", "dept"])


_PLAIN = ["weekly_sales", "temperature", "promo_total"]


@query(
    "w12_sequences",
    """WITH p AS (SELECT *, """ + " + ".join(f"coalesce({c}, 0)" for c in DEFAULT.promos) + """ AS promo_total FROM panel)
    SELECT store, dept, date, weekly_sales AS label, CASE WHEN is_holiday THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, """
    + ", ".join(f"coalesce(lag({f}, {k}) OVER w, 0) AS {f}_{k}" for f in _PLAIN for k in range(5, 0, -1))
    + " FROM p WINDOW w AS (PARTITION BY store, dept ORDER BY date) QUALIFY row_number() OVER w > 5",
    r4=_sequence_round(_PLAIN),
)
def sequences(data: Data) -> DataFrame:
    """Every cell of the sequences of each series."""
    return models.cells(models.sequences(FE.add_promos(data.panel()), _PLAIN), _PLAIN)


# --- hierarchy ------------------------------------------------------------------------


def _tree_ctes(suffix: str) -> None:
    """The closed form of the reconciliation, for a tree of two levels below the Total."""
    define_cte(
        f"tree_s{suffix}",
        f"""SELECT l.store, l.step, count(*) AS n, sum(l.ensemble) AS sy, max(s.ensemble) AS ys, max(t.ensemble) AS yt
    FROM node_forecasts{suffix} l JOIN node_forecasts{suffix} s ON s.level = 'Store' AND s.store = l.store AND s.step = l.step
    JOIN node_forecasts{suffix} t ON t.level = 'Total' AND t.step = l.step
    WHERE l.level = 'Store_Department' GROUP BY l.store, l.step""",
    )
    define_cte(
        f"tree_t{suffix}",
        f"SELECT step, sum((sy + n * (ys + yt)) / (1 + n)) AS v, sum(n / (1 + n)) AS u FROM tree_s{suffix} GROUP BY step",
    )
    define_cte(
        f"reconciled_leaves{suffix}",
        f"""SELECT l.store, l.dept, l.step, l.date, l.ensemble + s.ys + s.yt - (s.sy + s.n * (s.ys + s.yt)) / (1 + s.n)
      - 1 / (1 + s.n) * t.v / (1 + t.u) AS reconciled
    FROM node_forecasts{suffix} l JOIN tree_s{suffix} s ON s.store = l.store AND s.step = l.step
    JOIN tree_t{suffix} t ON t.step = l.step WHERE l.level = 'Store_Department'""",
    )
    define_cte(
        f"reconciled_nodes{suffix}",
        f"""SELECT {LEVEL_SQL} AS level, store, dept, step, sum(reconciled) AS reconciled FROM reconciled_leaves{suffix}
    GROUP BY GROUPING SETS ((step), (store, step), (store, dept, step))""",
    )
    define_cte(
        f"prediction_rows{suffix}",
        f"""SELECT s.date, level AS hierarchy_level, CASE level WHEN 'Total' THEN 'Total' WHEN 'Store' THEN 'Store_' || store
      ELSE 'Store_' || store || '_Dept_' || dept END AS entity_key, step AS forecast_period,
      reconciled AS predicted_sales, store AS store_id, dept AS department_id
    FROM reconciled_nodes{suffix} JOIN steps{suffix} s USING (step)""",
    )


_tree_ctes("")
_tree_ctes("12")
_tree_ctes("_next")


def reconciled(data: Data, staged: bool = False) -> DataFrame:
    out = hierarchy.reconcile_ols(forecasts(data, staged=True), "ensemble")
    return stage(out, "reconciled") if staged else out


@query(
    "h1_nodes",
    """SELECT 'Total' AS level, 'Total' AS node, NULL::VARCHAR AS parent, count(DISTINCT store) AS n_children FROM train
    UNION ALL SELECT 'Store', 'Store_' || store, 'Total', count(DISTINCT dept) FROM train GROUP BY store
    UNION ALL SELECT DISTINCT 'Store_Department', 'Store_' || store || '_Dept_' || dept, 'Store_' || store, 0 FROM train""",
)
def node_list(data: Data) -> DataFrame:
    return hierarchy.nodes(data.staged_train())


@query(
    "h2_summing_pairs",
    """WITH s AS (SELECT DISTINCT store, dept, 'Store_' || store || '_Dept_' || dept AS leaf FROM train)
    SELECT 'Total' AS node, leaf FROM s UNION ALL SELECT 'Store_' || store, leaf FROM s UNION ALL SELECT leaf, leaf FROM s""",
)
def summing_pairs(data: Data) -> DataFrame:
    return hierarchy.summing_pairs(data.train())


@query("h3_ols_reconciliation", "SELECT * FROM reconciled_nodes", r4="reconciled")
def ols_reconciliation(data: Data) -> DataFrame:
    return reconciled(data)


@query("h3_ols_by_supplier", "SELECT * FROM reconciled_nodes", site="supplier", r2="reconciled")
def ols_by_supplier(data: Data) -> DataFrame:
    return reconciled(data)


@query(
    "h4_bottom_up",
    f"""SELECT {LEVEL_SQL} AS level, store, dept, step, sum(historical_mean) AS bottom_up FROM node_forecasts
    WHERE level = 'Store_Department' GROUP BY GROUPING SETS ((step), (store, step), (store, dept, step))""",
    r4="bottom_up",
)
def bottom_up(data: Data) -> DataFrame:
    return hierarchy.bottom_up(forecasts(data), "historical_mean")


@query(
    "h5_top_down",
    """WITH l AS (SELECT store, dept, sum(weekly_sales) / (SELECT sum(weekly_sales) FROM fit) AS share FROM fit GROUP BY store, dept)
    SELECT l.store, l.dept, t.step, t.ensemble * share AS top_down FROM l CROSS JOIN node_forecasts t WHERE t.level = 'Total'""",
    r4="top_down",
)
def top_down(data: Data) -> DataFrame:
    fit, _ = clean.time_split(data.staged_train(), HORIZON)
    out = hierarchy.split_down(forecasts(data, staged=True), fit, "ensemble")
    return forecast.leaves(out).drop("level")


@query(
    "h5_middle_out",
    """WITH l AS (SELECT store, dept, sum(weekly_sales) AS y FROM fit GROUP BY store, dept),
    p AS (SELECT store, sum(y) AS py FROM l GROUP BY store)
    SELECT l.store, l.dept, t.step, t.ensemble * y / py AS middle_out FROM l JOIN p USING (store)
    JOIN node_forecasts t ON t.store = l.store AND t.level = 'Store'""",
    r4="middle_out",
)
def middle_out(data: Data) -> DataFrame:
    fit, _ = clean.time_split(data.staged_train(), HORIZON)
    out = hierarchy.split_down(forecasts(data, staged=True), fit, "ensemble", 1, name="middle_out")
    return forecast.leaves(out).drop("level")


@query(
    "h6_incoherence_before",
    """WITH s AS (SELECT store, step, sum(ensemble) AS c FROM node_forecasts WHERE level = 'Store_Department' GROUP BY store, step),
    t AS (SELECT step, sum(ensemble) AS c FROM node_forecasts WHERE level = 'Store' GROUP BY step)
    SELECT 'Store' AS level, 'Store_' || n.store AS node, max(abs(n.ensemble - c)) AS max_gap,
      max(abs(n.ensemble - c)) <= 1e-6 AS coherent FROM node_forecasts n JOIN s USING (store, step) WHERE n.level = 'Store' GROUP BY n.store
    UNION ALL SELECT 'Total', 'Total', max(abs(n.ensemble - c)), max(abs(n.ensemble - c)) <= 1e-6
    FROM node_forecasts n JOIN t USING (step) WHERE n.level = 'Total'""",
    r4="max_gap",
)
def incoherence_before(data: Data) -> DataFrame:
    return hierarchy.coherence(forecasts(data, staged=True), "ensemble")


@query(
    "h6_coherence_verdict",
    """WITH g AS (SELECT p.level, p.store, p.step, abs(any_value(p.reconciled) - sum(c.reconciled)) AS gap
      FROM reconciled_nodes p JOIN reconciled_nodes c ON c.step = p.step AND (p.level = 'Total' AND c.level = 'Store'
        OR p.level = 'Store' AND c.level = 'Store_Department' AND c.store = p.store) GROUP BY p.level, p.store, p.step)
    SELECT max(gap) <= 1e-6 AS coherent, max(gap) AS max_gap, count(DISTINCT (level, store)) AS n_nodes FROM g""",
    r4="max_gap",
)
def coherence_verdict(data: Data) -> DataFrame:
    checks = hierarchy.coherence(reconciled(data, staged=True), "reconciled")
    return hierarchy.coherence_verdict(checks)


@query(
    "h7_event_weights",
    "SELECT date, CASE WHEN bool_or(is_holiday) THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM train GROUP BY date",
)
def event_weights(data: Data) -> DataFrame:
    return forecast.event_weights(data.train())


def predictions(data: Data) -> DataFrame:
    fact = data.staged_train()
    fit, val = clean.time_split(fact, HORIZON)
    dates = forecast.horizon_dates(val, HORIZON)
    base = stage(forecast.base_forecasts(fit, dates, HORIZON), "forecasts")
    return hierarchy.prediction_table(hierarchy.reconcile_ols(base, "ensemble"), dates, "reconciled")


@query("h8_prediction_table", "SELECT * FROM prediction_rows", r4="predicted_sales")
def prediction_table(data: Data) -> DataFrame:
    return predictions(data)


@query(
    "h9_lookup",
    "SELECT * FROM prediction_rows WHERE hierarchy_level = 'Store_Department' AND store_id = 3",
    r4="predicted_sales",
)
def lookup(data: Data) -> DataFrame:
    return hierarchy.find(predictions(data), "Store_Department", store=3)


define_cte(
    "reconciled_results",
    """SELECT n.level, n.store, n.dept, s.date, n.step, coalesce(t.y, 0) AS actual, n.reconciled AS predicted, weight
    FROM reconciled_nodes12 n JOIN steps12 s USING (step) LEFT JOIN (SELECT store, dept, date, sum(weekly_sales) AS y FROM train
      GROUP BY GROUPING SETS ((date), (store, date), (store, dept, date))) t
    ON t.date = s.date AND t.store IS NOT DISTINCT FROM n.store AND t.dept IS NOT DISTINCT FROM n.dept
    JOIN (SELECT date, CASE WHEN bool_or(is_holiday) THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM train GROUP BY date) w
      ON w.date = s.date""",
)


def scored_nodes(data: Data) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reconciled forecasts of the scored dates, the nodes' values and weights."""
    fit, val = clean.time_split(data.staged_train(), SCORED)
    dates = forecast.horizon_dates(val, SCORED)
    base = stage(forecast.base_forecasts(fit, dates, SCORED), "base")
    fixed = hierarchy.reconcile_ols(base, "ensemble").join(F.broadcast(dates), "step")
    return fixed, rollup.node_totals(val), forecast.event_weights(val)


@query(
    "h10_level_errors",
    """SELECT level, 100 * avg(abs(actual - predicted) / greatest(abs(actual), 1)) AS mape,
      sum(weight * abs(actual - predicted)) / sum(weight) AS wmae, count(*) AS n FROM reconciled_results GROUP BY level""",
    r4="mape wmae",
)
def level_errors(data: Data) -> DataFrame:
    return hierarchy.level_errors(*scored_nodes(data), "reconciled")


@query(
    "a14_level_summary",
    """SELECT hierarchy_level, count(DISTINCT entity_key) AS n_entities, avg(predicted_sales) AS mean, sum(predicted_sales) AS total
    FROM prediction_rows GROUP BY hierarchy_level""",
    r4="mean total",
)
def level_summary(data: Data) -> DataFrame:
    return hierarchy.level_summary(predictions(data))


@query(
    "a14_top_stores",
    """SELECT entity_key, sum(predicted_sales) AS total FROM prediction_rows WHERE hierarchy_level = 'Store'
    GROUP BY entity_key ORDER BY total DESC, entity_key LIMIT 5""",
    r4="total",
)
def top_stores(data: Data) -> DataFrame:
    return hierarchy.top_entities(predictions(data), "Store")


@query("s3_export", "SELECT * FROM prediction_rows", r4="predicted_sales")
def export(data: Data) -> DataFrame:
    """Predictions written as CSV by level, and read back."""
    path = new_path(data.spark, "predictions")
    table = predictions(data)
    sinks.write_forecasts(table, path)
    schema = (
        "date date, entity_key string, forecast_period int, predicted_sales double, "
        "store_id int, department_id string, hierarchy_level string"
    )
    back = data.spark.read.schema(schema).option("header", True).csv(path)
    return back.select(*table.columns)


# --- evaluation -------------------------------------------------------------------------


@query("j6_results", "SELECT * FROM results", r4="predicted")
def aligned_results(data: Data) -> DataFrame:
    return results(data).withColumn("step", F.col("step").cast("int"))


_E, _APE = "(actual - predicted)", "abs((actual - predicted) / greatest(abs(actual), 1))"
define_cte(
    "scores",
    f"""SELECT model, model_type, count(*) AS n, sqrt(avg({_E} * {_E})) AS rmse, avg(abs({_E})) AS mae, 100 * avg({_APE}) AS mape,
    coalesce(1 - avg({_E} * {_E}) / nullif(var_pop(actual), 0), 0) AS r2,
    sqrt(sum(weight * {_E} * {_E}) / sum(weight)) AS weighted_rmse, sum(weight * abs({_E})) / sum(weight) AS weighted_mae,
    100 * sum(weight * {_APE}) / sum(weight) AS weighted_mape,
    coalesce(sqrt(avg({_E} * {_E}) FILTER (weight > 1)), 0) AS event_rmse,
    coalesce(100 * avg({_APE}) FILTER (weight > 1), 0) AS event_mape,
    coalesce(sqrt(avg({_E} * {_E}) FILTER (weight = 1)), 0) AS regular_rmse,
    coalesce(100 * avg({_APE}) FILTER (weight = 1), 0) AS regular_mape FROM results GROUP BY model, model_type""",
)
_SCORES = "rmse mae mape weighted_rmse weighted_mae weighted_mape event_rmse event_mape regular_rmse regular_mape"


@query("v1_v2_accuracy", "SELECT * FROM scores", r4=_SCORES, r6="r2")
def accuracy(data: Data) -> DataFrame:
    return evaluate.accuracy(results(data))


@query(
    "h10_hierarchy_accuracy",
    f"""SELECT 'reconciled' AS model, count(*) AS n, sqrt(avg({_E} * {_E})) AS rmse, avg(abs({_E})) AS mae,
    sum(weight * abs({_E})) / sum(weight) AS weighted_mae FROM reconciled_results WHERE level = 'Total'""",
    r4="rmse mae weighted_mae",
)
def hierarchy_accuracy(data: Data) -> DataFrame:
    """Errors of the reconciled forecast of the Total."""
    total = hierarchy.node_results(*scored_nodes(data), "reconciled").where("level = 'Total'")
    named = total.withColumns({"model": F.lit("reconciled"), "model_type": F.lit("Hierarchical")})
    return evaluate.accuracy(named).select("model", "n", "rmse", "mae", "weighted_mae")


define_cte(
    "directions",
    """SELECT model, 100 * avg(CAST((a > 0) = (p > 0) AS DOUBLE)) AS directional_accuracy FROM (SELECT model,
      actual - lag(actual) OVER w AS a, predicted - lag(predicted) OVER w AS p FROM results
      WINDOW w AS (PARTITION BY model, store, dept ORDER BY date)) WHERE a IS NOT NULL GROUP BY model""",
)


def steady(data: Data) -> DataFrame:
    """Results with forecasts rounded, so that equal steps are equal everywhere."""
    return results(data).withColumn("predicted", F.round("predicted", 4))


@query(
    "v3_directional_accuracy",
    """SELECT model, 100 * avg(CAST((a > 0) = (p > 0) AS DOUBLE)) AS directional_accuracy FROM (SELECT model,
      actual - lag(actual) OVER w AS a, round(predicted, 4) - lag(round(predicted, 4)) OVER w AS p FROM results
      WINDOW w AS (PARTITION BY model, store, dept ORDER BY date)) WHERE a IS NOT NULL GROUP BY model""",
    r4="directional_accuracy",
)
def directional(data: Data) -> DataFrame:
    return evaluate.directional_accuracy(steady(data))


@query(
    "v4_smoothed_metrics",
    f"""SELECT model, avg({_E} * {_E}) AS mse, sum(weight * abs({_E})) / sum(weight) AS wmae,
    sum(weight * {_E} * {_E}) / sum(weight) AS wmse, sqrt(sum(weight * {_E} * {_E}) / sum(weight)) AS wrmse,
    100 * avg(abs({_E} / (actual + 1e-8))) AS mape_smoothed,
    1 - sum({_E} * {_E}) / (count(*) * var_pop(actual) + 1e-8) AS r2_smoothed FROM results GROUP BY model""",
    r2="mse wmse",
    r4="wmae wrmse mape_smoothed",
    r6="r2_smoothed",
)
def smoothed_metrics(data: Data) -> DataFrame:
    return evaluate.accuracy_smoothed(results(data))


@query(
    "v5_sensitivity",
    f"""WITH b AS (SELECT model, stddev_pop(predicted) AS volatility, stddev_pop(actual) AS sa, regr_slope(actual, step) AS ta,
      regr_slope(predicted, step) AS tp, stddev_pop({_APE} * 100) AS mape_volatility,
      quantile_cont({_E}, 0.25) AS q25, quantile_cont({_E}, 0.75) AS q75 FROM total_results GROUP BY model),
    o AS (SELECT r.model, 100 * avg(CAST({_E} < q25 - 1.5 * (q75 - q25) OR {_E} > q75 + 1.5 * (q75 - q25) AS DOUBLE)) AS outlier_pct
      FROM total_results r JOIN b ON b.model = r.model GROUP BY r.model)
    SELECT model, volatility, volatility / sa AS volatility_ratio, outlier_pct, 100 * abs(ta - tp) / abs(ta) AS trend_gap_pct,
      mape_volatility FROM b JOIN o USING (model)""",
    r4="volatility outlier_pct trend_gap_pct mape_volatility",
    r6="volatility_ratio",
)
def sensitivity(data: Data) -> DataFrame:
    return evaluate.sensitivity(stage(evaluate.roll_results(results(data), []), "totals"))


_SPANS = f"""100 * avg({_APE}) FILTER (step BETWEEN 1 AND 4) AS short_mape,
    100 * avg({_APE}) FILTER (step BETWEEN 5 AND 8) AS medium_mape,
    100 * avg({_APE}) FILTER (step BETWEEN 9 AND 12) AS long_mape"""


@query(
    "v6_horizon_errors",
    f"SELECT model, {_SPANS} FROM results GROUP BY model",
    r4="short_mape medium_mape long_mape",
)
def horizon_errors(data: Data) -> DataFrame:
    return evaluate.horizon_errors(results(data))


RANKED = ["weighted_rmse", "rmse", "mae", "mape", "r2"]
define_cte(
    "ranked",
    "\nUNION ALL ".join(
        f"SELECT '{m}' AS metric, model, {m} AS value, rank() OVER (ORDER BY {m} {'DESC' if m == 'r2' else ''}, model) AS rank FROM scores"
        for m in RANKED
    ),
)


def rankings(data: Data) -> DataFrame:
    return evaluate.rank_models(evaluate.to_metrics(evaluate.accuracy(results(data))
                                                    .drop("model_type")), RANKED)


@query("v7_w14_i9_rankings", "SELECT metric, model, value, CAST(rank AS INTEGER) AS rank FROM ranked", r4="value")
def model_rankings(data: Data) -> DataFrame:
    return rankings(data)


@query(
    "v7_event_ranking",
    """SELECT model, event_rmse, CAST(row_number() OVER (ORDER BY event_rmse, model) AS INTEGER) AS rank
    FROM scores WHERE event_rmse > 0""",
    r4="event_rmse",
)
def event_ranking(data: Data) -> DataFrame:
    return evaluate.event_ranking(evaluate.accuracy(results(data)))


@query(
    "v7_type_means",
    "SELECT model_type, avg(weighted_rmse) AS mean_weighted_rmse FROM scores GROUP BY model_type",
    r4="mean_weighted_rmse",
)
def type_means(data: Data) -> DataFrame:
    return evaluate.type_means(evaluate.accuracy(results(data)))


@query(
    "v8_summary_picks",
    """SELECT (SELECT model FROM scores ORDER BY weighted_rmse, model LIMIT 1) AS best_weighted_rmse,
    (SELECT model FROM scores ORDER BY r2 DESC, model DESC LIMIT 1) AS best_r2,
    avg(weighted_rmse) FILTER (model_type = 'Statistical') AS statistical_mean,
    avg(weighted_rmse) FILTER (model_type = 'Ensemble') AS ensemble_mean, 1e5 / min(weighted_rmse) AS accuracy_score FROM scores""",
    r4="statistical_mean ensemble_mean",
    r6="accuracy_score",
)
def summary_picks(data: Data) -> DataFrame:
    return evaluate.summary_picks(evaluate.accuracy(results(data)))


@query(
    "v9_residual_t",
    f"""WITH s AS (SELECT model, avg({_E}) AS m, var_samp({_E}) AS v, count(*) AS n FROM results GROUP BY model),
    c AS (SELECT a.model AS model_a, b.model AS model_b, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)
      * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)) AS t, CAST(a.n + b.n - 2 AS BIGINT) AS df
      FROM s a JOIN s b ON a.model < b.model), p AS ({tail_sql("c", "model_a, model_b")})
    SELECT c.*, p_value FROM c JOIN p USING (model_a, model_b)""",
    r6="t p_value",
)
def residual_t(data: Data) -> DataFrame:
    return evaluate.residual_t_tests(results(data), sorted(MODELS))


_PROFILE_QS = ((0.1, "q10"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.9, "q90"))


def _moments_sql(c: str) -> str:
    return f"""avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max,
    max({c}) - min({c}) AS {c}_range, stddev_pop({c}) / (avg({c}) + 1e-8) AS {c}_cv"""


@query(
    "v10_prediction_profile",
    f"""SELECT model, {_moments_sql("predicted")}, {_moments_sql("actual")}, avg(predicted - actual) AS bias,
    var_pop(predicted - actual) AS error_variance, 100 * avg(predicted - actual) / avg(actual) AS bias_pct, """
    + ", ".join(
        f"quantile_cont(predicted, {q}) - quantile_cont(actual, {q}) AS {n}_gap, "
        f"100 * (quantile_cont(predicted, {q}) - quantile_cont(actual, {q})) / nullif(quantile_cont(actual, {q}), 0) AS {n}_gap_pct"
        for q, n in _PROFILE_QS
    )
    + " FROM results GROUP BY model",
    r2="error_variance",
    r4="predicted_mean predicted_std predicted_min predicted_max predicted_range actual_mean actual_std actual_min "
    "actual_max actual_range bias bias_pct q10_gap q10_gap_pct q25_gap q25_gap_pct q50_gap q50_gap_pct "
    "q75_gap q75_gap_pct q90_gap q90_gap_pct",
    r6="predicted_cv actual_cv",
)
def prediction_profile(data: Data) -> DataFrame:
    return evaluate.prediction_profile(results(data, staged=True))


@query(
    "v11_error_profile",
    """WITH e AS (SELECT *, predicted - actual AS e, abs(predicted - actual) AS ae,
      lag(predicted - actual) OVER (PARTITION BY model, store, dept ORDER BY date) AS e1 FROM results),
    q AS (SELECT model, quantile_cont(ae, 0.95) AS p95, quantile_cont(actual, 0.33) AS p33, quantile_cont(actual, 0.67) AS p67,
      avg(e) AS m FROM e GROUP BY model)
    SELECT e.model, avg(e) AS mean_error, stddev_pop(e) AS std_error, avg(pow(e - m, 3)) / pow(stddev_pop(e), 3) AS skewness,
      avg(pow(e - m, 4)) / pow(stddev_pop(e), 4) - 3 AS kurtosis, avg(ae) AS mae, CAST(count_if(ae > p95) AS BIGINT) AS n_large,
      max(ae) AS max_error, avg(ae) FILTER (ae > p95) AS mean_large, 100.0::DOUBLE * count_if(ae > p95) / count(*) AS pct_large,
      covar_pop(e1, e) / (stddev_pop(e1) FILTER (e IS NOT NULL) * stddev_pop(e) FILTER (e1 IS NOT NULL)) AS lag1_r,
      avg(ae) FILTER (actual < p33) AS mae_small, avg(ae) FILTER (actual BETWEEN p33 AND p67) AS mae_medium,
      avg(ae) FILTER (actual > p67) AS mae_large FROM e JOIN q ON q.model = e.model GROUP BY e.model""",
    r4="mean_error std_error mae max_error mean_large pct_large mae_small mae_medium mae_large",
    r6="skewness kurtosis lag1_r",
)
def error_profile(data: Data) -> DataFrame:
    return evaluate.error_profile(results(data, staged=True))


define_cte(
    "relevance",
    """WITH h AS (SELECT date, ntile(2) OVER (ORDER BY date DESC) = 2 AS early FROM (SELECT DISTINCT date FROM results)),
    a AS (SELECT model, sum(predicted - actual) AS total_impact, sum(actual) AS y, count(DISTINCT store) AS sites,
      100 * avg(abs((actual - predicted) / (actual + 1e-8))) AS mape_smoothed,
      100 * avg(abs((actual - predicted) / (actual + 1e-8))) FILTER (early) AS early_mape,
      100 * avg(abs((actual - predicted) / (actual + 1e-8))) FILTER (NOT early) AS late_mape
      FROM results JOIN h USING (date) GROUP BY model)
    SELECT model, total_impact, mape_smoothed, early_mape, late_mape, 100 * total_impact / y AS impact_pct,
      total_impact / sites AS impact_per_site,
      CASE WHEN mape_smoothed < 10 THEN 'Low' WHEN mape_smoothed < 20 THEN 'Medium' ELSE 'High' END AS error_level,
      mape_smoothed < 15 AS fit_planning, mape_smoothed < 10 AS fit_inventory, mape_smoothed < 5 AS fit_pricing,
      late_mape - early_mape AS degradation,
      CASE WHEN abs(late_mape - early_mape) < 5 THEN 'Stable' ELSE 'Degrading' END AS stability FROM a""",
)


@query(
    "v12_business_relevance",
    "SELECT * FROM relevance",
    r4="total_impact mape_smoothed early_mape late_mape impact_pct impact_per_site degradation",
)
def business_relevance(data: Data) -> DataFrame:
    return evaluate.business_relevance(results(data, staged=True))


@query(
    "v13_smoothness",
    """SELECT model, stddev_pop(c) AS volatility, avg(c) AS mean_change, max(abs(c)) AS max_change,
    1 / (1 + stddev_pop(c) / avg(predicted)) AS smoothness FROM (SELECT model, predicted,
      predicted - lag(predicted) OVER (PARTITION BY model, store, dept ORDER BY date) AS c FROM results) GROUP BY model""",
    r6="volatility mean_change max_change smoothness",
)
def smoothness(data: Data) -> DataFrame:
    return evaluate.smoothness(results(data))


_PAIRS = """SELECT a.model AS model_a, b.model AS model_b, covar_pop(a.predicted, b.predicted)
      / nullif(stddev_pop(a.predicted) * stddev_pop(b.predicted), 0) AS r
    FROM results a JOIN results b USING (store, dept, date) WHERE a.model < b.model GROUP BY 1, 2"""


@query("v14_agreement", _PAIRS, r6="r")
def agreement(data: Data) -> DataFrame:
    return evaluate.agreement(results(data), sorted(MODELS))


@query(
    "v14_agreement_level",
    f"""WITH p AS ({_PAIRS}) SELECT avg(coalesce(r, 0)) AS mean_r, CASE WHEN avg(coalesce(r, 0)) > 0.8 THEN 'High'
    WHEN avg(coalesce(r, 0)) > 0.6 THEN 'Medium' ELSE 'Low' END AS agreement FROM p""",
    r6="mean_r",
)
def agreement_level(data: Data) -> DataFrame:
    return evaluate.agreement_level(evaluate.agreement(results(data), sorted(MODELS)))


define_cte(
    "total_scores",
    """SELECT model, 100 * avg(abs((actual - predicted) / (actual + 1e-8))) AS m FROM total_results GROUP BY model""",
)


@query(
    "v15_suitable_models",
    """SELECT u.use, string_agg(model, ',' ORDER BY model) AS models FROM total_scores,
    (VALUES ('planning', 15), ('inventory', 10), ('pricing', 5)) u(use, lim) WHERE m < lim GROUP BY u.use""",
)
def suitable_models(data: Data) -> DataFrame:
    totals = evaluate.roll_results(results(data), ["store"]).groupBy("model", "date").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.lit("all").alias("store")
    )
    return evaluate.suitable_models(evaluate.business_relevance(stage(totals, "totals")))


_RUN_MODELS = ", ".join(MODELS)
_RUN_METRICS = {
    "weighted_rmse": f"sqrt(sum(weight * {_E} * {_E}) / sum(weight))",
    "event_rmse": f"coalesce(sqrt(avg({_E} * {_E}) FILTER (weight > 1)), 0)",
    "mape": f"100 * avg({_APE})",
    "r2": f"coalesce(1 - avg({_E} * {_E}) / nullif(var_pop(actual), 0), 0)",
}


@query(
    "f1_forecast_run",
    f"""WITH l AS (SELECT n.*, r.reconciled FROM node_forecasts n JOIN reconciled_leaves r
      ON r.store = n.store AND r.dept = n.dept AND r.step = n.step WHERE n.level = 'Store_Department'),
    u AS (SELECT u.model, t.weekly_sales AS actual, u.predicted, w.weight FROM
      (UNPIVOT (SELECT store, dept, date, {_RUN_MODELS}, reconciled FROM l)
        ON {_RUN_MODELS}, reconciled INTO NAME model VALUE predicted) u
      JOIN train t ON t.store = u.store AND t.dept = u.dept AND t.date = u.date
      JOIN (SELECT date, CASE WHEN bool_or(is_holiday) THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
        FROM train GROUP BY date) w ON w.date = u.date),
    m AS ("""
    + " UNION ALL ".join(f"SELECT '{n}' AS metric, model, {e} AS value FROM u GROUP BY model" for n, e in _RUN_METRICS.items())
    + """) SELECT metric, model, value, CAST(rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'r2' THEN -value
      ELSE value END, model) AS INTEGER) AS rank FROM m""",
    r4="value",
)
def forecast_run(data: Data) -> DataFrame:
    """The whole forecast plan; ranks all base models and the reconciled ensemble."""
    return forecasting.run(data.train()).ranking


@query("f2_future_forecasts", "SELECT * FROM prediction_rows_next", r4="predicted_sales")
def future_forecasts(data: Data) -> DataFrame:
    return forecasting.score_future(data.train())


define_cte(
    "given_sites",
    "SELECT n_nationkey AS store FROM nation UNION ALL SELECT n_nationkey + 100 FROM nation WHERE n_regionkey = 0",
)
define_cte(
    "given_rows",
    """SELECT store, dept, CAST(last + CAST(7 * i AS INTEGER) AS DATE) AS date, CAST(i AS INTEGER) AS step FROM given_sites,
      (SELECT DISTINCT dept FROM train UNION ALL SELECT 'NEW'), (SELECT max(date) AS last FROM train), range(0, 9) g(i)""",
)
define_cte(
    "given_scores",
    """SELECT g.store, g.dept, g.date, g.step, CASE WHEN g.step < 1 THEN NULL WHEN l.reconciled IS NOT NULL THEN l.reconciled
      WHEN s.reconciled IS NOT NULL THEN s.reconciled / (s.n + 1) ELSE t.reconciled / (t.n + 1) END AS predicted,
      CASE WHEN g.step < 1 THEN 'History' WHEN l.reconciled IS NOT NULL THEN 'Store_Department'
      WHEN s.reconciled IS NOT NULL THEN 'Store' ELSE 'Total' END AS source_level
    FROM given_rows g LEFT JOIN reconciled_leaves_next l ON l.store = g.store AND l.dept = g.dept AND l.step = g.step
    LEFT JOIN (SELECT store, step, sum(reconciled) AS reconciled, count(*) AS n FROM reconciled_leaves_next GROUP BY ALL) s
      ON s.store = g.store AND s.step = g.step
    LEFT JOIN (SELECT step, sum(reconciled) AS reconciled, count(*) AS n FROM reconciled_leaves_next GROUP BY ALL) t ON t.step = g.step""",
)


def given_scores(data: Data) -> DataFrame:
    """Forecasts of a grid of all nations, some new sites, all departments and a new
    one, over the panel's last date and the eight after it."""
    fact = data.staged_train()
    nation = data.table("nation")
    sites = nation.select(F.col("n_nationkey").alias("store")).unionByName(
        nation.where("n_regionkey = 0").select((F.col("n_nationkey") + 100).alias("store"))
    )
    known = fact.agg(F.collect_set("dept").alias("d"), F.max("date").alias("last"))
    ahead = F.explode(F.sequence(F.lit(0), F.lit(HORIZON)))
    depts = known.select(F.concat("d", F.array(F.lit("NEW"))).alias("d")).scalar()
    rows = sites.withColumn("dept", F.explode(depts)).withColumn("_i", ahead)
    date = F.date_add(known.select("last").scalar(), F.col("_i") * 7)
    return forecasting.score_given(fact, rows.select(F.col("store").cast("int").alias("store"), "dept", date.alias("date")))


@query("f3_given_grid", "SELECT * FROM given_scores", r4="predicted")
def given_grid(data: Data) -> DataFrame:
    """Every row of a given future grid, and the level its forecast comes from."""
    return given_scores(data)


@query(
    "f3_grid_levels",
    f"""SELECT {LEVEL_SQL} AS level, store, dept, step, sum(predicted) AS predicted FROM given_scores WHERE step > 0
    GROUP BY GROUPING SETS ((step), (store, step), (store, dept, step))""",
    r4="predicted",
)
def grid_levels(data: Data) -> DataFrame:
    return grid.grid_nodes(given_scores(data))


@query(
    "k6_model_store",
    """WITH r AS (SELECT model, model_type, store, dept, date, step, actual, weight,
        CASE WHEN model = 'smoothing' THEN predicted + 1 WHEN model = 'ensemble' THEN (SELECT NULL::DOUBLE) ELSE predicted END AS predicted
      FROM results)
    SELECT 'Store_Department' AS grain, model, model_type, count(*) AS n, sum(predicted) AS predicted, sum(actual) AS actual, max(step)::INTEGER AS steps
    FROM r WHERE model <> 'ensemble' GROUP BY model, model_type
    UNION ALL SELECT 'Store_Department', model, model_type, count(*), sum(predicted), sum(actual), max(step)::INTEGER FROM results
      WHERE model = 'ensemble' AND step <= 4 GROUP BY model, model_type""",
    r2="predicted actual",
)
def model_store(data: Data) -> DataFrame:
    """All base models saved; then one saved again with other forecasts, and another
    with fewer steps, of which some cells came twice."""
    rows = store.from_results(results(data, staged=True))
    kinds = {k: rows.schema[k].dataType for k in DEFAULT.keys}
    path = new_path(data.spark, "model_store")
    store.save(rows, path)
    again = rows.where("model = 'smoothing'").withColumn("predicted", F.col("predicted") + 1)
    twice = rows.where("model = 'ensemble' AND step <= 4").withColumn("run", F.lit(1))
    wrong = twice.where("step = 1").withColumns({"run": F.lit(0), "predicted": F.lit(-1.0)})
    store.save(again, path)
    store.save(store.keep_last(twice.unionByName(wrong), F.col("run")).drop("run"), path)
    back = store.load(data.spark, path, DEFAULT, kinds)
    return back.groupBy("grain", "model", "model_type").agg(
        F.count("*").alias("n"), F.sum("predicted").alias("predicted"), F.sum("actual").alias("actual"), F.max("step").alias("steps")
    )


@query("f4_fitted_ranking")
def fitted_ranking(data: Data) -> DataFrame:
    """Forest, seasonal regression and both autoregressions beside the base models:
    one store, one grain (sites by week), the cells all of them answer."""
    panel = data.staged_panel()
    kinds = {k: panel.schema[k].dataType for k in DEFAULT.keys}
    weights = forecast.event_weights(panel)
    path = new_path(data.spark, "fitted_models")
    fit, val = clean.time_split(panel, HORIZON)
    base = forecast.base_forecasts(fit, forecast.horizon_dates(val, HORIZON), HORIZON)
    store.save(store.from_results(forecast.forecast_results(base, val)), path)
    fitted = {
        "forest": (forest_forecast(data, trees=20, depth=8), "Machine learning", 2, weights),
        "seasonal_regression": (seasonal_regression(data), "Statistical", 2, weights),
        "multiplicative": (multiplicative_regression(data), "Statistical", 2, weights),
        "autoregression": (differenced_autoregression(data), "Statistical", 1, store.weights_by_week(panel)),
        "seasonal_arma": (seasonal_arma(data), "Statistical", 1, store.weights_by_week(panel)),
    }
    for name, (rows, kind, depth, weight) in fitted.items():
        store.save(store.rows_of(rows, name, kind, DEFAULT, depth, weight), path)
    saved = store.load(data.spark, path, DEFAULT, kinds)
    cells = stage(store.comparable(stage(store.at_grain(saved, ["store"]), "by_week"), ["store"]), "cells")
    metrics = evaluate.to_metrics(evaluate.accuracy(cells).drop("model_type"))
    return evaluate.rank_models(metrics, ["weighted_rmse", "event_rmse", "mape", "r2"])


# --- insight --------------------------------------------------------------------------------


def site_correlations(data: Data) -> DataFrame:
    return stats.correlations(analysis(data), "weekly_sales", ANALYSED)


def _values(rows: list[tuple]) -> str:
    def cell(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return f"'{v}'"
        return str(v).lower() if isinstance(v, bool) else str(v)

    return ", ".join(f"({', '.join(cell(v) for v in r)})" for r in rows)


define_cte(
    "domain_scores",
    f"""SELECT d.feature, category, CAST(weight AS DOUBLE) AS weight, controllable,
    coalesce(CASE WHEN n > 10 THEN abs(r) END, 0) AS statistical,
    weight::DOUBLE * (0.7::DOUBLE + 0.3::DOUBLE * coalesce(CASE WHEN n > 10 THEN abs(r) END, 0)) AS importance
    FROM (VALUES {_values(insight.DOMAIN)}) d(feature, category, weight, controllable) LEFT JOIN site_corr c ON c.feature = d.feature""",
)


@query("i4_j7_domain_importance", "SELECT * FROM domain_scores", r6="statistical importance")
def domain_importance(data: Data) -> DataFrame:
    return insight.domain_importance(site_correlations(data), insight.domain_table(data.spark))


define_cte(
    "model_corr",
    "\nUNION ALL ".join(
        f"""SELECT '{f}' AS feature, model AS source, abs(covar_pop({f}, p) / nullif(stddev_pop({f}) FILTER (p IS NOT NULL)
      * stddev_pop(p) FILTER ({f} IS NOT NULL), 0)) AS score
    FROM site_weeks JOIN (SELECT model, store, date, sum(predicted) AS p FROM results GROUP BY ALL) r USING (store, date) GROUP BY model"""
        for f in ANALYSED
    ),
)


def model_scores(data: Data) -> DataFrame:
    """Correlation of each feature with each model's forecasts, per site and date."""
    scored = results(data).groupBy("model", "store", "date").agg(F.sum("predicted").alias("p"))
    joined = scored.join(analysis(data).drop("model"), ["store", "date"])
    corr = stats.correlations(joined, "p", ANALYSED, by=["model"])
    return corr.where("r is not null").select(
        "feature", F.col("model").alias("source"), F.abs("r").alias("score")
    )


@query(
    "i5_consensus",
    """SELECT feature, avg(score) AS mean_importance, stddev_pop(score) AS std_importance,
    1 / (1 + stddev_pop(score)) AS consensus, count(*) AS n_sources FROM model_corr WHERE score IS NOT NULL GROUP BY feature""",
    r6="mean_importance std_importance consensus",
)
def consensus(data: Data) -> DataFrame:
    return insight.consensus(model_scores(data))


@query(
    "i11_top_consensus",
    """SELECT feature, 1 / (1 + stddev_pop(score)) AS consensus FROM model_corr WHERE score IS NOT NULL GROUP BY feature
    ORDER BY consensus DESC, feature LIMIT 3""",
    r6="consensus",
)
def top_consensus(data: Data) -> DataFrame:
    table = insight.consensus(model_scores(data)).select("feature", "consensus")
    return insight.top_importances(table, "consensus", 3)


define_cte(
    "theory",
    f"""SELECT c.feature, expected, confidence, r, expected = 0 OR r * expected > 0 AS supported,
    abs(r) * CASE WHEN expected = 0 OR r * expected > 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS evidence
    FROM site_corr c JOIN (VALUES {_values(insight.THEORY)}) t(feature, expected, confidence) ON t.feature = c.feature
    WHERE n > 10 AND r IS NOT NULL""",
)


@query("i6_theory_check", "SELECT * FROM theory", r6="r evidence")
def theory_check(data: Data) -> DataFrame:
    return insight.theory_check(site_correlations(data), insight.theory_table(data.spark))


define_cte(
    "drivers",
    f"""WITH s AS (SELECT feature, importance AS score FROM domain_scores UNION ALL
      SELECT feature, abs(r) FROM site_corr WHERE r IS NOT NULL),
    t AS (SELECT feature, avg(score) AS mean_score, 1 / (1 + stddev_pop(score)) AS consistency, count(*) AS evidence_count
      FROM s GROUP BY feature ORDER BY mean_score DESC, feature LIMIT 5)
    SELECT t.*, coalesce(control, 'Unknown') AS control FROM t
    LEFT JOIN (VALUES {_values(insight.CONTROL)}) c(feature, control) USING (feature)""",
)


@query("i7_key_drivers", "SELECT * FROM drivers", r6="mean_score consistency")
def key_drivers(data: Data) -> DataFrame:
    corr = stage(site_correlations(data), "correlations")
    domain = insight.domain_importance(corr, insight.domain_table(data.spark))
    scores = interpretation.driver_scores(corr, domain)
    return insight.key_drivers(scores, insight.control_table(data.spark))


@query("i11_controllable_drivers", "SELECT feature, control FROM drivers WHERE control IN ('High', 'Medium')")
def controllable_drivers(data: Data) -> DataFrame:
    corr = stage(site_correlations(data), "correlations")
    domain = insight.domain_importance(corr, insight.domain_table(data.spark))
    scores = interpretation.driver_scores(corr, domain)
    table = insight.key_drivers(scores, insight.control_table(data.spark))
    return table.where(F.col("control").isin("High", "Medium")).select("feature", "control")


define_cte(
    "finding_metrics",
    """SELECT feature AS subject, 'importance' AS metric, importance AS value FROM domain_scores
    UNION ALL SELECT feature, 'abs_r', abs(r) FROM site_corr WHERE r IS NOT NULL
    UNION ALL SELECT model, 'mape', mape FROM scores
    UNION ALL SELECT model, 'weighted_rmse_rank', rank FROM ranked WHERE metric = 'weighted_rmse'
    UNION ALL SELECT 'weekly_sales', 'lift_pct', 100 * (avg(weekly_sales) FILTER (is_holiday = 1)
      - avg(weekly_sales) FILTER (is_holiday = 0)) / avg(weekly_sales) FILTER (is_holiday = 0) FROM site_weeks
    UNION ALL SELECT 'weekly_sales', 'peak_month', (SELECT month(date) FROM site_weeks GROUP BY 1
      ORDER BY avg(weekly_sales) DESC, 1 LIMIT 1)""",
)


def finding_metrics(data: Data) -> DataFrame:
    sites = stage(analysis(data), "analysis")
    corr = stage(stats.correlations(sites, "weekly_sales", ANALYSED), "correlations")
    accuracy = stage(evaluate.accuracy(results(data)), "accuracy")
    domain = insight.domain_importance(corr, insight.domain_table(data.spark))
    return interpretation.long_metrics(sites, corr, domain, accuracy)


_RULE_COLUMNS = (
    "kind, area, rule_subject, metric, operator, threshold, priority, high_threshold, high_priority, actionability"
)
_FINDINGS = f"""SELECT kind, area, subject, m.metric, value, CASE WHEN value > high_threshold THEN high_priority ELSE priority END AS priority,
    actionability FROM finding_metrics m JOIN (VALUES {_values(insight.RULES)}) r({_RULE_COLUMNS}) ON r.metric = m.metric
    WHERE (rule_subject IS NULL OR rule_subject = subject) AND CASE operator WHEN '>' THEN value > threshold ELSE value < threshold END"""


@query("i8_findings", _FINDINGS, r4="value")
def findings(data: Data) -> DataFrame:
    return insight.findings(finding_metrics(data), insight.rule_table(data.spark))


@query(
    "i11_urgent_recommendations",
    f"WITH f AS ({_FINDINGS}) SELECT area, subject FROM f WHERE kind = 'recommendation' AND priority = 'High' AND actionability = 'High'",
)
def urgent(data: Data) -> DataFrame:
    found = insight.findings(finding_metrics(data), insight.rule_table(data.spark))
    chosen = "kind = 'recommendation' and priority = 'High' and actionability = 'High'"
    return found.where(chosen).select("area", "subject")


def _surrogate_rows(data: Data) -> DataFrame:
    scored = results(data).where("model = 'ensemble'").groupBy("store", "date").agg(F.sum("predicted").alias("p"))
    return stage(scored.join(analysis(data), ["store", "date"]), "surrogate")


@query("i2_surrogate_forest")
def surrogate_forest(data: Data) -> DataFrame:
    rows = _surrogate_rows(data)
    model = models.fit_forest(rows, ANALYSED, "p", weight=None, depth=10, leaf=1, keys=["store", "date"])
    fitted = model.transform(models.assemble(rows, ANALYSED))
    r2 = fitted.agg((1 - F.avg(F.pow(F.col("p") - F.col("prediction"), 2)) / F.var_pop("p")).alias("r2")).scalar()
    table = models.forest_importances(model, ANALYSED, data.spark)
    return insight.top_importances(table, "importance").withColumn("r2", r2)


def _ridge_sql(features: list[str], alpha: float = 1.0) -> str:
    """Ridge coefficients by Gauss-Jordan elimination, one select per pivot."""
    k = range(len(features))
    cells = [f"covar_pop(x{i}, x{j}) AS s{i}_{j}" for i in k for j in k]
    cells += [f"covar_pop(x{i}, p) AS t{i}" for i in k]
    inputs = ", ".join(f"coalesce(CAST({f} AS DOUBLE), 0) AS x{i}" for i, f in enumerate(features))
    text = f"SELECT count(*) AS n, var_pop(p) AS vy, {', '.join(cells)} FROM (SELECT p, {inputs} FROM surrogate_rows)"
    scaled = [f"s{i}_{j} / sqrt(s{i}_{i} * s{j}_{j}) AS r{i}_{j}" for i in k for j in k]
    scaled += [f"t{i} / sqrt(s{i}_{i}) AS y{i}" for i in k]
    text = f"SELECT n, vy, {', '.join(scaled)} FROM ({text})"
    start = [f"r{i}_{j}{f' + {alpha} / n' if i == j else ''} AS m{i}_{j}" for i in k for j in k]
    kept = ", ".join(["vy", *[f"r{i}_{j}" for i in k for j in k], *[f"y{i}" for i in k]])
    steps = [f"SELECT {kept}, {', '.join(start)}, {', '.join(f'y{i} AS b{i}' for i in k)} FROM ({text})"]
    for c in k:
        cells = [
            f"m{c}_{j} / m{c}_{c} AS m{c}_{j}" if i == c else f"m{i}_{j} - m{i}_{c} * m{c}_{j} / m{c}_{c} AS m{i}_{j}"
            for i in k
            for j in k
        ]
        cells += [f"b{c} / m{c}_{c} AS b{c}" if i == c else f"b{i} - m{i}_{c} * b{c} / m{c}_{c} AS b{i}" for i in k]
        steps.append(f"SELECT {kept}, {', '.join(cells)} FROM pivot{c}")
    fitted = " + ".join([*[f"2 * b{i} * y{i}" for i in k], *[f"-b{i} * b{j} * r{i}_{j}" for i in k for j in k]])
    chain = ", ".join(f"pivot{c} AS MATERIALIZED ({t})" for c, t in enumerate(steps))
    solved = f"SELECT ({fitted}) / vy AS r2, {', '.join(f'b{i}' for i in k)} FROM pivot{len(features)}"
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, b{i} AS coefficient, r2 FROM g" for i, f in enumerate(features))
    return f"""WITH {chain}, g AS ({solved}) SELECT * FROM ({rows}) ORDER BY abs(coefficient) DESC, feature LIMIT 5"""


define_cte(
    "surrogate_rows",
    """SELECT p, s.* FROM site_weeks s JOIN (SELECT store, date, sum(predicted) AS p FROM results
      WHERE model = 'ensemble' GROUP BY store, date) r ON r.store = s.store AND r.date = s.date""",
)


@query("i3_surrogate_ridge", _ridge_sql(ANALYSED), r4="coefficient", r6="r2")
def surrogate_ridge(data: Data) -> DataFrame:
    return insight.top_importances(insight.surrogate_ridge(_surrogate_rows(data), "p", ANALYSED), "coefficient")


def _report(data: Data) -> DataFrame:
    return interpretation.run(data.staged_panel(), results(data))["report"]


@query("i10_summary_report")
def summary_report(data: Data) -> DataFrame:
    return _report(data)


@query("s4_json_report")
def json_report(data: Data) -> DataFrame:
    """The report written as JSON, read back as text."""
    path = new_path(data.spark, "report")
    sinks.write_json(_report(data), path)
    return data.spark.read.text(path)


@query("s4_json_metrics", "SELECT * FROM scores", r4=_SCORES, r6="r2")
def json_metrics(data: Data) -> DataFrame:
    """Every metric, as one JSON document per model, parsed again."""
    scores = evaluate.accuracy(results(data))
    documents = sinks.to_json_documents(scores, "model")
    fields = [f for f in scores.schema.fields if f.name != "model"]
    parsed = F.from_json("document", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields))
    return documents.select("model", *[parsed[f.name].alias(f.name) for f in fields])
