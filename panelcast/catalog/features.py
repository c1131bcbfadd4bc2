"""Queries over sources, scalar functions, joins and series windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.catalog.registry import Data, define_cte, query
from panelcast.functions import scalars as S
from panelcast.functions import windows as WF
from panelcast.operators import carry, clean, features, profile
from panelcast.operators.joins import lookup_join
from panelcast.sources import panel as P
from panelcast.session import new_path, stage
from panelcast.sources import tables
from panelcast.spec import DEFAULT

KEY = ["store", "dept", "date"]


# --- sources ---------------------------------------------------------------


@query("s1_csv_scan", "SELECT store, dept, date, weekly_sales, is_holiday FROM train")
def csv_scan(data: Data) -> DataFrame:
    path = new_path(data.spark, "csv")
    out = data.train().withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    out.write.option("header", True).csv(path)
    schema = tables.TRAIN_SCHEMA.replace("dept int", "dept string")
    return tables.read_csv(data.spark, path, schema)


@query(
    "s2_date_parse",
    "SELECT store, date, try_cast(CASE WHEN is_holiday THEN 'n/a' "
    "ELSE strftime(date, '%Y-%m-%d') END AS DATE) AS parsed "
    "FROM (SELECT DISTINCT store, date, is_holiday FROM train)",
)
def date_parse(data: Data) -> DataFrame:
    text = F.when(F.col("is_holiday"), "n/a").otherwise(F.date_format("date", "yyyy-MM-dd"))
    rows = data.train().select("store", "date", "is_holiday").distinct()
    return rows.select("store", "date", tables.parse_date(text).alias("parsed"))


# --- projections -------------------------------------------------------------


@query(
    "p1_calendar",
    "SELECT date, year(date) AS year, month(date) AS month, weekofyear(date) AS week, "
    "quarter(date) AS quarter, dayofyear(date) AS day_of_year, count(*) AS n FROM train GROUP BY date",
)
def calendar(data: Data) -> DataFrame:
    parts = S.calendar_parts(F.col("date"))
    return (
        data.train()
        .groupBy("date")
        .agg(F.count("*").alias("n"))
        .withColumns({k: v.cast("bigint") for k, v in parts.items()})
    )


@query(
    "p3_cyclic",
    """SELECT store, dept, date, sin(2*pi()*month(date)/12) AS month_sin, cos(2*pi()*month(date)/12) AS month_cos,
    sin(2*pi()*weekofyear(date)/52) AS week_sin, cos(2*pi()*weekofyear(date)/52) AS week_cos FROM train""",
    r6="month_sin month_cos week_sin week_cos",
)
def cyclic(data: Data) -> DataFrame:
    out = features.add_cyclic(features.add_calendar(data.train()))
    return out.select(*KEY, "month_sin", "month_cos", "week_sin", "week_cos")


@query(
    "p4_event_weight",
    "SELECT store, dept, date, CASE WHEN is_holiday THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS event_weight FROM train",
)
def event_weight(data: Data) -> DataFrame:
    return features.add_event_weight(data.train()).select(*KEY, "event_weight")


@query(
    "p5_p8_promos",
    """SELECT *, promo_total / (size + 1) AS promo_intensity FROM (
    SELECT store, dept, date, size,
      coalesce(markdown1, 0) + coalesce(markdown2, 0) + coalesce(markdown3, 0)
        + coalesce(markdown4, 0) + coalesce(markdown5, 0) AS promo_total,
      CAST(coalesce(markdown1, 0) > 0 AS INTEGER) AS markdown1_active,
      CAST(coalesce(markdown2, 0) > 0 AS INTEGER) AS markdown2_active,
      CAST(coalesce(markdown3, 0) > 0 AS INTEGER) AS markdown3_active,
      CAST(coalesce(markdown4, 0) > 0 AS INTEGER) AS markdown4_active,
      CAST(coalesce(markdown5, 0) > 0 AS INTEGER) AS markdown5_active FROM panel)""",
    r4="promo_total",
    r6="promo_intensity",
)
def promos(data: Data) -> DataFrame:
    active = [f"{c}_active" for c in DEFAULT.promos]
    return features.add_promos(data.panel()).select(
        *KEY, "size", "promo_total", *active, "promo_intensity"
    )


@query(
    "p9_products",
    "SELECT store, dept, date, unemployment * temperature AS unemployment_x_temperature, "
    "cpi * fuel_price AS cpi_x_fuel_price FROM panel",
    r6="unemployment_x_temperature cpi_x_fuel_price",
)
def products(data: Data) -> DataFrame:
    names = [f"{a}_x_{b}" for a, b in features.PRODUCTS]
    return features.add_products(data.panel()).select(*KEY, *names)


@query(
    "p10_stress_index",
    """SELECT store, dept, date, (unemployment - mu) / su + (fuel_price - mf) / sf AS stress_index
    FROM panel, (SELECT avg(unemployment) mu, stddev_samp(unemployment) su, avg(fuel_price) mf,
      stddev_samp(fuel_price) sf FROM panel) s""",
    r6="stress_index",
)
def stress(data: Data) -> DataFrame:
    return features.add_stress_index(data.staged_panel()).select(*KEY, "stress_index")


@query(
    "p11_log_target",
    "SELECT store, dept, date, ln(1 + weekly_sales) AS log_sales FROM train WHERE weekly_sales > 0",
    r6="log_sales",
)
def log_target(data: Data) -> DataFrame:
    return data.train().where("weekly_sales > 0").select(*KEY, F.log1p("weekly_sales").alias("log_sales"))


@query(
    "p12_signs",
    """SELECT store, CAST(count_if(weekly_sales < 0) AS BIGINT) AS negative,
    CAST(count_if(weekly_sales = 0) AS BIGINT) AS zero, CAST(count_if(weekly_sales > 0) AS BIGINT) AS positive
    FROM train GROUP BY store""",
)
def signs(data: Data) -> DataFrame:
    tests = S.signs(F.col("weekly_sales"))
    return data.train().groupBy("store").agg(*[F.count_if(c).alias(n) for n, c in tests.items()])


@query(
    "p13_known_target",
    "SELECT store, dept, date, weekly_sales FROM train WHERE nullif(weekly_sales, 0) IS NOT NULL",
)
def known_target(data: Data) -> DataFrame:
    holes = data.train().withColumn("weekly_sales", F.nullif("weekly_sales", F.lit(0.0)))
    return clean.drop_unknown_target(holes).select(*KEY, "weekly_sales")


@query(
    "p14_top_sets",
    """WITH d AS (SELECT dept FROM train GROUP BY dept ORDER BY sum(weekly_sales) DESC, dept LIMIT 3),
    s AS (SELECT store FROM train GROUP BY store ORDER BY sum(weekly_sales) DESC, store LIMIT 8)
    SELECT store, dept, date, weekly_sales FROM train
    WHERE dept IN (SELECT dept FROM d) AND store IN (SELECT store FROM s)""",
)
def top_sets(data: Data) -> DataFrame:
    return profile.in_top_sets(data.staged_train(), {"dept": 3, "store": 8}).select(*KEY, "weekly_sales")


@query(
    "p15_promo_rows",
    " UNION ALL ".join(f"SELECT '{c}' AS promo, count({c}) AS n, avg({c}) AS mean_value FROM panel" for c in DEFAULT.promos),
    r4="mean_value",
)
def promo_rows(data: Data) -> DataFrame:
    return profile.known_promo_means(data.panel(), DEFAULT.promos)


@query(
    "p16_flag_after_merge",
    "SELECT store, dept, date, t.is_holiday FROM train t LEFT JOIN features f USING (store, date)",
)
def flag_after_merge(data: Data) -> DataFrame:
    fact, covariates = P.tables(data.spark, data.folder, data.site)
    flagged = covariates.withColumn("is_holiday", F.lit(False))
    merged = P.merge_panel(fact, flagged, data.stores())
    return merged.select(*KEY, "is_holiday")


@query(
    "p17_feature_columns",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS non_null FROM panel"
        for c in ("is_holiday", *DEFAULT.covariates, *DEFAULT.promos, "size")
    ),
)
def feature_columns(data: Data) -> DataFrame:
    panel = data.panel()
    names = set(DEFAULT.feature_columns(panel, numeric_only=True))
    counts = panel.agg(*[F.count(c).alias(c) for c in sorted(names)])
    return counts.unpivot([], sorted(names), "feature", "non_null")


@query(
    "p18_periods",
    """SELECT make_date(year(date), month(date), 1) AS month_a, CAST(date_trunc('month', date) AS DATE) AS month_b,
    sum(weekly_sales) AS total FROM train GROUP BY 1, 2""",
    r4="total",
)
def periods(data: Data) -> DataFrame:
    month_a = S.month_start(F.col("date")).alias("month_a")
    month_b = F.date_trunc("month", "date").cast("date").alias("month_b")
    return data.train().groupBy(month_a, month_b).agg(F.sum("weekly_sales").alias("total"))


@query(
    "p19_safe_casts",
    """SELECT store, dept, date, CASE WHEN is_holiday THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag,
    try_cast(dept AS DOUBLE) AS bad_number, try_cast(CAST(store AS VARCHAR) AS DOUBLE) AS good_number FROM train""",
)
def safe_casts(data: Data) -> DataFrame:
    return data.train().select(
        *KEY,
        S.flag_to_number(F.initcap(F.col("is_holiday").cast("string"))).alias("flag"),
        S.to_number(F.col("dept")).alias("bad_number"),
        S.to_number(F.col("store")).alias("good_number"),
    )


@query(
    "p20_epoch",
    "SELECT DISTINCT date, CAST(epoch(date) AS BIGINT) AS seconds FROM train",
)
def epoch(data: Data) -> DataFrame:
    return data.train().select("date").distinct().withColumn("seconds", S.epoch_seconds(F.col("date")))


@query(
    "p21_renames",
    "SELECT date AS ds, sum(weekly_sales) AS y, max(CAST(is_holiday AS INTEGER)) AS holiday FROM train GROUP BY date",
    r4="y",
)
def renames(data: Data) -> DataFrame:
    by_date = data.train().groupBy("date").agg(
        F.sum("weekly_sales").alias("weekly_sales"),
        F.max(F.col("is_holiday").cast("int")).alias("is_holiday"),
    )
    return by_date.withColumnsRenamed({"date": "ds", "weekly_sales": "y", "is_holiday": "holiday"})


@query(
    "p22_rounding",
    "SELECT dept, round(avg(weekly_sales), 2) AS mean, round(sum(weekly_sales), 2) AS total FROM train GROUP BY dept",
)
def rounding(data: Data) -> DataFrame:
    by_dept = data.train().groupBy("dept")
    return by_dept.agg(
        F.round(F.avg("weekly_sales"), 2).alias("mean"), F.round(F.sum("weekly_sales"), 2).alias("total")
    )


@query(
    "p23_entity_keys",
    """SELECT DISTINCT 'Store_' || store AS parent, 'Store_' || store || '_Dept_' || dept AS leaf,
    CAST(store AS VARCHAR) AS parsed_store, dept AS parsed_dept FROM train""",
)
def entity_keys(data: Data) -> DataFrame:
    leaf = S.leaf_key(F.col("store"), F.col("dept")).alias("leaf")
    parent = S.store_key(F.col("store")).alias("parent")
    keys = data.train().select("store", "dept").distinct().select(parent, leaf)
    store, dept = S.parse_key(F.col("leaf"))
    return keys.withColumns({"parsed_store": store, "parsed_dept": dept})


SAMPLE_SQL = """SELECT store, dept, date, weekly_sales, is_holiday FROM train
    ORDER BY md5(concat_ws('|', store, dept, date)), store, dept, date LIMIT {n}"""


@query("p24_sample_rows", SAMPLE_SQL.format(n=5000))
def sample_rows(data: Data) -> DataFrame:
    return clean.bounded_sample(data.train(), 5000, KEY)


# --- joins ---------------------------------------------------------------------


@query(
    "j1_join_covariates",
    """SELECT t.store, t.dept, t.date, t.weekly_sales, f.temperature, f.cpi, f.markdown1
    FROM train t LEFT JOIN features f ON t.store = f.store AND t.date = f.date""",
    r6="temperature cpi",
)
def join_covariates(data: Data) -> DataFrame:
    fact, covariates = P.tables(data.spark, data.folder, data.site)
    joined = fact.join(covariates, ["store", "date"], "left")
    return joined.select(*KEY, "weekly_sales", "temperature", "cpi", "markdown1")


@query(
    "j2_panel",
    "SELECT * FROM panel",
    r6="temperature fuel_price cpi unemployment",
)
def merged_panel(data: Data) -> DataFrame:
    return data.panel()


@query(
    "j3_inner_stores",
    "SELECT t.store, t.dept, t.date, s.type, s.size FROM train t JOIN stores s ON t.store = s.store",
)
def inner_stores(data: Data) -> DataFrame:
    return lookup_join(data.train(), data.stores(), ["store"], "inner").select(*KEY, "type", "size")


@query(
    "j4_group_means",
    """SELECT store, dept, date, avg(weekly_sales) OVER (PARTITION BY type) AS type_mean,
    avg(weekly_sales) OVER (PARTITION BY dept) AS dept_mean,
    avg(weekly_sales) OVER (PARTITION BY store, dept) AS series_mean FROM panel""",
)
def group_means(data: Data) -> DataFrame:
    return features.add_group_means(data.staged_panel()).select(*KEY, "type_mean", "dept_mean", "series_mean")


@query(
    "j4_group_means_fit_on_train",
    """WITH m AS (SELECT store, dept, avg(weekly_sales) AS series_mean FROM train, cut WHERE date < start GROUP BY store, dept)
    SELECT t.store, t.dept, t.date, m.series_mean FROM train t LEFT JOIN m ON t.store = m.store AND t.dept = m.dept""",
)
def group_means_train(data: Data) -> DataFrame:
    fact = data.staged_train()
    fit, _ = clean.time_split(fact)
    return features.add_group_means(fact, fit_on=fit).select(*KEY, "series_mean")


@query(
    "j5_holiday_label",
    """SELECT date, CASE weekofyear(date) WHEN 6 THEN 'Super Bowl' WHEN 36 THEN 'Labor Day'
    WHEN 47 THEN 'Thanksgiving' WHEN 52 THEN 'Christmas' ELSE 'Regular' END AS holiday,
    avg(weekly_sales) AS mean_sales FROM train GROUP BY date""",
    r4="mean_sales",
)
def holiday_label(data: Data) -> DataFrame:
    by_date = data.train().groupBy("date").agg(F.avg("weekly_sales").alias("mean_sales"))
    return profile.label_events(by_date, P.event_calendar(by_date))


# --- series windows --------------------------------------------------------------


LAG_SQL = ", ".join(
    f"lag(weekly_sales, {k}) OVER w AS weekly_sales_lag_{k}" for k in features.LAGS
)
LAG_NAMES = [f"weekly_sales_lag_{k}" for k in features.LAGS]


def _lags(data: Data) -> DataFrame:
    return features.add_lags(data.train()).select(*KEY, *LAG_NAMES)


for _name, _site in (("w1_lags", "nation"), ("w1_lags_by_supplier", "supplier")):
    query(
        _name,
        f"SELECT store, dept, date, {LAG_SQL} FROM train WINDOW w AS (PARTITION BY store, dept ORDER BY date)",
        site=_site,
    )(_lags)


@query(
    "w1_lags_calendar",
    """SELECT store, dept, date, max(weekly_sales) OVER (w RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING) AS weekly_sales_lag_1,
      max(weekly_sales) OVER (w RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND INTERVAL 364 DAY PRECEDING) AS weekly_sales_lag_52
    FROM train WINDOW w AS (PARTITION BY store, dept ORDER BY date)""",
)
def lags_calendar(data: Data) -> DataFrame:
    out = features.add_lags(data.train(), (1, 52), calendar=True)
    return out.select(*KEY, "weekly_sales_lag_1", "weekly_sales_lag_52")


@query(
    "w2_event_neighbours",
    """SELECT store, dept, date, coalesce(lead(CAST(is_holiday AS INTEGER)) OVER w, 0) AS pre_event,
    coalesce(lag(CAST(is_holiday AS INTEGER)) OVER w, 0) AS post_event
    FROM train WINDOW w AS (PARTITION BY store, dept ORDER BY date)""",
)
def event_neighbours(data: Data) -> DataFrame:
    return features.add_event_neighbours(data.train()).select(*KEY, "pre_event", "post_event")


_FN = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}
ROLL_SQL = ", ".join(
    f"CASE WHEN count(weekly_sales) OVER w{n} = {n} THEN {fn}(weekly_sales) OVER w{n} END AS weekly_sales_{s}_{n}"
    for n in features.WINDOWS
    for s, fn in _FN.items()
)
ROLL_FRAMES = ", ".join(
    f"w{n} AS (PARTITION BY store, dept ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    for n in features.WINDOWS
)
ROLL_NAMES = [f"weekly_sales_{s}_{n}" for n in features.WINDOWS for s in _FN]


def _rolling(data: Data) -> DataFrame:
    return features.add_rolling(data.train()).select(*KEY, *ROLL_NAMES)


for _name, _site in (("w3_rolling", "nation"), ("w3_rolling_by_supplier", "supplier")):
    query(
        _name,
        f"SELECT store, dept, date, {ROLL_SQL} FROM train WINDOW {ROLL_FRAMES}",
        site=_site,
        r4=" ".join(ROLL_NAMES),
    )(_rolling)


@query(
    "w3_rolling_past_only",
    """SELECT store, dept, date, CASE WHEN count(weekly_sales) OVER w = 4 THEN avg(weekly_sales) OVER w END
    AS weekly_sales_mean_4 FROM train
    WINDOW w AS (PARTITION BY store, dept ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""",
    r4="weekly_sales_mean_4",
)
def rolling_past(data: Data) -> DataFrame:
    out = features.add_rolling(data.train(), (4,), ("mean",), exclude_current=True)
    return out.select(*KEY, "weekly_sales_mean_4")


@query(
    "w6_difference",
    """SELECT store, dept, date, weekly_sales - lag(weekly_sales) OVER (PARTITION BY store, dept ORDER BY date)
    AS change FROM train""",
)
def difference(data: Data) -> DataFrame:
    w = WF.series_window(["store", "dept"], "date")
    return data.train().select(*KEY, WF.difference(F.col("weekly_sales"), w).alias("change"))


@query(
    "w6_difference_cross_series",
    """SELECT store, dept, date, weekly_sales - lag(weekly_sales) OVER (ORDER BY store, dept, date)
    AS change FROM train""",
)
def difference_cross(data: Data) -> DataFrame:
    return carry.difference_across(data.staged_train(), "weekly_sales").select(*KEY, "change")


@query(
    "w7_fill_forward",
    """SELECT store, dept, date, last_value(markdown1 IGNORE NULLS) OVER (PARTITION BY store, dept ORDER BY date
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS markdown1 FROM panel""",
)
def fill_forward(data: Data) -> DataFrame:
    return clean.fill_forward(data.panel(), ["markdown1"]).select(*KEY, "markdown1")


define_cte(
    "line_parts",
    """SELECT store, dept, date, temperature AS c, rn,
    last_value(temperature IGNORE NULLS) OVER before AS v0, first_value(temperature IGNORE NULLS) OVER after AS v1,
    last_value(CASE WHEN temperature IS NOT NULL THEN rn END IGNORE NULLS) OVER before AS p0,
    first_value(CASE WHEN temperature IS NOT NULL THEN rn END IGNORE NULLS) OVER after AS p1
    FROM (SELECT *, row_number() OVER (PARTITION BY store, dept ORDER BY date) AS rn FROM panel)
    WINDOW before AS (PARTITION BY store, dept ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      after AS (PARTITION BY store, dept ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
define_cte(
    "lined",
    """SELECT store, dept, date, CASE WHEN c IS NOT NULL THEN c WHEN v1 IS NULL THEN v0
    ELSE v0 + (v1 - v0) * (rn - p0) / (p1 - p0) END AS temperature FROM line_parts""",
)


@query("w8_interpolate", "SELECT * FROM lined", r6="temperature")
def interpolate(data: Data) -> DataFrame:
    return clean.interpolate(data.panel(), ["temperature"]).select(*KEY, "temperature")


@query(
    "w9_fill_global",
    """WITH f AS (SELECT *, last_value(temperature IGNORE NULLS) OVER (ORDER BY store, dept, date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM lined)
    SELECT store, dept, date, coalesce(a, first_value(temperature IGNORE NULLS) OVER (ORDER BY store, dept, date
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS temperature FROM f""",
    r6="temperature",
)
def fill_global(data: Data) -> DataFrame:
    lined = clean.interpolate(data.staged_panel(), ["temperature"])
    return carry.fill_across(lined, ["temperature"]).select(*KEY, "temperature")


@query(
    "w9_fill_series",
    "SELECT store, dept, date, coalesce(temperature, 0) AS temperature FROM lined",
    r6="temperature",
)
def fill_series(data: Data) -> DataFrame:
    out = clean.fill_within(clean.interpolate(data.panel(), ["temperature"]), ["temperature"])
    return out.select(*KEY, "temperature")


@query(
    "w10_ordered_carry",
    """WITH s AS (SELECT store, dept, max_by(markdown1, date) FILTER (markdown1 IS NOT NULL) AS last_value,
      min_by(markdown1, date) FILTER (markdown1 IS NOT NULL) AS first_value FROM panel GROUP BY store, dept)
    SELECT store, dept, last_value(last_value IGNORE NULLS) OVER (ORDER BY store, dept
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS markdown1_before,
      first_value(first_value IGNORE NULLS) OVER (ORDER BY store, dept
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS markdown1_after FROM s""",
)
def ordered_carry(data: Data) -> DataFrame:
    return carry.ordered_carry(data.panel(), ["markdown1"])


@query(
    "w11_centered_average",
    """WITH t AS (SELECT date, sum(weekly_sales) AS y FROM train GROUP BY date)
    SELECT date, CASE WHEN count(y) OVER (ORDER BY date ROWS BETWEEN 26 PRECEDING AND 26 FOLLOWING) = 53 THEN
      (sum(y) OVER (ORDER BY date ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)
       + 0.5 * (lag(y, 26) OVER (ORDER BY date) + lead(y, 26) OVER (ORDER BY date))) / 52 END AS trend FROM t""",
    r4="trend",
)
def centered(data: Data) -> DataFrame:
    total = data.train().groupBy(F.lit("Total").alias("node"), "date").agg(F.sum("weekly_sales").alias("y"))
    w = WF.series_window(["node"], "date")
    return total.select("date", WF.centered_average(F.col("y"), w).alias("trend"))


@query(
    "w13_position",
    """SELECT store, dept, date, row_number() OVER (PARTITION BY store, dept ORDER BY date) - 1 AS position FROM train""",
)
def position(data: Data) -> DataFrame:
    w = WF.series_window(["store", "dept"], "date")
    return data.train().select(*KEY, WF.position(w).cast("bigint").alias("position"))


@query(
    "t7_trend_slope",
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY store, dept ORDER BY date) - 1 AS p FROM train)
    SELECT store, dept, CASE WHEN count(*) >= 3 THEN regr_slope(weekly_sales, p) ELSE 0 END AS trend_slope
    FROM p GROUP BY store, dept""",
    r4="trend_slope",
)
def trend_slope(data: Data) -> DataFrame:
    return features.trend_slopes(data.train())


_PANEL_KEPT = "store, dept, date, weekly_sales, is_holiday, temperature, fuel_price, cpi, unemployment, type, size"
_FILLED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in DEFAULT.promos)
_ACTIVE = ", ".join(f"CAST({c} > 0 AS INTEGER) AS {c}_active" for c in DEFAULT.promos)
_FEATURE_SQL = f"""WITH b AS (SELECT {_PANEL_KEPT}, {_FILLED},
      row_number() OVER (PARTITION BY store, dept ORDER BY date) AS rn FROM panel),
    s AS (SELECT avg(unemployment) AS mu, stddev_samp(unemployment) AS su, avg(fuel_price) AS mf, stddev_samp(fuel_price) AS sf FROM b)
    SELECT b.* EXCLUDE (rn), CASE WHEN is_holiday THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS event_weight,
      coalesce(lead(CAST(is_holiday AS INTEGER)) OVER w, 0) AS pre_event,
      coalesce(lag(CAST(is_holiday AS INTEGER)) OVER w, 0) AS post_event,
      CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(weekofyear(date) AS INTEGER) AS week,
      CAST(quarter(date) AS INTEGER) AS quarter, CAST(dayofyear(date) AS INTEGER) AS day_of_year,
      sin(2*pi()*month(date)/12) AS month_sin, cos(2*pi()*month(date)/12) AS month_cos,
      sin(2*pi()*weekofyear(date)/52) AS week_sin, cos(2*pi()*weekofyear(date)/52) AS week_cos, {_ACTIVE},
      markdown1 + markdown2 + markdown3 + markdown4 + markdown5 AS promo_total,
      (markdown1 + markdown2 + markdown3 + markdown4 + markdown5) / (size + 1) AS promo_intensity,
      {LAG_SQL}, {ROLL_SQL},
      avg(weekly_sales) OVER (PARTITION BY type) AS type_mean, avg(weekly_sales) OVER (PARTITION BY dept) AS dept_mean,
      avg(weekly_sales) OVER v AS series_mean,
      unemployment * temperature AS unemployment_x_temperature, cpi * fuel_price AS cpi_x_fuel_price,
      (unemployment - mu) / su + (fuel_price - mf) / sf AS stress_index,
      CASE WHEN count(*) OVER v >= 3 THEN covar_pop(weekly_sales, rn) OVER v / var_pop(rn) OVER v ELSE 0 END AS trend_slope
    FROM b, s WINDOW w AS (PARTITION BY store, dept ORDER BY date), v AS (PARTITION BY store, dept), {ROLL_FRAMES}"""
_FEATURE_DOUBLES = (
    "temperature fuel_price cpi unemployment month_sin month_cos week_sin week_cos promo_intensity "
    "unemployment_x_temperature cpi_x_fuel_price stress_index"
)


@query("fe_all_features", _FEATURE_SQL, r4=" ".join([*ROLL_NAMES, "trend_slope"]), r6=_FEATURE_DOUBLES)
def all_features(data: Data) -> DataFrame:
    return features.engineer(data.staged_panel())


#: Columns of the engineered frame that can be empty: those carried forward, and all
#: numeric ones.
CARRIED = [*LAG_NAMES, *ROLL_NAMES]
IMPUTED = [*CARRIED, *DEFAULT.covariates, "unemployment_x_temperature", "cpi_x_fuel_price", "stress_index"]
_LAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_NEXT = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


def _each(columns: list[str], cell: str) -> str:
    return ", ".join(f"{cell.replace('#', c)} AS {c}" for c in columns)


_IMPUTED_SQL = f"""WITH engineered AS ({_FEATURE_SQL}),
    carried AS (SELECT *, row_number() OVER (PARTITION BY store, dept ORDER BY date) AS rn FROM (
      SELECT * REPLACE ({_each(CARRIED, "last_value(# IGNORE NULLS) OVER w")}) FROM engineered
      WINDOW w AS (PARTITION BY store, dept ORDER BY date {_LAST}))),
    ends AS (SELECT *, {", ".join(
        f"last_value({c} IGNORE NULLS) OVER b AS v0_{c}, first_value({c} IGNORE NULLS) OVER a AS v1_{c}, "
        f"last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS p0_{c}, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS p1_{c}" for c in IMPUTED)}
      FROM carried WINDOW b AS (PARTITION BY store, dept ORDER BY date {_LAST}), a AS (PARTITION BY store, dept ORDER BY date {_NEXT})),
    lines AS (SELECT store, dept, date, {_each(IMPUTED, "CASE WHEN # IS NOT NULL THEN # WHEN v1_# IS NULL THEN v0_# ELSE v0_# + (v1_# - v0_#) * (rn - p0_#) / (p1_# - p0_#) END")}
      FROM ends)"""
_IMPUTED_ROUND = {"r4": " ".join([*CARRIED]), "r6": " ".join(IMPUTED[len(CARRIED):])}


@query("c1_impute_features", f"{_IMPUTED_SQL} SELECT store, dept, date, {_each(IMPUTED, 'coalesce(#, 0)')} FROM lines", **_IMPUTED_ROUND)
def impute_features(data: Data) -> DataFrame:
    """The engineered frame with every empty column filled within its series."""
    ready = features.engineer(data.staged_panel())
    return clean.impute(ready, CARRIED, IMPUTED).select(*KEY, *IMPUTED)


@query(
    "c1_impute_features_global",
    f"""{_IMPUTED_SQL} SELECT store, dept, date, {_each(IMPUTED, "coalesce(last_value(# IGNORE NULLS) OVER b, first_value(# IGNORE NULLS) OVER a, 0)")}
    FROM lines WINDOW b AS (ORDER BY store, dept, date {_LAST}), a AS (ORDER BY store, dept, date {_NEXT})""",
    **_IMPUTED_ROUND,
)
def impute_features_global(data: Data) -> DataFrame:
    """The same, the rest filled from neighbouring series in key order."""
    ready = stage(features.engineer(data.staged_panel()), "engineered")
    return clean.impute(ready, CARRIED, IMPUTED, across=True).select(*KEY, *IMPUTED)
