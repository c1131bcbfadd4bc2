import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.functions import scalars as S
from panelcast.operators import carry, clean, features
from panelcast.spec import PanelSpec

KEY = ["store", "dept", "date"]


def table(df, *cols):
    return df.orderBy(*KEY).select(*cols).toPandas()


def test_spec_rejects_missing_and_mistyped_roles(panel):
    df = panel({(1, "a"): [1, 2]})
    assert PanelSpec().validate(df) is df
    with pytest.raises(ValueError):
        PanelSpec().validate(df.drop("dept"))
    with pytest.raises(TypeError):
        PanelSpec().validate(df.withColumn("date", F.col("date").cast("string")))


def test_feature_columns_skip_ids_target_and_scaled(panel):
    df = panel({(1, "a"): [1]}).withColumns({"x": F.lit(1.0), "x_scaled": F.lit(0.0), "note": F.lit("n")})
    assert PanelSpec().feature_columns(df, numeric_only=True) == ["is_holiday", "x"]
    assert "note" in PanelSpec().feature_columns(df)


def test_lags_count_rows_or_calendar_steps(panel):
    df = panel({(1, "a"): {0: 1, 1: 2, 3: 4}, (2, "a"): {0: 10, 1: 20}})
    rows = table(features.add_lags(df, (1,)), "weekly_sales_lag_1")["weekly_sales_lag_1"].tolist()
    assert [None if pd.isna(v) else v for v in rows] == [None, 1.0, 2.0, None, 10.0]
    steps = table(features.add_lags(df, (1,), calendar=True), "weekly_sales_lag_1")
    assert [None if pd.isna(v) else v for v in steps["weekly_sales_lag_1"]] == [None, 1.0, None, None, 10.0]


@pytest.mark.parametrize("exclude", [False, True])
def test_rolling_matches_pandas(panel, exclude):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=30), rng.normal(size=9)
    out = table(
        features.add_rolling(panel({(1, "a"): a, (2, "b"): b}), (4, 12), exclude_current=exclude),
        "store", "weekly_sales_mean_4", "weekly_sales_std_12", "weekly_sales_max_4", "weekly_sales_min_12",
    )
    for store, y in ((1, a), (2, b)):
        s = pd.Series(y).shift(1) if exclude else pd.Series(y)
        got = out[out.store == store]
        for col, want in (
            ("weekly_sales_mean_4", s.rolling(4).mean()),
            ("weekly_sales_std_12", s.rolling(12).std()),
            ("weekly_sales_max_4", s.rolling(4).max()),
            ("weekly_sales_min_12", s.rolling(12).min()),
        ):
            np.testing.assert_allclose(got[col].to_numpy(float), want.to_numpy(), rtol=1e-10)


def test_event_neighbours_are_zero_at_the_ends(panel):
    out = table(
        features.add_event_neighbours(panel({(1, "a"): [1, 1, 1, 1]}, flags={1})), "pre_event", "post_event"
    )
    assert out.pre_event.tolist() == [1, 0, 0, 0]
    assert out.post_event.tolist() == [0, 0, 1, 0]


def test_calendar_at_year_end(spark):
    df = spark.sql("SELECT explode(array(date'2015-12-25', date'2016-01-01', date'2016-01-08')) AS date")
    out = features.add_cyclic(features.add_calendar(df)).orderBy("date").toPandas()
    assert out.week.tolist() == [52, 53, 1]
    assert out.week_sin[1] == pytest.approx(math.sin(2 * math.pi * 53 / 52))


def test_promos_null_and_negative(spark):
    spec = PanelSpec(promos=("m1", "m2"))
    df = spark.createDataFrame([(1.0, None, 9), (-2.0, 3.0, 9)], "m1 double, m2 double, size int")
    out = features.add_promos(df, spec).toPandas()
    assert out.promo_total.tolist() == [1.0, 1.0]
    assert out.m1_active.tolist() == [1, 0] and out.m2_active.tolist() == [0, 1]
    assert out.promo_intensity.tolist() == [0.1, 0.1]


def test_trend_slopes(panel):
    df = panel({(1, "ramp"): [10 + 2 * t for t in range(60)], (1, "two"): [5, 9], (2, "flat"): [3] * 5})
    got = {r.dept: r.trend_slope for r in features.trend_slopes(df).collect()}
    assert got["ramp"] == pytest.approx(2) and got["two"] == 0 and got["flat"] == 0
    rows = features.add_trend(df).groupBy("dept").agg(F.avg("trend_slope").alias("s")).collect()
    assert {r.dept: pytest.approx(r.s) for r in rows} == got


def test_group_means_fit_on_leaves_validation_out(panel):
    df = panel({(1, "a"): [1, 1, 1, 100], (2, "a"): [5, 5, 5, 5]})
    fit, _ = clean.time_split(df, 1)
    out = features.add_group_means(df, PanelSpec(type=None), fit_on=fit)
    assert {(r.store, r.series_mean, r.dept_mean) for r in out.collect()} == {(1, 1.0, 3.0), (2, 5.0, 3.0)}


def test_interpolation_matches_pandas(panel):
    series = {
        (1, "none"): [None] * 4,
        (2, "lead"): [None, None, 3, None, 7, None],
        (3, "trail"): [1, None, None, 4, None, None],
    }
    out = table(clean.interpolate(panel(series), ["weekly_sales"]), "store", "weekly_sales")
    for (store, _), values in series.items():
        want = pd.Series(values, dtype=float).interpolate(method="linear").to_numpy()
        np.testing.assert_allclose(out[out.store == store].weekly_sales.to_numpy(float), want)


@pytest.mark.parametrize("first_null", [True, False])
def test_global_fill_matches_pandas(panel, first_null):
    series = {
        (1, "a"): [None] * 3 if first_null else [None, 2, None],
        (1, "b"): [None, 5, None],
        (2, "a"): [None, None, None],
        (2, "b"): [None, None, 8],
        (3, "a"): [None, None],
    }
    out = table(carry.fill_across(panel(series), ["weekly_sales"]), "weekly_sales")
    flat = pd.Series([v for s in series.values() for v in s], dtype=float)
    np.testing.assert_allclose(out.weekly_sales.to_numpy(float), flat.ffill().bfill().fillna(0).to_numpy())


def test_global_fill_of_nothing_known_is_zero(panel):
    out = carry.fill_across(panel({(1, "a"): [None, None]}), ["weekly_sales"])
    assert [r.weekly_sales for r in out.collect()] == [0.0, 0.0]


def test_difference_across_series(panel):
    df = panel({(1, "a"): [1, 4], (2, "a"): [10, 11]})
    got = table(carry.difference_across(df, "weekly_sales"), "change").change.tolist()
    assert math.isnan(got[0]) and got[1:] == [3.0, 6.0, 1.0]


@pytest.mark.parametrize("across", [True, False])
def test_imputation_leaves_no_nulls(panel, across):
    df = panel({(1, "a"): [None, None], (2, "a"): [1, None, 3, None]}).withColumn("markdown1", F.lit(None).cast("double"))
    df = features.add_lags(df, (1,))
    out = clean.impute(df, ["weekly_sales_lag_1"], ["weekly_sales"], across)
    cols = ["markdown1", "weekly_sales", "weekly_sales_lag_1"]
    assert out.where(" or ".join(f"{c} is null" for c in cols)).count() == 0


def test_scaling_is_population_and_reversible(panel):
    df = panel({(1, "a"): [1, 2, 3, 10]}).withColumn("flat", F.lit(7.0))
    out = clean.scale(df, ["weekly_sales", "flat"])
    row = out.agg(F.avg("weekly_sales_scaled"), F.stddev_pop("weekly_sales_scaled"), F.max("flat_scaled")).first()
    assert row[0] == pytest.approx(0, abs=1e-12) and row[1] == pytest.approx(1) and row[2] == 0
    back = clean.unscale(out.drop("weekly_sales"), ["weekly_sales"], df).orderBy("date").toPandas()
    np.testing.assert_allclose(back.weekly_sales, [1, 2, 3, 10])


def test_split_dates_are_disjoint(panel):
    fit, val = clean.time_split(panel({(1, "a"): range(20), (2, "b"): range(5)}), 8)
    assert val.select("date").distinct().count() == 8
    assert fit.agg(F.max("date")).first()[0] < val.agg(F.min("date")).first()[0]


def test_folds_grow_and_do_not_overlap(panel):
    folds = clean.walk_forward_folds(panel({(1, "a"): range(40)}), 3, 8).orderBy("fold").collect()
    assert [f.fold for f in folds] == [1, 2, 3]
    assert all(a.val_end < b.val_start for a, b in zip(folds, folds[1:]))
    assert all(f.train_end < f.val_start for f in folds)


def test_casts_and_keys(spark):
    df = spark.createDataFrame([("True", "1.5"), ("false", "x"), ("maybe", None)], "flag string, num string")
    out = df.select(S.flag_to_number(F.col("flag")).alias("f"), S.to_number(F.col("num")).alias("n")).collect()
    assert [(r.f, r.n) for r in out] == [(1.0, 1.5), (0.0, None), (None, None)]
    key = spark.createDataFrame([("Store_7",), ("Store_7_Dept_STANDARD",), ("Total",)], "k string")
    parsed = key.select(*[c.alias(n) for c, n in zip(S.parse_key(F.col("k")), ("s", "d"))]).collect()
    assert [(r.s, r.d) for r in parsed] == [("7", None), ("7", "STANDARD"), (None, None)]


def test_event_calendar_covers_the_years_of_the_data(spark):
    import datetime as dt

    from panelcast.sources.panel import event_calendar

    days = spark.createDataFrame([(dt.date(2004, 11, 19),), (dt.date(2013, 2, 8),)], "date date")
    named = {(r.holiday, r.date) for r in event_calendar(days).collect()}
    assert {d for _, d in named} >= {dt.date(2004, 11, 19), dt.date(2013, 2, 8)}
    assert event_calendar(days.limit(0)).count() == 0
