import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import clean, evaluate, forecast, hierarchy, models, rollup
from panelcast.plans import exploration, forecasting, interpretation
from panelcast.spec import PanelSpec


def naive(ts, h, alpha=0.3, window=4, cycle=52):
    """The base models of one dense series, step by step."""
    ts = np.asarray(ts, float)
    level = ts[-window:].mean()
    slope = (level - ts[-2 * window : -window].mean()) / window if len(ts) >= 2 * window else 0
    steps = np.arange(1, h + 1)
    if len(ts) < 2 * window:
        trend = average = np.full(h, max(ts.mean(), 0))
    else:
        average = level + slope * steps
        season = (ts[-cycle:] - ts[-cycle:].mean())[-h:] if len(ts) >= cycle else np.zeros(h)
        trend = average + season
    s = ts[0]
    for v in ts[1:]:
        s = alpha * v + (1 - alpha) * s
    smooth = np.full(h, max(s, 0))
    if len(ts) < 4:
        mixed = np.full(h, max(ts.mean(), 0))
    else:
        mixed = np.maximum(0.5 * trend + 0.3 * smooth + 0.2 * average, 0)
    return {"trend_seasonal": trend, "smoothing": smooth, "moving_average": average, "ensemble": mixed}


@pytest.mark.parametrize("length", [3, 5, 7, 20, 70])
def test_base_models_match_step_by_step(panel, length):
    rng = np.random.default_rng(length)
    series = {(1, "a"): rng.normal(50, 9, length), (1, "b"): rng.normal(-5, 3, length), (2, "a"): rng.normal(9, 1, length)}
    df = panel(series)
    out = forecast.base_forecasts(df, forecast.future_dates(df, 8), 8).toPandas().sort_values("step")
    dense = {("Store_Department", s, d): y for (s, d), y in series.items()}
    dense[("Store", 1, None)] = series[(1, "a")] + series[(1, "b")]
    dense[("Total", None, None)] = sum(series.values())
    for (level, store, dept), y in dense.items():
        got = out[out.level == level]
        got = got if store is None else got[got.store == store]
        got = got if dept is None else got[got.dept == dept]
        for model, want in naive(y, 8).items():
            np.testing.assert_allclose(got[model].to_numpy(float), want, rtol=1e-9, err_msg=f"{level} {model}")


def test_missing_cells_count_as_zero(panel):
    df = panel({(1, "a"): range(1, 31), (1, "b"): {0: 4.0, 28: 6.0}})
    out = forecast.base_forecasts(df, forecast.future_dates(df, 4), 4).where("dept = 'b'").toPandas()
    dense = np.zeros(30)
    dense[0], dense[28] = 4, 6
    np.testing.assert_allclose(out.sort_values("step").smoothing, naive(dense, 4)["smoothing"])


def test_ramp_is_continued_exactly(panel):
    df = panel({(1, "a"): [10 + 2 * t for t in range(40)]})
    out = forecast.base_forecasts(df, forecast.future_dates(df, 3), 3)
    got = forecast.leaves(out).orderBy("step").toPandas().moving_average.tolist()
    level = 10 + 2 * 37.5
    assert got == [level + 2 * i for i in (1, 2, 3)]


def tree_frame(spark, sizes, rng, steps=3):
    """Incoherent forecasts of a tree of depth two."""
    rows, base = [], []
    for step in range(1, steps + 1):
        rows.append(("Total", None, None, step, float(rng.normal(100, 9))))
        for s, n in enumerate(sizes):
            rows.append(("Store", s, None, step, float(rng.normal(30, 9))))
            rows += [("Store_Department", s, f"d{j}", step, float(rng.normal(9, 3))) for j in range(n)]
    base = spark.createDataFrame(rows, "level string, store int, dept string, step int, y double")
    return rows, base


def test_reconciliation_matches_pseudo_inverse(spark):
    sizes = (3, 1, 5, 2)
    rows, df = tree_frame(spark, sizes, np.random.default_rng(3))
    out = hierarchy.reconcile_ols(df, "y").toPandas()
    leaves = [(s, f"d{j}") for s, n in enumerate(sizes) for j in range(n)]
    nodes = [("Total", None, None)] + [("Store", s, None) for s in range(4)] + [("Store_Department", *x) for x in leaves]
    matrix = np.array([[1.0 if (n[1] in (None, s)) and (n[2] in (None, d)) else 0.0 for s, d in leaves] for n in nodes])
    for step in (1, 2, 3):
        y = np.array([next(r[4] for r in rows if r[:4] == (*n, step)) for n in nodes])
        want = matrix @ np.linalg.pinv(matrix.T @ matrix) @ matrix.T @ y
        here = out[out.step == step]
        for n, w in zip(nodes, want):
            m = here[here.level == n[0]]
            m = m if n[1] is None else m[m.store == n[1]]
            m = m if n[2] is None else m[m.dept == n[2]]
            assert m.reconciled.item() == pytest.approx(w, abs=1e-9)


def test_reconciliation_of_a_deeper_tree(spark):
    spec = PanelSpec(keys=("region", "store", "dept"), labels=("Region", "Store", "Department"))
    rng = np.random.default_rng(5)
    leaves = [(0, 0, 0), (0, 0, 1), (0, 1, 2), (1, 2, 3), (1, 3, 4), (1, 3, 5), (1, 3, 6)]
    nodes = [p for d in range(4) for p in sorted({x[:d] for x in leaves})]
    y = {n: float(rng.normal(20, 5)) for n in nodes}
    rows = [(spec.level(len(n)), *n, *[None] * (3 - len(n)), 1, y[n]) for n in nodes]
    df = spark.createDataFrame(rows, "level string, region int, store int, dept int, step int, y double")
    matrix = np.array([[float(x[: len(n)] == n) for x in leaves] for n in nodes])
    want = matrix @ np.linalg.pinv(matrix.T @ matrix) @ matrix.T @ np.array([y[n] for n in nodes])
    got = {
        tuple(k for k in (r.region, r.store, r.dept) if k is not None): r.reconciled
        for r in hierarchy.reconcile_ols(df, "y", spec).collect()
    }
    for n, w in zip(nodes, want):
        assert got[n] == pytest.approx(w, abs=1e-9)


def test_reconciliation_is_coherent_and_idempotent(spark):
    _, df = tree_frame(spark, (4, 2), np.random.default_rng(9))
    once = hierarchy.reconcile_ols(df, "y")
    assert hierarchy.coherence_verdict(hierarchy.coherence(once, "reconciled")).first().coherent
    assert not hierarchy.coherence_verdict(hierarchy.coherence(df, "y")).first().coherent
    twice = hierarchy.reconcile_ols(once, "reconciled", name="again")
    gap = once.join(twice, ["level", "step"]).where(
        once.store.eqNullSafe(twice.store) & once.dept.eqNullSafe(twice.dept)
    )
    assert gap.agg(F.max(F.abs(F.col("reconciled") - F.col("again")))).first()[0] < 1e-9


def test_top_down_keeps_the_total(panel):
    df = panel({(1, "a"): [1] * 9, (1, "b"): [3] * 9, (2, "a"): [4] * 9})
    base = forecast.base_forecasts(df, forecast.future_dates(df, 2), 2)
    out = hierarchy.split_down(base, df, "ensemble").where("step = 1").toPandas()
    assert out[out.level == "Total"].top_down.item() == pytest.approx(8)
    assert out[(out.store == 1) & (out.dept == "b")].top_down.item() == pytest.approx(3)


def test_resample_fills_gaps(panel):
    df = panel({(1, "a"): {0: 5, 3: 7}}).withColumn("t", F.lit(2.0))
    out = rollup.resample_weekly(df, PanelSpec(), ["store"], ["weekly_sales"], ["t"], ["is_holiday"])
    rows = out.orderBy("date").collect()
    assert [r.weekly_sales for r in rows] == [5.0, 0.0, 0.0, 7.0]
    assert all(r.t == 2.0 for r in rows) and all(r.date.isoweekday() == 7 for r in rows)


def result_frame(spark, actual, predicted, weight, week):
    rows = [("m", "Statistical", 1, "a", week(i), i + 1, float(a), float(p), float(w))
            for i, (a, p, w) in enumerate(zip(actual, predicted, weight))]
    return spark.createDataFrame(
        rows, "model string, model_type string, store int, dept string, date date, step int, "
        "actual double, predicted double, weight double")


def test_accuracy_matches_numpy(spark, week):
    rng = np.random.default_rng(4)
    a, w = rng.normal(10, 40, 25), np.where(np.arange(25) % 6 == 0, 5.0, 1.0)
    a[3] = 0.0
    p = a + rng.normal(0, 5, 25)
    got = evaluate.accuracy(result_frame(spark, a, p, w, week)).first()
    e, d = a - p, np.maximum(np.abs(a), 1)
    assert got.rmse == pytest.approx(np.sqrt(np.mean(e**2)))
    assert got.mape == pytest.approx(np.mean(np.abs(e / d)) * 100)
    assert got.weighted_mae == pytest.approx(np.average(np.abs(e), weights=w))
    assert got.r2 == pytest.approx(1 - (e**2).sum() / ((a - a.mean()) ** 2).sum())
    assert got.event_rmse == pytest.approx(np.sqrt(np.mean(e[w > 1] ** 2)))


def test_accuracy_without_events_or_variance(spark, week):
    got = evaluate.accuracy(result_frame(spark, [5] * 6, [4, 6] * 3, [1] * 6, week)).first()
    assert got.event_rmse == 0 and got.event_mape == 0 and got.r2 == 0
    assert got.weighted_rmse == got.rmse and got.weighted_mape == got.mape


def test_error_profile_matches_numpy(spark, week):
    rng = np.random.default_rng(8)
    a = rng.normal(50, 9, 60)
    e = rng.gamma(2, 3, 60)
    got = evaluate.error_profile(result_frame(spark, a, a + e, [1] * 60, week)).first()
    z = (e - e.mean()) / e.std()
    assert got.skewness == pytest.approx(np.mean(z**3)) and got.kurtosis == pytest.approx(np.mean(z**4) - 3)
    assert got.n_large == int((e > np.percentile(e, 95)).sum())
    assert got.lag1_r == pytest.approx(np.corrcoef(e[:-1], e[1:])[0, 1])
    assert got.mae_small == pytest.approx(e[a < np.percentile(a, 33)].mean())


def test_sequences_hold_the_rows_before(panel):
    lengths = {(1, "a"): 9, (1, "b"): 5, (2, "a"): 6}
    df = panel({k: [10 * k[0] + i for i in range(n)] for k, n in lengths.items()})
    out = models.sequences(df, ["weekly_sales"], 5)
    assert out.count() == sum(max(0, n - 5) for n in lengths.values())
    row = out.where("store = 2").first()
    assert [v[0] for v in row.sequence] == [20, 21, 22, 23, 24] and row.label == 25


def test_autoregression_continues_a_repeating_series(panel):
    season = 50 + 10 * np.sin(2 * np.pi * np.arange(52) / 52)
    values = np.concatenate([season + 3 * k for k in range(4)])
    rng = np.random.default_rng(1)
    df = panel({(1, "a"): values + rng.normal(0, 1e-3, len(values)), (2, "a"): 2 * values + rng.normal(0, 1e-3, len(values))})
    weekly = rollup.resample_weekly(df, PanelSpec(), ["store"], ["weekly_sales"], [], ["is_holiday"])
    out = models.differenced_autoregression(weekly, ["store"], [], 8).toPandas()
    assert len(out) == 16
    np.testing.assert_allclose(out.predicted, out.actual, rtol=0.01)


def test_autoregression_says_where_history_is_too_short(panel):
    rng = np.random.default_rng(2)
    df = panel({(s, "a"): 50 + rng.normal(0, 1, 200) for s in (1, 2)})
    weekly = rollup.resample_weekly(df, PanelSpec(), ["store"], ["weekly_sales"], [], ["is_holiday"])
    last = weekly.agg(F.max("date").alias("d")).scalar()
    both = weekly.where((F.col("store") == 1) | (F.datediff(last, "date") < 7 * 60))
    out = models.differenced_autoregression(both, ["store"], [], 8)
    assert out.where("store = 1 AND predicted IS NOT NULL AND reason IS NULL").count() == 8
    assert out.where("store = 2 AND predicted IS NULL AND reason = 'unknown history'").count() == 8


def test_upper_nodes_sum_the_means_of_their_leaves(panel):
    df = panel({(1, "a"): [10.0] * 20, (1, "b"): [4.0] * 20, (2, "a"): [1.0] * 20})
    val = df.select("date").distinct().orderBy(F.desc("date")).limit(2)
    fit = df.join(val, "date", "anti")
    out = forecast.base_forecasts(fit, forecast.horizon_dates(val, 2), 2)
    got = {(r.level, r.store, r.dept): r.historical_mean for r in out.where("step = 1").collect()}
    assert got[("Total", None, None)] == 15 and got[("Store", 1, None)] == 14
    assert got[("Store", 2, None)] == 1 and got[("Store_Department", 1, "b")] == 4


def test_seasonal_regression_keeps_series_without_positive_values(spark, panel, week):
    df = panel({(1, "a"): [-5.0] * 150, (2, "b"): [0.0] * 150, (3, "c"): [7.0] * 150}).withColumn("x", F.lit(1.0))
    calendar = spark.createDataFrame([("Event", week(10))], "holiday string, date date")
    out = models.SeasonalRegression().run(df, calendar, ["x"]).toPandas().sort_values(["store", "date"])
    np.testing.assert_allclose(out.predicted, np.repeat([-5.0, 0.0, 7.0], 8), atol=1e-6)


def test_node_results_count_missing_cells_as_zero(spark):
    head = "level string, store int, dept string, date string, step int, f double"
    f = spark.createDataFrame([("Total", None, None, "d1", 1, 3.0), ("Store", 1, None, "d1", 1, 2.0)], head)
    a = spark.createDataFrame([("Total", None, None, "d1", 5.0)], "level string, store int, dept string, date string, y double")
    w = spark.createDataFrame([("d1", 5.0)], "date string, weight double")
    rows = hierarchy.node_results(f, a, w, "f").collect()
    assert {(r.level, r.actual, r.predicted) for r in rows} == {("Total", 5.0, 3.0), ("Store", 0.0, 2.0)}


def test_seasonal_regression_recovers_a_multiplicative_season(spark, panel, week):
    days = np.array([week(i).toordinal() for i in range(220)])
    wave = np.exp(0.3 * np.sin(2 * np.pi * days / 365.25))
    df = panel({(1, "a"): 100 * wave, (2, "b"): 5 * wave}).withColumn("x", F.lit(1.0))
    calendar = spark.createDataFrame([("Event", week(10))], "holiday string, date date")
    out = models.SeasonalRegression().run(df, calendar, ["x"]).toPandas()
    assert len(out) == 16 and (out.lower <= out.predicted).all() and (out.predicted <= out.upper).all()
    np.testing.assert_allclose(out.predicted, out.actual, rtol=0.05)


def test_forest_learns_a_step(spark):
    df = spark.range(400).select(
        F.col("id").cast("double").alias("x"),
        F.when(F.col("id") < 200, 1.0).otherwise(9.0).alias("y"),
        F.lit(1.0).alias("event_weight"),
    )
    model = models.fit_forest(df, ["x"], "y", trees=5, depth=3, keys=["x"])
    out = model.transform(models.assemble(df, ["x"]))
    assert out.agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 3
    assert models.forest_importances(model, ["x"], spark).first().importance == pytest.approx(1.0)


def test_plans_run_end_to_end(spark):
    from panelcast.sources import panel as P

    folder = "/root/testdata/sf0.001"
    merged = P.panel(spark, folder)
    run = forecasting.run(merged.select("store", "dept", "date", "weekly_sales", "is_holiday"))
    assert hierarchy.coherence_verdict(run.coherence).first().coherent
    assert run.ranking.where("metric = 'weighted_rmse'").count() == 6
    tables = interpretation.run(merged, run.results)
    report = tables["report"].first()
    assert report.features_analyzed == 7 and len(report.top_drivers) == 5
    assert tables["findings"].count() > 0
    profile = exploration.run(merged)
    assert profile["events"].first().event_rows > 0
    assert profile["strengths"].count() == 1


def test_split_uses_all_dates(panel):
    df = panel({(1, "a"): range(30)})
    fit, val = clean.time_split(df, 8)
    steps = forecast.horizon_dates(val, 8).orderBy("step").collect()
    assert [s.step for s in steps] == list(range(1, 9)) and fit.count() == 22
