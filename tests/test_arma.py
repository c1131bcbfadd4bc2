"""The seasonal model with moving averages, on simulated panels and step by step."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import arma

PERIOD = 52


def simulated(terms, series=30, length=420, period=PERIOD, seed=1, beta=0.0, constant=0.0):
    """Levels whose twofold difference is a seasonal ARMA around a regression."""
    rng = np.random.default_rng(seed)
    a, sa, m, sm = terms
    lead = 6 * period
    e = rng.normal(0, 1, (lead + length, series))
    u, x = np.zeros_like(e), rng.normal(0, 1, e.shape)
    for t in range(period + 1, len(e)):
        u[t] = a * u[t - 1] + sa * u[t - period] - a * sa * u[t - period - 1] + e[t] + m * e[t - 1] + sm * e[t - period] + m * sm * e[t - period - 1]
    z, x = (u + constant + beta * x)[lead:], x[lead:]
    size = rng.uniform(1, 100, series)
    y, price = np.zeros_like(z), np.zeros_like(z)
    for t in range(len(z)):
        back = lambda g, k: g[t - k] if t >= k else 0.0  # noqa: B023, E731
        y[t] = z[t] * size + back(y, 1) + back(y, period) - back(y, period + 1)
        price[t] = x[t] + back(price, 1) + back(price, period) - back(price, period + 1)
    return y, price, float(np.sqrt((z[period + 1 :] ** 2).mean()))


def frame(spark, week, y, price):
    rows = [(s, week(t), float(y[t, s]), float(price[t, s])) for s in range(y.shape[1]) for t in range(len(y)) if not np.isnan(y[t, s])]
    return spark.createDataFrame(rows, "store int, date date, weekly_sales double, price double")


def plain_squares(v, z, x, period):
    """Conditional sum of squares of one series, row by row."""
    a, sa, m, sm, c, b = v
    u = [0.0 if t < period + 1 else z[t] - c - b * x[t] for t in range(len(z))]
    e = [0.0] * len(z)
    for t in range(2 * period + 2, len(z)):
        e[t] = u[t] - a * u[t - 1] - sa * u[t - period] + a * sa * u[t - period - 1] - m * e[t - 1] - sm * e[t - period] - m * sm * e[t - period - 1]
    return e


def test_coefficients_of_a_simulated_panel_are_found(spark, week):
    terms = (0.6, 0.3, 0.3, 0.5)
    y, price, deviation = simulated(terms, beta=0.8)
    model, out = arma.seasonal_arma(frame(spark, week, y, price), ["store"], ["price"])
    for name, want in zip(arma.TERMS, terms):
        assert model.terms[name] == pytest.approx(want, abs=0.05), name
    # The covariate has a deviation near 1, the series are scaled by their own.
    assert model.covariates["price"] == pytest.approx(0.8 / deviation, abs=0.03)
    assert out.count() == 30 * 8 and out.where("predicted is null").count() == 0


def test_residuals_and_slopes_match_a_plain_loop():
    rng = np.random.default_rng(4)
    period, v = 4, np.array([0.4, -0.3, 0.5, 0.2, 0.1, -0.7])
    z, x = rng.normal(0, 1, (40, 3)), rng.normal(0, 1, (40, 3, 1))
    model = arma.Arma({}, 0.0, {"x": 0.0}, period).replaced(v)
    n = np.array([40, 33, 40])
    _, e, slope = arma.residuals(model, z, x, period + 1, n)
    for i in range(3):
        want = plain_squares(v, z[: n[i], i], x[: n[i], i, 0], period)
        np.testing.assert_allclose(e[: n[i], i], want, atol=1e-12)
        assert not e[n[i] :, i].any()
        for p in range(6):
            near = [plain_squares(v + s * 1e-6 * np.eye(6)[p], z[: n[i], i], x[: n[i], i, 0], period) for s in (1, -1)]
            np.testing.assert_allclose(slope[: n[i], i, p], (np.array(near[0]) - near[1]) / 2e-6, atol=1e-6)


def test_forecasts_match_a_plain_loop(spark, week):
    period = 6
    y, price, _ = simulated((0.5, 0.3, -0.4, 0.5), series=4, length=70, period=period, seed=3, beta=0.5)
    model, out = arma.seasonal_arma(frame(spark, week, y, price), ["store"], ["price"], 5, period)
    got = {(r.store, r.date): r for r in out.collect()}
    dx = price[period + 1 :] - price[period:-1] - price[1:-period] + price[: -period - 1]
    scale = np.sqrt((dx[:-5] ** 2).mean())
    for s in range(4):
        full = y[period + 1 :, s] - y[period:-1, s] - y[1:-period, s] + y[: -period - 1, s]
        size = np.sqrt((full[:-5] ** 2).mean())
        z = np.concatenate([np.zeros(period + 1), full / size])
        x = np.concatenate([np.zeros(period + 1), dx[:, s] / scale])
        v, n = model.vector(), len(z) - 5
        e = plain_squares(v, z[:n], x[:n], period) + [0.0] * 5
        u = [0.0 if t < period + 1 else z[t] - v[4] - v[5] * x[t] for t in range(n)]
        level = list(y[:n, s])
        for t in range(n, n + 5):
            a, sa, m, sm = v[:4]
            u.append(a * u[t - 1] + sa * u[t - period] - a * sa * u[t - period - 1] + m * e[t - 1] + sm * e[t - period] + m * sm * e[t - period - 1])
            level.append(size * (u[t] + v[4] + v[5] * x[t]) + level[t - 1] + level[t - period] - level[t - period - 1])
            r = got[(s, week(t))]
            assert r.predicted == pytest.approx(level[t], rel=1e-8, abs=1e-6) and r.actual == pytest.approx(y[t, s])


def test_refinement_lowers_the_squares_and_ends_at_slope_zero(spark, week):
    period = 6
    y, price, _ = simulated((0.4, 0.2, 0.3, -0.5), series=10, length=120, period=period, seed=5)
    rows = arma.twice_differenced(frame(spark, week, y, price), ["store"], (), 5, period).cache()
    start, table = arma.hannan_rissanen(rows, ["store"], period)
    assert {r.stage for r in table.collect()} == {"long autoregression", "with residuals"}
    series = arma.packed(rows, ["store"], period).cache()
    model = arma.refined(series, start)
    _, slope, least, n = arma._sums(series, model)
    assert least <= arma._sums(series, start)[2] and np.abs(slope).max() < 1e-3 * n
    assert n == 10 * (115 - 3 * period - 2) and model.variance == pytest.approx(least / n)


def test_short_series_gaps_and_empty_tables(spark, week):
    period = 6
    y, price, _ = simulated((0.4, 0.2, 0.3, -0.5), series=4, length=80, period=period, seed=7)
    y[:62, 1] = np.nan
    df = frame(spark, week, y, price)
    df = df.withColumn("weekly_sales", F.when(~((F.col("store") == 2) & (F.col("date") == F.lit(week(30)))), F.col("weekly_sales")))
    df = df.withColumn("price", F.when(F.col("date") < F.lit(week(78)), F.col("price")))
    model, out = arma.seasonal_arma(df, ["store"], ["price"], 5, period)
    rows = out.collect()
    assert {(r.store, r.reason is None, r.predicted is None) for r in rows} == {(0, True, False), (1, False, True), (2, False, True), (3, True, False)}
    assert len(rows) == 20 and model.rows == 2 * (75 - 3 * period - 2)
    assert arma.coefficients(model, spark).count() == 7
    model, out = arma.seasonal_arma(df.where("false"), ["store"], ["price"], 5, period)
    assert out.count() == 0 and model.rows == 0
    assert arma.coefficients(model, spark).where("term <> 'residual_variance' and value <> 0").count() == 0


def test_columns_that_others_determine_are_harmless(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 0.0, 3.0 * i + 1) for i in range(9)] + [(None, 1.0, 0.0, 5.0)], "a double, b double, c double, y double")
    products, n = arma.normal_equations(df, ["a", "b", "c", "y"])
    found = arma.solved(products)
    assert n == 9 and found[0] == pytest.approx(1) and found[1] + 2 * found[2] == pytest.approx(3)
