import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import special
from panelcast.operators import insight, stats


@pytest.fixture(scope="module")
def frame(spark):
    def make(**cols):
        names = list(cols)
        rows = [tuple(None if v is None else float(v) for v in r) for r in zip(*cols.values())]
        return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))

    return make


def test_correlation_pairs_and_constants(frame):
    rng = np.random.default_rng(0)
    y, x = rng.normal(size=50), rng.normal(size=50)
    gaps = [None if i % 7 == 0 else v for i, v in enumerate(x)]
    rows = stats.correlations(frame(y=y, x=gaps, flat=[3] * 50), "y", ["x", "flat"]).collect()
    got = {r.feature: r for r in rows}
    keep = [i for i in range(50) if i % 7]
    assert got["x"].n == len(keep) and got["flat"].r is None
    assert got["x"].r == pytest.approx(np.corrcoef(x[keep], y[keep])[0, 1])


def test_student_tail_known_values():
    # Two-sided probabilities from published tables of Student's t.
    got = special.student_two_sided(np.array([2.228, 12.706, 1.96, 0.0, 4.587]), np.array([10, 1, 1e6, 5, 10]))
    np.testing.assert_allclose(got, [0.05, 0.05, 0.05, 1.0, 0.001], rtol=2e-3)


@pytest.mark.parametrize("df", [1, 2, 7, 40, 3000])
def test_student_tail_matches_integration(df):
    for t in (0.1, 1.0, 2.5, 6.0):
        grid = np.linspace(0, t, 200_001)
        const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        inside = np.trapezoid(const * (1 + grid**2 / df) ** (-(df + 1) / 2), grid)
        assert special.student_two_sided(np.array([t]), np.array([df]))[0] == pytest.approx(1 - 2 * inside, abs=1e-8)


def test_significance_of_an_exact_relation(frame):
    x = np.arange(20.0)
    row = stats.with_significance(stats.correlations(frame(y=2 * x, x=x), "y", ["x"])).first()
    assert row.p_value == pytest.approx(0, abs=1e-12) and row.significant


def test_partial_autocorrelation_of_ar1():
    r = 0.7 ** np.arange(6)
    np.testing.assert_allclose(special.partial_autocorrelations(r), [1, 0.7, 0, 0, 0, 0], atol=1e-12)


def test_partial_autocorrelation_matches_regression_system():
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(size=200)) * 0.1 + rng.normal(size=200)
    d = y - y.mean()
    r = np.array([(d[k:] * d[: len(d) - k]).sum() for k in range(9)]) / (d * d).sum()
    got = special.partial_autocorrelations(r)
    for k in range(1, 9):
        system = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got[k] == pytest.approx(np.linalg.solve(system, r[1 : k + 1])[-1])


def test_unit_root_verdicts_and_statistic():
    rng = np.random.default_rng(6)
    noise = rng.normal(size=400)
    walk, still = np.cumsum(noise), noise
    assert special.unit_root_test(walk)["p_value"] > 0.05
    assert special.unit_root_test(still)["p_value"] < 0.01
    assert special.unit_root_test(np.ones(50)) is None and special.unit_root_test(noise[:5]) is None
    result = special.unit_root_test(walk)
    k, dy = result["used_lags"], np.diff(walk)
    x = np.column_stack([walk[k:-1], *[dy[k - j : len(dy) - j] for j in range(1, k + 1)], np.ones(len(dy) - k)])
    beta = np.linalg.solve(x.T @ x, x.T @ dy[k:])
    rest = dy[k:] - x @ beta
    se = np.sqrt(rest @ rest / (len(rest) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])
    assert result["statistic"] == pytest.approx(beta[0] / se, rel=1e-6)
    assert result["crit_5"] == pytest.approx(-2.868, abs=0.01)


def test_unit_root_p_values_meet_critical_values():
    for stat, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert special.unit_root_p(stat) == pytest.approx(p, abs=0.003)


def test_predictive_gain_matches_least_squares(spark, week):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=120), np.zeros(120)
    for t in range(2, 120):
        y[t] = 0.4 * y[t - 1] + 0.9 * x[t - 1] + 0.1 * rng.normal()
    rows = [(1, week(i), float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "store int, date date, y double, x double")
    got = stats.predictive_gain(df, "y", ["x"], ["store"], "date").first()

    def r2(*cols):
        m = np.column_stack([*cols, np.ones(118)])
        rest = y[2:] - m @ np.linalg.lstsq(m, y[2:], rcond=None)[0]
        return 1 - rest @ rest / ((y[2:] - y[2:].mean()) ** 2).sum()

    assert got.r2_without == pytest.approx(r2(y[1:-1], y[:-2]))
    assert got.r2_with == pytest.approx(r2(y[1:-1], y[:-2], x[1:-1], x[:-2]))
    assert got.significant


def test_decomposition_recovers_a_season(panel):
    season = np.sin(2 * np.pi * np.arange(52) / 52)
    season -= season.mean()
    y = np.concatenate([season] * 4) + 0.5 * np.arange(208)
    df = panel({(1, "long"): y, (2, "short"): range(103)})
    out = stats.decompose(df, ["store", "dept"], "date", "weekly_sales").orderBy("date").toPandas()
    assert set(out.dept) == {"long"}
    inner = out.iloc[26:-26]
    np.testing.assert_allclose(inner.trend, 0.5 * np.arange(208)[26:-26], atol=1e-9)
    np.testing.assert_allclose(out.seasonal, np.tile(season, 4), atol=1e-9)
    np.testing.assert_allclose(inner.trend + inner.seasonal + inner.resid, inner.observed)
    assert out.trend.iloc[:26].isna().all()


def test_acf_matches_numpy(panel):
    y = np.random.default_rng(5).normal(size=80)
    out = stats.autocorrelations(panel({(1, "a"): y}), ["store", "dept"], "date", "weekly_sales", 10)
    d = y - y.mean()
    want = [(d[k:] * d[: 80 - k]).sum() / (d @ d) for k in range(11)]
    np.testing.assert_allclose([r.acf for r in out.orderBy("lag").collect()], want)


def test_ridge_matches_closed_form(frame):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 3)) * [1, 5, 20] + [0, 3, -4]
    y = x @ [2.0, -0.5, 0.1] + rng.normal(size=90)
    df = frame(a=x[:, 0], b=x[:, 1], c=x[:, 2], y=y)
    got = {r.feature: r for r in insight.surrogate_ridge(df, "y", ["a", "b", "c"]).collect()}
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    np.testing.assert_allclose([got[f].coefficient for f in "abc"], beta)
    rest = y - y.mean() - z @ beta
    assert got["a"].r2 == pytest.approx(1 - rest @ rest / ((y - y.mean()) ** 2).sum())


def test_findings_respect_subject_and_higher_threshold(spark):
    rows = [("promo_total", "importance", 0.85), ("size", "importance", 0.9), ("m", "mape", 12.0), ("n", "mape", 25.0)]
    metrics = spark.createDataFrame(rows, "subject string, metric string, value double")
    found = insight.findings(metrics, insight.rule_table(spark))
    got = {(r.kind, r.area, r.subject, r.priority) for r in found.collect()}
    assert got == {
        ("recommendation", "Promotional Strategy", "promo_total", "High"),
        ("opportunity", "Controllable Driver", "promo_total", "High"),
        ("opportunity", "Decision Support", "m", "Medium"),
        ("risk", "High Forecast Error", "n", "High"),
    }
    assert insight.with_text(found).where(F.col("text").contains("importance of promo_total is 0.850")).count() == 2


def test_predictive_gain_skips_unknown_rows_and_keeps_digits(spark, week):
    """Lags are the rows before on which both are known; an offset of 1e9 costs nothing."""
    rng = np.random.default_rng(12)
    rows = []
    for s in range(3):
        x, z = rng.normal(0, 1, 90), rng.normal(0, 1, 90)
        y = np.zeros(90)
        for t in range(2, 90):
            y[t] = 0.4 * y[t - 1] + 0.5 * x[t - 1] + rng.normal(0, 0.5)
        rows += [(s, week(t), None if t % 17 == 3 else float(y[t]), None if t % 7 == s else float(x[t]), float(z[t]), 1.0) for t in range(90)]
    df = spark.createDataFrame(rows, "store int, date date, y double, x double, z double, flat double")
    got = {r.feature: r for r in stats.predictive_gain(df, "y", ["x", "z", "flat"], ["store"], "date").collect()}
    for name, at in (("x", 3), ("z", 4)):
        full = []
        for s in range(3):
            own = [(r[2], r[at]) for r in rows if r[0] == s and r[2] is not None and r[at] is not None]
            full += [(own[i][0], own[i - 1][0], own[i - 2][0], own[i - 1][1], own[i - 2][1]) for i in range(2, len(own))]
        table = np.array(full)
        for width, value in ((2, got[name].r2_without), (4, got[name].r2_with)):
            a = np.column_stack([np.ones(len(table)), table[:, 1 : 1 + width]])
            left = table[:, 0] - a @ np.linalg.lstsq(a, table[:, 0], rcond=None)[0]
            assert value == pytest.approx(1 - left.var() / table[:, 0].var(), abs=1e-9)
        assert got[name].n == len(table)
    assert got["x"].significant and not got["z"].significant and got["flat"].gain == pytest.approx(0, abs=1e-12)
    far = df.withColumns({"y": F.col("y") + 1e9, "x": F.col("x") + 1e9})
    moved = stats.predictive_gain(far, "y", ["x"], ["store"], "date").first()
    assert moved.r2_with == pytest.approx(got["x"].r2_with, abs=1e-6)
    plan = stats.predictive_gain(df, "y", ["x", "z", "flat"], ["store"], "date")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("Window ") == 1
