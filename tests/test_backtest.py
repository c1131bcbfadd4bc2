"""Rolling-origin forecasts against fitting anew before every origin."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import backtest, evaluate, forecast
from panelcast.spec import PanelSpec


def refitted(df, folds, horizon, spec=None, aligned=False):
    """(fold, level, keys, step) to the models, one fit per fold."""
    spec = spec or PanelSpec()
    dates = sorted(r[0] for r in df.select(spec.time).distinct().collect())
    out = {}
    for fold in range(1, folds + 1):
        cut = len(dates) - (folds - fold + 1) * horizon
        if cut <= 0:
            continue
        train = df.where(F.col(spec.time) < F.lit(dates[cut]))
        val = df.where((F.col(spec.time) >= F.lit(dates[cut])) & (F.col(spec.time) <= F.lit(dates[min(cut + horizon, len(dates)) - 1])))
        rows = forecast.base_forecasts(train, forecast.horizon_dates(val, horizon, spec), horizon, spec, aligned)
        for r in rows.collect():
            out[(fold, r.level, *[r[k] for k in spec.keys], r.step, r[spec.time])] = [r[m] for m in forecast.MODELS]
    return out


def rolled(df, folds, horizon, spec=None, aligned=False):
    spec = spec or PanelSpec()
    rows = backtest.rolling_forecasts(df, folds, horizon, spec, aligned).collect()
    found = {(r.fold, r.level, *[r[k] for k in spec.keys], r.step, r[spec.time]): [r[m] for m in forecast.MODELS] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("folds, horizon, length, aligned", [(3, 8, 90, False), (5, 3, 30, False), (2, 8, 17, False), (4, 1, 70, True), (3, 20, 65, False)])
def test_equals_fitting_anew(panel, folds, horizon, length, aligned):
    rng = np.random.default_rng(length)
    full = {(s, d): dict(enumerate(rng.normal(50, 9, length))) for s in (1, 2) for d in "ab"}
    full[(1, "c")] = {i: float(i) for i in range(0, length, 7)}
    full[(3, "late")] = {length - 2: 4.0, length - 1: None}
    full[(3, "none")] = {i: None for i in range(length // 2)}
    df = panel(full)
    want, got = refitted(df, folds, horizon, aligned=aligned), rolled(df, folds, horizon, aligned=aligned)
    assert got.keys() == want.keys()
    for key, values in want.items():
        np.testing.assert_allclose(np.array(got[key], float), np.array(values, float), rtol=1e-9, atol=1e-9, err_msg=str(key))


def test_other_keys_and_scores(spark, week):
    spec = PanelSpec(keys=("area", "shop", "item"), time="week", target="y", event="flag", labels=("Area", "Shop", "Item"))
    rng = np.random.default_rng(2)
    rows = [(a, s, i, week(t), float(rng.normal(9, 2)), t % 9 == 0) for a in "xy" for s in (1, 2) for i in "mn" for t in range(60)]
    df = spark.createDataFrame(rows, "area string, shop int, item string, week date, y double, flag boolean")
    want, got = refitted(df, 3, 5, spec), rolled(df, 3, 5, spec)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    scored = backtest.rolling_results(df, 3, 5, spec)
    assert scored.groupBy("fold", "model").count().where("count <> 40").count() == 0
    first = evaluate.accuracy(scored, ["fold", "model"]).where("fold = 2 and model = 'smoothing'").first()
    errors = [(r[4] - want[(2, "Area_Shop_Item", *r[:3], step, r[3])][1]) for step, t in enumerate(range(50, 55), 1) for r in rows if r[3] == week(t)]
    assert first.n == 40 and first.rmse == pytest.approx(float(np.sqrt(np.mean(np.square(errors)))))


def test_no_rows_before_the_origin(panel):
    df = panel({(1, "a"): range(5)})
    assert backtest.rolling_forecasts(df, 2, 8).count() == 0
    assert backtest.rolling_forecasts(df.where("false"), 2, 8).count() == 0


def test_the_panel_is_shuffled_once(panel):
    """Only sums per series and segment meet, however many origins there are."""
    plan = backtest.rolling_statistics(panel({(1, "a"): range(80)}), 12, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Generate") <= 1
