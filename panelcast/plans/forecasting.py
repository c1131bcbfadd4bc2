"""Forecast plan: split, base forecasts, reconciliation, scoring, ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import clean, evaluate, forecast, grid, hierarchy
from panelcast.session import stage
from panelcast.spec import DEFAULT, PanelSpec


@dataclass(frozen=True)
class ForecastRun:
    """Lazy tables of one run. ``forecasts`` holds every node and step with the
    base models and the reconciled ensemble; ``results`` the scored leaves."""

    forecasts: DataFrame
    predictions: DataFrame
    results: DataFrame
    accuracy: DataFrame
    ranking: DataFrame
    coherence: DataFrame


def run(fact: DataFrame, horizon: int = 8, spec: PanelSpec = DEFAULT) -> ForecastRun:
    """Forecast the last ``horizon`` dates from the dates before them.

    The fact table is read once from its source; its cells, the base forecasts
    and the reconciled forecasts are each written once.
    """
    fact = stage(spec.validate(fact), "fact")
    fit, val = clean.time_split(fact, horizon, spec)
    dates = forecast.horizon_dates(val, horizon, spec)
    base = stage(forecast.base_forecasts(fit, dates, horizon, spec), "base")
    fixed = stage(hierarchy.reconcile_ols(base, "ensemble", spec), "reconciled")
    on = ["level", *spec.keys, "step"]
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = base.alias("a").join(fixed.alias("b"), cond).select("a.*", "b.reconciled")
    results = stage(forecast.forecast_results(joined, val, spec), "results")
    accuracy = evaluate.accuracy(results)
    metrics = evaluate.to_metrics(accuracy.drop("model_type"))
    return ForecastRun(
        forecasts=joined,
        predictions=hierarchy.prediction_table(fixed, dates, "reconciled", spec),
        results=results,
        accuracy=accuracy,
        ranking=evaluate.rank_models(metrics, ["weighted_rmse", "event_rmse", "mape", "r2"]),
        coherence=hierarchy.coherence(fixed, "reconciled", spec),
    )


def score_future(fact: DataFrame, horizon: int = 8, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Reconciled forecasts of the dates after the panel's last one."""
    fact = stage(spec.validate(fact), "fact")
    dates = forecast.future_dates(fact, horizon, spec)
    base = stage(forecast.base_forecasts(fact, dates, horizon, spec), "base")
    fixed = hierarchy.reconcile_ols(base, "ensemble", spec)
    return hierarchy.prediction_table(fixed, dates, "reconciled", spec)


def score_given(fact: DataFrame, given: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Reconciled forecasts of a given grid of series and future dates, with the
    level each forecast comes from. Series without history are in it too."""
    fact = stage(spec.validate(fact), "fact")
    rows, horizon = grid.placed_steps(given, fact, spec)
    dates = forecast.future_dates(fact, max(1, horizon), spec)
    base = stage(forecast.base_forecasts(fact, dates, max(1, horizon), spec), "base")
    fixed = stage(hierarchy.reconcile_ols(base, "ensemble", spec), "reconciled")
    return grid.score_grid(rows, fixed, "reconciled", spec)
