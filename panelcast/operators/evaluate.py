"""Forecast evaluation on the long result table.

``results`` has ``model, model_type, <series keys>, date, step, actual,
predicted, weight``. Models share no group with each other, and each model's sums
are combined on the map side before the few result rows meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.functions import scalars as S
from panelcast.functions import special
from panelcast.functions import windows as WF
from panelcast.operators.quantiles import quantile_columns
from panelcast.operators.stats import pearson
from panelcast.spec import DEFAULT, PanelSpec

DESCENDING = ("r2", "directional_accuracy")


def error() -> Column:
    return F.col("actual") - F.col("predicted")


def share_of_actual(c: Column) -> Column:
    """Relative to the actual value's size, at least 1."""
    return c / F.greatest(F.abs("actual"), F.lit(1.0))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def accuracy(results: DataFrame, by: Sequence[str] = ("model", "model_type")) -> DataFrame:
    """RMSE, MAE, MAPE, R² and their event-weighted forms, with separate errors
    of event (weight above 1) and regular rows; 0 where there are none."""
    e, w, y = error(), F.col("weight"), F.col("actual")
    ape = F.abs(share_of_actual(e))
    event, regular = w > 1, w == 1
    # var_pop keeps its digits where sum(y*y) - n*mean² would lose them.
    unexplained = S.ratio(F.avg(e * e), F.var_pop(y))
    return results.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (100 * F.avg(ape)).alias("mape"),
        _or_zero(1 - unexplained).alias("r2"),
        F.sqrt(S.ratio(F.sum(w * e * e), F.sum(w))).alias("weighted_rmse"),
        S.ratio(F.sum(w * F.abs(e)), F.sum(w)).alias("weighted_mae"),
        (100 * S.ratio(F.sum(w * ape), F.sum(w))).alias("weighted_mape"),
        _or_zero(F.sqrt(F.avg(F.when(event, e * e)))).alias("event_rmse"),
        _or_zero(100 * F.avg(F.when(event, ape))).alias("event_mape"),
        _or_zero(F.sqrt(F.avg(F.when(regular, e * e)))).alias("regular_rmse"),
        _or_zero(100 * F.avg(F.when(regular, ape))).alias("regular_mape"),
    )


def accuracy_smoothed(results: DataFrame) -> DataFrame:
    """The second metric family: MSE and weighted errors, with a tiny constant
    added to denominators instead of a floor of 1."""
    e, w, y, tiny = error(), F.col("weight"), F.col("actual"), F.lit(1e-8)
    n = F.count("*")
    return results.groupBy("model").agg(
        F.avg(e * e).alias("mse"),
        S.ratio(F.sum(w * F.abs(e)), F.sum(w)).alias("wmae"),
        S.ratio(F.sum(w * e * e), F.sum(w)).alias("wmse"),
        F.sqrt(S.ratio(F.sum(w * e * e), F.sum(w))).alias("wrmse"),
        (100 * F.avg(F.abs(S.ratio(e, y + tiny)))).alias("mape_smoothed"),
        (1 - F.sum(e * e) / (n * F.var_pop(y) + tiny)).alias("r2_smoothed"),
    )


def directional_accuracy(results: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Percent of steps on which forecast and actual value move the same way."""
    w = W.partitionBy("model", *spec.keys).orderBy(spec.time)
    moved = results.select(
        "model",
        WF.difference(F.col("actual"), w).alias("a"),
        WF.difference(F.col("predicted"), w).alias("p"),
    ).where("a is not null")
    same = ((F.col("a") > 0) == (F.col("p") > 0)).cast("double")
    return moved.groupBy("model").agg((100 * F.avg(same)).alias("directional_accuracy"))


def roll_results(results: DataFrame, by: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Results of a coarser grain: sums by model, the keys kept and date, so that
    models are compared at one grain."""
    return results.groupBy("model", "model_type", *by, spec.time, "step").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.max("weight").alias("weight")
    )


def sensitivity(results: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Volatility, outlier share, trend gap and spread of percentage errors of
    result series at total grain (``roll_results`` with no keys)."""
    e, position = error(), F.col("step").cast("double")
    base = results.groupBy("model").agg(
        F.stddev_pop("predicted").alias("volatility"),
        F.stddev_pop("actual").alias("_actual"),
        F.regr_slope(F.col("actual"), position).alias("_a"),
        F.regr_slope(F.col("predicted"), position).alias("_p"),
        F.stddev_pop(F.abs(share_of_actual(e)) * 100).alias("mape_volatility"),
        F.count("*").alias("_n"),
    )
    out = base.join(_outliers(results), "model")
    gap = 100 * S.ratio(F.abs(F.col("_a") - F.col("_p")), F.abs("_a"))
    return out.select(
        "model",
        "volatility",
        _or_zero(S.ratio(F.col("volatility"), F.col("_actual"))).alias("volatility_ratio"),
        "outlier_pct",
        _or_zero(gap).alias("trend_gap_pct"),
        "mape_volatility",
    )


def _outliers(results: DataFrame) -> DataFrame:
    """Percent of errors beyond the 1.5 IQR fences, per model."""
    rows = results.select("model", error().alias("e"))
    q = quantile_columns(rows, "e", {"q25": 0.25, "q75": 0.75}, ["model"])
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    marked = rows.join(F.broadcast(q), "model")  # one row per model
    out = (F.col("e") < F.col("q25") - reach) | (F.col("e") > F.col("q75") + reach)
    return marked.groupBy("model").agg((100 * F.avg(out.cast("double"))).alias("outlier_pct"))


def horizon_errors(results: DataFrame) -> DataFrame:
    """MAPE by model over steps 1-4, 5-8 and 9-12."""
    ape, step = F.abs(share_of_actual(error())), F.col("step")
    spans = {"short_mape": (1, 4), "medium_mape": (5, 8), "long_mape": (9, 12)}
    return results.groupBy("model").agg(
        *[(100 * F.avg(F.when(step.between(a, b), ape))).alias(n) for n, (a, b) in spans.items()]
    )


def to_metrics(table: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Wide metric table to ``(model, metric, value)``."""
    values = [f.name for f in table.schema.fields if f.dataType.typeName() == "double"]
    return table.unpivot(list(keys), values, "metric", "value")


def rank_models(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rank of each model per metric, best first; ties by name."""
    signed = F.when(F.col("metric").isin(*DESCENDING), -F.col("value")).otherwise(F.col("value"))
    order = W.partitionBy("metric").orderBy(signed, "model")
    known = metrics.where(F.col("metric").isin(*names) & F.col("value").isNotNull())
    return known.select("metric", "model", "value", F.rank().over(order).alias("rank"))


def event_ranking(table: DataFrame) -> DataFrame:
    """Models by their error on events, those without events left out."""
    known = table.where(F.col("event_rmse") > 0)
    order = W.partitionBy(F.lit(1)).orderBy("event_rmse", "model")
    return known.select("model", "event_rmse", F.row_number().over(order).alias("rank"))


def type_means(table: DataFrame) -> DataFrame:
    return table.groupBy("model_type").agg(F.avg("weighted_rmse").alias("mean_weighted_rmse"))


def summary_picks(table: DataFrame) -> DataFrame:
    """Best models by error and by fit, and the means of the model types."""
    best = F.min("weighted_rmse")
    return table.agg(
        F.min_by("model", F.struct("weighted_rmse", "model")).alias("best_weighted_rmse"),
        F.max_by("model", F.struct("r2", "model")).alias("best_r2"),
        F.avg(F.when(F.col("model_type") == "Statistical", F.col("weighted_rmse"))).alias("statistical_mean"),
        F.avg(F.when(F.col("model_type") == "Ensemble", F.col("weighted_rmse"))).alias("ensemble_mean"),
        S.ratio(F.lit(1e5), best).alias("accuracy_score"),
    )


def residual_t_tests(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Two-sample t tests (pooled variance) of the residuals of each model pair,
    from one aggregate row."""
    sums = []
    for i, m in enumerate(models):
        e = F.when(F.col("model") == m, error())
        sums += [F.avg(e).alias(f"m{i}"), F.var_samp(e).alias(f"v{i}"), F.count(e).alias(f"n{i}")]
    one = results.agg(*sums)

    def pair(i: int, j: int) -> Column:
        na, nb = F.col(f"n{i}"), F.col(f"n{j}")
        df = na + nb - 2
        pooled = S.ratio((na - 1) * F.col(f"v{i}") + (nb - 1) * F.col(f"v{j}"), df)
        spread = F.sqrt(pooled * (S.ratio(F.lit(1), na) + S.ratio(F.lit(1), nb)))
        t = S.ratio(F.col(f"m{i}") - F.col(f"m{j}"), spread)
        names = [F.lit(models[i]).alias("model_a"), F.lit(models[j]).alias("model_b")]
        return F.struct(*names, t.alias("t"), df.alias("df"))

    pairs = [pair(i, j) for i in range(len(models)) for j in range(i + 1, len(models))]
    out = one.select(F.inline(F.array(*pairs)))
    return out.withColumn("p_value", special.t_p_value(F.col("t"), F.col("df")))


QUANTILES = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}


def prediction_profile(results: DataFrame) -> DataFrame:
    """Moments of predictions and actual values, bias, and quantile gaps."""
    def moments(c: str, name: str) -> list[Column]:
        return [
            F.avg(c).alias(f"{name}_mean"),
            F.stddev_pop(c).alias(f"{name}_std"),
            F.min(c).alias(f"{name}_min"),
            F.max(c).alias(f"{name}_max"),
            (F.max(c) - F.min(c)).alias(f"{name}_range"),
            (F.stddev_pop(c) / (F.avg(c) + 1e-8)).alias(f"{name}_cv"),
        ]

    diff = F.col("predicted") - F.col("actual")
    base = results.groupBy("model").agg(
        *moments("predicted", "predicted"),
        *moments("actual", "actual"),
        F.avg(diff).alias("bias"),
        F.var_pop(diff).alias("error_variance"),
        S.percent(F.avg(diff), F.avg("actual")).alias("bias_pct"),
    )
    both = results.unpivot(["model"], ["predicted", "actual"], "side", "v")
    q = quantile_columns(both, "v", QUANTILES, ["model", "side"])
    sides = []
    for n in QUANTILES:
        p = F.max(F.when(F.col("side") == "predicted", F.col(n)))
        a = F.max(F.when(F.col("side") == "actual", F.col(n)))
        sides += [(p - a).alias(f"{n}_gap"), S.percent(p - a, a).alias(f"{n}_gap_pct")]
    return base.join(q.groupBy("model").agg(*sides), "model")


def error_profile(results: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Shape of the errors, their largest five percent, autocorrelation within
    series, and mean error by thirds of the actual value."""
    rows = results.select(
        "model", *spec.keys, spec.time, "actual", (F.col("predicted") - F.col("actual")).alias("e")
    ).withColumn("ae", F.abs("e"))
    sides = rows.unpivot(["model"], ["ae", "actual"], "side", "v")
    q = quantile_columns(sides, "v", {"p33": 0.33, "p67": 0.67, "p95": 0.95}, ["model", "side"])
    cells = [
        F.max(F.when(F.col("side") == side, F.col(p))).alias(p)
        for p, side in (("p33", "actual"), ("p67", "actual"), ("p95", "ae"))
    ]
    limits = q.groupBy("model").agg(*cells)
    marked = rows.join(F.broadcast(limits), "model")  # one row per model
    w = W.partitionBy("model", *spec.keys).orderBy(spec.time)
    marked = marked.withColumn("e1", F.lag("e", 1).over(w))
    ae, y = F.col("ae"), F.col("actual")
    large = ae > F.col("p95")
    return marked.groupBy("model").agg(
        F.avg("e").alias("mean_error"),
        F.stddev_pop("e").alias("std_error"),
        F.skewness("e").alias("skewness"),
        F.kurtosis("e").alias("kurtosis"),
        F.avg(ae).alias("mae"),
        F.count_if(large).alias("n_large"),
        F.max(ae).alias("max_error"),
        _or_zero(F.avg(F.when(large, ae))).alias("mean_large"),
        S.percent(F.count_if(large), F.count("*")).alias("pct_large"),
        pearson(F.col("e1"), F.col("e")).alias("lag1_r"),
        _or_zero(F.avg(F.when(y < F.col("p33"), ae))).alias("mae_small"),
        _or_zero(F.avg(F.when(y.between(F.col("p33"), F.col("p67")), ae))).alias("mae_medium"),
        _or_zero(F.avg(F.when(y > F.col("p67"), ae))).alias("mae_large"),
    )


# Error limits in percent below which a use is suitable.
LIMITS = {"planning": 15.0, "inventory": 10.0, "pricing": 5.0}


def business_relevance(results: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Total impact, error class, suitability per use, and stability from the
    earlier to the later half of the dates."""
    dates = results.select(spec.time).distinct()
    half = dates.withColumn(
        "_early", F.ntile(2).over(W.partitionBy(F.lit(1)).orderBy(F.desc(spec.time))) == 2
    )
    rows = results.join(F.broadcast(half), spec.time)
    ape = F.abs(S.ratio(error(), F.col("actual") + 1e-8)) * 100
    out = rows.groupBy("model").agg(
        F.sum(F.col("predicted") - F.col("actual")).alias("total_impact"),
        F.sum("actual").alias("_actual"),
        F.countDistinct(spec.top).alias("_sites"),
        F.avg(ape).alias("mape_smoothed"),
        F.avg(F.when(F.col("_early"), ape)).alias("early_mape"),
        F.avg(F.when(~F.col("_early"), ape)).alias("late_mape"),
    )
    mape, drift = F.col("mape_smoothed"), F.col("late_mape") - F.col("early_mape")
    return out.withColumns(
        {
            "impact_pct": S.percent(F.col("total_impact"), F.col("_actual")),
            "impact_per_site": S.ratio(F.col("total_impact"), F.col("_sites")),
            "error_level": F.when(mape < 10, "Low").when(mape < 20, "Medium").otherwise("High"),
            **{f"fit_{use}": mape < limit for use, limit in LIMITS.items()},
            "degradation": drift,
            "stability": F.when(F.abs(drift) < 5, "Stable").otherwise("Degrading"),
        }
    ).drop("_actual", "_sites")


def smoothness(results: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Changes of the forecasts within each series."""
    w = W.partitionBy("model", *spec.keys).orderBy(spec.time)
    rows = results.select("model", "predicted", WF.difference(F.col("predicted"), w).alias("c"))
    spread = F.stddev_pop("c")
    return rows.groupBy("model").agg(
        spread.alias("volatility"),
        F.avg("c").alias("mean_change"),
        F.max(F.abs("c")).alias("max_change"),
        S.ratio(F.lit(1.0), 1 + S.ratio(spread, F.avg("predicted"))).alias("smoothness"),
    )


def agreement(results: DataFrame, models: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Correlation of the forecasts of each model pair, from one row per cell."""
    cells = [F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in models]
    wide = results.groupBy(*spec.keys, spec.time).agg(*cells)
    structs = [
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), pearson(F.col(a), F.col(b)).alias("r"))
        for i, a in enumerate(models)
        for b in models[i + 1 :]
    ]
    return wide.agg(F.array(*structs).alias("p")).select(F.inline("p"))


def agreement_level(pairs: DataFrame) -> DataFrame:
    mean = F.avg(F.coalesce("r", F.lit(0.0)))
    return pairs.agg(
        mean.alias("mean_r"),
        F.when(mean > 0.8, "High").when(mean > 0.6, "Medium").otherwise("Low").alias("agreement"),
    )


def suitable_models(relevance: DataFrame) -> DataFrame:
    """Models suitable for each use, as a sorted list; models are few."""
    uses = F.array(
        *[F.struct(F.lit(u).alias("use"), F.col(f"fit_{u}").alias("fit")) for u in LIMITS]
    )
    rows = relevance.select("model", F.inline(uses)).where("fit")
    return rows.groupBy("use").agg(F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models"))
