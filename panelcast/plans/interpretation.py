"""Interpretation plan: importance, causes, drivers, findings and the report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators import evaluate, insight, stats
from panelcast.session import stage
from panelcast.spec import DEFAULT, PanelSpec


def long_metrics(
    sites: DataFrame, corr: DataFrame, domain: DataFrame, accuracy: DataFrame, spec: PanelSpec = DEFAULT
) -> DataFrame:
    """``(subject, metric, value)`` rows the rules are applied to."""
    ranks = evaluate.rank_models(evaluate.to_metrics(accuracy.drop("model_type")), ["weighted_rmse"])
    season = stats.month_seasonality(sites, [spec.target], spec.time)
    lift = stats.event_lift(sites, [spec.target], spec)

    def rows(df: DataFrame, subject: str, metric: str, value: Column) -> DataFrame:
        cells = [F.col(subject).alias("subject"), F.lit(metric).alias("metric")]
        return df.select(*cells, value.cast("double").alias("value"))

    out = rows(domain, "feature", "importance", F.col("importance"))
    for part in (
        rows(corr.where("r is not null"), "feature", "abs_r", F.abs("r")),
        rows(accuracy, "model", "mape", F.col("mape")),
        rows(ranks, "model", "weighted_rmse_rank", F.col("rank")),
        rows(lift, "feature", "lift_pct", F.col("lift_pct")),
        rows(season, "feature", "peak_month", F.col("peak_month")),
    ):
        out = out.unionByName(part)
    return out


def driver_scores(corr: DataFrame, domain: DataFrame) -> DataFrame:
    """Scores of each feature by domain importance and by correlation."""
    combined = domain.select("feature", F.col("importance").alias("score"))
    return combined.unionByName(corr.where("r is not null").select("feature", F.abs("r").alias("score")))


def run(
    panel: DataFrame,
    results: DataFrame,
    features: Sequence[str] = insight.FEATURES,
    spec: PanelSpec = DEFAULT,
) -> dict[str, DataFrame]:
    """Lazy insight tables by name. The site table is written once."""
    spark = panel.sparkSession
    sites = stage(insight.analysis_table(panel, spec), "sites")
    results = stage(results, "results")
    corr = stage(stats.correlations(sites, spec.target, list(features)), "correlations")
    domain = insight.domain_importance(corr, insight.domain_table(spark))
    theory = insight.theory_check(corr, insight.theory_table(spark))
    accuracy = stage(evaluate.accuracy(results), "accuracy")
    scores = driver_scores(corr, domain)
    drivers = insight.key_drivers(scores, insight.control_table(spark))
    metrics = long_metrics(sites, corr, domain, accuracy, spec)
    # Each model's direction is scored per series, so it joins as one more metric.
    moves = evaluate.directional_accuracy(results, spec).select(
        F.col("model").alias("subject"),
        F.lit("directional_accuracy").alias("metric"),
        F.col("directional_accuracy").alias("value"),
    )
    found = insight.findings(metrics.unionByName(moves), insight.rule_table(spark))
    relevance = evaluate.business_relevance(results, spec)
    by = ([spec.top], spec.time)
    lagged = stats.lagged_correlations(sites, spec.target, list(features), *by)
    return {
        "correlations": stats.with_significance(corr),
        "importance": domain,
        "theory": theory,
        "drivers": drivers,
        "lags": stats.strongest_lag(lagged),
        "predictive_gain": stats.predictive_gain(sites, spec.target, list(features), *by),
        "trends": stats.long_term_trend(sites, [spec.target, *spec.covariates], spec.time),
        "relevance": relevance,
        "suitable": evaluate.suitable_models(relevance),
        "smoothness": evaluate.smoothness(results, spec),
        "findings": insight.with_text(found),
        "report": insight.summary_report(accuracy, scores, drivers, found, theory),
    }
