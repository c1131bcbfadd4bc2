"""Interpretation: importance, consensus, theory checks, drivers, findings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions import scalars as S
from panelcast.functions import windows as WF
from panelcast.operators import features as FE
from panelcast.spec import DEFAULT, PanelSpec

FEATURES = ("temperature", "fuel_price", "cpi", "unemployment", "is_holiday", "promo_total", "size")

# Category, weight and controllability of each feature.
DOMAIN = [
    ("temperature", "External", 0.7, False),
    ("fuel_price", "Economic", 0.8, False),
    ("cpi", "Economic", 0.6, False),
    ("unemployment", "Economic", 0.7, False),
    ("is_holiday", "Temporal", 0.9, True),
    ("promo_total", "Promotional", 1.0, True),
    ("size", "Store", 0.8, False),
]

# Expected sign of each feature's effect (0 is mixed) and confidence.
THEORY = [
    ("is_holiday", 1, "high"),
    ("promo_total", 1, "high"),
    ("unemployment", -1, "medium"),
    ("temperature", 0, "medium"),
    ("fuel_price", -1, "medium"),
]

# How far a driver can be controlled.
CONTROL = [
    ("promo_total", "High"),
    ("is_holiday", "Medium"),
    ("size", "Low"),
    ("temperature", "None"),
    ("fuel_price", "None"),
    ("cpi", "None"),
    ("unemployment", "None"),
]

# Kind, area, subject (NULL: any), metric, operator, threshold,
# priority above it, higher threshold and the priority above that, actionability.
RULES = [
    ("recommendation", "Promotional Strategy", "promo_total", "importance", ">", 0.7, "High", None, None, "High"),
    ("recommendation", "Holiday Planning", "is_holiday", "importance", ">", 0.6, "High", None, None, "High"),
    ("recommendation", "Economic Monitoring", "unemployment", "importance", ">", 0.5, "Medium", None, None, "Medium"),
    ("recommendation", "Economic Monitoring", "cpi", "importance", ">", 0.5, "Medium", None, None, "Medium"),
    ("recommendation", "Economic Monitoring", "fuel_price", "importance", ">", 0.5, "Medium", None, None, "Medium"),
    ("recommendation", "Model Selection", None, "weighted_rmse_rank", "<", 1.5, "Medium", None, None, "High"),
    ("recommendation", "Seasonal Planning", None, "peak_month", ">", 0.0, "Medium", None, None, "High"),
    ("risk", "High Forecast Error", None, "mape", ">", 20.0, "High", None, None, None),
    ("risk", "Poor Trend Prediction", None, "directional_accuracy", "<", 60.0, "Medium", None, None, None),
    ("risk", "External Factor Dependency", "temperature", "abs_r", ">", 0.5, "Medium", None, None, None),
    ("risk", "External Factor Dependency", "fuel_price", "abs_r", ">", 0.5, "Medium", None, None, None),
    ("risk", "External Factor Dependency", "cpi", "abs_r", ">", 0.5, "Medium", None, None, None),
    ("risk", "External Factor Dependency", "unemployment", "abs_r", ">", 0.5, "Medium", None, None, None),
    ("opportunity", "Controllable Driver", "promo_total", "importance", ">", 0.6, "Medium", 0.8, "High", None),
    ("opportunity", "Controllable Driver", "is_holiday", "importance", ">", 0.6, "Medium", 0.8, "High", None),
    ("opportunity", "Holiday Strategy", None, "lift_pct", ">", 10.0, "High", None, None, None),
    ("opportunity", "Decision Support", None, "mape", "<", 15.0, "Medium", None, None, None),
]
RULE_SCHEMA = (
    "kind string, area string, rule_subject string, metric string, operator string, threshold double, "
    "priority string, high_threshold double, high_priority string, actionability string"
)


def domain_table(spark: SparkSession) -> DataFrame:
    schema = "feature string, category string, weight double, controllable boolean"
    return spark.createDataFrame(DOMAIN, schema)


def theory_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THEORY, "feature string, expected int, confidence string")


def control_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTROL, "feature string, control string")


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def analysis_table(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Site by date: target summed, features averaged, flag as max, with the
    target's lags, three-row mean and calendar parts."""
    ready = panel.withColumn("promo_total", S.promo_total(spec.promos))
    averaged = [c for c in (*spec.covariates, "promo_total", spec.size) if c and c in ready.columns]
    sites = ready.groupBy(spec.top, spec.time).agg(
        F.sum(spec.target).alias(spec.target),
        F.max(F.col(spec.event).cast("int")).alias(spec.event),
        *[F.avg(c).alias(c) for c in averaged],
    )
    w = WF.series_window([spec.top], spec.time)
    y = F.col(spec.target)
    out = sites.withColumns(
        {
            "sales_lag1": F.lag(y, 1).over(w),
            "sales_lag2": F.lag(y, 2).over(w),
            "sales_ma3": WF.full_rolling(y, F.avg, 3, w),
        }
    )
    return FE.add_calendar(out, spec)


def domain_importance(corr: DataFrame, domain: DataFrame) -> DataFrame:
    """Domain weight combined with statistical strength; ``domain`` is a short
    configuration list."""
    joined = F.broadcast(domain).join(corr.select("feature", "n", "r"), "feature", "left")
    strength = F.coalesce(F.when(F.col("n") > 10, F.abs("r")), F.lit(0.0))
    return joined.withColumn("statistical", strength).select(
        "feature",
        "category",
        "weight",
        "controllable",
        "statistical",
        (F.col("weight") * (0.7 + 0.3 * F.col("statistical"))).alias("importance"),
    )


def consensus(scores: DataFrame) -> DataFrame:
    """Agreement of ``(feature, source, score)`` rows over their sources."""
    spread = F.stddev_pop("score")
    return scores.groupBy("feature").agg(
        F.avg("score").alias("mean_importance"),
        spread.alias("std_importance"),
        (1 / (1 + spread)).alias("consensus"),
        F.count("*").alias("n_sources"),
    )


def theory_check(corr: DataFrame, theory: DataFrame) -> DataFrame:
    """Does the sign of each correlation agree with the expected effect?"""
    joined = corr.where("n > 10 and r is not null").join(F.broadcast(theory), "feature")
    supports = (F.col("expected") == 0) | (F.col("r") * F.col("expected") > 0)
    evidence = F.abs("r") * F.when(supports, 1.0).otherwise(0.5)
    return joined.select(
        "feature", "expected", "confidence", "r", supports.alias("supported"), evidence.alias("evidence")
    )


def key_drivers(scores: DataFrame, control: DataFrame, k: int = 5) -> DataFrame:
    """The k features with the highest mean score, and how far they can be controlled."""
    spread = F.stddev_pop("score")
    top = (
        scores.groupBy("feature")
        .agg(
            F.avg("score").alias("mean_score"),
            (1 / (1 + spread)).alias("consistency"),
            F.count("*").alias("evidence_count"),
        )
        .orderBy(F.desc("mean_score"), "feature")
        .limit(k)
    )
    labelled = top.join(F.broadcast(control), "feature", "left")
    return labelled.withColumn("control", F.coalesce("control", F.lit("Unknown")))


def findings(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that hold: ``metrics`` are ``(subject, metric, value)`` rows."""
    joined = metrics.join(F.broadcast(rules), "metric").where(
        F.col("rule_subject").isNull() | (F.col("rule_subject") == F.col("subject"))
    )
    v, limit = F.col("value"), F.col("threshold")
    holds = F.when(F.col("operator") == ">", v > limit).otherwise(v < limit)
    priority = F.when(v > F.col("high_threshold"), F.col("high_priority")).otherwise(F.col("priority"))
    return joined.where(holds).select(
        "kind", "area", "subject", "metric", "value", priority.alias("priority"), "actionability"
    )


def with_text(found: DataFrame) -> DataFrame:
    """A readable sentence per finding."""
    text = F.format_string(
        "%s: %s of %s is %.3f", F.col("area"), F.col("metric"), F.col("subject"), F.col("value")
    )
    return found.withColumn("text", text)


def surrogate_ridge(
    df: DataFrame, label: str, features: Sequence[str], alpha: float = 1.0
) -> DataFrame:
    """Ridge coefficients on standardized features and R², from one covariance pass."""
    names = [*features, label]
    k = len(features)
    filled = df.where(F.col(label).isNotNull()).select(
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
        F.col(label).cast("double").alias(label),
    )
    cov = F.array(*[F.covar_pop(a, b) for a in names for b in names])
    stats = filled.agg(F.count("*").alias("n"), cov.alias("c"))

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for rows, cells in zip(n, c):
            m = np.asarray(cells, float).reshape(k + 1, k + 1)
            sd = np.sqrt(np.diag(m)[:k])
            sd = np.where(sd > 0, sd, 1.0)
            r, xy = m[:k, :k] / np.outer(sd, sd), m[:k, k] / sd
            beta = np.linalg.solve(r + alpha / rows * np.eye(k), xy)
            left = m[k, k] - 2 * beta @ xy + beta @ r @ beta
            out.append([*beta, 1.0 - left / m[k, k] if m[k, k] > 0 else 0.0])
        return pd.Series(out)

    solved = stats.withColumn("_b", solve("n", "c"))
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col("_b")[i].alias("coefficient"), F.col("_b")[k].alias("r2"))
            for i, f in enumerate(features)
        ]
    )
    return solved.select(F.inline(rows))


def top_importances(table: DataFrame, value: str, k: int = 5) -> DataFrame:
    return table.orderBy(F.abs(value).desc(), "feature").limit(k)


def summary_report(
    accuracy: DataFrame, scores: DataFrame, drivers: DataFrame, found: DataFrame, theory: DataFrame
) -> DataFrame:
    """One nested row; every input is a short result table."""
    performance = accuracy.agg(
        F.array_sort(
            F.collect_list(
                F.struct("model", F.round("mape", 2).alias("mape"), F.round("r2", 3).alias("r2"), (F.col("mape") < 20).alias("suitable"))
            )
        )
    ).scalar()
    features = scores.agg(F.count_distinct("feature")).scalar()
    top = drivers.agg(F.array_sort(F.collect_list(F.struct("feature", "mean_score", "control")))).scalar()
    insights = found.agg(F.array_sort(F.collect_list(F.struct("kind", "area", "subject", "priority")))).scalar()
    causal = theory.where("supported").agg(
        F.array_sort(F.collect_list(F.struct("feature", "evidence")))
    ).scalar()
    spark = accuracy.sparkSession
    return spark.range(1).select(
        features.alias("features_analyzed"),
        performance.alias("performance"),
        top.alias("top_drivers"),
        insights.alias("findings"),
        causal.alias("causal"),
    )
