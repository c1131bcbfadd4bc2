"""Fitted models: event-weighted forest, pooled decomposable regression,
differenced autoregression, and model-ready sequence sets.

Fitting uses Spark ML over all rows; fitted objects are a few numbers, and the
forecasts are columns again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.functions import scalars as S
from panelcast.functions import windows as WF
from panelcast.operators import clean, rollup
from panelcast.operators.joins import lookup_join
from panelcast.operators.quantiles import quantile_columns
from panelcast.session import stage
from panelcast.spec import DEFAULT, PanelSpec


def sequences(
    df: DataFrame,
    features: Sequence[str],
    length: int = 5,
    keys: Sequence[str] = DEFAULT.keys,
    spec: PanelSpec = DEFAULT,
) -> DataFrame:
    """For each row with ``length`` rows before it: their features as a matrix,
    and its own target and weight. A frame holds ``length`` rows, no more."""
    w = WF.series_window(list(keys), spec.time)
    row = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    past = F.collect_list(row).over(w.rowsBetween(-length, -1))
    out = df.withColumn("sequence", past).where(F.size("sequence") == length)
    weight = F.col("event_weight") if "event_weight" in df.columns else S.event_weight(F.col(spec.event))
    return out.select(
        *keys, spec.time, "sequence", F.col(spec.target).alias("label"), weight.alias("weight")
    )


def sequence_sets(
    panel: DataFrame, features: Sequence[str], n_val: int = 8, length: int = 5, spec: PanelSpec = DEFAULT,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of the grain ``keys`` (sites by default), scaled on the training dates and
    cut into sequences over the whole panel, each marked by the part its target date
    belongs to. A window over a series needs no more than the calendar's rows."""
    keys = [spec.top] if keys is None else list(keys)
    sites = rollup.rollup_panel(panel, [*keys, spec.time], spec)
    start = clean.validation_start(sites, n_val, spec).scalar()
    fit = sites.where(F.col(spec.time) < start)
    filled = clean.fill_within(clean.scale(sites, list(features), fit), [f"{c}_scaled" for c in features])
    out = sequences(filled, [f"{c}_scaled" for c in features], length, keys, spec)
    part = F.when(F.col(spec.time) < start, "train").otherwise("validation")
    return out.withColumn("part", part)


def cells(sets: DataFrame, features: Sequence[str], length: int = 5) -> DataFrame:
    """Sequences as plain columns ``<feature>_<step>``, the last step being 1."""
    flat = [F.col("sequence")[length - k][i].alias(f"{f}_{k}") for i, f in enumerate(features) for k in range(length, 0, -1)]
    return sets.select(*[c for c in sets.columns if c != "sequence"], *flat)


def write_sequence_sets(sets: DataFrame, path: str) -> None:
    """The sets as a data set for training: one folder per part, written by the tasks."""
    sets.write.mode("overwrite").partitionBy("part").parquet(path)


def assemble(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    """Feature vector with nulls as 0."""
    ready = df.withColumns({f"_v_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    inputs = [f"_v_{c}" for c in features]
    return VectorAssembler(inputCols=inputs, outputCol=name).transform(ready).drop(*inputs)


def spread(df: DataFrame, keys: Sequence[str], partitions: int) -> DataFrame:
    """A fixed number of partitions by key, each in key order. A forest samples rows
    by partition and position, so the model is the same on any number of cores."""
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)


def fit_forest(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    weight: str | None = "event_weight",
    trees: int = 100,
    depth: int = 15,
    leaf: int = 5,
    seed: int = 42,
    keys: Sequence[str] = (*DEFAULT.keys, DEFAULT.time),
    partitions: int = 8,
):
    """Forest over all rows and the features named. ``keys`` identify a row;
    ``partitions`` (as many as the cores) decides, with ``seed``, which rows each
    tree sees. Each partition sends statistics of every open node, so more
    partitions cost more."""
    forest = RandomForestRegressor(
        featuresCol="features",
        labelCol=target,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=leaf,
        featureSubsetStrategy="all",
        seed=seed,
        maxMemoryInMB=1024,
        cacheNodeIds=True,
    )
    if weight:
        forest = forest.setWeightCol(weight)
    return forest.fit(spread(assemble(train, features), keys, partitions))


def forest_importances(model, features: Sequence[str], spark) -> DataFrame:
    pairs = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(pairs, "feature string, importance double")


# --- pooled decomposable regression -----------------------------------------------------


@dataclass(frozen=True)
class SeasonalRegression:
    """Trend with hinges, yearly Fourier terms, event dummies and covariates, pooled
    over all series: the target is divided by the mean size of the series' known
    values and taken around their mean, so negative values and zeros count too."""

    order: int = 10
    hinges: int = 10
    ridge: float = 0.01
    interval: float = 1.96

    def design(
        self, df: DataFrame, calendar: DataFrame, span: Column, covariates: Sequence[str], spec: PanelSpec
    ) -> tuple[DataFrame, list[str]]:
        """Design columns; ``span`` is a struct (lo, hi) of training dates."""
        days = F.datediff(span["hi"], span["lo"]).cast("double")
        t = F.datediff(spec.time, span["lo"]) / F.greatest(days, F.lit(1.0))
        cols: dict[str, Column] = {"trend": t}
        for i in range(1, self.hinges + 1):
            cols[f"hinge_{i}"] = F.greatest(t - F.lit(0.8 * i / (self.hinges + 1)), F.lit(0.0))
        angle = F.unix_date(spec.time) * F.lit(2 * math.pi / 365.25)
        for k in range(1, self.order + 1):
            cols[f"sin_{k}"], cols[f"cos_{k}"] = F.sin(angle * k), F.cos(angle * k)
        dated = df.join(F.broadcast(calendar), spec.time, "left")
        names = [r[0] for r in calendar.select("holiday").distinct().orderBy("holiday").collect()]
        for i, h in enumerate(names):
            cols[f"event_{i}"] = F.coalesce((F.col("holiday") == h).cast("double"), F.lit(0.0))
        cols |= {f"x_{c}": F.coalesce(F.col(f"{c}_scaled"), F.lit(0.0)) for c in covariates}
        return dated.withColumns(cols), list(cols)

    def run(
        self,
        panel: DataFrame,
        calendar: DataFrame,
        covariates: Sequence[str],
        n_val: int = 8,
        spec: PanelSpec = DEFAULT,
    ) -> DataFrame:
        """Forecasts and 95 % limits for the validation rows. A series with no known
        training value has null forecasts; one of zeros only has the size 1."""
        start = clean.validation_start(panel, n_val, spec).scalar()
        y = F.col(spec.target).cast("double")
        fit = panel.where((F.col(spec.time) < start) & y.isNotNull())
        span = fit.agg(F.struct(F.min(spec.time).alias("lo"), F.max(spec.time).alias("hi"))).scalar()
        level = fit.groupBy(*spec.keys).agg(F.avg(F.abs(y)).alias("_size"), F.avg(y).alias("_level"))
        level = level.withColumn("_size", F.when(F.col("_size") == 0, 1.0).otherwise(F.col("_size")))
        scaled = clean.scale(panel, list(covariates), fit)
        leveled = lookup_join(scaled, level, list(spec.keys), "left", computed=True)
        rows, names = self.design(leveled, calendar, span, covariates, spec)
        rows = assemble(rows, names).withColumn("_in", F.col(spec.time) < start)
        known = rows.where(F.col("_in") & y.isNotNull())
        known = known.withColumn("_label", (y - F.col("_level")) / F.col("_size"))
        known = known.withColumn("_w", S.event_weight(F.col(spec.event)))
        model = LinearRegression(
            featuresCol="features", labelCol="_label", weightCol="_w", regParam=self.ridge, elasticNetParam=0.0
        ).fit(known)
        spread = F.lit(self.interval * float(model.summary.rootMeanSquaredError))
        out = model.transform(rows.where(~F.col("_in")))
        size, middle = F.col("_size"), F.col("_level") + F.col("prediction") * F.col("_size")
        return out.select(
            *spec.keys,
            spec.time,
            F.col(spec.target).alias("actual"),
            middle.alias("predicted"),
            (middle - spread * size).alias("lower"),
            (middle + spread * size).alias("upper"),
        )


@dataclass(frozen=True)
class MultiplicativeRegression(SeasonalRegression):
    """The same design as a product: a series' level times the exponential of trend,
    season, events and covariates, fitted by reweighted least squares on the log link.

    The level keeps its sign and the fit asks only for weighted sums of errors, so zero
    and negative sales are rows like others. Limits come from a fit that ends one
    horizon earlier: the quantiles of its errors, relative to the series' size, by the
    number of steps ahead.
    """

    rounds: int = 6
    largest: float = 5.0
    coverage: float = 0.95

    def _fit(self, rows: DataFrame, start: Column, names: list[str], spec: PanelSpec) -> tuple[DataFrame, Column]:
        """``rows`` with ``_level`` and ``_size`` of the values before ``start``, and the
        exponent as a column; series without a known value there have neither."""
        y = F.col(spec.target).cast("double")
        known = rows.where((F.col(spec.time) < start) & y.isNotNull())
        level = known.groupBy(*spec.keys).agg(F.avg(F.abs(y)).alias("_size"), F.avg(y).alias("_level"))
        level = level.withColumn("_size", F.when(F.col("_size") == 0, 1.0).otherwise(F.col("_size")))
        rows = lookup_join(rows, level, list(spec.keys), "left", computed=True)
        # A level near 0 says little of the product: its weight goes with its square.
        sound = F.pow(F.col("_level") / F.col("_size"), 2) * S.event_weight(F.col(spec.event))
        fit = rows.where((F.col(spec.time) < start) & y.isNotNull() & (F.col("_level") != 0))
        fit = stage(assemble(fit.withColumns({"_v": y / F.col("_level"), "_w": sound}), names).select("features", "_v", "_w"), "fit")
        exponent: Column = F.lit(0.0)
        solver = LinearRegression(featuresCol="features", labelCol="_z", weightCol="_u", regParam=self.ridge, elasticNetParam=0.0)
        model = None
        if fit.isEmpty():
            return rows, exponent
        for _ in range(self.rounds):
            done = fit.withColumn("_eta", F.lit(0.0)) if model is None else model.setPredictionCol("_eta").transform(fit)
            eta = F.greatest(F.lit(-self.largest), F.least(F.lit(self.largest), F.col("_eta")))
            mean = F.exp(eta)
            model = solver.fit(done.withColumns({"_z": eta + F.col("_v") / mean - 1, "_u": F.col("_w") * mean}))
        for c, b in zip(names, model.coefficients):
            exponent = exponent + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(b))
        exponent = exponent + F.lit(float(model.intercept))
        return rows, F.greatest(F.lit(-self.largest), F.least(F.lit(self.largest), exponent))

    def run(
        self, panel: DataFrame, calendar: DataFrame, covariates: Sequence[str], n_val: int = 8, spec: PanelSpec = DEFAULT,
    ) -> DataFrame:
        """Forecasts and limits for the validation rows, with their step. A series with
        no known training value has none; one of level 0 has the forecast 0. Where no
        series reaches a step in the earlier fit, the limits are null."""
        starts = [clean.validation_start(panel, n, spec).scalar() for n in (2 * n_val, n_val)]
        fit = panel.where(F.col(spec.time) < starts[0])
        span = fit.agg(F.struct(F.min(spec.time).alias("lo"), F.max(spec.time).alias("hi"))).scalar()
        rows, names = self.design(clean.scale(panel, list(covariates), fit), calendar, span, covariates, spec)
        rows = stage(rows, "design")
        dates = rows.select(spec.time).distinct().agg(F.sort_array(F.collect_list(spec.time)).alias("d")).scalar()
        y = F.col(spec.target).cast("double")

        def forecasts(i: int) -> DataFrame:
            out, exponent = self._fit(rows, starts[i], names, spec)
            until = F.col(spec.time) < starts[1] if i == 0 else F.lit(True)
            position = F.array_position(dates, F.col(spec.time)) - F.array_position(dates, starts[i]) + 1
            predicted = F.col("_level") * F.exp(exponent)
            out = out.where((F.col(spec.time) >= starts[i]) & until)
            return out.select(*spec.keys, spec.time, position.cast("int").alias("step"), y.alias("actual"), predicted.alias("predicted"), "_size")

        before = stage(forecasts(0).withColumn("_r", (F.col("actual") - F.col("predicted")) / F.col("_size")), "errors")
        tail = (1 - self.coverage) / 2
        limits = quantile_columns(before, "_r", {"_lo": tail, "_hi": 1 - tail}, ["step"])
        out = forecasts(1).join(F.broadcast(stage(limits, "limits")), "step", "left")
        return out.select(
            *spec.keys, spec.time, "step", "actual", "predicted",
            (F.col("predicted") + F.col("_lo") * F.col("_size")).alias("lower"),
            (F.col("predicted") + F.col("_hi") * F.col("_size")).alias("upper"),
        )


# --- differenced autoregression -----------------------------------------------------------


def differenced_autoregression(
    weekly: DataFrame,
    keys: Sequence[str],
    covariates: Sequence[str],
    n_val: int = 8,
    period: int = 52,
    spec: PanelSpec = DEFAULT,
) -> DataFrame:
    """Autoregression of the twice differenced target (lags 1 and ``period``) on
    its own lags 1 and ``period`` and on differenced covariates.

    ``weekly`` is gap-free (``rollup.resample_weekly``). One pooled regression
    over all series; then each series is stepped forward from its last
    ``2 * period + 2`` values, one series per group. A series whose known values
    don't reach back far enough has null forecasts and a ``reason``. Covariates
    unknown in a future week count as moving as they did a period before.
    """
    keys = list(keys)
    start = clean.validation_start(weekly, n_val, spec).scalar()
    w = WF.series_window(keys, spec.time)
    y = F.col(spec.target).cast("double")

    def twice(c: Column) -> Column:
        return c - F.lag(c, 1).over(w) - F.lag(c, period).over(w) + F.lag(c, period + 1).over(w)

    xs = [f"d_{c}" for c in covariates]
    base = weekly.withColumns({"z": twice(y), **{f"d_{c}": twice(F.col(c).cast("double")) for c in covariates}})
    base = base.withColumns({"z_1": F.lag("z", 1).over(w), "z_p": F.lag("z", period).over(w)})
    fit = base.where(F.col(spec.time) < start).dropna(subset=["z", "z_1", "z_p", *xs])
    model = LinearRegression(featuresCol="features", labelCol="z", regParam=0.0).fit(
        assemble(fit, ["z_1", "z_p", *xs])
    )
    beta, constant = [float(b) for b in model.coefficients], float(model.intercept)
    need = 2 * period + 2
    recent = base.withColumn("_future", F.col(spec.time) >= start)
    back = W.partitionBy(*keys, "_future").orderBy(F.desc(spec.time))
    recent = recent.withColumn("_b", F.row_number().over(back)).where(
        F.col("_future") | (F.col("_b") <= need)
    )
    kinds = {f.name: f.dataType.simpleString() for f in weekly.schema.fields}
    head = ", ".join(f"{k} {kinds[k]}" for k in [*keys, spec.time])

    def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(spec.time)
        past, future = pdf[~pdf["_future"]], pdf[pdf["_future"]]
        out = future[[*keys, spec.time]].copy()
        out["actual"] = future["_y"].to_numpy(float)
        level = list(past["_y"].to_numpy(float))
        z = list(past["z"].to_numpy(float))
        values = [np.nan] * len(future)
        if len(level) > period:
            for i, x in enumerate(future[xs].fillna(0.0).to_numpy(float)):
                z.append(constant + float(np.dot(beta, [z[-1], z[-period], *x])))
                level.append(z[-1] + level[-1] + level[-period] - level[-period - 1])
                values[i] = level[-1]
        out["predicted"] = values
        out["reason"] = np.where(np.isnan(values), "unknown history", None)
        return out

    needed = recent.select(*keys, spec.time, y.alias("_y"), "z", *xs, "_future")
    return needed.groupBy(*keys).applyInPandas(step, f"{head}, actual double, predicted double, reason string")
