"""One store for the results of all models.

Results are long rows: model, series, date, step, actual, predicted, weight. The store
is a folder with one partition per grain and model, so a rerun of a model replaces its
own rows and leaves all others; within a run the last of equal cells counts. Models of
different grains meet after a roll-up to weeks and the keys that all of them have, on
the cells that all of them answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.forecast import event_weights
from panelcast.spec import DEFAULT, PanelSpec

_VALUES = ("step", "actual", "predicted", "weight")


def schema(spec: PanelSpec, kinds: dict[str, T.DataType]) -> T.StructType:
    """Columns of a stored row; ``kinds`` has the types of the series keys."""
    out = T.StructType()
    for k in spec.keys:
        out = out.add(k, kinds[k])
    out = out.add(spec.time, T.DateType()).add("model_type", T.StringType()).add("step", T.IntegerType())
    for c in _VALUES[1:]:
        out = out.add(c, T.DoubleType())
    return out.add("grain", T.StringType()).add("model", T.StringType())


def rows_of(
    forecasts: DataFrame, model: str, model_type: str, spec: PanelSpec = DEFAULT, depth: int | None = None,
    weights: DataFrame | None = None,
) -> DataFrame:
    """A model's forecasts (series keys, date, actual, predicted) as stored rows of
    the grain with the first ``depth`` keys. Steps count the dates it forecasts; the
    calendar bounds them. ``weights`` has one row per date, 1 where it has none."""
    depth = len(spec.keys) if depth is None else depth
    dates = forecasts.select(spec.time).distinct()
    steps = dates.agg(F.sort_array(F.collect_list(spec.time)).alias("d")).scalar()
    rows = forecasts if weights is None else forecasts.join(F.broadcast(weights.select(spec.time, "weight")), spec.time, "left")
    weight = F.lit(1.0) if weights is None else F.coalesce("weight", F.lit(1.0))
    kinds = {f.name: f.dataType for f in forecasts.schema.fields}
    keys = [F.col(k) if i < depth else F.lit(None).cast(kinds.get(k, T.StringType())).alias(k) for i, k in enumerate(spec.keys)]
    return rows.select(
        *keys, spec.time, F.lit(model_type).alias("model_type"), F.array_position(steps, F.col(spec.time)).cast("int").alias("step"),
        F.col("actual").cast("double").alias("actual"), F.col("predicted").cast("double").alias("predicted"), weight.cast("double").alias("weight"),
        F.lit(spec.level(depth)).alias("grain"), F.lit(model).alias("model"),
    )


def from_results(results: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Rows of ``forecast.forecast_results`` as stored rows of the leaf grain."""
    return results.select(
        *spec.keys, spec.time, "model_type", F.col("step").cast("int").alias("step"), *[F.col(c).cast("double").alias(c) for c in _VALUES[1:]],
        F.lit(spec.level(len(spec.keys))).alias("grain"), "model",
    )


def keep_last(rows: DataFrame, order: Column, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row per grain, model, series and date: the one that is last by ``order``.
    Partial maxima meet, so many reruns of one cell don't gather."""
    cell = ["grain", "model", *spec.keys, spec.time]
    rest = [c for c in rows.columns if c not in cell]
    last = rows.groupBy(*cell).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(*cell, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(rows.columns)


def save(rows: DataFrame, path: str) -> None:
    """Replace the partitions (grain, model) that ``rows`` has, and no others."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("grain", "model").parquet(path)


def load(spark: SparkSession, path: str, spec: PanelSpec, kinds: dict[str, T.DataType]) -> DataFrame:
    return spark.read.schema(schema(spec, kinds)).parquet(path)


def week_of(date: Column) -> Column:
    """The Sunday that ends a date's week."""
    return F.next_day(F.date_sub(date, 1), "SUN")


def at_grain(rows: DataFrame, by: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """All models by week and the keys ``by``: sums of actual and predicted values.
    A week with a null forecast has none. Rows of a grain without one of the keys
    are left out, since they can't be split."""
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in by], F.lit(True))
    whole = F.when(F.count("*") == F.count("predicted"), F.sum("predicted"))
    return rows.where(known).groupBy("model", "model_type", *by, week_of(F.col(spec.time)).alias(spec.time)).agg(
        F.sum("actual").alias("actual"), whole.alias("predicted"), F.max("weight").alias("weight"), F.min("step").alias("step")
    )


def comparable(rows: DataFrame, by: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """The cells of ``at_grain`` that every model answers; the actual value and
    weight are those most models give."""
    cell = [*by, spec.time]
    models = rows.select("model").distinct().agg(F.count("*")).scalar()
    known = rows.where("predicted IS NOT NULL AND actual IS NOT NULL")
    # As many rows per cell as there are models.
    each = known.groupBy(*cell).agg(
        F.count("*").alias("_n"), F.mode("actual", True).alias("actual"), F.max("weight").alias("weight"),
        F.collect_list(F.struct("model", "model_type", "step", "predicted")).alias("_m"),
    )
    full = each.where(F.col("_n") == models).select(*cell, "actual", "weight", F.inline("_m"))
    return full.select("model", "model_type", *cell, "step", "actual", "predicted", "weight")


def weights_by_week(panel: DataFrame, spec: PanelSpec = DEFAULT, weight: float = 5.0) -> DataFrame:
    """Weights of the Sundays that end the panel's weeks."""
    daily = event_weights(panel, spec, weight)
    return daily.groupBy(week_of(F.col(spec.time)).alias(spec.time)).agg(F.max("weight").alias("weight"))
