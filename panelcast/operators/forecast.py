"""Base forecasts for every node of the hierarchy.

The forecasters are weighted sums of a series' history, so an aggregate per leaf,
rolled up with GROUPING SETS, computes what they need for all nodes at once. A missing cell is 0
and adds nothing: the dense grid of series and dates is never built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.functions import scalars as S
from panelcast.operators.rollup import level_of
from panelcast.spec import DEFAULT, PanelSpec

# The base models, their shares in the ensemble, the recent window,
# the seasonal cycle and the smoothing factor.
MODELS = {
    "trend_seasonal": "Statistical",
    "smoothing": "Statistical",
    "moving_average": "Statistical",
    "ensemble": "Ensemble",
    "historical_mean": "Baseline",
}
SHARES = {"trend_seasonal": 0.5, "smoothing": 0.3, "moving_average": 0.2}
WINDOW, CYCLE, ALPHA = 4, 52, 0.3


def date_positions(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Distinct dates with their position 0..n-1; never longer than the calendar."""
    return df.select(spec.time).distinct().withColumn(
        "pos", F.row_number().over(W.orderBy(spec.time)) - 1
    )


def node_statistics(
    train: DataFrame, horizon: int = 8, spec: PanelSpec = DEFAULT, aligned: bool = False
) -> DataFrame:
    """Per node: length of history, sums over recent windows, the smoothed level,
    the recent values the seasonal part repeats, and the leaves' mean values.

    Rows are summed to leaves first; only the leaves are rolled up, so that every
    sum of an upper node, its mean included, is the sum of its leaves.
    """
    n = train.select(spec.time).distinct().agg(F.count("*")).scalar()
    placed = train.join(F.broadcast(date_positions(train, spec)), spec.time)
    placed = placed.withColumns({"_y": F.col(spec.target), "_back": n - 1 - F.col("pos")})
    y, back = F.col("_y"), F.col("_back")
    decay = F.when(F.col("pos") == 0, F.lit(1.0)).otherwise(F.lit(ALPHA)) * F.pow(F.lit(1 - ALPHA), back)

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, y)), F.lit(0.0))

    sums = {
        "total": F.coalesce(F.sum(y), F.lit(0.0)),
        "recent": total(back < WINDOW),
        "before": total((back >= WINDOW) & (back < 2 * WINDOW)),
        "cycle": total(back < CYCLE),
        "smooth": F.coalesce(F.sum(y * decay), F.lit(0.0)),
    }
    repeated = {f"_r{i}": total(back == seasonal_offset(i, horizon, aligned)) for i in range(horizon)}
    leaf = placed.groupBy(*spec.keys).agg(
        F.count(y).alias("_rows"), *[c.alias(name) for name, c in (sums | repeated).items()]
    )
    mean = F.greatest(S.ratio(F.col("total"), F.col("_rows")), F.lit(0.0))
    sets = [list(spec.keys[:i]) for i in range(len(spec.keys) + 1)]
    grouped = leaf.withColumn("mean", mean).groupingSets(sets, *spec.keys).agg(
        F.grouping_id().alias("_g"),
        *[F.sum(c).alias(c) for c in [*sums, "mean"]],
        F.array(*[F.sum(c) for c in repeated]).alias("repeated"),
    )
    return grouped.withColumn("n", n).withColumn("level", level_of(F.col("_g"), spec)).drop("_g")


def seasonal_offset(i: int, horizon: int, aligned: bool = False) -> int:
    """How many rows before the last one lies the row whose seasonal deviation
    step ``i`` repeats: the last ``horizon`` rows of the cycle, or with
    ``aligned`` the rows one cycle before the step."""
    if aligned or horizon > CYCLE:
        return CYCLE - 1 - i % CYCLE
    return horizon - 1 - i


def base_forecasts(
    train: DataFrame,
    dates: DataFrame,
    horizon: int = 8,
    spec: PanelSpec = DEFAULT,
    aligned: bool = False,
) -> DataFrame:
    """One row per node and step with the forecasts of all five base models.

    ``dates`` maps each step to its date, see ``horizon_dates``.
    """
    return model_forecasts(node_statistics(train, horizon, spec, aligned), dates, spec)


def model_forecasts(
    nodes: DataFrame, dates: DataFrame, spec: PanelSpec = DEFAULT, by: Sequence[str] = ()
) -> DataFrame:
    """The base models from node statistics; ``by`` names columns that separate
    several sets of nodes, each with dates of its own."""
    each = nodes.select("*", F.posexplode("repeated").alias("_i", "_value"))
    n, step = F.col("n"), (F.col("_i") + 1).cast("int")
    flat = F.greatest(F.col("total") / n, F.lit(0.0))
    level = F.col("recent") / WINDOW
    slope = (level - F.col("before") / WINDOW) / WINDOW
    seasonal = F.when(n >= CYCLE, F.col("_value") - F.col("cycle") / CYCLE).otherwise(0.0)
    line = level + slope * step
    models = {
        "trend_seasonal": F.when(n < 2 * WINDOW, flat).otherwise(line + seasonal),
        "smoothing": F.greatest("smooth", F.lit(0.0)),
        "moving_average": F.when(n < 2 * WINDOW, flat).otherwise(line),
    }
    mixed: Column = F.lit(0.0)
    for name, share in SHARES.items():
        mixed = mixed + share * F.col(name)
    out = each.withColumns({"step": step, **models})
    out = out.withColumn(
        "ensemble", F.when(F.col("n") < WINDOW, flat).otherwise(F.greatest(mixed, F.lit(0.0)))
    )
    out = out.withColumnRenamed("mean", "historical_mean")
    placed = out.join(F.broadcast(dates), [*by, "step"])
    return placed.select(*by, "level", *spec.keys, "step", spec.time, *MODELS)


def horizon_dates(val: DataFrame, horizon: int = 8, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Step 1..horizon to date, from the validation rows' distinct dates."""
    at = date_positions(val, spec).select((F.col("pos") + 1).alias("step"), spec.time)
    return at.where(F.col("step") <= horizon)


def future_dates(train: DataFrame, horizon: int = 8, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Step 1..horizon to date, continuing the panel's calendar."""
    last = train.agg(F.max(spec.time).alias("last")).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    )
    return last.select("step", F.date_add("last", F.col("step") * spec.step_days).alias(spec.time))


def leaves(forecasts: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    return forecasts.where(F.col("level") == spec.level(len(spec.keys)))


def forecast_results(
    forecasts: DataFrame, val: DataFrame, spec: PanelSpec = DEFAULT, weight: float = 5.0, by: Sequence[str] = ()
) -> DataFrame:
    """Long table of leaf forecasts beside their actual values and weights.

    Rows meet on series and date; a forecast without an actual value is left
    out. Only the models present in ``forecasts`` appear; ``by`` names columns
    of it that are kept.
    """
    models = [m for m in forecasts.columns if m not in (*by, "level", *spec.keys, "step", spec.time)]
    weights = event_weights(val, spec, weight)
    actual = val.select(*spec.keys, spec.time, F.col(spec.target).cast("double").alias("actual"))
    known = leaves(forecasts, spec).join(actual, [*spec.keys, spec.time])
    known = known.join(F.broadcast(weights), spec.time)
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.lit(MODELS.get(m, "Hierarchical")).alias("model_type"),
                F.col(m).alias("predicted"),
            )
            for m in models
        ]
    )
    ids = [*by, *spec.keys, spec.time, "step", "actual", "weight"]
    return known.select(*ids, F.inline(rows))


def event_weights(df: DataFrame, spec: PanelSpec = DEFAULT, weight: float = 5.0) -> DataFrame:
    """Weight of each date: raised if any row of the date is an event."""
    flag = F.max(F.col(spec.event).cast("int"))
    return df.groupBy(spec.time).agg(S.event_weight(flag, weight).alias("weight"))
