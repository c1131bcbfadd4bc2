"""Rolling-origin evaluation of the base models, without refitting per origin.

The base models need sums of a series' history over windows that end at an origin.
All windows of all origins are cut at their ends into segments; one aggregate gives
each series its sums per segment, and every origin's sums are running sums over those
few segments. The panel is read and shuffled once, whatever the number of origins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions import scalars as S
from panelcast.operators import forecast
from panelcast.operators.forecast import ALPHA, CYCLE, WINDOW
from panelcast.operators.rollup import level_of
from panelcast.spec import DEFAULT, PanelSpec


def _origins(folds: int, horizon: int) -> dict[int, int]:
    """Dates after the origin of each fold; the last fold ends with the panel."""
    return {f: (folds - f + 1) * horizon for f in range(1, folds + 1)}


def _edges(folds: int, horizon: int) -> list[int]:
    ends = (0, WINDOW, 2 * WINDOW, CYCLE)
    return sorted({o + e for o in _origins(folds, horizon).values() for e in ends})


def _fold_table(folds: int, horizon: int) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(o).alias("after")) for f, o in _origins(folds, horizon).items()])


def placed(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Rows with ``_pos``, the position of their date, ``_back``, the dates after
    it, and ``_n``, the number of dates."""
    dates = forecast.date_positions(df, spec)
    n = df.select(spec.time).distinct().agg(F.count("*")).scalar()
    out = df.join(F.broadcast(dates), spec.time).withColumnRenamed("pos", "_pos")
    return out.withColumn("_n", n).withColumn("_back", F.col("_n") - 1 - F.col("_pos"))


def rolling_statistics(
    df: DataFrame, folds: int = 3, horizon: int = 8, spec: PanelSpec = DEFAULT, aligned: bool = False
) -> DataFrame:
    """``forecast.node_statistics`` of the rows before each origin, by ``fold``."""
    edges = _edges(folds, horizon)
    offsets = [forecast.seasonal_offset(i, horizon, aligned) for i in range(horizon)]
    repeated = sorted({o + b for o in _origins(folds, horizon).values() for b in offsets})
    rows = placed(df, spec).where(F.col("_back") >= edges[0])
    back, y = F.col("_back"), F.col(spec.target).cast("double")
    edge = F.array_max(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= back))
    rows = rows.withColumn("_edge", edge)
    # Each segment's smoothed sum is as seen from its own end.
    decay = F.when(F.col("_pos") == 0, F.lit(1.0)).otherwise(F.lit(ALPHA)) * F.pow(F.lit(1 - ALPHA), back - F.col("_edge"))
    value = F.when(back.isin(repeated), F.struct(back.alias("back"), F.coalesce(y, F.lit(0.0)).alias("y")))
    segments = rows.groupBy(*spec.keys, "_edge").agg(
        F.max("_n").alias("_n"),
        F.count(y).alias("known"),
        F.coalesce(F.sum(y), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(y * decay), F.lit(0.0)).alias("smooth"),
        F.collect_list(value).alias("values"),
    )
    # No more segments per series than edges.
    part = F.struct(F.col("_edge").alias("edge"), "known", "total", "smooth", "values")
    series = segments.groupBy(*spec.keys).agg(F.max("_n").alias("_n"), F.collect_list(part).alias("_parts"))
    each = series.select("*", F.inline(_fold_table(folds, horizon)))
    after = F.col("after")

    def over(lo: int, hi: int | None, field: str = "total") -> Column:
        inside = lambda s: (s["edge"] >= after + lo) & (F.lit(True) if hi is None else s["edge"] < after + hi)
        return F.aggregate(F.filter("_parts", inside), F.lit(0.0), lambda a, s: a + s[field])

    def at(back: int) -> Column:
        there = F.filter("_values", lambda v: v["back"] == after + back)
        return F.aggregate(there, F.lit(0.0), lambda a, v: a + v["y"])

    seen = F.filter("_parts", lambda s: s["edge"] >= after)
    smooth = F.aggregate(seen, F.lit(0.0), lambda a, s: a + s["smooth"] * F.pow(F.lit(1 - ALPHA), s["edge"] - after))
    each = each.where(F.size(seen) > 0).withColumn("_values", F.flatten(F.transform("_parts", lambda s: s["values"])))
    leaf = each.select(
        "fold",
        *spec.keys,
        (F.col("_n") - after).alias("n"),
        over(0, None).alias("total"),
        over(0, WINDOW).alias("recent"),
        over(WINDOW, 2 * WINDOW).alias("before"),
        over(0, CYCLE).alias("cycle"),
        smooth.alias("smooth"),
        F.greatest(S.ratio(over(0, None), over(0, None, "known")), F.lit(0.0)).alias("mean"),
        *[at(b).alias(f"_r{i}") for i, b in enumerate(offsets)],
    )
    sets = [["fold", *spec.keys[:i]] for i in range(len(spec.keys) + 1)]
    sums = ("total", "recent", "before", "cycle", "smooth", "mean")
    nodes = leaf.groupingSets(sets, "fold", *spec.keys).agg(
        F.grouping_id().alias("_g"),
        F.max("n").alias("n"),
        *[F.sum(c).alias(c) for c in sums],
        F.array(*[F.sum(f"_r{i}") for i in range(horizon)]).alias("repeated"),
    )
    return nodes.withColumn("level", level_of(F.col("_g"), spec)).drop("_g")


def rolling_dates(df: DataFrame, folds: int = 3, horizon: int = 8, spec: PanelSpec = DEFAULT) -> DataFrame:
    """(fold, step, date) of the dates each fold forecasts."""
    dates = forecast.date_positions(df, spec)
    n = dates.agg(F.count("*")).scalar()
    back = n - 1 - F.col("pos")
    each = dates.select(spec.time, back.alias("_back"), F.inline(_fold_table(folds, horizon)))
    step = (F.col("after") - F.col("_back")).cast("int")
    return each.select("fold", step.alias("step"), spec.time).where(F.col("step").between(1, horizon))


def rolling_forecasts(
    df: DataFrame, folds: int = 3, horizon: int = 8, spec: PanelSpec = DEFAULT, aligned: bool = False
) -> DataFrame:
    """Base forecasts of every node from every origin: ``fold``, and the columns of
    ``forecast.base_forecasts``. A fold whose origin lies before the panel's first
    date has no rows."""
    nodes = rolling_statistics(df, folds, horizon, spec, aligned)
    return forecast.model_forecasts(nodes, rolling_dates(df, folds, horizon, spec), spec, ["fold"])


def rolling_results(
    df: DataFrame, folds: int = 3, horizon: int = 8, spec: PanelSpec = DEFAULT, weight: float = 5.0
) -> DataFrame:
    """Scored leaf rows of all folds, in the form ``evaluate`` reads, with ``fold``.
    Give it a staged panel: it is read for the history and for the actual values."""
    forecasts = rolling_forecasts(df, folds, horizon, spec)
    return forecast.forecast_results(forecasts, df, spec, weight, ["fold"])
