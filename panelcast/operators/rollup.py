"""Roll-ups: mixed aggregates, weekly resampling, hierarchy totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions import windows as WF
from panelcast.operators.quantiles import exact_quantiles
from panelcast.session import stage
from panelcast.spec import DEFAULT, PanelSpec


def default_aggs(spec: PanelSpec, columns: Sequence[str], promo: str = "sum") -> dict[str, Column]:
    """Target summed, covariates averaged, flag as max, promotions as named."""
    fn = F.sum if promo == "sum" else F.avg
    aggs = {spec.target: F.sum(spec.target), spec.event: F.max(F.col(spec.event).cast("int"))}
    aggs |= {c: F.avg(c) for c in spec.covariates}
    aggs |= {c: fn(c) for c in spec.promos}
    if spec.size:
        aggs[spec.size] = F.max(spec.size)
    return {k: v for k, v in aggs.items() if k in columns}


def rollup_panel(
    df: DataFrame, by: Sequence[str], spec: PanelSpec = DEFAULT, promo: str = "sum"
) -> DataFrame:
    aggs = default_aggs(spec, df.columns, promo)
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])


def resample_weekly(
    df: DataFrame, spec: PanelSpec, by: Sequence[str], sums: Sequence[str], means: Sequence[str], flags: Sequence[str]
) -> DataFrame:
    """Weeks ending on Sunday, gaps included. An empty week sums to 0; means and
    flags are filled forward, backward, and then with the column's median."""
    week_end = F.next_day(F.date_sub(spec.time, 1), "SUN")
    aggs = [F.sum(c).alias(c) for c in sums] + [F.avg(c).alias(c) for c in means]
    aggs += [F.max(F.col(c).cast("double")).alias(c) for c in flags]
    gaps = [*means, *flags]
    # Written once: the grid, its span and all medians read it.
    weeks = stage(df.groupBy(*by, week_end.alias(spec.time)).agg(*aggs), "weeks")
    span = weeks.groupBy(*by).agg(F.min(spec.time).alias("lo"), F.max(spec.time).alias("hi"))
    steps = F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias(spec.time)
    grid = span.select(*by, steps).join(weeks, [*by, spec.time], "left")
    w, back = WF.series_window(by, spec.time), WF.reverse_window(by, spec.time)
    filled = grid.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in sums})
    filled = filled.withColumns(
        {c: F.coalesce(WF.fill_forward(F.col(c), w), WF.fill_backward(F.col(c), back)) for c in gaps}
    )
    if not gaps:
        return filled
    # Only a column without any value in its series is still empty here. All medians
    # are found together.
    long = weeks.unpivot([], gaps, "column", "value")
    medians = exact_quantiles(long, "value", [0.5], ["column"])
    found = medians.agg(F.struct(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in gaps])).scalar()
    return filled.withColumns({c: F.coalesce(F.col(c), found[c]) for c in gaps})


def level_of(grouping_id: Column, spec: PanelSpec = DEFAULT) -> Column:
    """Level name from the grouping id of the series keys: the deeper keys are
    grouped away first, so the id is 0 on the lowest level."""
    name = F.lit(spec.level(len(spec.keys)))
    for depth in range(len(spec.keys)):
        rolled = 2 ** (len(spec.keys) - depth) - 1
        name = F.when(grouping_id == rolled, spec.level(depth)).otherwise(name)
    return name


def node_totals(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Target by date for every node of the hierarchy, on the dates it has rows."""
    sets = [[*spec.keys[:i], spec.time] for i in range(len(spec.keys) + 1)]
    grouped = df.groupingSets(sets, *spec.keys, spec.time).agg(
        F.sum(spec.target).alias("y"), F.grouping_id().alias("_g")
    )
    # The time column is the lowest bit of the grouping id and never grouped away.
    return grouped.withColumn("level", level_of(F.shiftright("_g", 1), spec)).drop("_g")


def hierarchy_totals(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Target by date for every node of the hierarchy, 0 where a date is missing.

    One ``GROUPING SETS`` shuffle gives all levels. The dates are an array of
    the calendar's length, exploded on the node list to fill the gaps.
    """
    totals = node_totals(df, spec)
    dates = df.select(spec.time).distinct().agg(F.collect_list(spec.time).alias("d")).scalar()
    nodes = totals.select("level", *spec.keys).distinct().withColumn(spec.time, F.explode(dates))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("level", *spec.keys, spec.time)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = nodes.alias("a").join(totals.alias("b"), cond, "left")
    cols = [F.col(f"a.{c}") for c in ("level", *spec.keys, spec.time)]
    return joined.select(*cols, F.coalesce("b.y", F.lit(0.0)).alias("y"))
