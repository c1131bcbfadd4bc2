"""Feature engineering on a merged panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.functions import scalars as S
from panelcast.functions import windows as WF
from panelcast.operators.joins import lookup_join, scalars
from panelcast.session import stage
from panelcast.spec import DEFAULT, PanelSpec

# Lags, rolling windows and covariate products of the feature set.
LAGS = (1, 2, 4, 8, 12, 52)
WINDOWS = (4, 8, 12, 24, 52)
ROLLING = {"mean": F.avg, "std": F.stddev, "max": F.max, "min": F.min}
PRODUCTS = (("unemployment", "temperature"), ("cpi", "fuel_price"))


def add_calendar(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    return df.withColumns(S.calendar_parts(F.col(spec.time)))


def add_cyclic(df: DataFrame) -> DataFrame:
    """Needs ``month`` and ``week`` from ``add_calendar``."""
    month, week = S.cyclic(F.col("month"), 12), S.cyclic(F.col("week"), 52)
    return df.withColumns(
        {"month_sin": month[0], "month_cos": month[1], "week_sin": week[0], "week_cos": week[1]}
    )


def add_event_weight(df: DataFrame, spec: PanelSpec = DEFAULT, weight: float = 5.0) -> DataFrame:
    return df.withColumn("event_weight", S.event_weight(F.col(spec.event), weight))


def add_event_neighbours(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """0/1 flags: the next (previous) row of the series is an event."""
    w = WF.series_window(spec.keys, spec.time)
    flag = F.col(spec.event).cast("int")
    return df.withColumns(
        {
            "pre_event": F.coalesce(F.lead(flag, 1).over(w), F.lit(0)),
            "post_event": F.coalesce(F.lag(flag, 1).over(w), F.lit(0)),
        }
    )


def add_promos(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Null promotions to 0, their total, active flags and intensity by size."""
    out = df.withColumns({c: S.zero_if_null(F.col(c)) for c in spec.promos})
    out = out.withColumns({f"{c}_active": S.promo_active(F.col(c)) for c in spec.promos})
    out = out.withColumn("promo_total", S.promo_total(spec.promos))
    if spec.size and spec.size in df.columns:
        intensity = S.promo_intensity(F.col("promo_total"), F.col(spec.size))
        out = out.withColumn("promo_intensity", intensity)
    return out


def add_products(df: DataFrame, pairs: tuple[tuple[str, str], ...] = PRODUCTS) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def add_stress_index(
    df: DataFrame,
    cols: tuple[str, str] = ("unemployment", "fuel_price"),
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Sum of z-scores (sample std); means and stds come as scalars."""
    base = df if fit_on is None else fit_on
    aggs = {}
    for c in cols:
        aggs |= {f"{c}_m": F.avg(c), f"{c}_s": F.stddev(c)}
    s = scalars(base, **aggs)
    index: Column = F.lit(0.0)
    for c in cols:
        index = index + S.ratio(F.col(c) - s[f"{c}_m"], s[f"{c}_s"])
    return df.withColumn("stress_index", index)


def add_lags(
    df: DataFrame,
    lags: tuple[int, ...] = LAGS,
    col: str | None = None,
    spec: PanelSpec = DEFAULT,
    calendar: bool = False,
) -> DataFrame:
    """Lags of a column by row, or by calendar step with ``calendar=True``.

    The calendar form reads the window one step range at a time (a range frame
    on the day number), so it needs no self-join.
    """
    col = col or spec.target
    if not calendar:
        w = WF.series_window(spec.keys, spec.time)
        return df.withColumns({f"{col}_lag_{k}": F.lag(col, k).over(w) for k in lags})
    w = W.partitionBy(*spec.keys).orderBy(F.unix_date(spec.time))
    steps = {k: -k * spec.step_days for k in lags}
    return df.withColumns(
        {f"{col}_lag_{k}": F.max(col).over(w.rangeBetween(d, d)) for k, d in steps.items()}
    )


def add_rolling(
    df: DataFrame,
    windows: tuple[int, ...] = WINDOWS,
    stats: tuple[str, ...] = ("mean", "std", "max", "min"),
    col: str | None = None,
    spec: PanelSpec = DEFAULT,
    exclude_current: bool = False,
) -> DataFrame:
    """Rolling statistics; ``exclude_current`` keeps the target out of its own row."""
    col = col or spec.target
    w = WF.series_window(spec.keys, spec.time)
    return df.withColumns(
        {
            f"{col}_{s}_{n}": WF.full_rolling(F.col(col), ROLLING[s], n, w, exclude_current)
            for n in windows
            for s in stats
        }
    )


def add_group_means(
    df: DataFrame, spec: PanelSpec = DEFAULT, fit_on: DataFrame | None = None
) -> DataFrame:
    """Mean target of the row's type, lowest key and series, mapped back. One
    pass with GROUPING SETS computes the means of all groups."""
    base = df if fit_on is None else fit_on
    groups = {"series_mean": list(spec.keys)}
    if len(spec.keys) > 1:
        groups = {f"{spec.keys[-1]}_mean": [spec.keys[-1]], **groups}
    if spec.type and spec.type in df.columns:
        groups = {"type_mean": [spec.type], **groups}
    cols = list(dict.fromkeys(c for by in groups.values() for c in by))
    sets = base.groupingSets(list(groups.values()), *cols)
    table = stage(sets.agg(F.avg(spec.target).alias("_mean"), F.grouping_id().alias("_g")), "means")
    out = df
    for name, by in groups.items():
        # Bits of the grouping id mark the columns grouped away.
        away = sum(2 ** (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in by)
        means = table.where(F.col("_g") == away).select(*by, F.col("_mean").alias(name))
        out = lookup_join(out, means, by, "left")
    return out


def trend_slopes(df: DataFrame, spec: PanelSpec = DEFAULT, col: str | None = None) -> DataFrame:
    """Least-squares slope of a column on its row position, per series; series
    under three rows get 0."""
    col = col or spec.target
    w = WF.series_window(spec.keys, spec.time)
    at = df.select(*spec.keys, F.col(col).alias("y"), WF.position(w).alias("p"))
    slope = F.when(F.count("y") >= 3, F.regr_slope(F.col("y"), F.col("p").cast("double")))
    return at.groupBy(*spec.keys).agg(F.coalesce(slope, F.lit(0.0)).alias("trend_slope"))


def add_trend(
    df: DataFrame, spec: PanelSpec = DEFAULT, fit_on: DataFrame | None = None
) -> DataFrame:
    """Series slope on each row. Fitted on the rows themselves the slope comes
    from window sums on the sort the lags already use; with ``fit_on`` it is
    looked up."""
    if fit_on is not None:
        return lookup_join(df, trend_slopes(fit_on, spec), list(spec.keys), "left", computed=True)
    w = WF.series_window(spec.keys, spec.time)
    every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    y, p = F.col(spec.target), F.col("_p")
    slope = F.when(
        F.count(y).over(every) >= 3,
        S.ratio(F.covar_pop(p, y).over(every), F.var_pop(p).over(every)),
    )
    return (
        df.withColumn("_p", WF.position(w).cast("double"))
        .withColumn("trend_slope", F.coalesce(slope, F.lit(0.0)))
        .drop("_p")
    )


def engineer(
    panel: DataFrame,
    spec: PanelSpec = DEFAULT,
    exclude_current: bool = False,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """The full feature set. With ``exclude_current`` and ``fit_on`` no feature
    of a row sees its own target or rows outside the fitting set."""
    out = add_event_neighbours(add_event_weight(panel, spec), spec)
    out = add_promos(add_cyclic(add_calendar(out, spec)), spec)
    out = add_lags(out, spec=spec)
    out = add_rolling(out, spec=spec, exclude_current=exclude_current)
    out = add_group_means(out, spec, fit_on)
    out = add_products(out)
    out = add_stress_index(out, fit_on=panel if fit_on is None else fit_on)
    return add_trend(out, spec, fit_on)
