"""Statistics of panels and of every series in them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.functions import scalars as S
from panelcast.functions import special
from panelcast.functions import windows as WF
from panelcast.spec import DEFAULT, PanelSpec


# --- correlation -----------------------------------------------------------------


def pearson(x: Column, y: Column) -> Column:
    """Correlation over jointly known pairs; NULL if either side is constant."""
    x, y = x.cast("double"), y.cast("double")
    joint_x, joint_y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(joint_x) * F.stddev_pop(joint_y))


def pair_count(x: Column, y: Column) -> Column:
    return F.count(F.when(x.isNotNull() & y.isNotNull(), 1))


def _as_rows(df: DataFrame, by: Sequence[str], structs: list[Column]) -> DataFrame:
    """One aggregate row per group with an array of results, turned into rows."""
    wide = df.groupBy(*by).agg(F.array(*structs).alias("_r"))
    return wide.select(*by, F.inline("_r"))


def correlations(
    df: DataFrame, target: str, features: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Correlation of each feature with the target, all in one pass."""
    y = F.col(target)
    structs = [
        F.struct(
            F.lit(f).alias("feature"),
            pair_count(F.col(f), y).alias("n"),
            pearson(F.col(f), y).alias("r"),
        )
        for f in features
    ]
    return _as_rows(df, by, structs)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise correlations ``(a, b, n, r)`` for a < b in the order given."""
    structs = [
        F.struct(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            pair_count(F.col(a), F.col(b)).alias("n"),
            pearson(F.col(a), F.col(b)).alias("r"),
        )
        for i, a in enumerate(cols)
        for b in cols[i + 1 :]
    ]
    return _as_rows(df, (), structs)


def correlation_classes(corr: DataFrame) -> DataFrame:
    """Listed correlations with their strength and direction."""
    listed = corr.where(F.abs("r") > 0.1)
    sign = F.when(F.col("r") > 0, "positive").otherwise("negative")
    return listed.withColumns({"strength": S.strength_label(F.col("r")), "direction": sign})


def strongest(corr: DataFrame, k: int = 3) -> DataFrame:
    return corr.where("r is not null").orderBy(F.abs("r").desc(), "feature").limit(k)


def with_significance(corr: DataFrame, least: int = 10, level: float = 0.05) -> DataFrame:
    """t statistic and two-sided p-value of correlations on more than ``least`` pairs."""
    r, n = F.col("r"), F.col("n")
    t = r * F.sqrt(F.try_divide((n - 2).cast("double"), F.greatest(1 - r * r, F.lit(0.0))))
    known = corr.where((n > least) & r.isNotNull()).withColumn("t", t)
    known = known.withColumn("p_value", special.t_p_value(F.col("t"), n - 2))
    # An exact linear relation has no finite t; its p-value is 0.
    known = known.withColumn("p_value", F.when(F.col("t").isNull(), 0.0).otherwise(F.col("p_value")))
    return known.withColumn("significant", F.col("p_value") < level)


def lagged_correlations(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    keys: Sequence[str],
    time: str,
    lags: Sequence[int] = (0, 1, 2, 3),
) -> DataFrame:
    """Correlation of the target with each feature's lags, per series lags."""
    w = WF.series_window(list(keys), time)
    lagged = df.select(
        target, *[F.lag(f, k).over(w).alias(f"{f}__{k}") for f in features for k in lags]
    )
    y = F.col(target)
    structs = [
        F.struct(
            F.lit(f).alias("feature"),
            F.lit(k).alias("lag"),
            pair_count(F.col(f"{f}__{k}"), y).alias("n"),
            pearson(F.col(f"{f}__{k}"), y).alias("r"),
        )
        for f in features
        for k in lags
    ]
    return _as_rows(lagged, (), structs)


def strongest_lag(lagged: DataFrame) -> DataFrame:
    """The lag with the largest absolute correlation; the smaller lag wins ties."""
    rank = F.struct(F.abs("r"), -F.col("lag"))
    return lagged.where("r is not null").groupBy("feature").agg(
        F.max_by("lag", rank).alias("lag"), F.max_by("r", rank).alias("r")
    )


def predictive_gain(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    keys: Sequence[str],
    time: str,
    least: int = 20,
    threshold: float = 0.01,
) -> DataFrame:
    """R² of the target on its own two lags, and with two lags of a feature.

    The data is reduced to one covariance matrix per feature. Eliminating the
    regressors from it one by one leaves the target's unexplained variance. A lag is
    the row before on which target and feature are known: all features take theirs
    from one window over the series, and no row is copied per feature. The
    co-moments are merged with their means, so a large offset costs no digits.
    """
    y, names, wide, structs = F.col(target).cast("double"), ["y", "y1", "y2", "x1", "x2"], {}, []
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        wide[f"_{i}_y"], wide[f"_{i}_x"] = F.when(x.isNotNull(), y), F.when(y.isNotNull(), x)
    rows = df.select(*keys, time, *[c.alias(n) for n, c in wide.items()])
    rows = rows.select("*", *[_lag_known(c, k, keys, time).alias(f"{c}{k}") for c in wide for k in (1, 2)])
    for i, f in enumerate(features):
        full = reduce(Column.__and__, [F.col(f"_{i}_{n}").isNotNull() for n in names])
        cell = {n: F.when(full, F.col(f"_{i}_{n}")) for n in names}
        structs.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.count_if(full).alias("n"),
                *[F.covar_pop(cell[a], cell[b]).alias(_cell(a, b)) for j, a in enumerate(names) for b in names[j:]],
                *[F.var_pop(cell[n]).alias(f"v_{n}") for n in names],
            )
        )
    table = _as_rows(rows, (), structs).where(F.col("n") + 2 > least)
    own = eliminate(eliminate(table, names, "y1"), names[:1] + names[2:], "y2")
    own = own.withColumn("r2_without", 1 - S.ratio(F.col(_cell("y", "y")), F.col("v_y")))
    both = eliminate(eliminate(own, ["y", "x1", "x2"], "x1"), ["y", "x2"], "x2")
    both = both.withColumn("r2_with", 1 - S.ratio(F.col(_cell("y", "y")), F.col("v_y")))
    gain = F.col("r2_with") - F.col("r2_without")
    return both.select("feature", "n", "r2_without", "r2_with").withColumns(
        {"gain": gain, "strength": F.greatest(gain, F.lit(0.0)), "significant": gain > threshold}
    )


def _lag_known(col: str, k: int, keys: Sequence[str], time: str) -> Column:
    """The k-th known value before a row of its series."""
    by = ", ".join(f"`{c}`" for c in keys)
    return F.expr(f"lag(`{col}`, {k}) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY `{time}`)")


def _cell(a: str, b: str) -> str:
    return f"c_{min(a, b)}_{max(a, b)}"


def eliminate(table: DataFrame, names: Sequence[str], k: str) -> DataFrame:
    """Covariances of the other variables given ``k``. A variable with (almost)
    no variance of its own left explains nothing more and is passed over."""
    rest = [n for n in names if n != k]
    own = F.col(_cell(k, k))
    usable = own > F.col(f"v_{k}") * 1e-9

    def given(a: str, b: str) -> Column:
        part = F.try_divide(F.col(_cell(a, k)) * F.col(_cell(b, k)), own)
        return F.col(_cell(a, b)) - F.coalesce(F.when(usable, part), F.lit(0.0))

    return table.withColumns({_cell(a, b): given(a, b) for i, a in enumerate(rest) for b in rest[i:]})


# --- trend and seasonality -------------------------------------------------------------


def long_term_trend(df: DataFrame, cols: Sequence[str], time: str) -> DataFrame:
    """Slope per second, direction and strength of each column over time.

    Days since 2000 are regressed and rescaled: epoch seconds would lose digits.
    """
    day = (F.unix_date(time) - F.lit(10957)).cast("double")
    structs = []
    for c in cols:
        x = F.when(F.col(c).isNotNull(), day)
        slope = F.try_divide(F.covar_pop(day, F.col(c).cast("double")), F.var_pop(x)) / 86400.0
        structs.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.count(c).alias("n"),
                slope.alias("slope"),
                (F.abs(slope) > F.stddev(c) / 1000.0).alias("_strong"),
            )
        )
    rows = _as_rows(df, (), structs).where("n > 10")
    direction = F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing")
    return rows.select(
        "feature",
        "slope",
        F.coalesce(direction, F.lit("stable")).alias("direction"),
        F.when(F.col("_strong"), "strong").otherwise("weak").alias("strength"),
    )


def decompose(
    df: DataFrame, keys: Sequence[str], time: str, col: str, period: int = 52
) -> DataFrame:
    """Additive decomposition of every series with at least two full cycles.

    All steps are windows within the series keys, so the rows are shuffled once.
    """
    keys = list(keys)
    w = WF.series_window(keys, time)
    by_series, by_phase = W.partitionBy(*keys), W.partitionBy(*keys, "_phase")
    y = F.col(col)
    base = df.select(*keys, time, y.cast("double").alias("observed"))
    out = base.withColumns(
        {
            "_phase": WF.position(w) % period,
            "trend": WF.centered_average(F.col("observed"), w, period),
            "_n": F.count("*").over(by_series),
        }
    ).where(F.col("_n") >= 2 * period)
    detrended = F.col("observed") - F.col("trend")
    out = out.withColumns(
        {"_mean": F.avg(detrended).over(by_phase), "_rows": F.count("*").over(by_phase)}
    )
    # Each phase counts once in the level, however many rows it has.
    level = F.sum(F.col("_mean") / F.col("_rows")).over(by_series) / period
    out = out.withColumn("seasonal", F.col("_mean") - level)
    resid = F.col("observed") - F.col("trend") - F.col("seasonal")
    return out.withColumn("resid", resid).select(*keys, time, "observed", "trend", "seasonal", "resid")


def component_strengths(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    base = F.stddev("observed")
    names = ("trend", "seasonal", "resid")
    return parts.groupBy(*keys).agg(
        *[S.ratio(F.stddev(c), base).alias(f"{c}_strength") for c in names]
    )


def autocorrelations(
    df: DataFrame, keys: Sequence[str], time: str, col: str, lags: int = 52
) -> DataFrame:
    """Biased autocorrelations of every series, lags 0 to ``lags``."""
    arrays = _acf_arrays(df, keys, time, col, lags)
    return arrays.select(*keys, F.posexplode("acf").alias("lag", "acf"))


def _acf_arrays(df: DataFrame, keys: Sequence[str], time: str, col: str, lags: int) -> DataFrame:
    keys = list(keys)
    w = WF.series_window(keys, time)
    known = df.where(F.col(col).isNotNull())
    centered = known.select(
        *keys, time, (F.col(col) - F.avg(col).over(W.partitionBy(*keys))).alias("d")
    )
    pairs = centered.select(
        *keys, "d", *[F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, lags + 1)]
    )
    square = F.sum(F.col("d") * F.col("d"))
    cross = [F.coalesce(F.sum(F.col("d") * F.col(f"d{k}")), F.lit(0.0)) for k in range(1, lags + 1)]
    values = F.array(*[S.ratio(c, square) for c in [square, *cross]])
    return pairs.groupBy(*keys).agg(values.alias("acf"))


def listed_autocorrelations(acf: DataFrame) -> DataFrame:
    """The lags of each series whose autocorrelation exceeds 0.1."""
    return acf.where((F.col("lag") > 0) & (F.abs("acf") > 0.1))


def partial_autocorrelations(
    df: DataFrame, keys: Sequence[str], time: str, col: str, lags: int = 52
) -> DataFrame:
    """Partial autocorrelations from the autocorrelation row of each series."""

    @F.pandas_udf("array<double>")
    def recurse(acf: pd.Series) -> pd.Series:
        return pd.Series([special.partial_autocorrelations(np.asarray(a, float)) for a in acf])

    arrays = _acf_arrays(df, keys, time, col, lags).where(F.col("acf")[0].isNotNull())
    return arrays.select(*keys, F.posexplode(recurse("acf")).alias("lag", "pacf"))


def unit_root_tests(df: DataFrame, keys: Sequence[str], time: str, col: str) -> DataFrame:
    """Unit-root test of every series, on its level and its first difference.

    A group is one series: one row per date, see ``sources.panel.cells``.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    numbers = ("statistic", "p_value", "crit_1", "crit_5", "crit_10")
    schema = (
        f"{head}, form string, {', '.join(f'{c} double' for c in numbers)}, "
        "used_lags int, n_obs int, stationary boolean"
    )

    def test(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(time)[col].to_numpy(float)
        rows = []
        for form, values in (("level", y), ("difference", np.diff(y))):
            result = special.unit_root_test(values)
            if result:
                ids = dict(zip(keys, key))
                rows.append({**ids, "form": form, **result, "stationary": result["p_value"] <= 0.05})
        names = [*keys, "form", *numbers, "used_lags", "n_obs", "stationary"]
        return pd.DataFrame(rows, columns=names)

    known = df.where(F.col(col).isNotNull()).select(*keys, time, F.col(col).cast("double").alias(col))
    return known.groupBy(*keys).applyInPandas(test, schema)


def month_seasonality(df: DataFrame, cols: Sequence[str], time: str) -> DataFrame:
    """Peak and lowest month and relative variation of each column's month means."""
    means = df.groupBy(F.month(time).alias("month")).agg(*[F.avg(c).alias(c) for c in cols])
    long = means.unpivot(["month"], list(cols), "feature", "v").where("v is not null")
    return long.groupBy("feature").agg(
        F.max_by("month", F.struct(F.col("v"), -F.col("month"))).alias("peak_month"),
        F.min_by("month", F.struct("v", "month")).alias("lowest_month"),
        S.ratio(F.max("v") - F.min("v"), F.avg("v")).alias("variation"),
    )


def week_cycle(df: DataFrame, col: str, time: str, k: int = 3) -> DataFrame:
    """Top and bottom weeks of the year by mean, with the weeks' variation."""
    means = df.groupBy(F.weekofyear(time).alias("week")).agg(F.avg(col).alias("v"))
    every = W.partitionBy(F.lit(1))
    ranked = means.withColumns(
        {
            "top": F.row_number().over(every.orderBy(F.desc("v"), "week")),
            "bottom": F.row_number().over(every.orderBy("v", "week")),
            "variation": S.ratio(F.stddev("v").over(every), F.avg("v").over(every)),
        }
    )
    return ranked.where((F.col("top") <= k) | (F.col("bottom") <= k)).select(
        "week",
        F.col("v").alias("mean"),
        F.when(F.col("top") <= k, "peak").otherwise("lowest").alias("kind"),
        "variation",
    )


def temporal_profile(
    df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str], time: str
) -> DataFrame:
    """Volatility of each feature's changes, and their correlation with the
    target's changes, per series."""
    w = WF.series_window(list(keys), time)
    changes = df.select(
        WF.difference(F.col(target), w).alias(target),
        *[WF.difference(F.col(f).cast("double"), w).alias(f) for f in features],
    )
    structs = [
        F.struct(
            F.lit(f).alias("feature"),
            F.stddev_pop(f).alias("volatility"),
            pearson(F.col(f), F.col(target)).alias("change_r"),
        )
        for f in features
    ]
    return _as_rows(changes, (), structs)


def event_lift(df: DataFrame, cols: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Mean of each column on event and other rows, and the lift in percent."""
    flag = F.col(spec.event).cast("boolean")
    structs = []
    for c in cols:
        on, off = F.avg(F.when(flag, F.col(c))), F.avg(F.when(~flag, F.col(c)))
        structs.append(
            F.struct(
                F.lit(c).alias("feature"),
                on.alias("event_mean"),
                off.alias("regular_mean"),
                S.percent(on - off, off).alias("lift_pct"),
            )
        )
    return _as_rows(df, (), structs)


def select_features(
    df: DataFrame, target: str, features: Sequence[str], k: int = 15, forced: Sequence[str] = ()
) -> DataFrame:
    """The k features most correlated with the target, and the forced ones."""
    score = F.coalesce(F.abs("r"), F.lit(0.0))
    scores = correlations(df, target, features).select("feature", score.alias("score"))
    order = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), "feature"))
    ranked = scores.withColumn("_i", order)
    kept = ranked.where((F.col("_i") <= k) | F.col("feature").isin(*forced))
    return kept.select("feature", "score", (F.col("_i") > k).alias("forced"))
