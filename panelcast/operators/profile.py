"""Profiling a panel: overview, quality, group statistics, histograms, KPIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.functions import scalars as S
from panelcast.operators.joins import lookup_join, scalars
from panelcast.operators.quantiles import quantile_columns
from panelcast.spec import DEFAULT, PanelSpec


def overview(tables: dict[str, DataFrame], spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row per table: rows, columns, date range and distinct keys."""
    out = None
    for name, df in tables.items():
        has = set(df.columns)
        date = F.col(spec.time) if spec.time in has else F.lit(None).cast("date")
        distinct = [
            (F.countDistinct(k) if k in has else F.lit(None).cast("bigint")).alias(f"n_{k}")
            for k in spec.keys
        ]
        row = df.agg(
            F.count("*").alias("n_rows"), F.min(date).alias("first"), F.max(date).alias("last"), *distinct
        ).select(
            F.lit(name).alias("table"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "*"
        )
        out = row if out is None else out.unionByName(row)
    return out


def target_quality(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Counts and shares of negative, zero and positive targets."""
    y = F.col(spec.target)
    tests = S.signs(y)
    n = F.count(y)
    cells = [F.count(y).alias("n"), F.sum(y).alias("total")]
    for name, c in tests.items():
        cells += [F.count_if(c).alias(f"n_{name}"), S.percent(F.count_if(c), n).alias(f"pct_{name}")]
    low = F.when(y < 0, y)
    return df.agg(*cells, F.min(low).alias("lowest_negative"), F.max(low).alias("highest_negative"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max, one row per column."""
    long = df.unpivot([], list(cols), "column", "value").where("value is not null")
    basics = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = quantile_columns(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column"])
    return basics.join(quartiles, "column")


def missing_report(df: DataFrame) -> DataFrame:
    """Null count and share of every column, in one pass."""
    counts = df.agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    long = counts.unpivot(["_n"], list(df.columns), "column", "n_missing")
    return long.select("column", "n_missing", S.percent(F.col("n_missing"), F.col("_n")).alias("pct_missing"))


def missing_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: missing cells, columns with gaps, the worst column and its share."""
    out = None
    for name, df in tables.items():
        gap = F.col("n_missing") > 0
        worst = F.struct("n_missing", "pct_missing")
        row = missing_report(df).agg(
            F.lit(name).alias("table"),
            F.sum("n_missing").alias("n_missing"),
            F.count_if(gap).alias("n_columns"),
            F.max_by("column", F.struct("n_missing", "column")).alias("worst_column"),
            F.max(worst)["pct_missing"].alias("worst_pct"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def event_impact(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Target with and without events, multiplier and boost, as one row."""
    y, flag = F.col(spec.target), F.col(spec.event).cast("boolean")
    on, off = F.when(flag, y), F.when(~flag, y)
    cells = []
    for name, c in (("event", on), ("regular", off)):
        cells += [
            F.avg(c).alias(f"{name}_mean"),
            F.sum(c).alias(f"{name}_total"),
            F.count(c).alias(f"{name}_rows"),
            F.stddev(c).alias(f"{name}_std"),
        ]
    multiplier = S.ratio(F.col("event_mean"), F.col("regular_mean"))
    return df.agg(*cells).withColumns({"multiplier": multiplier, "boost_pct": (multiplier - 1) * 100})


def event_medians(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    return quantile_columns(df, spec.target, {"median": 0.5}, [spec.event])


def group_profile(df: DataFrame, by: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    y = F.col(spec.target)
    return df.groupBy(*by).agg(
        F.avg(y).alias("mean"), F.sum(y).alias("total"), F.count(y).alias("n"), F.stddev(y).alias("std")
    )


def top_k(df: DataFrame, value: str, key: str, k: int = 10, bottom: bool = False) -> DataFrame:
    order = F.col(value).asc() if bottom else F.col(value).desc()
    return df.where(F.col(value).isNotNull()).orderBy(order, key).limit(k)


def in_top_sets(df: DataFrame, sizes: dict[str, int], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Rows whose key is among the top k totals, for each key named. The key
    sets are limits of fixed size, so they are broadcast."""
    out = df
    for key, k in sizes.items():
        totals = df.groupBy(key).agg(F.sum(spec.target).alias("_t"))
        out = out.join(F.broadcast(top_k(totals, "_t", key, k).select(key)), key, "left_semi")
    return out


def label_events(df: DataFrame, calendar: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Event name of each row, 'Regular' otherwise; the calendar is a fixed list."""
    out = df.join(F.broadcast(calendar), spec.time, "left")
    return out.withColumn("holiday", F.coalesce("holiday", F.lit("Regular")))


def known_promo_means(df: DataFrame, promos: Sequence[str]) -> DataFrame:
    long = df.unpivot([], list(promos), "promo", "value").where("value is not null")
    return long.groupBy("promo").agg(F.count("value").alias("n"), F.avg("value").alias("mean_value"))


def promo_effect(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per promotion: availability, mean value, sales with and without it."""
    long = df.unpivot([spec.target], list(spec.promos), "promo", "value")
    known, y = F.col("value").isNotNull(), F.col(spec.target)
    out = long.groupBy("promo").agg(
        S.percent(F.count("value"), F.count("*")).alias("availability_pct"),
        F.avg("value").alias("mean_value"),
        F.avg(F.when(known, y)).alias("sales_with"),
        F.avg(F.when(~known, y)).alias("sales_without"),
    )
    lift = F.when(F.col("sales_without") > 0, S.ratio(F.col("sales_with"), F.col("sales_without")))
    return out.withColumn("ratio", F.coalesce(lift, F.lit(0.0)))


def totals_by_time(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    return df.groupBy(spec.time).agg(F.sum(spec.target).alias("total"), F.avg(spec.target).alias("mean"))


def best_and_worst(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with the highest and lowest value; the smallest key wins ties."""
    known = df.where(F.col(value).isNotNull())
    return known.agg(
        F.max_by(key, F.struct(F.col(value), -F.col(key))).alias("best"),
        F.min_by(key, F.struct(F.col(value), F.col(key))).alias("worst"),
        F.max(value).alias("best_value"),
        F.min(value).alias("worst_value"),
        S.percent(F.max(value) - F.min(value), F.min(value)).alias("variation_pct"),
    )


def yearly_growth(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Totals by year and growth on the year before; years are few."""
    years = df.groupBy(F.year(spec.time).alias("year")).agg(
        F.sum(spec.target).alias("total"), F.avg(spec.target).alias("mean")
    )
    before = F.lag("total", 1).over(W.orderBy("year"))
    return years.withColumn("growth_pct", S.percent(F.col("total") - before, before))


def first_to_last_growth(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Growth of the last year's total on the first year's."""
    years = df.groupBy(F.year(spec.time).alias("year")).agg(F.sum(spec.target).alias("total"))
    return years.agg(
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        S.percent(
            F.max_by("total", "year") - F.min_by("total", "year"), F.min_by("total", "year")
        ).alias("growth_pct"),
    )


def store_profile(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Site statistics; size and type depend on the site, so they are group keys."""
    return group_profile(df, [spec.top, spec.type, spec.size], spec)


def headline(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row of key figures, with the best site, department and type."""
    y = F.col(spec.target)
    row = df.agg(
        F.sum(y).alias("total"),
        F.avg(y).alias("mean"),
        F.countDistinct(spec.keys[0]).alias("n_sites"),
        F.countDistinct(spec.keys[-1]).alias("n_departments"),
        F.min(spec.time).alias("first"),
        F.max(spec.time).alias("last"),
        F.avg(F.when(F.col(spec.event), y)).alias("event_mean"),
        F.avg(F.when(~F.col(spec.event), y)).alias("regular_mean"),
    )
    best = {}
    for name, key in (("top_site", spec.keys[0]), ("top_department", spec.keys[-1]), ("top_type", spec.type)):
        means = df.groupBy(key).agg(F.sum(spec.target).alias("v"))
        best[name] = top_k(means, "v", key, 1).select(key).scalar()
    return row.withColumns(best)


def promo_counts(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    known: Column = F.lit(0)
    for c in spec.promos:
        known = known + F.col(c).isNotNull().cast("int")
    return df.groupBy(spec.time).agg(F.sum(known).alias("promo_cells"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts and their share of all rows."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("pct", S.percent(F.col("n"), total))


def pivot_means(df: DataFrame, sizes: dict[str, int], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Mean target of the top sites by the top departments, long form with 0 for
    a missing combination; both key sets have a fixed size."""
    row, col = sizes
    top = in_top_sets(df, sizes, spec)
    means = top.groupBy(row, col).agg(F.avg(spec.target).alias("mean"))
    columns = means.agg(F.array_sort(F.collect_set(col)).alias("c")).scalar()
    grid = means.select(row).distinct().withColumn(col, F.explode(columns))
    filled = grid.join(means, [row, col], "left")
    return filled.withColumn("mean", F.coalesce("mean", F.lit(0.0)))


def pivot_by_event(df: DataFrame, by: str, fn=F.sum, spec: PanelSpec = DEFAULT) -> DataFrame:
    y, flag = F.col(spec.target), F.col(spec.event)
    return df.groupBy(by).agg(fn(F.when(flag, y)).alias("event"), fn(F.when(~flag, y)).alias("regular"))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram with empty bins; the last edge is inclusive."""
    s = scalars(df, lo=F.min(col), hi=F.max(col))
    lo, hi = s["lo"].cast("double"), s["hi"].cast("double")
    at = F.floor(S.ratio(F.col(col) - lo, hi - lo) * bins)
    bin_no = F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(col).isNotNull()).groupBy(bin_no.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    step = (hi - lo) / bins
    return grid.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * step).alias("left_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_plot(df: DataFrame, col: str, by: str) -> DataFrame:
    """Five numbers, 1.5 IQR fences and the number of rows beyond them."""
    names = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    q = quantile_columns(df, col, names, [by])
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    fences = q.withColumns({"low_fence": F.col("q25") - reach, "high_fence": F.col("q75") + reach})
    rows = lookup_join(df.select(by, F.col(col).alias("_v")), fences, [by], "inner", computed=True)
    outside = (F.col("_v") < F.col("low_fence")) | (F.col("_v") > F.col("high_fence"))
    return rows.groupBy(by, *names, "low_fence", "high_fence").agg(
        F.min("_v").alias("min"), F.max("_v").alias("max"), F.count_if(outside).alias("n_outside")
    )


def monthly_promo(df: DataFrame, promo: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    month = F.trunc(spec.time, "month").alias("month")
    known = df.where(F.col(promo).isNotNull())
    return known.groupBy(month).agg(
        F.avg(promo).alias("mean_promo"), F.avg(spec.target).alias("mean_sales")
    )
