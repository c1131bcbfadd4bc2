"""Panel construction: cells from raw rows, and the merge with its dimensions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.joins import lookup_join
from panelcast.session import stage
from panelcast.sources.tables import read_table
from panelcast.spec import DEFAULT, PanelSpec

# The ISO weeks that hold the four calendar events.
EVENT_WEEKS = {"Super Bowl": 6, "Labor Day": 36, "Thanksgiving": 47, "Christmas": 52}
PROMO_START = "1998-06-05"

# The event dates of the published weekly retail panel.
EVENT_DATES = {
    "Super Bowl": ("2010-02-12", "2011-02-11", "2012-02-10", "2013-02-08"),
    "Labor Day": ("2010-09-10", "2011-09-09", "2012-09-07", "2013-09-06"),
    "Thanksgiving": ("2010-11-26", "2011-11-25", "2012-11-23", "2013-11-29"),
    "Christmas": ("2010-12-31", "2011-12-30", "2012-12-28", "2013-12-27"),
}


def cells(raw: DataFrame, keys: list[str], time: str, measures: Mapping[str, Column]) -> DataFrame:
    """One row per (keys, time) from raw rows.

    Raw rows of a hot key are combined on the map side first, so a key with a
    third of all rows sends at most one row per task and date to its reducer.
    Afterwards a series holds at most one row per date, which bounds every
    per-series window and group in this library by the length of the calendar.
    """
    return raw.groupBy(*keys, time).agg(*[c.alias(n) for n, c in measures.items()])


def duplicate_cells(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Cells with more than one row; empty for a valid panel."""
    return panel.groupBy(*spec.keys, spec.time).count().where("count > 1")


def friday(ts: Column) -> Column:
    """The Friday of a timestamp's ISO week."""
    return F.date_add(F.date_trunc("week", ts).cast("date"), 4)


def sales_lines(spark: SparkSession, folder: str, site: str) -> DataFrame:
    """Order lines with their site and week; amounts in whole units, so that
    sums do not depend on the order of addition."""
    line = read_table(spark, folder, "lineitem")
    supplier = read_table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    key = F.col("s_nationkey") if site == "nation" else F.col("s_suppkey")
    return (
        line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
        .withColumn("store", key.cast("int"))
        .withColumn("date", friday(F.col("l_shipdate")))
    )


def whole(c: Column) -> Column:
    return F.floor(c + 0.5).cast("double")


def sales_amount() -> Column:
    sign = F.when(F.col("l_returnflag") == "R", -0.25).otherwise(1.0)
    return F.sum(sign * whole(F.col("l_extendedprice") * (1 - F.col("l_discount"))))


def with_department(lines: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    part = read_table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("dept"))
    return lines.join(part, lines["l_partkey"] == part["p_partkey"])


def with_event_flag(fact: DataFrame) -> DataFrame:
    return fact.withColumn("is_holiday", F.weekofyear("date").isin(*EVENT_WEEKS.values()))


def train(spark: SparkSession, folder: str, site: str = "nation") -> DataFrame:
    """Fact table: sales by site (nation or supplier), product type and week."""
    lines = with_department(sales_lines(spark, folder, site), spark, folder)
    return with_event_flag(cells(lines, ["store", "dept"], "date", {"weekly_sales": sales_amount()}))


def stores(spark: SparkSession, folder: str, site: str = "nation") -> DataFrame:
    """Site dimension: type A, B or C and a size."""
    nation = read_table(spark, folder, "nation")
    supplier = read_table(spark, folder, "supplier")
    letter = F.substring(F.lit("ABC"), F.col("n_regionkey") % 3 + 1, F.lit(1))
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    if site == "nation":
        return joined.groupBy(F.col("n_nationkey").alias("store"), letter.alias("type")).agg(
            (10000 * F.count("*") + 100 * F.col("n_nationkey")).cast("int").alias("size")
        )
    return joined.select(
        F.col("s_suppkey").cast("int").alias("store"),
        letter.alias("type"),
        (10000 + F.col("s_suppkey") % 100 * 100).cast("int").alias("size"),
    )


def covariate_sums() -> dict[str, Column]:
    """Sums and counts the covariates and promotions are made of; they add up
    over departments, so one pass over the lines serves both grains."""
    promo = whole(F.col("l_extendedprice") * F.col("l_discount"))
    started = F.col("date") >= F.lit(PROMO_START).cast("date")
    kinds = {
        "markdown1": F.col("l_returnflag") == "A",
        "markdown2": F.col("l_returnflag") == "N",
        "markdown3": F.col("l_returnflag") == "R",
        "markdown4": F.col("l_linestatus") == "F",
        "markdown5": F.col("l_linestatus") == "O",
    }
    return {
        "n_lines": F.count("*"),
        "returns": F.sum((F.col("l_returnflag") == "R").cast("bigint")),
        "quantity": F.sum("l_quantity"),
        "tax": F.sum(whole(100 * F.col("l_tax"))),
        "price": F.sum(whole(F.col("l_extendedprice") / F.col("l_quantity"))),
        "discount": F.sum(whole(100 * F.col("l_discount"))),
        **{name: F.sum(F.when(started & cond, promo)) for name, cond in kinds.items()},
    }


def covariates(sums: DataFrame) -> DataFrame:
    """Covariates and promotions by site and week, from their sums at any finer
    grain. They are known for weeks with a return; other weeks have no row."""
    names = list(covariate_sums())
    total = sums.groupBy("store", "date").agg(*[F.sum(c).alias(c) for c in names])
    n = F.col("n_lines")
    return total.where("returns > 0").select(
        "store",
        "date",
        (F.col("quantity") / n).alias("temperature"),
        (2 + F.col("tax") / n).alias("fuel_price"),
        (F.col("price") / n / 7).alias("cpi"),
        (3 + F.col("discount") / n).alias("unemployment"),
        *[c for c in names if c.startswith("markdown")],
    )


def features(spark: SparkSession, folder: str, site: str = "nation") -> DataFrame:
    """Covariates and promotions by site and week."""
    lines = sales_lines(spark, folder, site)
    return covariates(cells(lines, ["store"], "date", covariate_sums()))


def merge_panel(
    fact: DataFrame, covariates: DataFrame, dimension: DataFrame, spec: PanelSpec = DEFAULT
) -> DataFrame:
    """Fact LEFT JOIN covariates LEFT JOIN dimension.

    The fact's event flag wins, so the covariates' copy is dropped first. The
    covariate join key holds the date, so a hot site is spread over its weeks.
    """
    extra = covariates.drop(spec.event)
    merged = fact.join(extra, [spec.top, spec.time], "left")
    return lookup_join(merged, dimension, [spec.top], "left")


def tables(spark: SparkSession, folder: str, site: str = "nation") -> tuple[DataFrame, DataFrame]:
    """Fact and covariate table from one pass over the lines.

    The cells hold the sales and the covariates' sums and are written once; they
    serve as the fact table and, rolled up over departments, as the covariates.
    """
    lines = with_department(sales_lines(spark, folder, site), spark, folder)
    measures = {"weekly_sales": sales_amount(), **covariate_sums()}
    base = stage(cells(lines, ["store", "dept"], "date", measures), "cells")
    fact = with_event_flag(base.select("store", "dept", "date", "weekly_sales"))
    return fact, covariates(base)


def panel(spark: SparkSession, folder: str, site: str = "nation") -> DataFrame:
    """The merged panel of the data folder."""
    fact, extra = tables(spark, folder, site)
    return merge_panel(fact, extra, stores(spark, folder, site))


def listed_calendar(spark: SparkSession, dates: Mapping[str, tuple[str, ...]] = EVENT_DATES) -> DataFrame:
    """Event name by date, from a list of dates per event."""
    rows = [(name, d) for name, days in dates.items() for d in days]
    return spark.createDataFrame(rows, "holiday string, date string").withColumn(
        "date", F.col("date").cast("date")
    )


def event_calendar(fact: DataFrame, time: str = "date") -> DataFrame:
    """Event name by date: the Friday of each event's ISO week, for every year that
    the dates of ``fact`` touch."""
    weeks = F.array(*[F.struct(F.lit(n).alias("holiday"), F.lit(w).alias("week")) for n, w in EVENT_WEEKS.items()])
    bounds = fact.agg(F.year(F.min(time)).alias("lo"), F.year(F.max(time)).alias("hi")).where("lo IS NOT NULL")
    years = bounds.select(F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)).alias("year"))
    monday_1 = F.date_trunc("week", F.make_date("year", F.lit(1), F.lit(4))).cast("date")
    return years.withColumn("event", F.explode(weeks)).select(
        F.col("event.holiday").alias("holiday"), F.date_add(monday_1, F.col("event.week") * 7 - 3).alias("date")
    )
