"""The product form of the pooled regression."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import models
from panelcast.operators.models import MultiplicativeRegression

STEPS = 4


def simulated(spark, series=1_500, length=70, noise=0.2, seed=3, levels=None):
    rng = np.random.default_rng(seed)
    dates = [dt.date(2015, 1, 2) + dt.timedelta(days=7 * t) for t in range(length)]
    t = np.arange(length)
    shape = np.exp(0.006 * t + 0.4 * np.sin(2 * np.pi * t / 52))
    levels = rng.uniform(5, 500, series) if levels is None else levels
    rows = []
    for s, level in enumerate(levels):
        y = level * (shape + noise * rng.normal(0, 1, length))
        rows += [(s, "a", d, float(v), False, float(np.sin(i))) for i, (d, v) in enumerate(zip(dates, y))]
    df = spark.createDataFrame(rows, "store int, dept string, date date, weekly_sales double, is_holiday boolean, price double")
    calendar = spark.createDataFrame([(dates[3], "Fair")], "date date, holiday string")
    return df, calendar, shape, levels


def small(**more):
    return MultiplicativeRegression(order=2, hinges=0, ridge=1e-6, **more)


def test_limits_cover_as_many_rows_as_they_should(spark):
    df, calendar, shape, levels = simulated(spark)
    out = small().run(df, calendar, ["price"], STEPS).toPandas()
    assert sorted(out.step.unique()) == [1, 2, 3, 4] and len(out) == 1_500 * STEPS
    inside = out.assign(ok=(out.actual >= out.lower) & (out.actual <= out.upper)).groupby("step").ok.mean()
    assert ((inside > 0.93) & (inside < 0.97)).all(), inside
    # The product is found, and each series' own level.
    known = shape[: -STEPS].mean()
    want = out.store.map(lambda s: levels[s]) * out.step.map(lambda k: shape[-STEPS - 1 + k])
    assert (np.abs(out.predicted / want - 1) < 0.15).mean() > 0.95 and known > 0


def test_negative_and_zero_rows_count(spark):
    levels = np.array([*np.linspace(10, 90, 60), *np.linspace(-90, -10, 20)])
    df, calendar, _, _ = simulated(spark, 80, 80, 0.02, 5, levels)
    df = df.withColumn("weekly_sales", F.when((F.col("store") < 5) & (F.dayofmonth("date") < 4), 0.0).otherwise(F.col("weekly_sales")))
    out = small().run(df, calendar, [], STEPS).toPandas()
    assert (out[out.store >= 60].predicted < 0).all() and (out[out.store < 60].predicted > 0).all()
    late = out[(out.store >= 5) & (out.store < 60)]
    assert (np.abs(late.predicted / late.actual - 1) < 0.25).mean() > 0.95


def test_the_last_step_solves_its_equations(spark):
    """Weighted sums of errors times each column are 0 at the end, without a penalty."""
    df, calendar, _, _ = simulated(spark, 60, 70, 0.1, 7)
    model = MultiplicativeRegression(order=1, hinges=0, ridge=0.0, rounds=12)
    span = df.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
    rows, names = model.design(df, calendar.limit(0), span, [], models.DEFAULT)
    out, exponent = model._fit(rows, F.lit(dt.date(2100, 1, 1)), names, models.DEFAULT)
    v, weight = F.col("weekly_sales") / F.col("_level"), F.pow(F.col("_level") / F.col("_size"), 2)
    error = weight * (v - F.exp(exponent))
    sums = out.agg(*[F.sum(error * F.col(c)).alias(c) for c in names], F.sum(error).alias("one"), F.sum(F.abs(error)).alias("all")).first().asDict()
    whole = sums.pop("all")
    assert all(abs(x) < 1e-6 * whole for x in sums.values()), sums


def test_series_without_history_or_level(spark, week):
    df, calendar, _, _ = simulated(spark, 20, 60, 0.05, 9)
    extra = [(100, "new", week(58), 5.0, False, 0.0), (101, "zero", week(10), 0.0, False, 0.0), (101, "zero", week(58), 1.0, False, 0.0), (102, "none", week(10), None, False, 0.0), (102, "none", week(59), None, False, 0.0)]
    both = df.unionByName(spark.createDataFrame(extra, df.schema))
    got = {(r.store, r.date): r for r in small().run(both, calendar, ["price"], STEPS).collect()}
    assert got[100, week(58)].predicted is None and got[102, week(59)].predicted is None
    assert got[101, week(58)].predicted == 0 and got[101, week(58)].lower <= 0 <= got[101, week(58)].upper
    assert got[5, week(59)].lower < got[5, week(59)].predicted < got[5, week(59)].upper
    nothing = small().run(df.where("false"), calendar, ["price"], STEPS)
    assert nothing.count() == 0 and {"step", "lower", "upper"} <= set(nothing.columns)


def test_short_panels_have_no_limits(spark):
    df, calendar, _, _ = simulated(spark, 10, STEPS + 2, 0.05, 11)
    out = small().run(df, calendar, [], STEPS).toPandas()
    assert len(out) == 10 * STEPS and out.predicted.notna().all()
