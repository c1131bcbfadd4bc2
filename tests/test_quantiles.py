"""Exact quantiles where brackets hold too many values to be ordered at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import quantiles
from panelcast.operators.quantiles import exact_quantiles, order_key

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


def tables():
    rng = np.random.default_rng(8)
    n = 6_000
    far = rng.normal(0, 1, n)
    far[17] = 1e300
    wide = np.concatenate([2.0 ** np.arange(-1_060, 1_020), -(2.0 ** np.arange(-1_060, 1_020))])
    return {
        "lognormal": np.exp(rng.normal(0, 6, n)),
        "outlier": far,
        "equal": np.full(n, 3.25),
        "two": np.where(rng.random(n) < 0.5, -1.0, 1e9),
        "powers": wide,
        "near": 1.0 + rng.integers(0, 50, n) * 2.0**-52,
        "signs": np.concatenate([[-0.0, 0.0, 5e-324, -5e-324], rng.normal(0, 1e-310, n)]),
        "ties": rng.integers(-3, 4, n).astype(float),
        "whole": rng.integers(-(10**9), 10**9, n).astype(float),
    }


@pytest.mark.parametrize("ordered_rows", [1, 40, 10**9])
def test_any_distribution(spark, ordered_rows):
    named = tables()
    rows = [(k, float(v)) for k, values in named.items() for v in values]
    df = spark.createDataFrame(rows, "kind string, v double").cache()
    got = {(r.kind, r.prob): r.value for r in exact_quantiles(df, "v", PROBS, ["kind"], accuracy=100, ordered_rows=ordered_rows).collect()}
    assert len(got) == len(named) * len(PROBS)
    for kind, values in named.items():
        for p in PROBS:
            values = np.sort(values)
            h = p * (len(values) - 1)
            lo, hi = values[int(np.floor(h))], values[int(np.ceil(h))]
            assert got[kind, p] == pytest.approx(lo + (hi - lo) * (h - np.floor(h)), rel=1e-12, abs=0), (kind, p)


def test_without_groups_and_without_rows(spark):
    values = np.random.default_rng(1).standard_cauchy(5_000)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = {r.prob: r.value for r in exact_quantiles(df, "v", PROBS, accuracy=50, ordered_rows=5).collect()}
    for p in PROBS:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12)
    assert exact_quantiles(df.where("v is null"), "v", [0.5]).where("value is not null").count() == 0


def test_keys_order_as_doubles_do(spark):
    rng = np.random.default_rng(2)
    bits = rng.integers(-(2**63), 2**63 - 1, 20_000, dtype=np.int64).view(np.float64)
    edges = np.array([0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), 1.0, np.nextafter(1, 0), np.nextafter(1, 2), 1.7976931348623157e308, np.inf, -np.inf, 2.0**1023, np.nextafter(2.0**1023, 0)])
    values = np.concatenate([bits[np.isfinite(bits)], edges, -edges, 2.0 ** np.arange(-1074, 1024)])
    keys = np.array([r.k for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").select("i", order_key(F.col("v")).alias("k")).orderBy("i").collect()])
    whole = np.abs(values).view(np.int64)
    assert (keys == np.where(values < 0, -whole, whole)).all()
    nan = spark.range(1).select(order_key(F.lit(float("nan"))).alias("k"), order_key(F.lit(float("inf"))).alias("inf")).first()
    assert nan.k > nan.inf


def test_small_groups_need_no_brackets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    named = {f"small{i}": rng.normal(0, 10, 1 + i).round(1) for i in range(60)} | {"large": rng.normal(0, 1, 500)}
    bracketed, brackets = [], quantiles._brackets

    def seen(rows, *more):
        bracketed.extend(r.kind for r in rows.select("kind").distinct().collect())
        return brackets(rows, *more)

    monkeypatch.setattr(quantiles, "_brackets", seen)
    rows = [(k, float(v)) for k, values in named.items() for v in values] + [("small1", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "kind string, v double").cache()
    for most, large in ((100, ["large"]), (1_000, [])):
        bracketed.clear()
        got = {(r.kind, r.prob): r.value for r in exact_quantiles(df, "v", PROBS, ["kind"], accuracy=most).collect()}
        assert bracketed == large and len(got) == len(named) * len(PROBS)
        assert all(v == pytest.approx(np.quantile(named[k], p), rel=1e-12, abs=1e-12) for (k, p), v in got.items())
