"""Hot keys, large groups and plan shapes."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast import session
from panelcast.catalog import QUERIES
from panelcast.operators import clean, features, joins, profile
from panelcast.operators.quantiles import exact_quantiles, quantile_columns
from panelcast.sources import panel as P
from panelcast.sources import sinks, tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; some have none."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.col("id") % 5000)
    return spark.range(60_000).select(key.cast("int").alias("k"), (F.col("id") * 37 % 1009).cast("double").alias("v"))


def test_lookup_join_beyond_the_limit_still_matches(spark, skewed):
    right = spark.range(5000).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("x"))
    small, large = (joins.lookup_join(skewed, right, ["k"], "left", max_rows=n) for n in (10_000, 10))
    assert small.exceptAll(large).count() == 0
    with pytest.raises(ValueError):
        joins.lookup_join(skewed, right, ["k"], "full")


@pytest.mark.parametrize("ordered_rows", [2_000_000, 50])
@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_quantiles_are_exact(spark, accuracy, ordered_rows):
    rng = np.random.default_rng(accuracy)
    values = np.concatenate([rng.normal(size=9000), np.full(3000, 0.25), rng.lognormal(3, 2, 4000)])
    df = spark.createDataFrame([(int(i % 3 == 0), float(v)) for i, v in enumerate(values)], "g int, v double")
    probs = [0.0, 0.05, 0.33, 0.5, 0.95, 1.0]
    out = exact_quantiles(df, "v", probs, ["g"], accuracy, ordered_rows).collect()
    assert len(out) == 12
    for r in out:
        part = values[[(i % 3 == 0) == bool(r.g) for i in range(len(values))]]
        assert r.value == pytest.approx(np.quantile(part, r.prob), rel=1e-12)
    total = quantile_columns(df, "v", {"m": 0.5}).first()
    assert total.m == pytest.approx(np.median(values))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 11])
def test_quantiles_of_few_rows(spark, n):
    df = spark.range(n).select((F.col("id") * F.col("id")).cast("double").alias("v"))
    for r in exact_quantiles(df, "v", [0.1, 0.25, 0.9]).collect():
        assert r.value == pytest.approx(np.quantile(np.arange(n) ** 2.0, r.prob))


def test_cells_of_a_hot_series_are_one_row_per_date(spark):
    raw = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).cast("int").alias("store"),
        F.lit("a").alias("dept"),
        F.date_add(F.lit("2015-01-02").cast("date"), (F.col("id") % 10 * 7).cast("int")).alias("date"),
        F.lit(1.0).alias("y"),
    )
    out = P.cells(raw, ["store", "dept"], "date", {"weekly_sales": F.sum("y")})
    assert P.duplicate_cells(out).count() == 0
    assert out.groupBy("store").count().agg(F.max("count")).first()[0] <= 10
    assert out.agg(F.sum("weekly_sales")).first()[0] == 30_000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_series_windows_share_one_shuffle(spark, panel):
    df = panel({(1, "a"): range(5)})
    out = features.add_rolling(features.add_lags(features.add_event_neighbours(df)))
    text = plan(out)
    assert text.count("Exchange hashpartitioning(store") == 1
    assert "SinglePartition" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(P.train(spark, FOLDER))
    schema = re.search(r"ReadSchema: struct<l_partkey[^>]*>", text).group(0)
    assert "l_orderkey" not in schema and "l_tax" not in schema
    dated = plan(P.train(spark, FOLDER).where("store = 3"))
    assert "EqualTo(s_nationkey,3)" in dated


def test_scalars_need_no_join(spark, panel):
    text = plan(clean.scale(panel({(1, "a"): range(5)}), ["weekly_sales"]))
    assert "Join" not in text


@pytest.mark.parametrize("name", ["w3_rolling", "w8_interpolate", "t9_decompose", "t11_acf", "j1_join_covariates"])
def test_no_single_partition_over_the_fact(spark, name):
    assert "SinglePartition" not in plan(QUERIES[name](spark, FOLDER))


def test_no_cross_joins(spark):
    for name in ("m4_ensemble", "h3_ols_reconciliation", "a17_hierarchy_totals", "p10_stress_index"):
        text = plan(QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_bare_carriage_returns_and_missing_values(spark, tmp_path):
    (tmp_path / "stores.csv").write_bytes(b"Store,Type,Size\r1,A,151315\r2,B,202307\r")
    rows = tables.read_csv(spark, str(tmp_path / "stores.csv"), tables.STORES_SCHEMA).orderBy("store").collect()
    assert [(r.store, r.type, r["size"]) for r in rows] == [(1, "A", 151315), (2, "B", 202307)]
    (tmp_path / "x.csv").write_text("Store,Date,V\n1,2015-01-02,NaN\n2,oops,NA\n3,2015-01-09,1.5\n")
    rows = tables.read_csv(spark, str(tmp_path / "x.csv"), "store int, date string, v double").orderBy("store").collect()
    assert [r.v for r in rows] == [None, None, 1.5] and rows[1].date is None


def test_folder_of_csv_tables(spark, tmp_path):
    (tmp_path / "train.csv").write_text("Store,Dept,Date,Weekly_Sales,IsHoliday\n1,1,2010-02-12,5.5,TRUE\n")
    (tmp_path / "test.csv").write_text("Store,Dept,Date,IsHoliday\n1,1,2010-02-19,FALSE\n")
    (tmp_path / "stores.csv").write_bytes(b"Store,Type,Size\r1,A,151315\r")
    names = "Store,Date,Temperature,Fuel_Price,MarkDown1,MarkDown2,MarkDown3,MarkDown4,MarkDown5,CPI,Unemployment,IsHoliday"
    (tmp_path / "features.csv").write_text(f"{names}\n1,2010-02-12,38.5,2.5,NA,NA,NA,NA,NA,211.2,8.1,TRUE\n")
    t = tables.read_sales_folder(spark, str(tmp_path))
    row = P.merge_panel(t["train"], t["features"], t["stores"]).first()
    assert row.is_holiday and row.markdown1 is None and row.cpi == 211.2 and row.type == "A"
    assert t["test"].first().date.isoformat() == "2010-02-19"
    event = P.listed_calendar(spark).join(t["train"].select("date"), "date").first()
    assert event.holiday == "Super Bowl"


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_csv(spark, str(tmp_path / "none.csv"), tables.STORES_SCHEMA)


def test_forecast_export_by_level(spark, tmp_path):
    df = spark.createDataFrame([("Total", 1.0), ("Store", 2.0)], "hierarchy_level string, y double")
    sinks.write_forecasts(df, str(tmp_path / "out"))
    assert (tmp_path / "out" / "hierarchy_level=Total").exists()


def test_staged_tables_are_read_back_and_dropped(spark, monkeypatch):
    monkeypatch.setattr(session, "_STAGED", [])
    df = session.stage(spark.range(10).withColumn("x", F.lit("a")), "t")
    assert df.columns == ["id", "x"] and df.count() == 10
    assert session.drop_staged(spark) == 1 and session.drop_staged(spark) == 0


def test_ties_and_top_k(panel):
    df = panel({(1, "b"): [5], (2, "a"): [5], (3, "c"): [1]})
    totals = profile.group_profile(df, ["store"])
    assert [r.store for r in profile.top_k(totals, "total", "store", 2).collect()] == [1, 2]
    row = profile.best_and_worst(totals, "store", "total").first()
    assert row.best == 1 and row.worst == 3


def test_event_impact_without_events(panel):
    row = profile.event_impact(panel({(1, "a"): [1, 2]})).first()
    assert row.event_mean is None and row.multiplier is None and row.regular_mean == 1.5


def test_histogram_of_a_constant(panel):
    rows = profile.histogram(panel({(1, "a"): [4, 4, 4]}), "weekly_sales", 5).orderBy("bin").collect()
    assert [r.n for r in rows] == [3, 0, 0, 0, 0]
