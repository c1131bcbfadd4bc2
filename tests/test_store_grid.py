"""The store of model results, and scoring of a given grid."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.operators import evaluate, forecast, grid, hierarchy, store
from panelcast.plans import forecasting
from panelcast.session import new_path
from panelcast.spec import DEFAULT, PanelSpec


def stored(spark, week, model, cells, depth=2, kind="Statistical"):
    rows = [(s, d, week(t), float(a), None if p is None else float(p)) for (s, d, t), (a, p) in cells.items()]
    df = spark.createDataFrame(rows, "store int, dept string, date date, actual double, predicted double")
    return store.rows_of(df, model, kind, depth=depth)


def kinds(df):
    return {k: df.schema[k].dataType for k in DEFAULT.keys}


def test_a_rerun_replaces_its_own_rows_only(spark, week):
    path = new_path(spark, "store")
    cells = {(s, d, t): (t, t + s) for s in (1, 2) for d in "ab" for t in (5, 6, 7)}
    one, two = stored(spark, week, "one", cells), stored(spark, week, "two", cells)
    sites = stored(spark, week, "one", {(s, "", t): (9, 8) for s in (1, 2) for t in (5, 6)}, depth=1)
    store.save(one.unionByName(two), path)
    store.save(sites, path)
    store.save(stored(spark, week, "two", {(1, "a", 5): (5, -1)}), path)
    back = store.load(spark, path, DEFAULT, kinds(one))
    assert sorted(map(tuple, back.groupBy("grain", "model").count().collect())) == [("Store", "one", 4), ("Store_Department", "one", 12), ("Store_Department", "two", 1)]
    got = back.where("model = 'one' AND grain = 'Store_Department'").select(one.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, one.collect()))
    assert {(r.store, r.dept, r.step) for r in back.where("grain = 'Store'").collect()} == {(1, None, 1), (1, None, 2), (2, None, 1), (2, None, 2)}


def test_the_last_of_equal_cells_counts(spark, week):
    a = stored(spark, week, "m", {(1, "a", 1): (1, 10), (1, "b", 1): (1, 11)}).withColumn("run", F.lit(1))
    b = stored(spark, week, "m", {(1, "a", 1): (1, 20)}).withColumn("run", F.lit(2))
    other = stored(spark, week, "n", {(1, "a", 1): (1, None)}).withColumn("run", F.lit(1))
    rows = store.keep_last(a.unionByName(b).unionByName(b).unionByName(other), F.col("run"))
    assert rows.columns == a.columns
    assert {(r.model, r.dept, r.predicted) for r in rows.collect()} == {("m", "a", 20.0), ("m", "b", 11.0), ("n", "a", None)}


def test_models_meet_on_cells_that_all_answer(spark, week):
    fine = stored(spark, week, "fine", {(s, d, t): (10, 4) for s in (1, 2) for d in "ab" for t in (1, 2)})
    sunday = lambda t: week(t) + dt.timedelta(days=2)
    rows = [(s, sunday(t), 20.0, None if (s, t) == (2, 2) else 9.0) for s in (1, 2) for t in (1, 2)]
    coarse = store.rows_of(spark.createDataFrame(rows, "store int, date date, actual double, predicted double").withColumn("dept", F.lit(None).cast("string")), "coarse", "x", depth=1)
    weekly = store.at_grain(fine.unionByName(coarse), ["store"])
    cells = store.comparable(weekly, ["store"])
    got = {(r.model, r.store, r.date): (r.actual, r.predicted) for r in cells.collect()}
    assert got == {(m, s, sunday(t)): (20.0, p) for m, p in (("fine", 8.0), ("coarse", 9.0)) for s, t in ((1, 1), (1, 2), (2, 1))}
    assert {r.model: r.mae for r in evaluate.accuracy(cells).collect()} == {"fine": 12.0, "coarse": 11.0}
    # The coarse model has no departments, so it has no rows at that grain.
    assert {r.model for r in store.at_grain(fine.unionByName(coarse), ["store", "dept"]).collect()} == {"fine"}
    assert store.comparable(weekly.where("false"), ["store"]).count() == 0


def test_new_series_take_a_share_of_their_nearest_ancestor(panel, spark, week):
    df = panel({(1, "a"): [10] * 20, (1, "b"): [20] * 20, (2, "a"): [30] * 20})
    keys = [(1, "a"), (1, "b"), (2, "a"), (1, "new"), (2, "b"), (7, "a"), (7, "new"), (None, "a"), (1, None), (1, "a")]
    rows = [(s, d, week(t), f"{s}{d}{t}", 0.0) for s, d in keys for t in (18, 20, 23)]
    given = spark.createDataFrame(rows, "store int, dept string, date date, id string, reconciled double")
    out = forecasting.score_given(df, given)
    got = {}
    for r in out.collect():
        got.setdefault((r.store, r.dept), []).append((r.step, r.source_level, r.predicted))
    assert out.count() == len(rows) and set(given.columns) <= set(out.columns)
    wanted = {(1, "b"): (20, "Store_Department"), (1, "new"): (10, "Store"), (2, "b"): (15, "Store"), (7, "a"): (15, "Total"), (None, "a"): (15, "Total"), (1, None): (10, "Store")}
    for key, (value, level) in wanted.items():
        known = sorted(got[key], key=lambda x: x[0])
        assert [k[:2] for k in known] == [(-1, "History"), (1, level), (4, level)]
        assert known[0][2] is None and known[1][2] == pytest.approx(value) and known[2][2] == pytest.approx(value)
    assert len(got[(1, "a")]) == 6
    fixed = out.where("store IS NOT NULL AND dept IS NOT NULL").dropDuplicates(["store", "dept", "step"])
    checks = hierarchy.coherence(grid.grid_nodes(fixed), "predicted")
    assert hierarchy.coherence_verdict(checks).first().coherent


def test_deeper_trees_empty_grids_and_far_dates(spark, week):
    spec = PanelSpec(keys=("area", "shop", "item"), time="day", target="y", event="flag", labels=("Area", "Shop", "Item"))
    rows = [(a, s, i, week(t), float(v), False) for a, s, i, v in (("x", 1, "m", 4), ("x", 1, "n", 8), ("x", 2, "m", 6), ("y", 3, "m", 1)) for t in range(12)]
    df = spark.createDataFrame(rows, "area string, shop int, item string, day date, y double, flag boolean")
    given = spark.createDataFrame([("x", 1, "z", week(12)), ("x", 9, "m", week(13)), ("z", 9, "m", week(12)), ("y", 3, "m", week(12))], "area string, shop int, item string, day date")
    got = {(r.area, r.shop, r.item): (r.source_level, r.predicted) for r in forecasting.score_given(df, given, spec).collect()}
    assert got[("x", 1, "z")] == ("Area_Shop", pytest.approx(4)) and got[("x", 9, "m")] == ("Area", pytest.approx(4.5))
    assert got[("z", 9, "m")] == ("Total", pytest.approx(3.8)) and got[("y", 3, "m")] == ("Area_Shop_Item", pytest.approx(1))
    assert forecasting.score_given(df, given.where("false"), spec).count() == 0
    with pytest.raises(ValueError):
        forecasting.score_given(df, given.withColumn("day", F.date_add("day", 7 * 1_000)), spec)
    base = forecast.base_forecasts(df, forecast.future_dates(df, 2, spec), 2, spec)
    assert base.where("step = 2 AND level = 'Total'").first().ensemble == pytest.approx(19)
