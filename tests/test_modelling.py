"""Features, imputation and split as one plan; sequences written as a data set."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import clean, features, models
from panelcast.plans import modelling
from panelcast.session import new_path


@pytest.fixture(scope="module")
def merged(panel):
    rng = np.random.default_rng(4)
    df = panel({(s, d): rng.normal(50, 9, 75) for s in (1, 2) for d in "ab"}, flags=(5, 40, 70))
    df = df.withColumns({
        "temperature": F.when(F.dayofyear("date") % 3 != 0, F.col("weekly_sales") / 2 + F.col("store")),
        "fuel_price": F.lit(None).cast("double"), "cpi": F.col("store") + F.rand(1), "unemployment": F.rand(2),
        **{f"markdown{i}": F.when(F.month("date") == i, F.lit(3.0 * i)) for i in range(1, 6)},
        "size": F.col("store") * 100, "type": F.when(F.col("store") == 1, "A").otherwise("B"),
    })
    return df.cache()


def test_no_gap_is_left_and_no_row_lost(merged):
    sets = modelling.run(merged)
    assert sets.train.count() == 4 * 67 and sets.validation.count() == 4 * 8
    known = [c for c in sets.imputed if c != "fuel_price" and "fuel" not in c and "stress" not in c]
    for part in (sets.train, sets.validation):
        gaps = part.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in known]).first().asDict()
        assert not any(gaps.values()), gaps
    assert {"weekly_sales_lag_52", "weekly_sales_mean_52", "temperature"} <= set(sets.imputed)


def test_training_rows_see_nothing_of_the_validation_rows(merged):
    changed = merged.withColumn("weekly_sales", F.when(F.col("date") >= clean.validation_start(merged).scalar(), -1e6).otherwise(F.col("weekly_sales")))
    order = ["store", "dept", "date"]
    one, two = (modelling.run(p).train.orderBy(order).toPandas() for p in (merged, changed))
    numeric = one.select_dtypes("number").columns
    np.testing.assert_allclose(one[numeric].to_numpy(float), two[numeric].to_numpy(float), rtol=1e-9, equal_nan=True)


def test_a_gap_takes_the_last_value_or_the_training_mean(merged):
    sets = modelling.run(merged)
    train = sets.train.where("store = 1 and dept = 'a'").orderBy("date").toPandas()
    given = merged.where("store = 1 and dept = 'a'").orderBy("date").toPandas().temperature.ffill()
    np.testing.assert_allclose(train.temperature[5:], given[5:67])
    engineered = features.engineer(merged, exclude_current=True, fit_on=clean.time_split(merged)[0])
    start = clean.validation_start(merged).scalar()
    mean = engineered.where(F.col("date") < start).agg(F.avg("weekly_sales_lag_52")).first()[0]
    assert train.weekly_sales_lag_52[:52].tolist() == pytest.approx([mean] * 52)


def test_sequences_as_a_data_set(merged, spark):
    names = ["weekly_sales", "cpi", "markdown1"]
    sets = models.sequence_sets(merged, names, length=4, keys=["store", "dept"])
    path = new_path(spark, "sets")
    models.write_sequence_sets(sets, path)
    back = spark.read.schema(sets.schema).parquet(path)
    assert back.count() == sets.count() == 4 * (75 - 4) and back.where("part = 'validation'").count() == 4 * 8
    cells = models.cells(back, names, 4)
    assert {f"{n}_{k}" for n in names for k in (1, 2, 3, 4)} <= set(cells.columns)
    fit = merged.where(F.col("date") < clean.validation_start(merged).scalar())
    m, s = fit.agg(F.avg("weekly_sales"), F.stddev_pop("weekly_sales")).first()
    own = merged.where("store = 2 and dept = 'b'").orderBy("date").toPandas().weekly_sales.to_numpy()
    rows = cells.where("store = 2 and dept = 'b'").orderBy("date").toPandas()
    for k in (1, 2, 3, 4):
        np.testing.assert_allclose(rows[f"weekly_sales_{k}"], (own[4 - k : -k] - m) / s)
    with pytest.raises(ValueError):
        modelling.run(merged.drop("weekly_sales"))
