"""Order-dependent operations across series, without a one-partition window.

The order is (series keys, time). A value from an earlier series reaches a later
one through a table with one row per series, cut into key ranges: first within
each range, then between the ranges, of which there are as many as shuffle
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.functions import windows as WF
from panelcast.operators.joins import lookup_join
from panelcast.session import stage
from panelcast.spec import DEFAULT, PanelSpec

def ordered_carry(df: DataFrame, cols: list[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per series: the last known value of all earlier series (``*_before``) and
    the first known value of all later series (``*_after``).

    Range partitioning on the whole key balances the ranges even if one top key
    owns most series. The range number is written with the rows: every reader,
    also after the loss of an executor, sees the same one.
    """
    keys, time = list(spec.keys), spec.time
    aggs = []
    for c in cols:
        when = F.when(F.col(c).isNotNull(), F.col(time))
        aggs += [F.max_by(c, when).alias(f"_l_{c}"), F.min_by(c, when).alias(f"_f_{c}")]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = df.groupBy(*keys).agg(*aggs).repartitionByRange(ranges, *keys)
    ends = stage(ends.withColumn("_range", F.spark_partition_id()), "ranges")
    names = [n for c in cols for n in (f"_l_{c}", f"_f_{c}")]
    key = F.struct(*keys)
    per_range = ends.groupBy("_range").agg(
        *[
            (F.max_by if n.startswith("_l_") else F.min_by)(n, F.when(F.col(n).isNotNull(), key)).alias(n)
            for n in names
        ]
    )
    between = _neighbours(per_range, W.orderBy("_range"), cols, "range")
    within = _neighbours(ends, W.partitionBy("_range").orderBy(*keys), cols, "series")
    joined = within.join(F.broadcast(between.drop(*names)), "_range")
    out = {}
    for c in cols:
        for side in ("before", "after"):
            out[f"{c}_{side}"] = F.coalesce(f"_series_{side}_{c}", f"_range_{side}_{c}")
    return joined.select(*keys, *[v.alias(n) for n, v in out.items()])


def _neighbours(df: DataFrame, w, cols: list[str], name: str) -> DataFrame:
    before = w.rowsBetween(W.unboundedPreceding, -1)
    after = w.rowsBetween(1, W.unboundedFollowing)
    new = {}
    for c in cols:
        new[f"_{name}_before_{c}"] = F.last(f"_l_{c}", ignorenulls=True).over(before)
        new[f"_{name}_after_{c}"] = F.first(f"_f_{c}", ignorenulls=True).over(after)
    return df.withColumns(new)


def fill_across(df: DataFrame, cols: list[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Forward fill over the whole ordered table, then backward, then 0."""
    w, back = WF.series_window(spec.keys, spec.time), WF.reverse_window(spec.keys, spec.time)
    out = lookup_join(df, ordered_carry(df, cols, spec), list(spec.keys), "left", computed=True)

    def value(c: str) -> Column:
        forward = F.coalesce(WF.fill_forward(F.col(c), w), F.col(f"{c}_before"))
        backward = F.coalesce(WF.fill_backward(F.col(c), back), F.col(f"{c}_after"))
        return F.coalesce(forward, backward, F.lit(0.0))

    filled = out.select(
        *[(value(c).alias(c) if c in cols else F.col(c)) for c in df.columns]
    )
    return filled


def difference_across(df: DataFrame, col: str, name: str = "change", spec: PanelSpec = DEFAULT) -> DataFrame:
    """First difference over the whole ordered table: the first row of a series
    is compared with the last row of the series before it."""
    w = WF.series_window(spec.keys, spec.time)
    out = lookup_join(df, ordered_carry(df, [col], spec), list(spec.keys), "left", computed=True)
    first = F.row_number().over(w) == 1
    previous = F.when(first, F.col(f"{col}_before")).otherwise(F.lag(col, 1).over(w))
    return out.withColumn(name, F.col(col) - previous).select(*df.columns, name)
