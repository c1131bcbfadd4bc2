"""Per-series window functions.

A panel has one row per (series, date), see ``sources.panel.cells``. A window
partition therefore never holds more rows than the calendar has dates, whatever
the raw volume of its key, and all functions here share one window
specification, so a query sorts its series once.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def series_window(keys: list[str] | tuple[str, ...], time: str) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(time)


def reverse_window(keys: list[str] | tuple[str, ...], time: str) -> WindowSpec:
    """The same partitions from the last row to the first. What follows a row is then
    a running frame, which Spark extends row by row; a frame that ends with the
    partition is computed anew for every row."""
    return W.partitionBy(*keys).orderBy(F.desc(time))


def full_rolling(c: Column, fn, n: int, w: WindowSpec, exclude_current: bool = False) -> Column:
    """A rolling statistic that is NULL until ``n`` non-null values are seen."""
    frame = w.rowsBetween(-n, -1) if exclude_current else w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) == n, fn(c).over(frame))


def difference(c: Column, w: WindowSpec, k: int = 1) -> Column:
    return c - F.lag(c, k).over(w)


def position(w: WindowSpec) -> Column:
    return F.row_number().over(w) - 1


def fill_forward(c: Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))


def fill_backward(c: Column, back: WindowSpec) -> Column:
    """``back`` is the reverse window."""
    return fill_forward(c, back)


def interpolate(c: Column, pos: Column, w: WindowSpec, back: WindowSpec) -> Column:
    """Straight line between known rows, by row position ``pos``; leading gaps
    stay NULL, trailing gaps keep the last known value. ``back`` is the reverse
    window."""
    at = F.when(c.isNotNull(), pos)
    v0, v1 = fill_forward(c, w), fill_forward(c, back)
    p0, p1 = fill_forward(at, w), fill_forward(at, back)
    line = v0 + (v1 - v0) * (pos - p0) / (p1 - p0)
    return F.when(c.isNotNull(), c).when(v1.isNull(), v0).otherwise(line)


def centered_average(c: Column, w: WindowSpec, period: int = 52) -> Column:
    """Centered moving average of an even period: half weight on both ends,
    NULL where the span does not fit."""
    half = period // 2
    span = w.rowsBetween(-half, half)
    inner = F.sum(c).over(w.rowsBetween(-(half - 1), half - 1))
    ends = F.lag(c, half).over(w) + F.lead(c, half).over(w)
    return F.when(F.count(c).over(span) == period + 1, (inner + 0.5 * ends) / period)
