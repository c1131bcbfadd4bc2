"""Joins with a checked broadcast, and scalars attached without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import stage

BROADCAST_ROWS = 100_000


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    computed: bool = False,
) -> DataFrame:
    """Join a fact with a table that has one row per ``on``.

    The right side is broadcast only after a count, stopped at ``max_rows``, has
    shown it to be small. ``computed`` marks a right side that is itself an
    aggregate of a large table: it is written first, so that the count and the
    join do not compute it twice.

    A larger right side is shuffled. Adaptive execution then splits the tasks of
    a hot key.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"a lookup cannot serve a {how} join")
    right = stage(right, "lookup") if computed else right
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how)


def scalars(df: DataFrame, **aggs: Column) -> Column:
    """Aggregates over the whole table as one struct-valued scalar subquery.

    The value reaches every task inside the plan: no join and no broadcast.
    """
    return df.agg(F.struct(*[c.alias(n) for n, c in aggs.items()]).alias("s")).scalar()
