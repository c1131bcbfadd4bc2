"""Scoring a given future grid of series and dates.

A series that has history gets its own forecast. Any other takes that of its nearest
ancestor with history, shared as if the series were one more of the ancestor's leaves.
The grid is joined level by level, each time only the rows that are still open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions import scalars as S
from panelcast.operators.hierarchy import with_parents
from panelcast.session import stage
from panelcast.spec import DEFAULT, PanelSpec

#: A grid further ahead than this many steps is refused.
MOST_STEPS = 520
BEFORE = "History"


def placed_steps(grid: DataFrame, history: DataFrame, spec: PanelSpec = DEFAULT) -> tuple[DataFrame, int]:
    """The grid with ``step``, the steps from the last date of ``history`` (0 or less
    for dates that are not after it), and the largest step."""
    last = history.agg(F.max(spec.time)).scalar()
    step = F.ceil(F.datediff(spec.time, last) / spec.step_days).cast("int")
    rows = grid.withColumn("step", step)
    most = rows.agg(F.max("step")).first()[0] or 0
    if most > MOST_STEPS:
        raise ValueError(f"the grid reaches {most} steps ahead, more than {MOST_STEPS}")
    return rows, max(0, most)


def score_grid(grid: DataFrame, forecasts: DataFrame, value: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Grid rows (keys, date, step) with ``predicted`` and ``source_level``.

    ``forecasts`` has every node and step. A new series gets 1 / (n + 1) of its
    nearest ancestor's forecast, n being the ancestor's leaves with a forecast. Rows
    of dates that are not in the future have no forecast and the level 'History'; a
    row with a null key counts as a new series. Rows of the grid stay as they are,
    repeated ones too.
    """
    depth = len(spec.keys)
    leaves = forecasts.where(F.col("level") == spec.level(depth))
    rows = grid.withColumns({"predicted": F.lit(None).cast("double"), "source_level": F.when(F.col("step") < 1, BEFORE)})
    names = rows.columns
    done = []
    for d in range(depth, -1, -1):
        by = list(spec.keys[:d])
        here = forecasts.where(F.col("level") == spec.level(d)).select(*by, "step", F.col(value).alias("_y"))
        if d < depth:
            size = leaves.groupBy(*by, "step").agg(F.count("*").alias("_n"))
            here = here.join(size, [*by, "step"]).withColumn("_y", S.ratio(F.col("_y"), F.col("_n") + 1)).drop("_n")
        # The Total has a row per step; other levels are left to the adaptive join.
        here = F.broadcast(here) if d == 0 else here
        joined = rows.join(here, [*by, "step"], "left")
        found = F.col("_y").isNotNull() & F.col("source_level").isNull()
        joined = joined.withColumns({
            "predicted": F.when(found, F.col("_y")).otherwise(F.col("predicted")),
            "source_level": F.when(found, spec.level(d)).otherwise(F.col("source_level")),
        }).select(names)
        joined = stage(joined, "grid") if d else joined
        done.append(joined.where("source_level IS NOT NULL"))
        rows = joined.where("source_level IS NULL")
    out = rows
    for part in done:
        out = out.unionByName(part)
    return out


def grid_nodes(scored: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Sums of a scored grid on every level, by step: coherent by construction."""
    return with_parents(scored.where("predicted IS NOT NULL"), "predicted", spec)
