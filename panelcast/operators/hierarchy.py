"""Hierarchies: nodes, reconciliation, coherence, look-ups.

A forecast table has one row per node and step: ``level``, the series keys (NULL
below the node's level), ``step`` and a value column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions import scalars as S
from panelcast.operators.rollup import level_of
from panelcast.spec import DEFAULT, PanelSpec


def entity_key(depth: int, spec: PanelSpec = DEFAULT) -> Column:
    if depth == 0:
        return F.lit("Total")
    if depth == 1:
        return S.store_key(F.col(spec.keys[0]))
    return S.leaf_key(F.col(spec.keys[0]), F.concat_ws("_", *[F.col(k) for k in spec.keys[1:depth]]))


def nodes(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """All nodes with their parent: ``level, node, parent, n_children``."""
    out = None
    series = df.select(*spec.keys).distinct()
    for depth in range(len(spec.keys) + 1):
        by = list(spec.keys[:depth])
        below = spec.keys[depth] if depth < len(spec.keys) else None
        count = F.countDistinct(below) if below else F.lit(0).cast("bigint")
        if by:
            level = series.groupBy(*by).agg(count.alias("n_children"))
        else:
            level = series.agg(count.alias("n_children"))
        parent = entity_key(depth - 1, spec) if depth else F.lit(None).cast("string")
        level = level.select(
            F.lit(spec.level(depth)).alias("level"),
            entity_key(depth, spec).alias("node"),
            parent.alias("parent"),
            "n_children",
        )
        out = level if out is None else out.unionByName(level)
    return out


def summing_pairs(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The summing matrix as sparse ``(node, leaf)`` pairs, for inspection."""
    leaf = entity_key(len(spec.keys), spec)
    path = F.array(*[entity_key(d, spec) for d in range(len(spec.keys) + 1)])
    return df.select(*spec.keys).distinct().select(F.explode(path).alias("node"), leaf.alias("leaf"))


def _level(forecasts: DataFrame, depth: int, value: str, spec: PanelSpec) -> DataFrame:
    rows = forecasts.where(F.col("level") == spec.level(depth))
    return rows.select(*spec.keys[:depth], "step", F.col(value).alias("y"))


def _onto_children(child: DataFrame, parent: DataFrame, depth: int, spec: PanelSpec) -> DataFrame:
    """Parent values on child rows. The Total has one row per step, so it is
    broadcast; other levels are left to the adaptive join, which splits a hot parent."""
    right = F.broadcast(parent) if depth == 0 else parent
    return child.join(right, [*spec.keys[:depth], "step"])


def reconcile_ols(
    forecasts: DataFrame, value: str, spec: PanelSpec = DEFAULT, name: str = "reconciled"
) -> DataFrame:
    """Least-squares reconciliation ``S (S'S)^-1 S' y``, exactly, without a matrix.

    For nested sums ``S'S`` is the identity plus one block of ones per node, so
    its inverse is a chain of rank-one updates. Their sums run up the tree level
    by level and their corrections run down; a leaf receives its parent's one
    correction. The leaves meet one aggregate and one join, whatever the depth.
    """
    depth = len(spec.keys)
    leaf = _level(forecasts, depth, value, spec)
    table = leaf.groupBy(*spec.keys[: depth - 1], "step").agg(
        F.sum("y").alias("v0"),
        F.count("*").cast("double").alias("u0"),
        F.sum("y").alias("leaf_sum"),
        F.count("*").cast("double").alias("leaf_count"),
    )
    up: dict[int, DataFrame] = {}
    for d in range(depth - 1, -1, -1):
        own = _level(forecasts, d, value, spec)
        joined = table.join(own, [*spec.keys[:d], "step"])
        v = (F.col("v0") + F.col("y") * F.col("u0")) / (1 + F.col("u0"))
        up[d] = joined.withColumns(
            {"v": v, "d": F.col("y") - v, "shrink": 1 / (1 + F.col("u0")), "u": F.col("u0") / (1 + F.col("u0"))}
        )
        if d:
            table = up[d].groupBy(*spec.keys[: d - 1], "step").agg(
                F.sum("v").alias("v0"), F.sum("u").alias("u0")
            )
    correction = up[0].select("step", F.col("d").alias("g"))
    for d in range(1, depth):
        above = correction.withColumnRenamed("g", "g0")
        here = _onto_children(up[d], above, d - 1, spec)
        correction = here.withColumn("g", F.col("d") + F.col("g0") * F.col("shrink"))
        keep = ["leaf_sum", "leaf_count"] if d == depth - 1 else []
        correction = correction.select(*spec.keys[:d], "step", "g", *keep)
    fixed = _onto_children(leaf, correction.select(*spec.keys[: depth - 1], "step", "g"), depth - 1, spec)
    bottom = fixed.select(*spec.keys, "step", (F.col("y") + F.col("g")).alias(name))
    return with_parents(bottom, name, spec)


def with_parents(leaf: DataFrame, value: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Leaf values and their sums on every level, in one shuffle."""
    sets = [[*spec.keys[:i], "step"] for i in range(len(spec.keys) + 1)]
    grouped = leaf.groupingSets(sets, *spec.keys, "step").agg(
        F.sum(value).alias(value), F.grouping_id().alias("_g")
    )
    level = level_of(F.shiftright("_g", 1), spec)
    return grouped.select(level.alias("level"), *spec.keys, "step", value)


def bottom_up(
    forecasts: DataFrame, value: str, spec: PanelSpec = DEFAULT, name: str = "bottom_up"
) -> DataFrame:
    leaf = _level(forecasts, len(spec.keys), value, spec).withColumnRenamed("y", name)
    return with_parents(leaf, name, spec)


def split_down(
    forecasts: DataFrame,
    history: DataFrame,
    value: str,
    depth: int = 0,
    spec: PanelSpec = DEFAULT,
    name: str = "top_down",
) -> DataFrame:
    """Forecasts of one level split by the leaves' share of history: top-down
    from the Total (``depth`` 0), middle-out from a level below."""
    by = list(spec.keys[:depth])
    leaf = history.groupBy(*spec.keys).agg(F.sum(spec.target).alias("_t"))
    if by:
        # A parent's total is combined map-side, then joined to its leaves.
        leaf = leaf.join(leaf.groupBy(*by).agg(F.sum("_t").alias("_p")), by)
    else:
        leaf = leaf.withColumn("_p", leaf.agg(F.sum("_t")).scalar())
    share = F.coalesce(S.ratio(F.col("_t"), F.col("_p")), F.lit(0.0))
    parent = _level(forecasts, depth, value, spec)
    shares = leaf.select(*spec.keys, share.alias("_s"))
    if by:
        split = shares.join(parent, by)
    else:
        steps = parent.agg(F.collect_list(F.struct("step", "y"))).scalar()
        split = shares.select("*", F.inline(steps))
    leaf_values = split.select(*spec.keys, "step", (F.col("y") * F.col("_s")).alias(name))
    return with_parents(leaf_values, name, spec)


def coherence(
    forecasts: DataFrame, value: str, spec: PanelSpec = DEFAULT, tolerance: float = 1e-6
) -> DataFrame:
    """Per parent node: the largest gap between it and the sum of its children."""
    out = None
    for d in range(len(spec.keys)):
        by = list(spec.keys[:d])
        sums = _level(forecasts, d + 1, value, spec).groupBy(*by, "step").agg(F.sum("y").alias("s"))
        gaps = _level(forecasts, d, value, spec).join(sums, [*by, "step"])
        worst = gaps.groupBy(entity_key(d, spec).alias("node")).agg(
            F.max(F.abs(F.col("y") - F.col("s"))).alias("max_gap")
        )
        level = worst.select(F.lit(spec.level(d)).alias("level"), "node", "max_gap")
        out = level if out is None else out.unionByName(level)
    return out.withColumn("coherent", F.col("max_gap") <= tolerance)


def coherence_verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.bool_and("coherent").alias("coherent"),
        F.max("max_gap").alias("max_gap"),
        F.count("*").alias("n_nodes"),
    )


def prediction_table(
    forecasts: DataFrame, dates: DataFrame, value: str, spec: PanelSpec = DEFAULT
) -> DataFrame:
    """Long table of all levels, with entity keys; ``dates`` maps steps to dates."""
    key = entity_key(len(spec.keys), spec)
    for d in range(len(spec.keys) - 1, -1, -1):
        key = F.when(F.col("level") == spec.level(d), entity_key(d, spec)).otherwise(key)
    placed = forecasts.drop(spec.time).join(F.broadcast(dates), "step")
    return placed.select(
        spec.time,
        F.col("level").alias("hierarchy_level"),
        key.alias("entity_key"),
        F.col("step").cast("int").alias("forecast_period"),
        F.col(value).alias("predicted_sales"),
        F.col(spec.keys[0]).alias("store_id"),
        F.col(spec.keys[-1]).alias("department_id"),
    )


def find(
    table: DataFrame,
    level: str | None = None,
    store: object | None = None,
    dept: object | None = None,
) -> DataFrame:
    """Rows of a prediction table by level, store and department."""
    out = table
    for col, v in (("hierarchy_level", level), ("store_id", store), ("department_id", dept)):
        out = out if v is None else out.where(F.col(col) == F.lit(v))
    return out


def level_summary(table: DataFrame) -> DataFrame:
    return table.groupBy("hierarchy_level").agg(
        F.countDistinct("entity_key").alias("n_entities"),
        F.avg("predicted_sales").alias("mean"),
        F.sum("predicted_sales").alias("total"),
    )


def top_entities(table: DataFrame, level: str, k: int = 5) -> DataFrame:
    rows = table.where(F.col("hierarchy_level") == level)
    totals = rows.groupBy("entity_key").agg(F.sum("predicted_sales").alias("total"))
    return totals.orderBy(F.desc("total"), "entity_key").limit(k)


def node_results(
    forecasts: DataFrame, actual: DataFrame, weights: DataFrame, value: str, spec: PanelSpec = DEFAULT
) -> DataFrame:
    """Every node's forecast beside its actual value, 0 on dates without rows.

    ``forecasts`` carries the date, ``actual`` the nodes' values on the dates to
    score (``rollup.node_totals``), ``weights`` one row per date.
    """
    a, b = forecasts.alias("a"), actual.alias("b")
    cond = F.lit(True)
    for c in ("level", spec.time, *spec.keys):
        cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    rows = a.join(b, cond, "left").select(
        *[F.col(f"a.{c}") for c in ("level", *spec.keys, spec.time, "step")],
        F.coalesce("b.y", F.lit(0.0)).alias("actual"),
        F.col(f"a.{value}").alias("predicted"),
    )
    return rows.join(F.broadcast(weights), spec.time)


def level_errors(
    forecasts: DataFrame, actual: DataFrame, weights: DataFrame, value: str, spec: PanelSpec = DEFAULT
) -> DataFrame:
    """MAPE and weighted MAE by level, see ``node_results``."""
    rows = node_results(forecasts, actual, weights, value, spec).select(
        "level",
        "weight",
        F.abs(F.col("actual") - F.col("predicted")).alias("e"),
        F.greatest(F.abs("actual"), F.lit(1.0)).alias("d"),
    )
    w = F.col("weight")
    return rows.groupBy("level").agg(
        (100 * F.avg(F.col("e") / F.col("d"))).alias("mape"),
        S.ratio(F.sum(w * F.col("e")), F.sum(w)).alias("wmae"),
        F.count("*").alias("n"),
    )
