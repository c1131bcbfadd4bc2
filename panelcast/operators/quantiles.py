"""Exact quantiles without collecting a group.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here
a bounded sketch first brackets each quantile; only values inside a bracket are
counted and ordered, about ``6 / ACCURACY`` of a group, ties collapsed. All
other rows only add to a count, combined on the map side. Where the brackets
still hold many values, they are cut into slices again and again, until the slices
with the wanted ranks hold few. The slices divide the bits of the values, not their
range, so a heavy tail or a far outlier doesn't leave all values in one slice.

Groups of at most ``ACCURACY`` values need neither sketch nor brackets: they are
shuffled and ordered once, and all quantiles are read off by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.operators.joins import lookup_join
from panelcast.session import stage

ACCURACY = 10_000
ORDERED_ROWS = 2_000_000
#: Slices of one pass. Passes end when values are told apart: doubles have 64 bits.
SLICES, PASSES = 4_096, 8


def exact_quantiles(
    df: DataFrame,
    col: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
    ordered_rows: int = ORDERED_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles: rows ``(by..., prob, value)``."""
    by = list(by)
    rows = df.select(*by, F.col(col).cast("double").alias("_v")).where("_v is not null")
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    if by:
        sizes = stage(rows.groupBy(*by).agg(F.count("*").alias("_n")), "sizes")
        large = sizes.where(F.col("_n") > accuracy)
        if large.isEmpty():
            return _ordered(rows, probs, by)
        sized = lookup_join(rows, large, by)
        small = _ordered(sized.where("_n is null").drop("_n"), probs, by)
        return small.unionByName(_bracketed(sized.where("_n is not null").drop("_n"), probs, by, accuracy, ordered_rows))
    return _bracketed(rows, probs, by, accuracy, ordered_rows)


def _ordered(rows: DataFrame, probs: Sequence[float], by: list[str]) -> DataFrame:
    """Quantiles of groups of few values, by their position in the group's order."""
    group = W.partitionBy(*by)
    placed = rows.withColumn("_r", F.row_number().over(group.orderBy("_v")) - 1).withColumn("_n", F.count("*").over(group))
    ends, cells = [], []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        ends += [F.max(F.when(F.col("_r") == at(h), F.col("_v"))).alias(f"{name}{i}") for name, at in (("_a", F.floor), ("_b", F.ceil))]
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        cells.append(F.struct(F.lit(float(p)).alias("prob"), (a + (b - a) * (h - F.floor(h))).alias("value")))
    found = placed.groupBy(*by).agg(F.max("_n").alias("_n"), *ends)
    return found.select(*by, F.inline(F.array(*cells)))


def _bracketed(rows: DataFrame, probs: Sequence[float], by: list[str], accuracy: int, ordered_rows: int) -> DataFrame:
    """Quantiles of groups of many values."""
    brackets = _brackets(rows, probs, by, accuracy)
    if by:
        marked = lookup_join(rows, brackets, by, "inner", computed=True)
    else:
        marked = rows.withColumn("_b", brackets.select("_b").scalar())
    # Values under a bracket collapse into one NULL value, counted per task.
    each = marked.select(*by, "_v", F.explode("_b").alias("b")).where("_v <= b.hi")
    value = F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("_v")
    group = [*by, *[F.col(f"b.{c}").alias(c) for c in ("prob", "h", "lo", "hi")]]
    counts = stage(each.groupBy(*group, value).agg(F.count("*").alias("n")), "counts")
    if counts.count() > ordered_rows:
        counts = _wanted_slices(counts, by, ordered_rows)
    order = W.partitionBy(*by, "prob").orderBy(F.col("_v").asc_nulls_first())
    upto = counts.withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("_v")))

    h = F.col("h")
    ends = upto.groupBy(*by, "prob", "h").agg(at(F.floor(h)).alias("a"), at(F.ceil(h)).alias("b"))
    return ends.select(*by, "prob", (F.col("a") + (F.col("b") - F.col("a")) * (h - F.floor(h))).alias("value"))


def _brackets(rows: DataFrame, probs: Sequence[float], by: list[str], accuracy: int) -> DataFrame:
    """Per group an array of (prob, position h, lo, hi). Groups no larger than
    the sketch's accuracy take all their rows."""
    slack = 3.0 / accuracy
    wanted = [max(p - slack, 0.0) for p in probs] + [min(p + slack, 1.0) for p in probs]
    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.percentile_approx("_v", wanted, accuracy).alias("q")
    )
    n, q = F.col("n"), F.col("q")
    whole = n <= accuracy
    structs = [
        F.struct(
            F.lit(float(p)).alias("prob"),
            (F.lit(float(p)) * (n - 1)).alias("h"),
            F.when(whole, F.lit(float("-inf"))).otherwise(q[i]).alias("lo"),
            F.when(whole, F.lit(float("inf"))).otherwise(q[i + len(probs)]).alias("hi"),
        )
        for i, p in enumerate(probs)
    ]
    return sketch.select(*by, F.array(*structs).alias("_b"))


def order_key(v: Column) -> Column:
    """A long that orders as the double does: its exponent and fraction as bits,
    negated for negative values; both zeros are 0, NaN comes last."""
    a = F.abs(v)
    guess = F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1022)), F.lit(1023)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)
    e = guess - F.when(a < power(guess), 1).otherwise(0) + F.when((guess < 1023) & (a >= power(guess + 1)), 1).otherwise(0)
    fraction = ((a / power(e) - 1) * F.lit(2.0**52)).cast("long")
    normal = (e + 1023).cast("long") * F.lit(1 << 52) + fraction
    small = (a / F.lit(5e-324)).cast("long")
    bits = F.when(a < F.lit(2.0**-1022), small).when(a == float("inf"), F.lit(0x7FF << 52)).otherwise(normal)
    return F.when(F.isnan(v), F.lit((0x7FF << 52) + 1)).when(v < 0, -bits).otherwise(bits)


def _wanted_slices(counts: DataFrame, by: list[str], ordered_rows: int) -> DataFrame:
    """Keep the values of the slices that hold a wanted rank, pass by pass until few
    are left; what lies below them becomes one NULL value with its count."""
    rows = counts.select(*by, "prob", "h", "_v", "n", order_key(F.col("_v")).alias("_k"))
    for _ in range(PASSES):
        rows = stage(_narrowed(rows, by), "slices")
        if rows.count() <= ordered_rows:
            break
    return rows.drop("_k")


def _narrowed(rows: DataFrame, by: list[str]) -> DataFrame:
    """One pass: the keys between a group's least and greatest are cut into slices."""
    span = rows.groupBy(*by, "prob").agg(F.min("_k").cast("double").alias("_lo"), F.max("_k").cast("double").alias("_hi"))
    placed = lookup_join(rows, span, [*by, "prob"], "inner", computed=True)
    # As doubles, differences of keys can't overflow and keep their order.
    at = F.floor((F.col("_k").cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * SLICES)
    sliced = placed.withColumn("_s", F.when(F.col("_k").isNull(), -1).otherwise(F.least(at, F.lit(SLICES - 1))).cast("int")).drop("_lo", "_hi")
    totals = sliced.groupBy(*by, "prob", "h", "_s").agg(F.sum("n").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    order = W.partitionBy(*by, "prob").orderBy("_s").rowsBetween(W.unboundedPreceding, 0)
    upto = totals.withColumn("upto", F.sum("n").over(order))

    def holds(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.struct("_s", "least", "most")))

    wanted = upto.groupBy(*by, "prob").agg(holds(F.floor("h")).alias("_first"), holds(F.ceil("h")).alias("_last"))
    kept = lookup_join(sliced, wanted, [*by, "prob"], "inner", computed=True).where(F.col("_s") <= F.col("_last._s"))
    # Where two slices hold the two ranks, these are the ends that face each other.
    same = F.col("_first._s") == F.col("_last._s")
    inside = F.when(same, F.col("_s") == F.col("_first._s")).otherwise(
        ((F.col("_s") == F.col("_first._s")) & (F.col("_v") == F.col("_first.most")))
        | ((F.col("_s") == F.col("_last._s")) & (F.col("_v") == F.col("_last.least")))
    )
    below = (F.col("_s") < F.col("_last._s")) | same
    value, key = F.when(inside, F.col("_v")).alias("_v"), F.when(inside, F.col("_k")).alias("_k")
    return kept.where(below | inside).groupBy(*by, "prob", "h", value, key).agg(F.sum("n").alias("n"))


def quantile_columns(
    df: DataFrame, col: str, names: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles as columns, one row per group."""
    long = exact_quantiles(df, col, list(names.values()), by)
    cells = [F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in names.items()]
    return long.groupBy(*by).agg(*cells)
