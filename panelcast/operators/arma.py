"""Seasonal autoregression with moving-average terms, pooled over all series.

The target is differenced once and over a period, and regressed on differenced
covariates; the rest follows ``(1 - a B)(1 - A B^s) u = (1 + m B)(1 + M B^s) e``.
The coefficients are common to all series, each scaled by its own deviation.

A long autoregression gives first residuals, and a regression on lagged values and
lagged residuals the first coefficients: two sets of normal equations, each one
aggregate. Gauss-Newton steps on the conditional sum of squares then refine them. In
such a step every task runs the recursion over its own series, many at a time, and
returns one matrix of fixed size; series are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions import windows as WF
from panelcast.operators import clean
from panelcast.operators.joins import scalars
from panelcast.session import stage
from panelcast.spec import DEFAULT, PanelSpec

#: Most steps of the refinement, the relative gain below which it ends, and the
#: largest size of a coefficient of the recursion.
STEPS, GAIN, LARGEST = 25, 1e-9, 0.99
#: Innovations before the first known ones count as 0, which is wrong for a period at
#: least: a series with this many periods is scored from one period later on.
LONG = 5
TERMS = ("ar", "seasonal_ar", "ma", "seasonal_ma")


@dataclass(frozen=True)
class Arma:
    """Coefficients, in units of each series' deviation and each covariate's."""

    terms: dict[str, float]
    constant: float
    covariates: dict[str, float] = field(default_factory=dict)
    period: int = 52
    #: Residual variance, rows and steps of the fit.
    variance: float = float("nan")
    rows: int = 0
    steps: int = 0

    def vector(self) -> np.ndarray:
        return np.array([*(self.terms[t] for t in TERMS), self.constant, *self.covariates.values()])

    def replaced(self, v: np.ndarray, **more) -> Arma:
        named = dict(zip(self.covariates, v[5:].tolist()))
        return Arma(dict(zip(TERMS, v[:4].tolist())), float(v[4]), named, self.period, **more)


def twice_differenced(
    weekly: DataFrame, keys: Sequence[str], covariates: Sequence[str] = (), n_val: int = 8, period: int = 52,
    spec: PanelSpec = DEFAULT,
) -> DataFrame:
    """Rows (keys, time, _y, _in, _size, z, d_<covariate>): the differenced target
    over its root mean square in training, and covariates likewise over all rows.

    ``weekly`` is gap-free; ``_in`` marks training rows. A covariate that is
    unknown moves as it did a period before, so its difference is 0.
    """
    keys, start = list(keys), clean.validation_start(weekly, n_val, spec).scalar()
    w = WF.series_window(keys, spec.time)

    def twice(c: Column) -> Column:
        return c - F.lag(c, 1).over(w) - F.lag(c, period).over(w) + F.lag(c, period + 1).over(w)

    y = F.col(spec.target).cast("double")
    rows = weekly.select(
        *keys, spec.time, y.alias("_y"), (F.col(spec.time) < start).alias("_in"), twice(y).alias("_z"),
        *[F.coalesce(twice(F.col(c).cast("double")), F.lit(0.0)).alias(f"_x_{c}") for c in covariates],
    )
    size = F.sqrt(F.avg(F.when(F.col("_in"), F.col("_z") * F.col("_z"))).over(W.partitionBy(*keys)))
    rows = rows.withColumn("_size", F.coalesce(F.nullif(size, F.lit(0.0)), F.lit(1.0)))
    known = rows.where(F.col("_in") & F.col("_z").isNotNull())
    moves = {c: F.sqrt(F.avg(F.col(f"_x_{c}") * F.col(f"_x_{c}"))) for c in covariates}
    scale = scalars(known, **moves) if covariates else None
    xs = [(F.col(f"_x_{c}") / F.coalesce(F.nullif(scale[c], F.lit(0.0)), F.lit(1.0))).alias(f"d_{c}") for c in covariates]
    return rows.select(*keys, spec.time, "_y", "_in", "_size", (F.col("_z") / F.col("_size")).alias("z"), *xs)


def normal_equations(rows: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """Sums of products of all pairs of a constant and ``columns``, by one
    aggregate, and the number of rows; rows with a null don't count."""
    cells = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    pairs = [(i, j) for i in range(len(cells)) for j in range(i + 1)]
    sums = rows.dropna(subset=list(columns)).agg(
        F.count("*").alias("n"), F.array(*[F.coalesce(F.sum(cells[i] * cells[j]), F.lit(0.0)) for i, j in pairs]).alias("s")
    ).first()
    out = np.zeros((len(cells), len(cells)))
    for (i, j), value in zip(pairs, sums.s):
        out[i, j] = out[j, i] = value
    return out, sums.n


def solved(products: np.ndarray) -> np.ndarray:
    """Least-squares coefficients of the last column on all others; those of columns
    that others determine are the smallest that fit as well."""
    return np.linalg.lstsq(products[:-1, :-1], products[:-1, -1], rcond=1e-10)[0]


def long_lags(period: int) -> list[int]:
    return sorted({1, 2, 3, period, period + 1})


def hannan_rissanen(rows: DataFrame, keys: Sequence[str], period: int = 52, spec: PanelSpec = DEFAULT) -> tuple[Arma, DataFrame]:
    """First coefficients from two regressions, and the terms of both as rows
    (stage, term, value). ``rows`` is what ``twice_differenced`` returns, staged."""
    w = WF.series_window(list(keys), spec.time)
    xs = [c for c in rows.columns if c.startswith("d_")]
    lags = {f"z_{k}": F.lag("z", k).over(w) for k in long_lags(period)}
    lagged = rows.withColumns(lags)
    first = solved(normal_equations(lagged.where("_in"), [*lags, *xs, "z"])[0])
    fitted: Column = F.lit(float(first[0]))
    for c, b in zip([*lags, *xs], first[1:]):
        fitted = fitted + F.col(c) * F.lit(float(b))
    lagged = lagged.withColumn("e", F.col("z") - fitted)
    late = {f"e_{k}": F.lag("e", k).over(w) for k in (1, period, period + 1)}
    names = ["z_1", f"z_{period}", f"z_{period + 1}", *late, *xs]
    second = solved(normal_equations(lagged.withColumns(late).where("_in"), [*names, "z"])[0])
    by = dict(zip(["constant", *names], second.tolist()))
    terms = {"ar": by["z_1"], "seasonal_ar": by[f"z_{period}"], "ma": by["e_1"], "seasonal_ma": by[f"e_{period}"]}
    terms = {t: float(np.clip(v, -LARGEST + 0.04, LARGEST - 0.04)) for t, v in terms.items()}
    table = [("long autoregression", t, float(v)) for t, v in zip(["constant", *lags, *xs], first)]
    table += [("with residuals", t, v) for t, v in by.items()]
    # The regression's constant belongs to the filtered series.
    gain = (1 - terms["ar"]) * (1 - terms["seasonal_ar"])
    start = Arma(terms, by["constant"] / gain, {x.removeprefix("d_"): by[x] for x in xs}, period)
    return start, rows.sparkSession.createDataFrame(table, "stage string, term string, value double")


def packed(rows: DataFrame, keys: Sequence[str], period: int = 52, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row per series, no longer than the calendar: its dates, values, scaled
    differences and covariates in order, the number ``n`` of training rows, and
    ``usable``, whether training reaches back far enough and has no gap."""
    xs = [c for c in rows.columns if c.startswith("d_")]
    cell = F.struct(F.col(spec.time).alias("t"), F.col("_y").alias("y"), F.col("z").alias("z"), F.array(*xs).cast("array<double>").alias("x"))
    out = rows.groupBy(*keys).agg(
        F.first("_size").alias("size"), F.sum(F.col("_in").cast("int")).alias("n"),
        F.sum((F.col("_in") & F.col("z").isNull()).cast("int")).alias("unknown"), F.sort_array(F.collect_list(cell)).alias("c"),
    )
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    usable = (F.col("n") >= 2 * period + 3) & (F.col("unknown") == period + 1)
    return out.select(
        *keys, "size", "n", usable.alias("usable"), F.transform("c", lambda s: s["t"]).alias("dates"),
        F.transform("c", lambda s: s["y"]).alias("y"), F.transform("c", lambda s: zero(s["z"])).alias("z"),
        F.flatten(F.transform("c", lambda s: s["x"])).alias("x"),
    )


def _grids(batch: pa.RecordBatch, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Differences and covariates of a batch of series as padded grids (time first),
    and their lengths."""
    zs = [np.asarray(v, float) for v in batch.column("z").to_pylist()]
    xs = [np.asarray(v, float).reshape(len(z), wide) for z, v in zip(zs, batch.column("x").to_pylist())]
    sizes = np.array([len(z) for z in zs])
    z, x = np.zeros((sizes.max(), len(zs))), np.zeros((sizes.max(), len(zs), wide))
    for i in range(len(zs)):
        z[: sizes[i], i], x[: sizes[i], i] = zs[i], xs[i]
    return z, x, sizes


def _back(grid: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(grid)
    out[k:] = grid[:-k]
    return out


def residuals(model: Arma, z: np.ndarray, x: np.ndarray, first: int, n: np.ndarray, slopes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Regression residuals ``u``, innovations ``e`` (0 before they can be known and
    after ``n`` rows) and their slopes by coefficient. ``first`` is the first row
    with a difference."""
    s = model.period
    (a, sa, m, sm), c, beta = (model.terms[t] for t in TERMS), model.constant, np.array(list(model.covariates.values()))
    time = np.arange(len(z))[:, None]
    live = (time >= first + s + 1) & (time < n)
    u = np.where(time >= first, z - c - x @ beta, 0.0)
    driven = u - a * _back(u, 1) - sa * _back(u, s) + a * sa * _back(u, s + 1)

    def recursion(given: np.ndarray, live: np.ndarray) -> np.ndarray:
        out = np.zeros_like(given)
        for t in range(first + s + 1, len(given)):
            out[t] = np.where(live[t], given[t] - m * out[t - 1] - sm * out[t - s] - m * sm * out[t - s - 1], 0.0)
        return out

    e = recursion(driven, live)
    if not slopes:
        return u, e, np.zeros((*e.shape, 0))
    ones = np.where(time >= first, np.ones_like(z), 0.0)
    inputs = np.concatenate([ones[:, :, None], np.where((time >= first)[:, :, None], x, 0.0)], axis=2)
    direct = np.concatenate(
        [
            np.stack([sa * _back(u, s + 1) - _back(u, 1), a * _back(u, s + 1) - _back(u, s), -_back(e, 1) - sm * _back(e, s + 1), -_back(e, s) - m * _back(e, s + 1)], axis=2),
            -(inputs - a * _back(inputs, 1) - sa * _back(inputs, s) + a * sa * _back(inputs, s + 1)),
        ],
        axis=2,
    )
    return u, e, recursion(direct, live[:, :, None])


def scored_from(n: np.ndarray, period: int) -> np.ndarray:
    """First row of each series that counts in the sum of squares."""
    return 2 * period + 2 + np.where(n >= LONG * period, period, 0)


def _sums(series: DataFrame, model: Arma) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Products of slopes, slopes times residuals, squares and rows, over all series."""
    size, first = 5 + len(model.covariates), model.period + 1
    shared = series.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, model = np.zeros(size * size + size + 2), shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                z, x, _ = _grids(b, size - 5)
                n = b.column("n").to_numpy()
                _, e, slope = residuals(model, z, x, first, n)
                begin = scored_from(n, model.period)
                counts = np.arange(len(z))[:, None] >= begin
                flat, own = (slope * counts[:, :, None]).reshape(-1, size), (e * counts).ravel()
                rows = np.maximum(n - begin, 0).sum()
                total += np.concatenate([(flat.T @ flat).ravel(), flat.T @ own, [own @ own, rows]])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "v": pa.array(total)})

    sums = series.select("n", "z", "x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    total = np.zeros(size * size + size + 2)
    for r in sums.collect():
        total[r.i] = r.v
    return total[: size * size].reshape(size, size), total[size * size : -2], float(total[-2]), int(total[-1])


def refined(series: DataFrame, start: Arma, steps: int = STEPS) -> Arma:
    """Least conditional sum of squares from ``start``, by damped Gauss-Newton steps;
    each is one job over the packed series (staged, usable ones only)."""
    best, damping = start, 1e-4
    products, slope, least, rows = _sums(series, start)
    if rows == 0:
        return start
    for step in range(1, steps + 1):
        damped = products + damping * np.diag(np.diag(products) + 1e-9)
        move = np.linalg.lstsq(damped, -slope, rcond=1e-12)[0]
        v = best.vector() + move
        v[:4] = np.clip(v[:4], -LARGEST, LARGEST)
        tried = best.replaced(v, rows=rows, steps=step)
        found = _sums(series, tried)
        if found[2] <= least:
            gain = (least - found[2]) / max(least, 1e-300)
            best, damping = tried, damping / 10
            products, slope, least, rows = found
            if gain < GAIN:
                break
        else:
            damping *= 10
            if damping > 1e6:
                break
    return best.replaced(best.vector(), variance=least / rows, rows=rows, steps=best.steps)


def continued(series: DataFrame, model: Arma, keys: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Forecasts of every row after training: actual, predicted, and for series that
    don't reach back far enough no forecast but a ``reason``."""
    shared = series.sparkSession.sparkContext.broadcast(model)
    wide, first, s = len(model.covariates), model.period + 1, model.period

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        a, sa, m, sm = (model.terms[t] for t in TERMS)
        beta = np.array(list(model.covariates.values()))
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                z, x, sizes = _grids(b, wide)
                n = b.column("n").to_numpy()
                us, es, _ = residuals(model, z, x, first, n, slopes=False)
                out = []
                for i, (size, usable, y) in enumerate(zip(*(b.column(c).to_pylist() for c in ("size", "usable", "y")))):
                    if not usable:
                        out.append([None] * int(sizes[i] - n[i]))
                        continue
                    u, e, level = list(us[: n[i], i]), es[:, i], [float(v) for v in y[: n[i]]]
                    for t in range(n[i], sizes[i]):
                        u.append(a * u[t - 1] + sa * u[t - s] - a * sa * u[t - s - 1] + m * e[t - 1] + sm * e[t - s] + m * sm * e[t - s - 1])
                        move = size * (u[t] + model.constant + float(x[t, i] @ beta))
                        level.append(move + level[t - 1] + level[t - s] - level[t - s - 1])
                    out.append(level[n[i] :])
                kept = [b.column(k) for k in (*keys, "n", "usable", "dates", "y")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.float64()))], names=[*keys, "n", "usable", "dates", "y", "predicted"])

    schema = series.select(*keys, "n", "usable", "dates", "y").schema.add("predicted", T.ArrayType(T.DoubleType()))
    rows = series.mapInArrow(run, schema)
    after = lambda c: F.slice(c, F.col("n").cast("int") + 1, F.greatest(F.size(c) - F.col("n").cast("int"), F.lit(0)))
    cells = F.arrays_zip(after("dates").alias("t"), after("y").alias("y"), F.col("predicted").alias("p"))
    reason = F.when(~F.col("usable"), F.lit("unknown history"))
    each = rows.select(*keys, reason.alias("reason"), F.explode(cells).alias("_c"))
    return each.select(*keys, F.col("_c.t").alias(spec.time), F.col("_c.y").alias("actual"), F.col("_c.p").alias("predicted"), "reason")


def seasonal_arma(
    weekly: DataFrame, keys: Sequence[str], covariates: Sequence[str] = (), n_val: int = 8, period: int = 52,
    spec: PanelSpec = DEFAULT,
) -> tuple[Arma, DataFrame]:
    """The fitted coefficients, and forecasts of the last ``n_val`` dates."""
    rows = stage(twice_differenced(weekly, keys, covariates, n_val, period, spec), "differenced")
    start, _ = hannan_rissanen(rows, keys, period, spec)
    series = stage(packed(rows, keys, period, spec), "series")
    model = refined(series.where("usable"), start)
    return model, continued(series, model, keys, spec)


def coefficients(model: Arma, spark) -> DataFrame:
    rows = [*model.terms.items(), ("constant", model.constant), *model.covariates.items(), ("residual_variance", model.variance)]
    return spark.createDataFrame([(t, float(v)) for t, v in rows], "term string, value double")
