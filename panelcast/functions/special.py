"""Small vectorized Python functions for values with no Spark built-in."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a, b, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 301):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| > |t|) for Student's t, by the regularized incomplete beta function."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    out[np.isinf(t) & (df > 0)] = 0.0
    a, b = df[ok] / 2.0, 0.5
    x = df[ok] / (df[ok] + t[ok] ** 2)
    gamma = np.array([math.lgamma(v + b) - math.lgamma(v) - math.lgamma(b) for v in a])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma + a * np.log(x) + b * np.log1p(-x))
        direct = x < (a + 1.0) / (a + b + 2.0)
        left = front * _beta_fraction(a, b, x) / a
        right = 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    out[ok] = np.clip(np.where(t[ok] == 0, 1.0, np.where(direct, left, right)), 0.0, 1.0)
    return out


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value column; for small result tables."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(student_two_sided(t.to_numpy(float), df.to_numpy(float)))

    return F.nullif(p(t.cast("double"), df.cast("double")), F.lit(float("nan")))


def partial_autocorrelations(r: np.ndarray) -> np.ndarray:
    """Durbin-Levinson recursion on autocorrelations r[0..m]."""
    m = len(r) - 1
    out = np.ones(m + 1)
    phi = np.zeros(0)
    for k in range(1, m + 1):
        if k == 1:
            last = r[1]
        else:
            last = (r[k] - phi @ r[k - 1 : 0 : -1]) / (1.0 - phi @ r[1:k])
        phi = np.append(phi - last * phi[::-1], last)
        out[k] = last
    return out


# MacKinnon (1994) p-value polynomials and MacKinnon (2010)
# critical values for a unit-root test with a constant.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}


def unit_root_p(stat: float) -> float:
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    poly = SMALL_P if stat <= TAU_STAR else LARGE_P
    z = sum(c * stat**i for i, c in enumerate(poly))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    ssr = float(rest @ rest)
    spread = ssr / max(len(y) - x.shape[1], 1) * np.linalg.pinv(x.T @ x)
    return beta, np.sqrt(np.maximum(np.diag(spread), 0.0)), ssr


def unit_root_test(y: np.ndarray) -> dict[str, float] | None:
    """Augmented Dickey-Fuller test with a constant; the lag order minimizes AIC
    on a common sample. None for series too short or constant."""
    n = len(y)
    if n < 10 or np.ptp(y) == 0:
        return None
    most = min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2)
    dy = np.diff(y)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(skip, len(dy))
        cols = [y[rows], *[dy[rows - j] for j in range(1, lags + 1)], np.ones(len(rows))]
        return np.column_stack(cols), dy[rows]

    best, best_aic = 0, math.inf
    for lags in range(most + 1):
        x, d = design(lags, most)
        *_, ssr = _ols(x, d)
        aic = len(d) * math.log(max(ssr, 1e-300) / len(d)) + 2 * x.shape[1]
        if aic < best_aic - 1e-12:
            best, best_aic = lags, aic
    x, d = design(best, best)
    beta, se, _ = _ols(x, d)
    if se[0] == 0:
        return None
    stat = float(beta[0] / se[0])
    used = len(d)
    out = {"statistic": stat, "p_value": unit_root_p(stat), "used_lags": best, "n_obs": used}
    out |= {k: sum(c / used**i for i, c in enumerate(v)) for k, v in CRITICAL.items()}
    return out
