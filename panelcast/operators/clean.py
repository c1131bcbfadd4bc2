"""Imputation, splitting, folds, scaling and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.functions import scalars as S
from panelcast.functions import windows as WF
from panelcast.operators import carry
from panelcast.operators.joins import scalars
from panelcast.spec import DEFAULT, PanelSpec


def drop_unknown_target(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    return df.dropna(subset=[spec.target])


def fill_forward(df: DataFrame, cols: list[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    w = WF.series_window(spec.keys, spec.time)
    return df.withColumns({c: WF.fill_forward(F.col(c), w) for c in cols})


def interpolate(df: DataFrame, cols: list[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    w, back = WF.series_window(spec.keys, spec.time), WF.reverse_window(spec.keys, spec.time)
    at = df.withColumn("_pos", F.row_number().over(w))
    return at.withColumns({c: WF.interpolate(F.col(c), F.col("_pos"), w, back) for c in cols}).drop("_pos")


def fill_within(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols})


def impute(
    df: DataFrame,
    carried: list[str],
    numeric: list[str],
    across: bool = False,
    spec: PanelSpec = DEFAULT,
) -> DataFrame:
    """Promotions to 0, ``carried`` columns filled forward, all ``numeric`` ones
    interpolated, and the rest 0. With ``across`` the rest is first filled from
    neighbouring series in key order, which mixes series."""
    promos = [c for c in spec.promos if c in df.columns]
    out = df.withColumns({c: S.zero_if_null(F.col(c)) for c in promos})
    todo = list(dict.fromkeys([*carried, *numeric]))
    out = interpolate(fill_forward(out, carried, spec), todo, spec)
    return carry.fill_across(out, todo, spec) if across else fill_within(out, todo)


def mean_impute(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Empty cells take the mean of their column, in ``fit_on`` if that is given."""
    s = scalars(df if fit_on is None else fit_on, **{c: F.avg(c) for c in cols})
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), s[c]) for c in cols})


def validation_start(df: DataFrame, n: int = 8, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row: the n-th last distinct date (the first, if there are fewer)."""
    last = df.select(spec.time).distinct().orderBy(F.col(spec.time).desc()).limit(n)
    return last.agg(F.min(spec.time).alias("start"))


def time_split(df: DataFrame, n: int = 8, spec: PanelSpec = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows: the last ``n`` distinct dates validate."""
    start = validation_start(df, n, spec).scalar()
    return df.where(F.col(spec.time) < start), df.where(F.col(spec.time) >= start)


def walk_forward_folds(
    df: DataFrame, folds: int = 3, horizon: int = 8, spec: PanelSpec = DEFAULT
) -> DataFrame:
    """Fold table: each fold validates the ``horizon`` dates after its training end.

    Built on the distinct dates, a table no longer than the calendar.
    """
    dates = df.select(spec.time).distinct()
    back = F.row_number().over(W.orderBy(F.col(spec.time).desc())) - 1
    fold = (folds - F.floor(F.col("back") / horizon)).cast("int")
    return (
        dates.withColumn("back", back)
        .where(F.col("back") < folds * horizon)
        .groupBy(fold.alias("fold"))
        .agg(F.min(spec.time).alias("val_start"), F.max(spec.time).alias("val_end"))
        .withColumn("train_end", F.date_sub("val_start", 1))
        .select("fold", "train_end", "val_start", "val_end")
    )


def assign_folds(df: DataFrame, folds: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Rows by fold and role. A row trains in every later fold and validates in
    at most one; the fold table has a few rows by construction."""
    table = folds.agg(F.collect_list(F.struct("fold", "train_end", "val_start", "val_end")).alias("f"))
    each = df.withColumn("_f", F.explode(table.scalar()))
    role = F.when(F.col(spec.time) <= F.col("_f.train_end"), "train").when(
        F.col(spec.time) <= F.col("_f.val_end"), "validation"
    )
    return (
        each.withColumn("fold", F.col("_f.fold")).withColumn("role", role).drop("_f").where("role is not null")
    )


def scaling_table(df: DataFrame, cols: list[str]) -> dict:
    """Population mean and std per column, as scalar expressions; zero std is 1."""
    aggs = {}
    for c in cols:
        aggs |= {f"{c}_m": F.avg(c), f"{c}_s": F.stddev_pop(c)}
    s = scalars(df, **aggs)
    one = F.lit(1.0)
    return {
        c: (s[f"{c}_m"], F.coalesce(F.nullif(s[f"{c}_s"], F.lit(0.0)), one)) for c in cols
    }


def scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    table = scaling_table(df if fit_on is None else fit_on, cols)
    return df.withColumns({f"{c}_scaled": (F.col(c) - m) / s for c, (m, s) in table.items()})


def unscale(df: DataFrame, cols: list[str], fit_on: DataFrame) -> DataFrame:
    """Scaled values back to their original scale."""
    table = scaling_table(fit_on, cols)
    return df.withColumns({c: F.col(f"{c}_scaled") * s + m for c, (m, s) in table.items()})


def bounded_sample(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The same ``n`` rows on every run: those whose keys have the smallest
    digest. Each task keeps its own first ``n`` only."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    return df.orderBy(digest, *keys).limit(n)
