"""Modelling plan: features, imputation, split, as the input of a fitted model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import clean, features
from panelcast.session import stage
from panelcast.spec import DEFAULT, PanelSpec


@dataclass(frozen=True)
class ModelSets:
    """Rows before and from the first validation date on, and the columns filled."""

    train: DataFrame
    validation: DataFrame
    imputed: list[str]


def run(panel: DataFrame, n_val: int = 8, spec: PanelSpec = DEFAULT) -> ModelSets:
    """Engineered features that see only the past, without gaps.

    Lags and rolling statistics are carried forward within their series; what is
    still empty there, before a series has its first, takes the training mean. Covariates
    are carried forward too, never interpolated: a line between two known values would
    show a training row what comes later.
    """
    panel = stage(spec.validate(panel), "panel")
    fit, _ = clean.time_split(panel, n_val, spec)
    ready = features.engineer(panel, spec, exclude_current=True, fit_on=fit)
    derived = [c for c in ready.columns if c.startswith(f"{spec.target}_")]
    numeric = [c for c in spec.feature_columns(ready, numeric_only=True) if c not in spec.promos and c not in derived and c != spec.event]
    filled = clean.fill_forward(ready, [*derived, *numeric], spec)
    start = clean.validation_start(panel, n_val, spec).scalar()
    known = filled.where(F.col(spec.time) < start)
    rows = stage(clean.mean_impute(filled, [*derived, *numeric], known), "modelling")
    train, validation = clean.time_split(rows, n_val, spec)
    return ModelSets(train, validation, [*derived, *numeric])
