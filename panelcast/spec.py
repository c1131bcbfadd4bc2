"""Column roles of a panel.

Every operator takes its column names from a ``PanelSpec``, so nothing in the
library depends on one data set's naming.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class PanelSpec:
    """Roles of a panel's columns.

    ``keys`` lists the series keys from the top of the hierarchy downwards.
    A panel holds at most one row per (keys, time); ``cells`` builds such a
    table from raw rows, ``duplicate_cells`` finds violations.
    """

    keys: tuple[str, ...] = ("store", "dept")
    time: str = "date"
    target: str = "weekly_sales"
    event: str = "is_holiday"
    promos: tuple[str, ...] = ("markdown1", "markdown2", "markdown3", "markdown4", "markdown5")
    covariates: tuple[str, ...] = ("temperature", "fuel_price", "cpi", "unemployment")
    size: str | None = "size"
    type: str | None = "type"
    step_days: int = 7
    labels: tuple[str, ...] = ("Store", "Department")

    @property
    def top(self) -> str:
        return self.keys[0]

    def level(self, depth: int) -> str:
        """Name of a hierarchy level: 'Total', 'Store', 'Store_Department'."""
        return "_".join(self.labels[:depth]) or "Total"

    def required(self) -> list[str]:
        return [*self.keys, self.time, self.target]

    def validate(self, df: DataFrame) -> DataFrame:
        """Check that the roles exist with usable types (schema only, no job)."""
        missing = [c for c in self.required() if c not in df.columns]
        if missing:
            raise ValueError(f"panel lacks the columns {missing}")
        if not isinstance(df.schema[self.time].dataType, T.DateType):
            raise TypeError(f"{self.time} must be a date")
        if not isinstance(df.schema[self.target].dataType, T.NumericType):
            raise TypeError(f"{self.target} must be numeric")
        return df

    def feature_columns(self, df: DataFrame, numeric_only: bool = False) -> list[str]:
        """Model columns: all but the identifiers, target and ``*_scaled`` copies."""
        excluded = {*self.keys, self.time, self.target, self.type, "event_weight"}
        kinds = (T.NumericType, T.BooleanType) if numeric_only else (T.DataType,)
        return [
            f.name
            for f in df.schema.fields
            if f.name not in excluded
            and not f.name.endswith("_scaled")
            and isinstance(f.dataType, kinds)
        ]


DEFAULT = PanelSpec()
