"""panelcast: panel time-series analytics and forecasting on Spark DataFrames."""

from panelcast.spec import PanelSpec

__all__ = ["PanelSpec"]
