"""Named queries over the input tables, with their SQL."""

from panelcast.catalog import features, forecast, profile, stats  # noqa: F401
from panelcast.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
