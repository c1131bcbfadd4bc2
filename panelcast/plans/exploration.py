"""Exploration plan: the profile tables of one merged panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import profile, stats
from panelcast.session import stage
from panelcast.spec import DEFAULT, PanelSpec


def run(panel: DataFrame, spec: PanelSpec = DEFAULT) -> dict[str, DataFrame]:
    """Lazy profile tables by name. The panel is written once; every table is an
    independent aggregate that reads only its own columns."""
    panel = stage(spec.validate(panel), "panel")
    total = panel.groupBy(F.lit("Total").alias("node"), spec.time).agg(F.sum(spec.target).alias("y"))
    series = (["node"], spec.time, "y")
    parts = stats.decompose(total, *series)
    numeric = [spec.target, *spec.covariates, *spec.promos]
    return {
        "overview": profile.overview({"panel": panel}, spec),
        "quality": profile.target_quality(panel, spec),
        "missing": profile.missing_report(panel),
        "description": profile.describe(panel, numeric),
        "events": profile.event_impact(panel, spec),
        "types": profile.group_profile(panel, [spec.type], spec),
        "departments": profile.group_profile(panel, [spec.keys[-1]], spec),
        "sites": profile.store_profile(panel, spec),
        "promotions": profile.promo_effect(panel, spec),
        "by_date": profile.totals_by_time(panel, spec),
        "years": profile.yearly_growth(panel, spec),
        "headline": profile.headline(panel, spec),
        "correlations": stats.correlations(panel, spec.target, numeric[1:]),
        "decomposition": parts,
        "strengths": stats.component_strengths(parts, ["node"]),
        "autocorrelation": stats.autocorrelations(total, *series),
        "unit_root": stats.unit_root_tests(total, *series),
    }
