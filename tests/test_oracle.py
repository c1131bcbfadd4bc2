"""Registered queries against their SQL. All of them with PANELCAST_ALL=1;
otherwise one or more of each section."""

import os

import pytest
from compare import compare, connect

from panelcast.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SECTIONS = (
    "s2_date_parse p5_p8_promos p10_stress_index j2_panel j4_group_means a4_missing a8_promo_effect "
    "a15_rollup_date a17_hierarchy_totals a23_exact_quantiles w1_lags w3_rolling w8_interpolate "
    "w9_fill_global k5_validation_start c1_impute_series c5_folds t1_correlations t9_decompose t11_acf "
    "m4_ensemble h3_ols_reconciliation h6_coherence_verdict v1_v2_accuracy v11_error_profile "
    "i7_key_drivers i8_findings c5_backtest f3_given_grid k6_model_store m8_hannan_rissanen w1_lags_calendar"
).split()
NAMES = list(ORACLES) if os.environ.get("PANELCAST_ALL") else SECTIONS


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    problem, rows = compare(spark, duck, FOLDER, QUERIES[name], ORACLES[name])
    assert problem is None and rows > 0


def test_names_are_consistent():
    assert set(ORACLES) <= set(QUERIES)
