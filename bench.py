"""Headline benchmark: prints one JSON line with seconds per query.

Each query is run once to warm up and then timed; the median of the timed runs
counts. Results are written to Spark's ``noop`` sink, which computes every row.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from panelcast.catalog import QUERIES
from panelcast.session import drop_staged, local_session

HEADLINE = [
    "j2_panel",
    "j4_group_means",
    "w1_lags_by_supplier",
    "w3_rolling_by_supplier",
    "c1_impute_series",
    "fe_all_features",
    "a5_event_impact",
    "a8_promo_effect",
    "a15_rollup_store_date",
    "a17_hierarchy_totals",
    "a23_exact_quantiles",
    "t1_correlations",
    "t9_decompose",
    "t11_acf",
    "t13_unit_root",
    "m4_ensemble_by_supplier",
    "h3_ols_by_supplier",
    "v1_v2_accuracy",
    "v11_error_profile",
    "i7_key_drivers",
    "f1_forecast_run",
]
#: Slower or newer queries: timed once after a warm-up, not part of the sum.
MORE = ["a3_describe", "a16_weekly_resample", "h10_level_errors", "c5_backtest", "m8_hannan_rissanen", "f3_given_grid"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus, "panelcast-bench")
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        timed(name)
        seconds[name] = round(statistics.median(timed(name) for _ in range(runs)), 3)
    more = {}
    for name in MORE if names == HEADLINE else []:
        timed(name)
        more[name] = round(timed(name), 3)
    drop_staged(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "more": more,
                "sf": folder.rsplit("sf", 1)[-1],
                "cpus": int(cpus) if cpus.isdigit() else cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
