"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores.
Each query runs once cold, in this order, into a sink that keeps nothing; one
unrelated query runs first so that JVM start-up is not charged to any of them.
"""

from __future__ import annotations

import json
import os
import time

from chainweft.plans import catalog
from chainweft.plans.registry import bound
from chainweft.session import local_session

HEADLINE = [
    "wallet_overview", "a01_latest_line_version", "a03_canonical_outputs", "c04_recent_transfers",
    "c06_transaction_participants", "d05_exchange_flows", "d06_rapid_pass_through", "d10_spender",
    "e02_utxo_wallet_summary", "e05_account_fingerprint", "e08_asset_flows", "e09_counterparty_shares",
    "e11_wallet_aggregate", "e12_flow_trend", "e17_net_flows", "f05_missing_ranges", "h01_neighbourhood",
    "h06_exposure_capped", "h08_exposure_pairs", "h09_exposure_utxo", "i01_common_input_leads", "j06_swaps",
    "j14_transaction_type", "k02_wallet_type", "k06_risk_assessment", "n01_gap_scan",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    bound(catalog.QUERIES["g02_top_assets"])(spark, path).collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        df = bound(catalog.QUERIES[name])(spark, path)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
