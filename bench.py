"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from larder.catalog import QUERIES
from larder.session import local_session

HEADLINE = [
    "txt01_clean", "txt11_printed_percent", "txt12_match", "cls04_rules", "agg01_group", "agg05_supported_mean", "jon10_hierarchical_fallback",
    "win01_keep_first", "win10_totals", "sta01_regression", "cmp07_choose_estimator", "cmp09_sum_to_100", "trd05_reconcile", "trd08_re_export",
    "trd13_reweight", "env01_impacts", "mc02_weighted_draws", "mc05_product_totals", "nut06_letters", "hlt02_relative_risk",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start-up is not measured
    times = {}
    for name in [q for q in HEADLINE if q in QUERIES]:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
