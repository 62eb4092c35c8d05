"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Each query runs to the end and every output column is produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

from streamwarden.plans.registry import QUERIES
from streamwarden.session import local_session

HEADLINE = (
    "violation_counts",
    "contract_route",
    "heal_outcomes",
    "psi_by_column",
    "chi2_by_column",
    "drift_verdict",
    "distribution_distances",
    "breaker_replay",
    "guard_replay",
    "dedup_stale",
    "feature_projection",
    "forest_score",
    "context_join",
    "catalog_upsert",
    "cosine_top1",
    "last_n_per_topic",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
