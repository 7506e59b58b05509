"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line.

The store of rollups is built once and timed by itself (`rebuild_events_per_s`); queries that read it are timed apart.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallymill.operators import analytics, rollup  # noqa: E402
from tallymill.plans import registry, usage  # noqa: E402
from tallymill.sources import stored, testdata  # noqa: E402

#: Queries that compute from events, and queries that read the stored rollup.
BUILDING = ("a2_time_rollup", "a5_session_rollup", "p12_cost_auto_days", "l5_replay_classes", "q2_quota_transitions", "b1_reconcile", "g5_range_categories", "s6_observations")
READING = ("u1_overview", "u3_daily_series", "u4_breakdown_model", "u5_rhythm_cells", "u7_lifetime", "x1_model_shares")


def timed(run) -> float:
    began = time.time()
    run()
    return round(time.time() - began, 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    events = testdata.usage_event(spark, sf_dir)
    n = events.count()  # starts the workers
    events.write.format("noop").mode("overwrite").save()
    found, took = registry.queries(), {}
    for name in BUILDING:
        took[name] = timed(lambda name=name: found[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    rebuilt = timed(lambda: stored.write(rollup.time_rollup(events), tempfile.mkdtemp(prefix="tallymill-bench-") + "/rollup"))
    kept = usage.kept(spark, sf_dir)
    kept.count()
    for name in READING:
        took[name] = timed(lambda name=name: found[name](spark, sf_dir).collect())
    full = lambda: analytics.full_analytics(kept, usage.START, usage.END, usage.TARGETS, zone=usage.ZONE).collect()
    took["full_analytics_cold"] = timed(full)
    took["full_analytics_on_rollup"] = min(timed(full) for _ in range(3))
    took["overview_on_rollup"] = min(timed(lambda: analytics.overview(kept, usage.START, usage.END).collect()) for _ in range(3))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "rebuild_events_per_s": round(n / max(rebuilt, 1e-9))}))


if __name__ == "__main__":
    main()
