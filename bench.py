"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

value: seconds of all queries, warm; cold: the same the first time. rate: diagnoses a second over
the whole signal table in the replay.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from rootspan.plans import catalog

NAMES = ["f2_signals_by_node", "f3_ancestors", "f9_candidate_causes", "f11_diagnose_all", "f12_replay", "g4_alert_groups", "h1_islands", "h7_blast_radius", "c1_classify_failure", "b1_b13_edges", "b21_ci_graph"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, cold, warm, rows = catalog.queries(), {}, {}, {}
    for times in (cold, warm):
        for name in NAMES:
            began = time.time()
            seen = Observation()
            df = queries[name](spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("n"))
            df.write.format("noop").mode("overwrite").save()  # every column is computed
            rows[name] = seen.get["n"]
            times[name] = round(time.time() - began, 3)
    out = {"metric": "headline queries, warm", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "rows": rows, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    out["diagnoses_per_sec"] = round(rows["f12_replay"] / warm["f12_replay"], 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
