"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.  The pair table, the
cell halves and the counts of all splits, which a pipeline stores once, are built and timed first, as ``universe``,
``halves`` and ``sums``; queries read them, so the counting itself is in ``sums`` and no longer in ``evidence_counts``.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

import workloads
from workloads.base import STORED, Inputs

HEADLINE = [
    "contacts_to_pixels", "contact_filter", "route_contacts", "family_half_counts", "evidence_counts", "assign_pair_id", "replicate_support", "annotate_anchors",
    "classification_metrics", "exact_quantiles", "conditional_ll", "topk_overlap_neighbour", "catalog_support", "adaptive_smooth", "reproducibility_summary",
    "overlap_mean", "draw_controls", "neighbour_count", "ice_balance",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("contactspark-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times = {}
    STORED.clear()
    inputs = Inputs(spark, folder)
    for name, table in (("universe", "universe"), ("halves", "assignments"), ("sums", "sums")):
        start = time.perf_counter()
        getattr(inputs, table)
        times[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        workloads.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
