"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["tpl_01_filter_aggregate_measure", "pred_07_within_radius", "join_01_nearest_of_set", "join_02_radius_join", "join_05_ontology_match", "agg_10_fingerprint", "agg_13_conditional", "agg_27_weight_grid", "top_05_like_this", "top_08_links_per_head", "str_01_trigram", "gra_07_clustering", "drf_06_divergence", "ext_tumbling_windows"]


def main() -> None:
    from quadrille.plans import catalog

    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 4)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(where.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
