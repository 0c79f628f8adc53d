"""Headline queries, timed end to end; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the threads."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quillspark import registry

HEADLINE = (
    "graph_edges_lines", "graph_nodes", "embedding_records", "degrees", "pair_enrichment", "pair_repeats", "bidirectional_pairs", "book_trajectory",
    "book_trajectory_lines", "pair_trajectory", "active_pairs", "ranked_arcs", "paths_up_to", "n_hop_reach", "two_step_walks", "templated_chains",
    "resolution_map", "nearest_within_book", "guessed_language", "question_plans",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        started = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
