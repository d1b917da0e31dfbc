"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``: one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from cellframe import catalog
from cellframe.core import settled
from cellframe.operators import graph, metrics
from cellframe.plans.adapter import latent_many

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "two_group_deg", "two_group_deg_pvalues", "nested_deg", "clip_logfc", "highlight_genes", "pearson_fit", "pearson_transform",
    "dotplot_table", "stacked_bars", "density_2d", "normalize_log1p", "stratified_split", "hvg_sample", "variable_genes",
    "split_stats", "condition_vector", "dataset_rows", "knn_cosine", "graph_connectivity", "kbet", "silhouettes", "lisi", "leiden", "scib_metrics",
]


def larger(spark: SparkSession) -> dict:
    """Communities and metrics at the sizes that others publish: 14,000 and 28,000 cells at sf0.1."""
    cells = {n: settled(latent_many(spark, SF_DIR, n), "cells") for n in (7, 14)}
    near = {n: settled(graph.knn(c, 15), "knn") for n, c in cells.items()}
    return {
        "scib_metrics_x7": lambda: metrics.scib_metrics(cells[7].select("cell_id", "vec"), cells[7], n_neighbors=15),
        "knn_x14": lambda: graph.knn(cells[14], 15),
        "knn_approximate_x14": lambda: graph.knn(cells[14], 15, method="approximate"),
        "leiden_x14": lambda: graph.leiden(cells[14], graph.knn_edges(near[14])),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    found["two_group_deg"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # starts workers, compiles
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    for name, f in larger(spark).items():
        began = time.perf_counter()
        f().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(os.path.normpath(SF_DIR)).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
