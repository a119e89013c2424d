"""Time the headline queries and the three spans of a full run; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairloom.catalog import REGISTRY
from pairloom.catalog.learning import prepared_documents
from pairloom.plans.end_to_end import finish, fit
from pairloom.session import local_session

HEADLINE = [
    "clean_text", "record_text", "dedupe_last_text", "truth_pairs", "exact_sample", "shuffle_split",
    "l2_normalize", "knn_join_exact", "knn_join_exact_cells", "knn_join_ivf", "knn_join_lsh", "knn_self_join",
    "label_pairs", "pair_features", "hybrid_features", "jaro_winkler_pairs", "query_hybrid", "pr_curve",
    "pr_f1_global", "mine_noisy_pairs", "knn_components", "embed_hashing", "kmeans_chunks",
]


def drain(df) -> None:
    """Run the whole plan and discard the rows."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    drain(REGISTRY["knn_join_exact_cells"].run(spark, sf_dir))  # start the JVM and the Python workers
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.time()
        drain(REGISTRY[name].run(spark, sf_dir))
        seconds[name] = round(time.time() - started, 3)
    run = finish(fit(prepared_documents(spark, sf_dir)))
    metrics = {r["scope"]: {k: round(r[k], 4) for k in ("precision", "recall", "f1")} for r in run.metrics().collect()}
    for span, took in run.seconds.items():
        seconds[f"run_{span}"] = round(took, 3)
    recall = {r["method"]: {"recall": r["recall"], "compared": r["compared"]} for r in REGISTRY["knn_recall"].run(spark, sf_dir).collect()}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "knn_recall": recall, "quality": metrics,
        "spark": spark.version, "cores": cores, "driver_memory": spark.conf.get("spark.driver.memory"),
    }))


if __name__ == "__main__":
    main()
