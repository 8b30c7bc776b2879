"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ONLY (comma list).
Every query starts without models left over from the query before.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ratewise import catalog
from ratewise.session import local_session

HEADLINE = [
    "a1_a3_item_features",
    "p1_p5_interactions_to_ratings",
    "a13_data_health",
    "m2_bias_als_parameters",
    "w1_m2_top10_bias",
    "j7_m9_item_similarity_edges",
    "m9_m11_predict_item_item",
    "m10_m11_predict_user_user",
    "m12_user_profiles",
    "m5_fit_linear",
    "t1_postings",
    "t3_j9_w2_sparse_top50",
    "t4_j10_dense_top10",
    "t6_w5_keyword_enrichment",
    "t7_x4_x7_recipe_metadata",
    "r8_r7_questionnaire_batch",
    "w4_per_user_holdout",
    "e4_top_n_metrics",
    "e6_evaluate_hybrid",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session("bench", cpus, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the engine outside the clock
    names = list(catalog.QUERIES) if only == ["all"] else only or HEADLINE
    timings = {}
    for name in names:
        catalog.forget_shared()
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_wall_time", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
