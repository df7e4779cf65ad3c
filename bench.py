"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES  # noqa: E402
from tastemesh.session import build_session  # noqa: E402

HEADLINE = (
    "interaction_cells", "clean_history", "export_history_rated", "catalog_denorm", "rec_pearson", "rec_cosine",
    "rec_consensus", "pearson_neighbors_batch", "cosine_neighbors_batch", "rec_pearson_batch", "rec_cosine_batch",
    "pearson_matrix", "cosine_matrix", "pearson_predict_all", "cosine_predict_all", "content_score_all",
    "tokens", "ngrams", "tfidf_vocab", "tfidf_vectors", "rec_content", "rec_content_batch", "vector_mean",
    "vector_cosine",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(2 * int(cpus)), spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's scan path and the Python workers before anything is timed.
    QUERIES["pearson_neighbors_batch"](spark, "/root/testdata/sf0.001").count()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
