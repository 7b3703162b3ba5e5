"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: input folder (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8);
BENCH_RUNS: timed runs per query after one warm-up (default 3, the median counts);
BENCH_QUERIES: comma-separated names, or ``all``.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans.registry import QUERIES  # noqa: E402
from quire.session import build_session  # noqa: E402

HEADLINE = [
    "classified_by_keywords",
    "answers_parsed",
    "confidence_scored",
    "similar_documents",
    "prompts_compared",
    "drift_checked",
    "histogram_extraction_confidence",
    "text_assembled",
    "confidence_by_page",
    "ocr_reconciled",
    "invoice_fields",
    "documents_in_flight",
    "overall_accuracy",
    "documents_upserted",
    "documents_extracted",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.log.level": "ERROR",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
