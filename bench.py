"""Time the headline queries and print one JSON line.

Each query runs once cold and then five times warm into a sink that takes in every row; the reported
number is the warm median. Settings: BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default all cores).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gleaner.queries import load_all  # noqa: E402
from gleaner.session import build_session  # noqa: E402

HEADLINE = [
    "top_skills", "set_overlap", "dedupe_keep_last", "keyword_mask_any_column", "bm25_retrieve", "bm25_rank",
    "html_to_markdown", "company_rollup", "dedupe_keep_first", "value_counts_topn", "inner_join_renamed_keys",
    "lead_flag", "keyword_candidates", "md_blocks", "card_repair",
]
WARM_RUNS = 5


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "gleaner-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()

    def timed(name: str) -> float:
        start = time.perf_counter()
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    cold, warm = {}, {}
    for name in HEADLINE:
        cold[name] = round(timed(name), 3)
        warm[name] = round(statistics.median(timed(name) for _ in range(WARM_RUNS)), 3)
    print(json.dumps({
        "metric": "sum of warm medians", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "cold": cold, "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
