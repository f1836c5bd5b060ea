"""Times the headline queries and prints one JSON line.

Every query is planned and run in full into Spark's no-op sink, so all rows and
columns are produced.  One warm-up query starts the session's code paths first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from attestry.registry import QUERIES  # noqa: E402
from attestry.session import session  # noqa: E402

HEADLINE = [
    "scoreboard_models", "scoreboard_groups", "instance_first_final", "tokens_to_labels",
    "median_select", "nest_task_types", "catalog_normalise", "catalog_diff", "resolve_identity",
    "explore_queue", "import_counts", "backfill_model", "backfill_task_type", "run_counts",
    "runs_index", "library_versions_top20", "library_versions_pruned", "deliverable_top8",
    "first_start_sticky", "output_tail_batch", "token_scrape", "notes_parse", "notes_for_model",
    "dq_check", "text_measures", "url_allowlist", "section_contract", "review_findings",
    "page_contract", "lint_tasks", "write_collisions", "paths_in_scope", "symbols_in_corpus",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "attestry-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(key: str) -> float:
        begin = time.perf_counter()
        QUERIES[key](spark, root).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begin, 3)

    run("count_attempts")
    run("scoreboard_models")
    times = {key: run(key) for key in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
                "unit": "sec", "queries": times, "sf": os.path.basename(root.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
