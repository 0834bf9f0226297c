"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "fk_resolved",
    "dependency_edges",
    "index_stats",
    "unresolved_by_target",
    "orphan_rows",
    "references_to_rows",
    "condition_filter_fold",
    "natural_sort_topk",
    "downsample",
    "numeric_columns",
    "describe_numeric",
    "renumber_dense",
    "downstream_closure",
    "remap_targets",
    "text_roundtrip_lineitem",
    "soil_layers",
    "plant_members",
    "decision_tables",
    "output_text",
    "csv_quoted",
    "json_records",
    "format_issue_cap",
    "file_list_class_summary",
)


def main() -> None:
    from linkfold.plans import registry
    from linkfold.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One small run starts the JVM code paths and the Python workers.
    for warm in ("dependency_edges", "plant_members"):
        registry.QUERIES[warm](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
