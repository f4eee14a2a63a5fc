"""Benchmark: headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tieout.queries import load_all  # noqa: E402
from tieout.session import local_session  # noqa: E402

HEADLINE = [
    "sum_of_details", "amount_parse_robust", "balance_parent_children", "income_rules", "cash_flow_rules", "scoped_vertical_sums",
    "roll_forward_by_segment", "block_subtotals", "netting_check", "total_column_check", "facts_as_of", "note_tie_outs_by_form",
    "column_roles", "classification_by_votes", "resolved_marks", "run_diff", "failure_aggregation", "audit_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cpus)
    queries, _ = load_all()
    wanted = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the executors before timing
    times = {}
    for name in wanted:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    match = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": float(match.group(1)) if match else None,
            }
        )
    )


if __name__ == "__main__":
    main()
