"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores; BENCH_ALL=1 times every registered query, BENCH_ONLY="a b" the named ones.
Each query is run once to warm up and once to be timed, every row computed and none kept.
"""

from __future__ import annotations

import json
import os
import sys
import time

from casemill.plans import load_all
from casemill.plans.registry import QUERIES
from casemill.session import build_session

HEADLINE = (
    "decision_summary", "decisions_all_rules", "fact_pivot", "component_points", "decisions_prechecked", "packet_hashes",
    "shown_statuses", "latest_decisions", "committee_plurality", "committee_final", "drawn_committees",
    "action_decision_links", "audit_timeline", "round_robin_reviewers", "case_details", "log_retention",
    "page_chunks", "token_counts", "scan_verdicts", "keyword_density", "document_completeness", "document_contradictions",
    "syllabus_facts", "catalog_candidates", "parsed_courses", "transcript_courses",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    every = os.environ.get("BENCH_ALL") == "1"
    wanted = os.environ.get("BENCH_ONLY", "").split()
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "16g",
           "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"})
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    times: dict[str, float] = {}
    for name in wanted or (QUERIES if every else HEADLINE):
        for attempt in range(1 if every else 2):
            start = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total" if not every else "all_queries_total",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
