"""Time the headline queries on the given tables and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). With --all every registered
query is timed; with --plans the number of exchanges per plan is added.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from vacantia.catalog.registry import QUERIES, load_all
from vacantia.session import local_session

HEADLINE = (
    "ranked_parts", "rubric_score", "weight_sweep", "canonical_url", "url_dedup_latest", "html_to_text", "tiered_keyword_filter",
    "contact_parse", "liveness_rules", "field_classify", "scan_outcomes", "snapshot_merge", "registry_refresh", "company_merge",
    "application_upsert", "status_timeline", "duplicate_gap_accepted", "repost_signal", "lifecycle_join", "priority_match",
    "cap_flags", "ranked_queue_view", "funnel", "triage_queue", "watchlist", "titles_per_group", "feed_candidates",
    "pending_selection", "provider_workday", "stream_timeline",
)


def run_once(spark, fn, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange ") - plan.count("BroadcastExchange ")


def main(argv: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    load_all()
    chosen = [a for a in argv if not a.startswith("--")] or (list(QUERIES) if "--all" in argv else list(HEADLINE))
    times, plans = {}, {}
    for name in chosen:
        run_once(spark, QUERIES[name], sf_dir)  # warm-up: JIT and file listing
        times[name] = round(statistics.median(run_once(spark, QUERIES[name], sf_dir) for _ in range(3)), 3)
        if "--plans" in argv:
            plans[name] = exchanges(QUERIES[name](spark, sf_dir))
        if "--verbose" in argv:
            print(name, times[name], plans.get(name, ""), file=sys.stderr, flush=True)
    out = {
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    if plans:
        out["exchanges"] = plans
    print(json.dumps(out))


if __name__ == "__main__":
    main(sys.argv[1:])
