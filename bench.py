"""Time the headline queries: BENCH_SF_DIR, BENCH_CPUS; prints one JSON line.

Each query runs once to warm up and once for the record, in full (all rows, all columns).
"""

from __future__ import annotations

import json
import os
import sys
import time

from cairn.plans import discovery
from cairn.plans import testdata as td
from cairn.plans.catalog.registry import all_queries
from cairn.session import build_session

HEADLINE = [
    "discover_by_confidence", "place_clusters", "merged_places", "scored_catalogue",
    "discover_by_distance", "recommendations", "planned_routes", "optimized_routes",
    "route_budget", "route_assembly", "gpx_exports", "box_search", "nearby_visit",
    "nearest_place", "exploration_stats", "path_length", "visit_streaks", "heat_map",
    "trip_summaries", "trip_markdown", "fog_reveal", "region_coverage", "achievement_progress",
    "xp_history", "leaderboard", "moderation_history", "review_scores", "karma",
    "duplicate_submissions", "trailing_calls", "admitted_calls", "osm_places",
    "research_places", "research_dedupe", "query_intents", "sanitized_texts", "masked_texts",
]


def run(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def one_request(spark, sf_dir: str) -> dict[str, float]:
    """Seconds for one discovery request: from raw sources, and on a catalogue that is ready."""
    def request():
        return td.requests(spark, sf_dir).orderBy("request_id").limit(1)

    def found(catalogue):
        return discovery.page(discovery.matches(request(), catalogue))

    def build():
        return discovery.build_catalogue(discovery.gather_sources(spark, td.SOURCE_LOADERS, sf_dir))

    cold = run(lambda *_: found(build()), spark, sf_dir)
    catalogue = build()
    run(lambda *_: found(catalogue), spark, sf_dir)
    return {"discover_one_cold": round(cold, 3),
            "discover_one_ready": round(run(lambda *_: found(catalogue), spark, sf_dir), 3)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cores)
    queries = all_queries()
    picked = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in picked:
        run(queries[name], spark, sf_dir)
        seconds[name] = round(run(queries[name], spark, sf_dir), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)  # the headline queries only, as in earlier rounds
    if not sys.argv[1:]:
        seconds |= one_request(spark, sf_dir)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds_warm", "value": total, "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
        "cpus": cores}))


if __name__ == "__main__":
    main()
