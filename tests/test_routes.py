from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import routes as ops
from cairn.plans import route_planning
from tests.test_geo import haversine


def cost(points):
    return sum(haversine(*a, *b) for a, b in zip(points, points[1:]))


def plain_tour(origin, stops, end):
    """Nearest neighbour and first-improvement 2-opt with full costs."""
    if len(stops) <= 2:
        return list(range(len(stops)))
    left, here, order = set(range(len(stops))), origin, []
    while left:
        best = min(sorted(left), key=lambda j: haversine(*here, *stops[j]))
        left.remove(best)
        order.append(best)
        here = stops[best]

    def total(o):
        return cost([origin, *(stops[i] for i in o), end])

    best, improved, sweeps = total(order), True, 0
    while improved and sweeps < 100:
        improved, sweeps = False, sweeps + 1
        for i in range(len(order) - 1):
            for j in range(i + 1, len(order)):
                tried = order[:i] + order[i:j + 1][::-1] + order[j + 1:]
                if total(tried) < best - 1e-9:
                    order, best, improved = tried, total(tried), True
    return order


@pytest.mark.parametrize("size", [1, 2, 3, 7, 15, 30])
def test_tour_matches_the_plain_search(size):
    rng = random.Random(size)
    points = [(42 + rng.uniform(0, .2), 19 + rng.uniform(0, .2)) for _ in range(size + 2)]
    dist = ops._distances(np.array([p[0] for p in points]), np.array([p[1] for p in points]))
    got = [int(i) - 1 for i in ops._tour(dist)]
    assert got == plain_tour(points[0], points[1:-1], points[-1])


def test_small_tour_is_optimal_on_a_line():
    lats = np.array([42.0, 42.03, 42.01, 42.04, 42.02, 42.05])
    got = ops._tour(ops._distances(lats, np.full(6, 19.0)))
    best = min(itertools.permutations(range(1, 5)), key=lambda o: cost(
        [(lats[i], 19.0) for i in (0, *o, 5)]))
    assert tuple(got) == best


def make(spark, stops, **columns):
    rows = [(1, i, f"p{i}", lat, lng) for i, (lat, lng) in enumerate(stops)]
    places = route_planning.as_search_result(spark.createDataFrame(
        rows, "route_id bigint, position int, id string, lat double, lng double"))
    base = {"o_lat": 42.0, "o_lng": 19.0, "d_lat": None, "d_lng": None, "mode": "walking",
            "max_duration_hours": 4.0, "max_waypoints": 10, "optimize": True,
            "surprise_mode": False, **columns}
    request = spark.range(1).select(F.lit(1).cast("bigint").alias("route_id"), *[
        (F.lit(v) if v is not None else F.lit(None).cast("double")).alias(k)
        for k, v in base.items()])
    return route_planning.with_stops(request, places)


@pytest.mark.parametrize("circular", [True, False])
def test_budget_skips_and_goes_on(spark, circular):
    rng = random.Random(11)
    stops = [(42 + rng.uniform(0, .05), 19 + rng.uniform(0, .05)) for _ in range(25)]
    here, spent, want = (42.0, 19.0), 0.0, []
    for i, stop in enumerate(stops):
        step = haversine(*here, *stop) / 1.4
        back = haversine(*stop, 42.0, 19.0) / 1.4 if circular else 0
        if spent + step + 600 + back <= 4 * 3600:
            want.append(f"p{i}")
            spent, here = spent + step + 600, stop
    ends = {} if circular else {"d_lat": 42.05, "d_lng": 19.05}
    kept = ops.fit_budget(make(spark, stops, **ends)).first()["stops"]
    assert [s["id"] for s in kept] == want and len(want) < 25


def test_assembly_and_empty_route(spark):
    built = ops.assemble(make(spark, [(42.01, 19.0), (42.02, 19.0)])).first()
    assert [w["name"] for w in built["waypoints"]][0::3] == ["Start", "Return to Start"]
    assert built["places_count"] == 2 and len(built["segments"]) == 3
    assert built["total_distance_m"] == pytest.approx(sum(s["distance_m"] for s in
                                                          built["segments"]), abs=0.3)
    empty = ops.links(ops.summary(ops.assemble(make(spark, []))))
    row = empty.first()
    assert row["places_count"] == 0 and row["total_distance_m"] == 0
    assert row["summary"] == "Circular walking route: 0.0 km, ~0min, 0 stops"
    assert row["geo"] == "geo:42.0,19.0"


def test_surprise_hides_and_remembers(spark):
    rows = make(spark, [(42.01, 19.0)], surprise_mode=True).withColumn("stops", F.transform(
        "stops", lambda s: s.withField("name", F.lit("Bay")).withField("photos", F.array(
            F.lit("x")))))
    stop = ops.mask_stops(rows).first()["stops"][0]
    assert stop["name"] == "Mystery Stop #1" and stop["photos"] == []
    assert stop["metadata"]["_surprise_original_name"] == "Bay"


def test_reorder_rejects_wrong_positions(spark):
    rows = make(spark, [(42.01, 19.0), (42.02, 19.0), (42.03, 19.0)])
    for order, fine in (([2, 0, 1], True), ([0, 1], False), ([0, 0, 1], False), ([1, 2, 3], False)):
        good, bad = ops.reorder(rows.withColumn("o", F.array(*[F.lit(i) for i in order])), "o")
        assert (good.count(), bad.count()) == ((1, 0) if fine else (0, 1))
        if fine:
            assert [s["id"] for s in good.first()["stops"]] == ["p2", "p0", "p1"]
