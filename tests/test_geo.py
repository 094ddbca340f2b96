from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.functions.columns import round_to
from cairn.operators import spatial


def haversine(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = (math.sin((q - p) / 2) ** 2
         + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2)
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_known_distances(spark):
    f = F.lit
    assert one(spark, geo.haversine_m(f(42.4411), f(19.2636), f(42.0931), f(19.1003))) == \
        pytest.approx(40962.5, abs=0.5)
    assert 110_000 < one(spark, geo.haversine_m(f(0.0), f(0.0), f(0.0), f(1.0))) < 112_000
    assert one(spark, geo.haversine_m(f(1.0), f(2.0), f(1.0), f(2.0))) == 0


@pytest.mark.parametrize("lat,lng,want", [(1.0, 0.0, 0), (0.0, 1.0, 90), (-1.0, 0.0, 180),
                                          (0.0, -1.0, 270)])
def test_cardinal_bearings(spark, lat, lng, want):
    got = one(spark, geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(lat), F.lit(lng)))
    assert got == pytest.approx(want, abs=1e-6)


def test_segment_distance_of_a_point_segment(spark):
    p = [F.lit(v) for v in (42.001, 19.0, 42.0, 19.0, 42.0, 19.0)]
    assert one(spark, geo.segment_distance_m(*p)) == pytest.approx(111.32, abs=0.01)


def test_grid_key_has_no_minus_zero(spark):
    assert one(spark, geo.grid_key(F.lit(-0.0003), F.lit(0.0003))) == "0.0000_0.0000"
    assert one(spark, geo.grid_key(F.lit(42.44149), F.lit(18.7705))) == "42.4410_18.7700"


def test_fifty_metres_at_42_north_reveal_one_cell(spark):
    keys = one(spark, geo.grid_keys_in_radius(F.lit(42.441), F.lit(18.771), F.lit(50.0)))
    assert keys == ["42.4410_18.7710"]


def test_round_half_even(spark):
    """Half to even after scaling; a product that lands on a tie (2.675) is the known difference
    from rounding the exact binary value."""
    values = [one(spark, round_to(F.lit(v), 2)) for v in (0.125, 0.285, -0.001, 2.675)]
    assert values == [round(0.125, 2), round(0.285, 2), 0.0, 2.68]
    assert math.copysign(1, values[2]) == 1


@pytest.mark.parametrize("centre", [(42.0, 19.0), (0.0, 179.9995), (-70.0, -179.9999),
                                    (89.99, 10.0), (0.0, 0.0)])
def test_circle_join_finds_every_pair(spark, centre):
    """Also across the date line and next to a pole."""
    rng = random.Random(hash(centre) & 0xffff)
    spread = 0.004

    def spot():
        lat = max(-90.0, min(90.0, centre[0] + rng.uniform(-spread, spread)))
        lng = centre[1] + rng.uniform(-spread, spread) * (50 if abs(centre[0]) > 80 else 1)
        return lat, (lng + 180) % 360 - 180

    a = [(i, *spot()) for i in range(60)]
    b = [(i, *spot()) for i in range(60)]
    left = spark.createDataFrame(a, "q bigint, q_lat double, q_lng double")
    right = spark.createDataFrame(b, "ord bigint, lat double, lng double")
    got = {(r["q"], r["ord"]) for r in spatial.circle_join(
        left, right, 150.0, cell_degrees=150 / 111000).select("q", "ord").collect()}
    want = {(i, j) for i, x, y in a for j, u, v in b if haversine(x, y, u, v) <= 150}
    assert got == want and want


def test_circle_join_has_no_duplicates(spark):
    left = spark.createDataFrame([(1, 89.999, 0.0)], "q bigint, q_lat double, q_lng double")
    right = spark.createDataFrame([(1, 89.999, 1.0)], "ord bigint, lat double, lng double")
    assert spatial.circle_join(left, right, 500.0, cell_degrees=0.001).count() == 1


def test_nearest_point_matches_brute_force(spark):
    rng = random.Random(5)
    sites = [(i, f"s{i}", rng.uniform(-60, 60), rng.uniform(-170, 170)) for i in range(40)]
    sites += [(40 + i, f"s{40 + i}", 42.0 + i * 1e-4, 19.0) for i in range(20)] + [
        (60, "copy", 42.0, 19.0)]
    spots = [(i, rng.uniform(-60, 60), rng.uniform(-170, 170)) for i in range(20)]
    spots += [(20 + i, 42.0 + rng.uniform(0, .003), 19.0) for i in range(20)]
    points = spark.createDataFrame(sites, "ord bigint, id string, lat double, lng double")
    queries = spark.createDataFrame(spots, "q bigint, q_lat double, q_lng double")
    got = {r["q"]: r["id"] for r in spatial.nearest_point(queries, points).collect()}
    want = {q: min(sites, key=lambda s: (haversine(x, y, s[2], s[3]), s[0]))[1]
            for q, x, y in spots}
    assert got == want
