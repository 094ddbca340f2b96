"""Geometry, grid, tiles and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions import geo, text
from cairn.functions.columns import round_to
from cairn.operators import spatial
from cairn.plans import testdata as td
from cairn.plans.catalog import Catalog
from cairn.plans.catalog import base as q

catalog = Catalog()

_P_LAT, _P_LNG = q.lat("l_partkey"), q.lng("l_partkey")
_S_LAT, _S_LNG = q.lat("l_suppkey"), q.lng("l_suppkey")


def _legs(spark, sf_dir):
    """Every line item as a leg from its supplier's to its part's position."""
    rows = td.read(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        td.lat_of(F.col("l_suppkey")).alias("a_lat"), td.lng_of(F.col("l_suppkey")).alias("a_lng"),
        td.lat_of(F.col("l_partkey")).alias("b_lat"), td.lng_of(F.col("l_partkey")).alias("b_lng"),
        td.lat_of(F.col("l_orderkey")).alias("c_lat"),
        td.lng_of(F.col("l_orderkey")).alias("c_lng"), "l_returnflag")


@catalog.add(f"""
SELECT l_orderkey, l_linenumber,
  {q.rnd(q.hav(_S_LAT, _S_LNG, _P_LAT, _P_LNG), 1)} AS distance_m,
  {q.rnd(f'''((degrees(atan2(sin(radians({_P_LNG} - {_S_LNG})) * cos(radians({_P_LAT})),
    cos(radians({_S_LAT})) * sin(radians({_P_LAT})) - sin(radians({_S_LAT}))
    * cos(radians({_P_LAT})) * cos(radians({_P_LNG} - {_S_LNG})))) + 360e0) % 360e0)''', 1)}
    AS bearing
FROM lineitem""")
def distance_and_bearing(spark, sf_dir):
    """M-1, M-2, JN-18."""
    ends = ("a_lat", "a_lng", "b_lat", "b_lng")
    return _legs(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", round_to(geo.haversine_m(*ends), 1).alias("distance_m"),
        round_to(geo.bearing_deg(*ends), 1).alias("bearing"))


@catalog.add(f"""
WITH legs AS (SELECT l_orderkey, l_linenumber, {_S_LAT} AS a_lat, {_S_LNG} AS a_lng,
  {_P_LAT} AS b_lat, {_P_LNG} AS b_lng, {q.lat('l_orderkey')} AS c_lat,
  {q.lng('l_orderkey')} AS c_lng FROM lineitem),
plane AS (SELECT *, cos(radians((a_lat + b_lat) / 2e0)) * 111320e0 AS per_lng FROM legs),
xy AS (SELECT *, (c_lng - a_lng) * per_lng AS px, (c_lat - a_lat) * 111320e0 AS py,
  (b_lng - a_lng) * per_lng AS dx, (b_lat - a_lat) * 111320e0 AS dy FROM plane),
t AS (SELECT *, dx * dx + dy * dy AS len2 FROM xy),
u AS (SELECT *, CASE WHEN len2 = 0 THEN 0e0
  ELSE greatest(0e0, least(1e0, (px * dx + py * dy) / len2)) END AS s FROM t),
d AS (SELECT *, CASE WHEN len2 = 0 THEN sqrt(px * px + py * py)
  ELSE sqrt((px - s * dx) * (px - s * dx) + (py - s * dy) * (py - s * dy)) END AS m FROM u)
SELECT l_orderkey, l_linenumber, {q.rnd('m', 1)} AS offset_m, m <= 1000e0 AS in_corridor FROM d""")
def corridor_distance(spark, sf_dir):
    """M-3, FL-13: how far each order's position lies off its leg."""
    off = geo.segment_distance_m("c_lat", "c_lng", "a_lat", "a_lng", "b_lat", "b_lng")
    return _legs(spark, sf_dir).withColumn("m", off).select(
        "l_orderkey", "l_linenumber", round_to("m", 1).alias("offset_m"),
        (F.col("m") <= 1000.0).alias("in_corridor"))


@catalog.add(f"""
WITH legs AS (SELECT l_orderkey, l_linenumber, l_returnflag,
  {q.hav(_S_LAT, _S_LNG, _P_LAT, _P_LNG)} AS m FROM lineitem),
timed AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'cycling' WHEN 'R' THEN 'driving'
  ELSE 'ferry' END AS mode FROM legs),
secs AS (SELECT *, m / CASE mode WHEN 'cycling' THEN 4.2e0 WHEN 'driving' THEN 11.1e0
  ELSE 1.4e0 END AS s FROM timed)
SELECT l_orderkey, l_linenumber, mode, {q.rnd('s', 1)} AS seconds,
  CASE WHEN floor(s / 3600) > 0
    THEN printf('%dh %dmin', floor(s / 3600)::BIGINT, floor((s % 3600e0) / 60)::BIGINT)
    ELSE printf('%dmin', floor((s % 3600e0) / 60)::BIGINT) END AS label,
  least(50e0, greatest(2e0, m / 1000e0 + 1e0)) >= 50e0 AS radius_capped
FROM secs""")
def travel_time(spark, sf_dir):
    """M-6, M-7, D-4."""
    mode = F.when(F.col("l_returnflag") == "A", "cycling").when(
        F.col("l_returnflag") == "R", "driving").otherwise("ferry")
    legs = _legs(spark, sf_dir).withColumn("mode", mode).withColumn(
        "m", geo.haversine_m("a_lat", "a_lng", "b_lat", "b_lng")).withColumn(
        "s", geo.travel_seconds("m", "mode"))
    return legs.select("l_orderkey", "l_linenumber", "mode", round_to("s", 1).alias("seconds"),
                       text.duration_label("s").alias("label"),
                       (geo.route_search_radius_km("m", F.lit(1.0)) >= 50.0)
                       .alias("radius_capped"))


@catalog.add(f"""
SELECT p_partkey, {q.grid_key(q.lat('p_partkey'), q.lng('p_partkey'))} AS cell,
  {q.rnd(f"split_part({q.grid_key(q.lat('p_partkey'), q.lng('p_partkey'))}, '_', 1)::DOUBLE", 4)}
    AS cell_lat,
  {q.rnd(f"split_part({q.grid_key(q.lat('p_partkey'), q.lng('p_partkey'))}, '_', 2)::DOUBLE", 4)}
    AS cell_lng
FROM part""")
def grid_cells(spark, sf_dir):
    """M-4."""
    key = F.col("p_partkey")
    rows = td.read(spark, sf_dir, "part").select(
        "p_partkey", geo.grid_key(td.lat_of(key), td.lng_of(key)).alias("cell"))
    return rows.select("p_partkey", "cell",
                       round_to(geo.grid_key_position("cell")["lat"], 4).alias("cell_lat"),
                       round_to(geo.grid_key_position("cell")["lng"], 4).alias("cell_lng"))


_TILES = f"""
WITH spots AS (SELECT c_custkey, {q.lat('c_custkey')} AS lat, {q.lng('c_custkey')} AS lng
  FROM customer),
z AS (SELECT *, unnest(range(0, 17, 4)) AS zoom FROM spots)"""


@catalog.add(_TILES + """
SELECT c_custkey, zoom::INTEGER AS zoom, trunc((lng + 180) / 360 * pow(2e0, zoom))::INTEGER AS x,
  trunc((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2 * pow(2e0, zoom))::INTEGER AS y
FROM z""")
def map_tiles(spark, sf_dir):
    """M-5."""
    key = F.col("c_custkey")
    rows = td.read(spark, sf_dir, "customer").select(
        "c_custkey", td.lat_of(key).alias("lat"), td.lng_of(key).alias("lng"),
        F.explode(F.sequence(F.lit(0), F.lit(16), F.lit(4))).alias("zoom"))
    return rows.select("c_custkey", "zoom", geo.tile_x("lng", "zoom").alias("x"),
                       geo.tile_y("lat", "zoom").alias("y"))


@catalog.add(q.with_ctes(q.REQUESTS) + f"""
SELECT request_id, {q.rnd('r_lat - dlat', 6)} AS south, {q.rnd('r_lng - dlng', 6)} AS west,
  {q.rnd('r_lat + dlat', 6)} AS north, {q.rnd('r_lng + dlng', 6)} AS east,
  {q.rnd(q.hav('(r_lat - dlat)', '(r_lng - dlng)', '(r_lat + dlat)', '(r_lng + dlng)') + ' / 2e0', 1)}
    AS half_diagonal_m FROM boxes""")
def search_boxes(spark, sf_dir):
    """FL-3, M-10."""
    boxed = td.requests(spark, sf_dir).select(
        "request_id", geo.bounding_box("lat", "lng", "radius_km").alias("b"))
    half = geo.box_centre_radius("b.south", "b.west", "b.north", "b.east")["radius_m"]
    return boxed.select("request_id", *[round_to(f"b.{side}", 6).alias(side)
                                        for side in ("south", "west", "north", "east")],
                        round_to(half, 1).alias("half_diagonal_m"))


@catalog.add(q.with_ctes(q.PLACES, q.REQUESTS) + """
SELECT request_id, count(*) AS in_box,
  count(*) FILTER (WHERE len(list_intersect(categories, wanted)) > 0) AS wanted_in_box
FROM boxes JOIN places ON lat BETWEEN r_lat - dlat AND r_lat + dlat
  AND lng BETWEEN r_lng - dlng AND r_lng + dlng
GROUP BY request_id""")
def box_search(spark, sf_dir):
    """JN-12, FL-4, FL-6, U-1, U-3."""
    boxed = td.requests(spark, sf_dir).select(
        "request_id", F.col("categories").alias("wanted"),
        geo.bounding_box("lat", "lng", "radius_km").alias("b")).select(
        "request_id", "wanted", "b.*")
    hits = spatial.box_join(boxed, _all_places(spark, sf_dir).select("lat", "lng", "categories"))
    return hits.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("in_box"),
        F.count_if(F.arrays_overlap("categories", "wanted")).alias("wanted_in_box"))


def _all_places(spark, sf_dir):
    from cairn.plans.discovery import gather_sources
    return gather_sources(spark, td.SOURCE_LOADERS, sf_dir)


_QUERY_SPOTS = f"""spots AS (
  SELECT c_custkey AS spot_id, {q.lat('c_custkey', 12)} AS q_lat, {q.lng('c_custkey')} AS q_lng
  FROM customer)"""


def _spots(spark, sf_dir):
    key = F.col("c_custkey")
    return td.read(spark, sf_dir, "customer").select(
        key.alias("spot_id"), td.lat_of(key, 12).alias("q_lat"), td.lng_of(key).alias("q_lng"))


@catalog.add(q.with_ctes(q.VISITS, _QUERY_SPOTS, f"""hits AS (
  SELECT spot_id, v.place_id, v.place_name, v.status, v.ord,
    {q.hav('q_lat', 'q_lng', 'v.lat', 'v.lng')} AS m
  FROM spots s JOIN visits v ON v.lat BETWEEN q_lat - 5e-3 AND q_lat + 5e-3
    AND v.lng BETWEEN q_lng - 5e-3 AND q_lng + 5e-3
  WHERE {q.hav('q_lat', 'q_lng', 'v.lat', 'v.lng')} <= 200
  QUALIFY row_number() OVER (PARTITION BY spot_id ORDER BY v.ord) = 1)""") + f"""
SELECT s.spot_id, place_id AS nearby_place_id, place_name AS nearby_place_name,
  {q.rnd('m', 1)} AS distance_m, coalesce(status = 'visited', false) AS already_visited
FROM spots s LEFT JOIN hits USING (spot_id)""")
def nearby_visit(spark, sf_dir):
    """JN-3, FL-5: first visit in insertion order within 200 m of each spot."""
    seen = td.visits(spark, sf_dir).select("place_id", "place_name", "status", "ord", "lat", "lng")
    found = spatial.first_within(_spots(spark, sf_dir), seen, 200.0)
    return found.select(
        "spot_id", F.col("hit.place_id").alias("nearby_place_id"),
        F.col("hit.place_name").alias("nearby_place_name"),
        round_to("hit.distance_m", 1).alias("distance_m"),
        F.coalesce(F.col("hit.status") == "visited", F.lit(False)).alias("already_visited"))


@catalog.add(q.with_ctes(q.PLACES, _QUERY_SPOTS) + f"""
SELECT spot_id, id AS place_id, {q.rnd('m', 1)} AS distance_m FROM (
  SELECT spot_id, id, {q.hav('q_lat', 'q_lng', 'lat', 'lng')} AS m
  FROM spots, places_atlas
  QUALIFY row_number() OVER (PARTITION BY spot_id
    ORDER BY {q.hav('q_lat', 'q_lng', 'lat', 'lng')}, ord) = 1)""")
def nearest_place(spark, sf_dir):
    """JN-4: nearest cached place to each spot, over several search levels."""
    cached = td.places_atlas(spark, sf_dir).select("id", "ord", "lat", "lng")
    found = spatial.nearest_point(_spots(spark, sf_dir), cached)
    return found.select("spot_id", F.col("id").alias("place_id"),
                        round_to("distance_m", 1).alias("distance_m"))


@catalog.add(f"""
WITH groups(cat, grp) AS (VALUES {', '.join(f"('{c}', '{g}')" for c, g in fv.CATEGORY_GROUPS.items())}),
presets AS (
  SELECT 'all' AS preset, list(cat) AS cats FROM groups
  UNION ALL SELECT 'hidden', list(cat) FROM groups WHERE grp = 'unusual'
  UNION ALL SELECT 'classic', list(cat) FROM groups WHERE grp = 'classic'
  UNION ALL SELECT 'notable', list(cat) FROM groups WHERE grp = 'notable'
  {' '.join(f"UNION ALL SELECT '{n}', {q.text_list(c)}" for n, c in fv.NAMED_PRESETS.items())}),
{q.PLACES}
SELECT preset, count(*) AS places FROM presets JOIN places
  ON len(list_intersect(categories, cats)) > 0 GROUP BY preset""")
def preset_counts(spark, sf_dir):
    """FL-16, FL-1: places per filter preset."""
    from cairn.operators.filters import preset_members
    return preset_members(_all_places(spark, sf_dir)).groupBy("preset").agg(
        F.count(F.lit(1)).alias("places"))


@catalog.add(q.with_ctes(q.PLACES) + f"""
SELECT id, len(list_intersect(categories, {q.text_list(fv.UNUSUAL_CATEGORIES)})) > 0 AS unusual
FROM places""")
def unusual_places(spark, sf_dir):
    """FL-12."""
    from cairn.operators.filters import is_unusual
    return _all_places(spark, sf_dir).select("id", is_unusual().alias("unusual"))
