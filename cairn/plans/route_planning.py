"""Batches of planned routes: search, corridor, order, budget, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.functions.columns import strings
from cairn.operators import routes as ops
from cairn.plans import discovery

# request columns: route_id, o_lat, o_lng, d_lat, d_lng (null: circular), mode,
# max_duration_hours, categories, corridor_width_km, max_waypoints, optimize, surprise_mode,
# max_candidates (null: all), and radius_km for explore routes


def _search_requests(requests: DataFrame, explore: bool) -> DataFrame:
    if explore:
        lat, lng, radius = F.col("o_lat"), F.col("o_lng"), F.col("radius_km")
    else:
        e_lat, e_lng = F.coalesce("d_lat", "o_lat"), F.coalesce("d_lng", "o_lng")
        lat, lng = (F.col("o_lat") + e_lat) / 2, (F.col("o_lng") + e_lng) / 2
        radius = geo.route_search_radius_km(
            geo.haversine_m("o_lat", "o_lng", e_lat, e_lng), "corridor_width_km")
    return requests.select(F.col("route_id").alias("request_id"), lat.alias("lat"),
                           lng.alias("lng"), radius.alias("radius_km"), "categories")


def candidates(requests: DataFrame, catalogue: DataFrame, excluded: DataFrame | None = None,
               explore: bool = False) -> DataFrame:
    """Places of each route's search area that lie in its corridor, best first, with details.

    The corridor is part of the search: places are ranked inside it, and ``max_candidates`` of the
    request (null: all) cuts last, so a place off the line never takes the room of one near it. If
    every request has a bound, the largest goes into the window, which then drops rows early.
    """
    found = discovery.matches(_search_requests(requests, explore), catalogue, excluded) \
        .withColumnRenamed("request_id", "route_id")
    if not explore:
        found = in_corridor(requests, found)
    order = Window.partitionBy("route_id").orderBy(F.col("confidence").desc(), "ord")
    ranked = found.withColumn("position", F.row_number().over(order))
    most = requests.agg(F.when(F.count_if(F.col("max_candidates").isNull()) == 0, F.max("max_candidates"))).first()[0]
    if most is not None:
        ranked = ranked.where(F.col("position") <= int(most))
    limits = requests.select("route_id", "max_candidates")
    kept = ranked.join(limits, "route_id").where(
        F.col("max_candidates").isNull() | (F.col("position") <= F.col("max_candidates")))
    details = catalogue.select("ord", "description", "photos", "metadata")
    return kept.select("route_id", "position", "ord", "id", "name", "categories", "lat", "lng").join(details, "ord")


def in_corridor(requests: DataFrame, places: DataFrame) -> DataFrame:
    """Places near the straight line of their route; circular routes keep all."""
    lines = requests.select("route_id", "o_lat", "o_lng", "d_lat", "d_lng", "corridor_width_km")
    off = geo.segment_distance_m("lat", "lng", "o_lat", "o_lng", "d_lat", "d_lng")
    joined = places.join(lines, "route_id").where(
        F.col("d_lat").isNull() | (off <= F.col("corridor_width_km") * 1000))
    return joined.select(*places.columns)


def with_stops(requests: DataFrame, places: DataFrame) -> DataFrame:
    """Requests with their candidates as array ``stops``, in search order."""
    fields = ["id", "name", "description", "categories", "photos", "lat", "lng"]
    # maps cannot be sorted, so metadata travels as entries
    stop = F.struct("position", *fields, F.map_entries("metadata").alias("entries"))
    arrays = places.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.transform(F.array_sort(F.collect_list(stop)), lambda s: F.struct(
            *[s[c].alias(c) for c in fields], F.map_from_entries(s["entries"]).alias("metadata")))
        .alias("stops"))
    empty = F.array().cast(arrays.schema["stops"].dataType)
    return requests.join(arrays, "route_id", "left").withColumns({
        "stops": F.coalesce("stops", empty), "candidates": F.coalesce("candidates", F.lit(0))})


def finish(routes: DataFrame) -> DataFrame:
    """Order if asked for, fit the time budget, cap, mask and assemble."""
    built = ops.assemble(ops.mask_stops(ops.cap_stops(ops.fit_budget(_ordered(routes)))))
    return ops.links(ops.summary(built))


def _ordered(routes: DataFrame) -> DataFrame:
    return ops.order_stops(routes.where("optimize")).unionByName(routes.where("NOT optimize"))


def build_routes(requests: DataFrame, catalogue: DataFrame,
                 excluded: DataFrame | None = None) -> DataFrame:
    """Point-to-point (or circular) routes through places near the straight line."""
    return finish(with_stops(requests, candidates(requests, catalogue, excluded)))


def build_explore_routes(requests: DataFrame, catalogue: DataFrame,
                         excluded: DataFrame | None = None) -> DataFrame:
    """Circular routes through the best places around an origin."""
    circular = requests.withColumns({
        "d_lat": F.lit(None).cast("double"), "d_lng": F.lit(None).cast("double"),
        "optimize": F.lit(True)})
    return finish(with_stops(circular, candidates(circular, catalogue, excluded, explore=True)))


def as_search_result(places: DataFrame) -> DataFrame:
    """Fill the optional stop columns of a plain (route_id, position, id, lat, lng) table."""
    defaults = {"name": F.lit(None).cast("string"), "description": F.lit(None).cast("string"),
                "categories": strings([]), "photos": strings([]),
                "metadata": F.map_from_arrays(strings([]), strings([]))}
    return places.withColumns({c: v for c, v in defaults.items() if c not in places.columns})
