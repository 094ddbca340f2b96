"""Ordering, fitting, assembling and describing routes.

A route is one row with its stops in an array (at most 200 candidates, 50 stops by definition), so
everything but the tour search is a column expression.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn import fixed_values as fv
from cairn.functions import geo, text
from cairn.functions.columns import as_col, not_empty, round_to, strings


def _distances(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Between all points of a route, or of each route if there is a leading axis."""
    phi, lam = np.radians(lat)[..., None, :], np.radians(lng)[..., None, :]
    there, across = phi.swapaxes(-1, -2), lam.swapaxes(-1, -2)
    a = (np.sin((there - phi) / 2) ** 2
         + np.cos(there) * np.cos(phi) * np.sin((across - lam) / 2) ** 2)
    return 2 * geo.EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def _tour(dist: np.ndarray) -> np.ndarray:
    """Tour through nodes 1..n from node 0 to node n+1: nearest neighbour, then 2-opt.

    2-opt takes the first improving reversal and goes on from there; only the two changed edges
    are compared, for all ends of a start at once. Every reversal shortens the tour, so it ends by
    itself, at a tour without an improving reversal.
    """
    end = len(dist) - 1
    if end <= 3:
        return np.arange(1, end)
    left, tour, here = np.ones(len(dist), bool), [], 0
    left[[0, end]] = False
    while left.any():
        here = int(np.argmin(np.where(left, dist[here], np.inf)))
        left[here] = False
        tour.append(here)
    path = np.array([0, *tour, end])
    improved = True
    while improved:
        improved = False
        for i in range(1, end - 1):
            j = i + 1
            while j < end:
                last, after = path[j:end], path[j + 1:]
                gain = (dist[path[i - 1], last] + dist[path[i], after]
                        - dist[path[i - 1], path[i]] - dist[last, after])
                better = np.flatnonzero(gain < -1e-9)
                if not better.size:
                    break
                j += int(better[0])
                path[i:j + 1] = path[i:j + 1][::-1].copy()
                improved, j = True, j + 1
    return path[1:-1]


def _tours(dist: np.ndarray) -> np.ndarray:
    """``_tour`` of many routes of equal length at once, each with its matrix in ``dist``: the same
    comparisons in the same order, so the same tours."""
    rows, end = np.arange(len(dist)), dist.shape[1] - 1
    if end <= 3:
        return np.tile(np.arange(1, end), (len(dist), 1))
    path = np.zeros((len(dist), end + 1), np.int64)
    path[:, end] = end
    left = np.ones((len(dist), end + 1), bool)
    left[:, [0, end]] = False
    for at in range(1, end):
        path[:, at] = np.argmin(np.where(left, dist[rows, path[:, at - 1]], np.inf), axis=1)
        left[rows, path[:, at]] = False
    open_ = rows
    while open_.size:
        improved = np.zeros(len(open_), bool)
        for i in range(1, end - 1):
            for j in range(i + 1, end):
                before, first, last, after = (path[open_, k] for k in (i - 1, i, j, j + 1))
                gain = (dist[open_, before, last] + dist[open_, first, after]
                        - dist[open_, before, first] - dist[open_, last, after])
                better = gain < -1e-9
                if better.any():
                    at = open_[better]
                    path[at, i:j + 1] = path[at, i:j + 1][:, ::-1]
                    improved |= better
        open_ = open_[improved]
    return path[:, 1:-1]


#: Routes of up to so many stops are ordered many at once, longer ones one by one.
SHORT_ROUTE = 12


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def visit_order(ends: pd.DataFrame, lats: pd.Series, lngs: pd.Series) -> pd.Series:
    """Zero-based visiting order of each route's stops; ``ends`` has the two end points.

    One Arrow batch carries many routes. Up to two stops stay in their given order.
    """
    orders: list = [None] * len(lats)
    origin, goal = ends[["o_lat", "o_lng"]].to_numpy(), ends[["e_lat", "e_lng"]].to_numpy()
    lats, lngs = lats.to_numpy(), lngs.to_numpy()
    sizes = np.array([len(lat) for lat in lats])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for part in np.array_split(at, -(-len(at) // (4096 if size <= SHORT_ROUTE else 1))):
            lat = np.column_stack((origin[part, 0], np.stack(lats[part]), goal[part, 0]))
            lng = np.column_stack((origin[part, 1], np.stack(lngs[part]), goal[part, 1]))
            if size <= SHORT_ROUTE:
                tours = _tours(_distances(lat, lng)) - 1
            else:
                tours = _tour(_distances(lat[0], lng[0]))[None] - 1
            for row, tour in zip(part.tolist(), tours.astype(np.int32)):
                orders[row] = tour
    return pd.Series(orders, dtype="object")


def order_stops(routes: DataFrame) -> DataFrame:
    """Put ``stops`` of each route (o_lat, o_lng, d_lat, d_lng or null) in visiting order."""
    ends = F.struct(
        "o_lat", "o_lng", F.coalesce("d_lat", "o_lat").alias("e_lat"),
        F.coalesce("d_lng", "o_lng").alias("e_lng"))
    order = visit_order(ends, F.transform("stops", lambda s: s["lat"]),
                        F.transform("stops", lambda s: s["lng"]))
    return permute(routes.withColumn("_order", order), "_order").drop("_order")


def permute(routes: DataFrame, order: str) -> DataFrame:
    """Reorder ``stops`` by an array of zero-based positions."""
    return routes.withColumn("stops", F.transform(order, lambda i: F.element_at("stops", i + 1)))


def is_permutation(order, size) -> Column:
    wanted = F.when(as_col(size) > 0, F.sequence(F.lit(0), as_col(size) - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.array_sort(as_col(order)) == wanted


def fit_budget(routes: DataFrame) -> DataFrame:
    """Keep the stops that fit into ``max_duration_hours``, in order.

    A stop that does not fit is skipped and the walk goes on, so this is a fold, not a prefix.
    Circular routes must leave time for the way back from every stop.
    """
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0.0).alias("elapsed"),
                     F.col("o_lat").alias("lat"), F.col("o_lng").alias("lng"))

    def step(state: Column, i: Column) -> Column:
        stop = F.element_at("stops", i)
        spent = state["elapsed"] + geo.travel_seconds(geo.haversine_m(
            state["lat"], state["lng"], stop["lat"], stop["lng"]), "mode") + F.lit(
            fv.VISIT_SECONDS)
        back = F.when(F.col("d_lat").isNull(), geo.travel_seconds(geo.haversine_m(
            stop["lat"], stop["lng"], "o_lat", "o_lng"), "mode")).otherwise(0.0)
        fits = spent + back <= F.col("max_duration_hours") * 3600
        return F.when(fits, F.struct(
            F.concat(state["kept"], F.array(i)).alias("kept"), spent.alias("elapsed"),
            stop["lat"].alias("lat"), stop["lng"].alias("lng"))).otherwise(state)

    positions = F.when(F.size("stops") > 0, F.sequence(F.lit(1), F.size("stops"))).otherwise(
        F.array().cast("array<int>"))
    kept = F.aggregate(positions, start, step)["kept"]
    return routes.withColumn("_kept", kept).withColumn(
        "stops", F.transform("_kept", lambda i: F.element_at("stops", i))).drop("_kept")


def cap_stops(routes: DataFrame) -> DataFrame:
    """At most ``max_waypoints`` stops."""
    return routes.withColumn("stops", F.slice("stops", F.lit(1), F.col("max_waypoints")))


def mask_stops(routes: DataFrame) -> DataFrame:
    """Surprise mode: hide what a stop is, keep the originals in its metadata."""
    hidden = F.transform("stops", lambda s, i: F.struct(
        s["id"].alias("id"), F.format_string("Mystery Stop #%d", i + 1).alias("name"),
        F.lit(fv.SURPRISE_DESCRIPTION).alias("description"), s["categories"].alias("categories"),
        strings([]).alias("photos"), s["lat"].alias("lat"), s["lng"].alias("lng"),
        F.map_concat(s["metadata"], F.create_map(
            F.lit("_surprise_original_name"), s["name"],
            F.lit("_surprise_original_description"), s["description"])).alias("metadata")))
    return routes.withColumn("stops", F.when(F.col("surprise_mode"), hidden).otherwise(
        F.col("stops")))


def assemble(routes: DataFrame) -> DataFrame:
    """Waypoints with both ends, segments, totals and the average detour of a stop."""
    short = F.substring(F.col("route_id").cast("string"), 1, 8)
    circular = F.col("d_lat").isNull()

    def point(prefix, name, lat: Column, lng: Column, origin: bool) -> Column:
        return F.struct(
            F.concat(prefix, F.lit("_"), short).alias("id"), name.alias("name"),
            F.lit(None).cast("string").alias("description"), strings([]).alias("categories"),
            lat.alias("lat"), lng.alias("lng"), F.lit(origin).alias("is_origin"),
            F.lit(not origin).alias("is_destination"))

    first = point(F.lit("origin"), F.lit("Start"), F.col("o_lat"), F.col("o_lng"), True)
    last = point(F.when(circular, "return").otherwise("dest"),
                 F.when(circular, "Return to Start").otherwise("Destination"),
                 F.coalesce("d_lat", "o_lat"), F.coalesce("d_lng", "o_lng"), False)
    middle = F.transform("stops", lambda s: F.struct(
        s["id"].alias("id"), s["name"].alias("name"), s["description"].alias("description"),
        s["categories"].alias("categories"), s["lat"].alias("lat"), s["lng"].alias("lng"),
        F.lit(False).alias("is_origin"), F.lit(False).alias("is_destination")))
    rows = routes.withColumns({
        "is_circular": circular, "places_count": F.size("stops"),
        "waypoints": F.concat(F.array(first), middle, F.array(last))})
    legs = F.zip_with(
        F.slice("waypoints", F.lit(1), F.size("waypoints") - 1),
        F.slice("waypoints", F.lit(2), F.size("waypoints") - 1),
        lambda a, b: F.struct(a["lat"].alias("from_lat"), a["lng"].alias("from_lng"),
                              b["lat"].alias("to_lat"), b["lng"].alias("to_lng"), geo.haversine_m(
                                  a["lat"], a["lng"], b["lat"], b["lng"]).alias("metres")))
    rows = rows.withColumn("_legs", legs).withColumn("_metres", F.aggregate(
        "_legs", F.lit(0.0), lambda total, leg: total + leg["metres"]))
    direct = geo.haversine_m("o_lat", "o_lng", F.coalesce("d_lat", "o_lat"),
                             F.coalesce("d_lng", "o_lng"))
    return rows.withColumns({
        "segments": F.transform("_legs", lambda leg: F.struct(
            leg["from_lat"].alias("from_lat"), leg["from_lng"].alias("from_lng"),
            leg["to_lat"].alias("to_lat"), leg["to_lng"].alias("to_lng"),
            round_to(leg["metres"], 1).alias("distance_m"),
            round_to(geo.travel_seconds(leg["metres"], "mode"), 1).alias("duration_s"))),
        "total_distance_m": round_to("_metres", 1),
        "total_duration_s": round_to(geo.travel_seconds("_metres", "mode"), 1),
        "stop_detour_m": F.when(F.size("stops") > 0, round_to(
            F.greatest(F.lit(0.0), F.col("_metres") - direct)
            / F.greatest(F.lit(1), F.size("stops")), 1)).otherwise(0.0),
    }).withColumn("stop_detour_s", round_to(geo.travel_seconds("stop_detour_m", "mode"), 1)) \
        .drop("_legs", "_metres")


def reorder(routes: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Apply a requested order of the stops and recompute: (routes, rejected requests)."""
    fine = F.coalesce(is_permutation(F.col(order), F.size("stops")), F.lit(False))
    return assemble(permute(routes.where(fine), order)), routes.where(~fine)


# --- descriptions -------------------------------------------------------------------------------


def summary(routes: DataFrame) -> DataFrame:
    """Adds a one-line ``summary``."""
    kind = F.when(F.col("is_circular"), "Circular").otherwise("Point-To-Point")
    names = F.filter(F.transform("stops", lambda s: s["name"]), lambda n: F.coalesce(
        F.length(n), F.lit(0)) > 0)
    listed = F.concat(F.array_join(F.slice(names, 1, 5), ", "), F.when(
        F.size(names) > 5, F.format_string(" +%d more", F.size(names) - 5)).otherwise(""))
    head = F.format_string("%s %s route: %.1f km, ~%s, %d stops", kind, "mode",
                           round_to(F.col("total_distance_m") / 1000, 1),
                           text.duration_label("total_duration_s"), "places_count")
    return routes.withColumn("summary", F.when(F.size(names) > 0, F.concat(
        head, F.lit(" ("), listed, F.lit(")"))).otherwise(head))


def number(value: Column) -> Column:
    """Coordinate as plain decimal text without trailing zeros, e.g. ``42.441``; ``42.0`` stays."""
    fixed = F.regexp_replace(F.format_string("%.7f", value), r"0+$", "")
    return F.regexp_replace(fixed, r"\.$", ".0")


def links(routes: DataFrame) -> DataFrame:
    """Adds deep links of navigation apps and a share image address."""
    pairs = F.transform("waypoints", lambda w: F.concat(number(w["lat"]), F.lit(","),
                                                        number(w["lng"])))
    maps = F.concat(F.lit("https://www.google.com/maps/dir/"), F.array_join(pairs, "/"))
    end = F.element_at("waypoints", -1)
    return routes.withColumns({
        "google_maps": maps,
        "osmand": F.concat(F.lit("osmand://navigate?lat="), number(end["lat"]), F.lit("&lon="),
                           number(end["lng"])),
        "geo": F.concat(F.lit("geo:"), number(end["lat"]), F.lit(","), number(end["lng"])),
        "qr_data": F.concat(F.lit("https://api.qrserver.com/v1/create-qr-code/?size=300x300&data="),
                            F.url_encode(maps))})


def _facts() -> Column:
    return F.format_string(
        "Mode: %s, Distance: %.1f km, Duration: %.1fh, Stops: %d", "mode",
        round_to(F.col("total_distance_m") / 1000, 1),
        round_to(F.col("total_duration_s") / 3600, 1), "places_count")


def _waypoint_name(w: Column, i: Column) -> Column:
    return text.xml_escape(F.coalesce(not_empty(w["name"]), F.format_string("Point %d", i)))


def gpx(routes: DataFrame, product: str = "cairn", descriptions: bool = True) -> DataFrame:
    """Adds a GPX 1.1 document: metadata, one ``wpt`` per waypoint, one track."""
    def wpt(w: Column, i: Column) -> Column:
        about = F.when(F.lit(descriptions) & not_empty(w["description"]).isNotNull(), F.concat(
            F.lit("\n    <desc>"), text.xml_escape(w["description"]), F.lit("</desc>"))) \
            .otherwise("")
        kind = F.when(F.size(w["categories"]) > 0, F.concat(
            F.lit("\n    <type>"), F.array_join(w["categories"], ", "), F.lit("</type>"))) \
            .otherwise("")
        return F.concat(F.lit('  <wpt lat="'), number(w["lat"]), F.lit('" lon="'),
                        number(w["lng"]), F.lit('">\n    <name>'), _waypoint_name(w, i),
                        F.lit("</name>"), about, kind, F.lit("\n  </wpt>"))

    track = F.transform("waypoints", lambda w: F.concat(
        F.lit('      <trkpt lat="'), number(w["lat"]), F.lit('" lon="'), number(w["lng"]),
        F.lit('" />')))
    return routes.withColumn("gpx", F.concat_ws(
        "\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>'),
        F.lit(f'<gpx version="1.1" creator="{product}" xmlns="http://www.topografix.com/GPX/1/1" '
              'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation='
              '"http://www.topografix.com/GPX/1/1 http://www.topografix.com/GPX/1/1/gpx.xsd">'),
        F.lit("  <metadata>"),
        F.format_string(f"    <name>{product} Route (%d places)</name>", "places_count"),
        F.concat(F.lit("    <time>"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX"),
                 F.lit("</time>")),
        F.concat(F.lit("    <desc>"), _facts(), F.lit("</desc>")), F.lit("  </metadata>"),
        F.array_join(F.transform("waypoints", wpt), "\n"), F.lit("  <trk>"),
        F.concat(F.lit("    <name>Route ("), "mode", F.lit(")</name>")), F.lit("    <trkseg>"),
        F.array_join(track, "\n"), F.lit("    </trkseg>\n  </trk>\n</gpx>")))


def kml(routes: DataFrame, product: str = "cairn", descriptions: bool = True) -> DataFrame:
    """Adds a KML document: styles, one placemark per waypoint, the line of the route."""

    def position(w: Column) -> Column:
        return F.concat(number(w["lng"]), F.lit(","), number(w["lat"]), F.lit(",0"))

    def placemark(w: Column, i: Column) -> Column:
        style = F.when(w["is_origin"], "startStyle").when(
            w["is_destination"], "endStyle").otherwise("waypointStyle")
        about = F.when(F.lit(descriptions) & not_empty(w["description"]).isNotNull(), F.concat(
            F.lit("\n      <description>"), text.xml_escape(w["description"]),
            F.lit("</description>"))).otherwise("")
        return F.concat(
            F.lit("    <Placemark>\n      <name>"), _waypoint_name(w, i),
            F.lit("</name>\n      <styleUrl>#"), style, F.lit("</styleUrl>"), about,
            F.lit("\n      <Point>\n        <coordinates>"), position(w),
            F.lit("</coordinates>\n      </Point>\n    </Placemark>"))

    return routes.withColumn("kml", F.concat_ws(
        "\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>'),
        F.lit('<kml xmlns="http://www.opengis.net/kml/2.2">\n  <Document>'),
        F.format_string(f"    <name>{product} Route (%d places)</name>", "places_count"),
        F.concat(F.lit("    <description>"), _facts(), F.lit("</description>")), F.lit(fv.KML_STYLES),
        F.array_join(F.transform("waypoints", placemark), "\n"),
        F.concat(F.lit("    <Placemark>\n      <name>Route ("), "mode", F.lit(
            ")</name>\n      <styleUrl>#routeStyle</styleUrl>\n      <LineString>\n"
            "        <tessellate>1</tessellate>\n        <coordinates>"),
            F.array_join(F.transform("waypoints", position), " "), F.lit(
                "</coordinates>\n      </LineString>\n    </Placemark>\n  </Document>\n</kml>"))))
