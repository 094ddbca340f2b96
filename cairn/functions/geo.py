"""Geographic column expressions. Degrees in, metres out; everything stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions.columns import as_col

EARTH_RADIUS_M = 6_371_000.0
# widens computed search boxes a little so that rounding can never exclude a true match
SAFETY = 1.0001
CELL_ROW_STRIDE = 1 << 32


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance in metres."""
    lat1, lng1, lat2, lng2 = (as_col(v) for v in (lat1, lng1, lat2, lng2))
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlng = F.sin(F.radians(lng2 - lng1) / 2)
    a = (half_dlat * half_dlat
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlng * half_dlng)
    return F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)) * F.lit(2.0 * EARTH_RADIUS_M)


def bearing_deg(lat1, lng1, lat2, lng2) -> Column:
    """Initial bearing, 0 to 360 degrees."""
    lat1, lng1, lat2, lng2 = (as_col(v) for v in (lat1, lng1, lat2, lng2))
    phi1, phi2, dlam = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    east = F.sin(dlam) * F.cos(phi2)
    north = F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(dlam)
    return F.pmod(F.degrees(F.atan2(east, north)) + F.lit(360.0), F.lit(360.0))


def segment_distance_m(lat, lng, from_lat, from_lng, to_lat, to_lng) -> Column:
    """Distance from a point to a segment in the plane tangent at the segment's mean latitude."""
    lat, lng, from_lat, from_lng, to_lat, to_lng = (
        as_col(v) for v in (lat, lng, from_lat, from_lng, to_lat, to_lng))
    per_lng = F.cos(F.radians((from_lat + to_lat) / 2)) * F.lit(fv.METRES_PER_DEGREE)
    per_lat = F.lit(fv.METRES_PER_DEGREE)
    px, py = (lng - from_lng) * per_lng, (lat - from_lat) * per_lat
    dx, dy = (to_lng - from_lng) * per_lng, (to_lat - from_lat) * per_lat
    length_sq = dx * dx + dy * dy
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / length_sq))
    off_x, off_y = px - along * dx, py - along * dy
    return F.when(length_sq == 0, F.sqrt(px * px + py * py)).otherwise(
        F.sqrt(off_x * off_x + off_y * off_y))


def bounding_box(lat, lng, radius_km) -> Column:
    """``struct<south, west, north, east>`` around a centre."""
    lat, lng, radius_km = as_col(lat), as_col(lng), as_col(radius_km)
    dlat = F.degrees(radius_km / F.lit(EARTH_RADIUS_M / 1000))
    dlng = F.degrees(radius_km / (F.cos(F.radians(lat)) * F.lit(EARTH_RADIUS_M / 1000)))
    return F.struct((lat - dlat).alias("south"), (lng - dlng).alias("west"),
                    (lat + dlat).alias("north"), (lng + dlng).alias("east"))


def in_box(lat, lng, south, west, north, east) -> Column:
    """Containment, inclusive on all sides."""
    return (as_col(lat).between(as_col(south), as_col(north))
            & as_col(lng).between(as_col(west), as_col(east)))


def box_centre_radius(min_lat, min_lng, max_lat, max_lng) -> Column:
    """``struct<lat, lng, radius_m>``: middle of a box and half of its diagonal."""
    min_lat, min_lng, max_lat, max_lng = (as_col(v) for v in (min_lat, min_lng, max_lat, max_lng))
    return F.struct(((min_lat + max_lat) / 2).alias("lat"), ((min_lng + max_lng) / 2).alias("lng"),
                    (haversine_m(min_lat, min_lng, max_lat, max_lng) / 2).alias("radius_m"))


def travel_seconds(distance_m, mode) -> Column:
    """Travel time; an unknown mode counts as walking."""
    mode = as_col(mode)
    speed = F.lit(fv.SPEED_M_PER_S["walking"])
    for name, value in fv.SPEED_M_PER_S.items():
        speed = F.when(mode == name, F.lit(value)).otherwise(speed)
    return as_col(distance_m) / speed


def route_search_radius_km(direct_m, corridor_km) -> Column:
    """Radius that covers a corridor, at most 50 km."""
    corridor_km = as_col(corridor_km)
    return F.least(F.lit(50.0), F.greatest(corridor_km * 2,
                                           as_col(direct_m) / 1000 + corridor_km))


# --- the exploration grid ----------------------------------------------------------------------


def grid_index(degrees) -> Column:
    """Nearest grid line (half to even), as an integer so that minus zero cannot appear."""
    return F.rint(as_col(degrees) / F.lit(fv.CELL_DEGREES)).cast("bigint")


def grid_key(lat, lng) -> Column:
    """Text key of an exploration cell, e.g. ``42.4410_18.7710``."""
    step = F.lit(fv.CELL_DEGREES)
    return F.format_string("%.4f_%.4f", grid_index(lat) * step, grid_index(lng) * step)


def grid_key_position(key) -> Column:
    """``struct<lat, lng>`` from a cell key."""
    parts = F.split(as_col(key), "_")
    return F.struct(parts[0].cast("double").alias("lat"), parts[1].cast("double").alias("lng"))


def grid_reach(radius_m) -> Column:
    """Grid steps to try in each direction for a radius, at least one."""
    steps = F.floor(as_col(radius_m) / F.lit(111.0 * fv.CELL_DEGREES * 1000)) + 1
    return F.greatest(F.lit(1), steps).cast("int")


def grid_keys_in_radius(lat, lng, radius_m) -> Column:
    """Keys of the cells reached from a point; offsets start at the raw point, not the grid."""
    lat, lng, radius_m = as_col(lat), as_col(lng), as_col(radius_m)
    step = F.lit(fv.CELL_DEGREES)
    offsets = F.sequence(-grid_reach(radius_m), grid_reach(radius_m))
    points = F.flatten(F.transform(offsets, lambda dy: F.transform(offsets, lambda dx: F.struct(
        (lat + dy * step).alias("lat"), (lng + dx * step).alias("lng")))))
    near = F.filter(points, lambda p: haversine_m(lat, lng, p["lat"], p["lng"]) <= radius_m)
    return F.transform(near, lambda p: grid_key(p["lat"], p["lng"]))


# --- slippy map tiles --------------------------------------------------------------------------


def tile_x(lng, zoom) -> Column:
    return ((as_col(lng) + 180) / 360 * F.pow(F.lit(2.0), as_col(zoom))).cast("int")


def tile_y(lat, zoom) -> Column:
    phi = F.radians(as_col(lat))
    mercator = F.log(F.tan(phi) + F.lit(1.0) / F.cos(phi))
    return ((F.lit(1.0) - mercator / F.lit(math.pi)) / 2
            * F.pow(F.lit(2.0), as_col(zoom))).cast("int")


# --- join cells --------------------------------------------------------------------------------
# Rows of equal height `size` (degrees of latitude). A row is cut into a whole number of cells that
# are at most as wide as high on the ground, so cells stay about square and wrap at 180 degrees.


def row_cells(row, size: float) -> Column:
    """How many cells a row has."""
    row = as_col(row)
    edge = F.least(F.lit(90.0), F.greatest(F.abs(row), F.abs(row + 1)) * F.lit(size))
    return F.greatest(F.lit(1), F.ceil(F.cos(F.radians(edge)) * F.lit(360.0 / size)))


def cell_row(lat, size: float) -> Column:
    return F.floor(as_col(lat) / F.lit(size))


def cell_column(lng, cells) -> Column:
    """Column in a row of ``cells`` cells, not yet wrapped at 180 degrees."""
    return F.floor((as_col(lng) + 180) / 360 * as_col(cells))


def cell_id(row, column, cells) -> Column:
    return as_col(row) * F.lit(CELL_ROW_STRIDE) + F.pmod(as_col(column), as_col(cells))


def join_cell(lat, lng, size: float) -> Column:
    """Cell id of a point, a bigint usable as an equi-join key."""
    row = cell_row(lat, size)
    cells = row_cells(row, size)
    return cell_id(row, cell_column(lng, cells), cells)


def cell_rows(south, north, size: float) -> Column:
    """``array<bigint>`` of the rows that a box touches."""
    return F.sequence(cell_row(south, size), cell_row(north, size))


def cell_columns(west, east, cells) -> Column:
    """``array<bigint>`` of the columns that a box touches in a row of ``cells`` cells."""
    first = cell_column(west, cells)
    return F.sequence(first, F.least(cell_column(east, cells), first + as_col(cells) - 1))


def reach_box(lat, lng, radius_m) -> Column:
    """``struct<south, west, north, east>`` that holds every point within ``radius_m`` metres.

    Longitudes may leave -180..180; cell ids wrap around.
    """
    lat, lng, radius_m = as_col(lat), as_col(lng), as_col(radius_m)
    angle = radius_m / F.lit(EARTH_RADIUS_M)
    dlat = F.degrees(angle) * F.lit(SAFETY)
    top = F.abs(lat) + dlat
    dlng = F.when(top >= 89.9, F.lit(180.0)).otherwise(F.least(
        F.lit(180.0), F.degrees(angle) / F.cos(F.radians(top)) * F.lit(SAFETY)))
    return F.struct(F.greatest(F.lit(-90.0), lat - dlat).alias("south"),
                    (lng - dlng).alias("west"), F.least(F.lit(90.0), lat + dlat).alias("north"),
                    (lng + dlng).alias("east"))
