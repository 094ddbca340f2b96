"""Greedy leader election over nearby rows: going through the rows in ``ord`` order, a row is covered
if a leader before it is its neighbour, else it becomes a leader.

All that can be decided inside a tile is decided in one task, row after row; rows whose fate hangs on
an undecided row beyond the tile's edge wait for the next round, which sees larger tiles. A tile holds
at most ``TILE_ROWS`` undecided rows: the size is picked from counts, so few rounds do, also for long
trails in order, and a task's memory is bounded. Where even the smallest tile is fuller, rounds of the
lowest row per small cell thin the crowd first.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.operators.cells import cell_degrees_for, expand_to_cells
from cairn.session import cut

TILE_ROWS = 100_000
#: Tile heights to choose from, as multiples of the reach; the last is the whole globe.
GROWTH, LEVELS = 2.0, 20
LEADS, COVERED, OPEN = 1, 2, 0
SCHEMA = "ord bigint, lat double, lng double, name string, state int"
FIELDS = ["ord", "lat", "lng", "name", "state"]

Place = tuple[float, float, str]


def within_metres(limit: float) -> tuple[Callable, Callable]:
    """Neighbours closer than ``limit`` metres, by cells of space, which have no edge or pole."""
    side = 2 * math.sin(min(limit / geo.EARTH_RADIUS_M, math.pi) / 2) * geo.SAFETY or 1e-12

    def cell(place: Place) -> tuple:
        lat, lng = math.radians(place[0]), math.radians(place[1])
        flat = math.cos(lat)
        return (math.floor(flat * math.cos(lng) / side), math.floor(flat * math.sin(lng) / side),
                math.floor(math.sin(lat) / side))

    def near(a: Place, b: Place) -> bool:
        one, two = math.radians(a[0]), math.radians(b[0])
        dlat, dlng = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
        h = math.sin(dlat / 2) ** 2 + math.cos(one) * math.cos(two) * math.sin(dlng / 2) ** 2
        return math.atan2(math.sqrt(h), math.sqrt(1.0 - h)) * (2.0 * geo.EARTH_RADIUS_M) < limit

    return cell, near


def within_degrees(limit: float) -> tuple[Callable, Callable]:
    """Neighbours of the same name whose latitudes and longitudes differ by less than ``limit``."""
    def cell(place: Place) -> tuple:
        return (math.floor(place[0] / limit), math.floor(place[1] / limit), place[2])

    def near(a: Place, b: Place) -> bool:
        return a[2] == b[2] and abs(a[0] - b[0]) < limit and abs(a[1] - b[1]) < limit

    return cell, near


def _beside(cell: tuple) -> list[tuple]:
    spread = [range(c - 1, c + 2) if isinstance(c, int) else (c,) for c in cell]
    return [(x, y, z) for x in spread[0] for y in spread[1] for z in spread[2]]


def decide(places: list[Place], state: list[int], home: list[bool], cell: Callable,
           near: Callable) -> list[int]:
    """States of rows in ``ord`` order. Rows that are not at home may have unseen neighbours."""
    leaders, waiting = defaultdict(list), defaultdict(list)
    result = []
    for place, known, own in zip(places, state, home):
        here = cell(place)
        if known == LEADS:
            leaders[here].append(place)
            result.append(LEADS)
            continue
        beside = _beside(here)
        if any(near(other, place) for c in beside if c in leaders for other in leaders[c]):
            result.append(COVERED)
        elif not own or any(near(other, place) for c in beside if c in waiting for other in waiting[c]):
            waiting[here].append(place)
            result.append(OPEN)
        else:
            leaders[here].append(place)
            result.append(LEADS)
    return result


def _fullest(rows: DataFrame, sizes: list[float]) -> list[int]:
    """Rows of the fullest tile at each size, in one job."""
    tiles = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), geo.join_cell("lat", "lng", size).alias("tile"))
                                for i, size in enumerate(sizes)])).alias("t")
    counts = rows.select(tiles).groupBy("t.level", "t.tile").count()
    most = {r["level"]: r["most"] for r in counts.groupBy("level").agg(F.max("count").alias("most")).collect()}
    return [most.get(i, 0) for i in range(len(sizes))]


def _thinned(rows: DataFrame, size: float, reach: Callable, close) -> DataFrame:
    """One round in the JVM: the lowest row of each small cell leads unless a lower row of another
    cell is its neighbour; what it reaches is covered."""
    celled = rows.withColumn("_cell", F.struct(geo.join_cell("lat", "lng", size), "name"))
    lowest = celled.groupBy("_cell").agg(F.min_by(F.struct("ord", "lat", "lng", "name"), "ord").alias("p")).select("p.*")

    def named(frame: DataFrame) -> DataFrame:
        held = frame.select(*[F.col(c).alias(f"c_{c}") for c in ("ord", "lat", "lng", "name")])
        return reach(held, size).withColumn("_cell", F.struct("_cell", F.col("c_name").alias("name"))).drop("c_name")

    blocked = celled.join(named(lowest), "_cell").where((F.col("ord") < F.col("c_ord")) & close) \
        .select(F.col("c_ord").alias("ord")).distinct()
    elected = cut(lowest.join(blocked, "ord", "left_anti"))
    hit = celled.join(named(elected), "_cell").where(close).groupBy("ord").agg(
        F.when(F.max(F.col("ord") == F.col("c_ord")), LEADS).otherwise(COVERED).alias("new"))
    return rows.join(hit, "ord", "left").withColumn("state", F.coalesce("new", "state")).drop("new")


def elect(rows: DataFrame, limit: float, degrees: bool = False, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(ord, lat, lng, name, leads)`` for rows of distinct ``ord``: neighbours by metres, or by
    degrees and equal names. Positions must be folded before."""
    cell, near = within_degrees(limit) if degrees else within_metres(limit)
    size = limit if degrees else cell_degrees_for(limit)

    def box(lat, lng):
        if not degrees:
            return geo.reach_box(lat, lng, F.lit(limit))
        lat, lng = F.col(lat), F.col(lng)
        return F.struct((lat - limit).alias("south"), (lng - limit).alias("west"),
                        (lat + limit).alias("north"), (lng + limit).alias("east"))

    def reach(frame: DataFrame, tile: float) -> DataFrame:
        return expand_to_cells(frame.withColumn("_box", box(*frame.columns[1:3])), tile, "_box").drop("_box")

    if degrees:
        close = (F.abs(F.col("lat") - F.col("c_lat")) < limit) & (F.abs(F.col("lng") - F.col("c_lng")) < limit)
    else:
        close = geo.haversine_m("lat", "lng", "c_lat", "c_lng") < limit

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord")
        places = list(zip(frame["lat"].tolist(), frame["lng"].tolist(), frame["name"].tolist()))
        found = decide(places, frame["state"].tolist(), frame["home"].tolist(), cell, near)
        new = frame["home"] & (frame["state"] == OPEN)
        return frame.assign(state=found).loc[new, FIELDS]

    if "name" not in rows.columns:
        rows = rows.withColumn("name", F.lit(""))
    sizes = [min(180.0, size * GROWTH ** i) for i in range(1, LEVELS)]
    open_ = cut(rows.select("ord", "lat", "lng", "name", F.lit(OPEN).alias("state")))
    rounds, recent = [], None
    while (fullest := _fullest(open_, sizes))[-1]:
        fitting = [s for s, n in zip(sizes, fullest) if n <= tile_rows]
        known = open_ if recent is None else open_.unionByName(recent)
        if fitting:
            seen = reach(known, fitting[-1]).withColumn(
                "home", geo.join_cell("lat", "lng", fitting[-1]) == F.col("_cell"))
            state = cut(seen.groupBy("_cell").applyInPandas(walk, SCHEMA))
            # an open row has met every leader of its own tile: only those that reach beyond theirs are news
            across = box("lat", "lng")
            recent = state.where(F.col("state") == LEADS).where(
                geo.join_cell(across["south"], across["west"], fitting[-1])
                != geo.join_cell(across["north"], across["east"], fitting[-1]))
        else:
            if recent is not None:  # the thinning round looks at open rows only
                hit = open_.withColumn("_cell", geo.join_cell("lat", "lng", size)).join(
                    reach(recent.select(*[F.col(c).alias(f"c_{c}") for c in ("ord", "lat", "lng", "name")]), size), "_cell") \
                    .where(close & (F.col("name") == F.col("c_name"))).select("ord").distinct()
                open_ = cut(open_.join(hit.withColumn("new", F.lit(COVERED)), "ord", "left")
                            .withColumn("state", F.coalesce("new", "state")).drop("new"))
                rounds.append(open_.where(F.col("state") != OPEN))
                open_, recent = open_.where(F.col("state") == OPEN), None
            state = cut(_thinned(open_, size, reach, close))
        rounds.append(state.where(F.col("state") != OPEN))
        open_ = state.where(F.col("state") == OPEN)
    leads = (F.col("state") == LEADS).alias("leads")
    found = open_.select("ord", "lat", "lng", "name", leads)
    for part in rounds:
        found = found.unionByName(part.select("ord", "lat", "lng", "name", leads))
    return found
