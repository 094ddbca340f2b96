"""Spatial joins as equi-joins on grid cells.

Only the smaller, query-like side is expanded to the cells it may touch; the large side keeps one
row per record. Plans never fall back to a nested loop, and AQE may split a crowded cell.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.operators.cells import cell_degrees_for, expand_reach, expand_to_cells
from cairn.operators.election import elect
from cairn.session import cut

BOX_CELL_DEGREES = 0.05


#: A box touches about so many cells along a side at most; their heights are these.
BOX_SIDE_CELLS = 12
BOX_LEVELS = tuple(BOX_CELL_DEGREES / 4 * 4 ** k for k in range(7))
#: Points of a block at most.
BLOCK_POINTS = 256


def _by_level(queries: DataFrame, join: Callable[[DataFrame, float], DataFrame]) -> DataFrame:
    """``join(boxes, cell_degrees)`` of the boxes of each of ``BOX_LEVELS`` that occurs, together."""
    extent = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    level = F.lit(len(BOX_LEVELS) - 1)
    for k in reversed(range(len(BOX_LEVELS) - 1)):
        level = F.when(extent <= BOX_LEVELS[k] * BOX_SIDE_CELLS, k).otherwise(level)
    used = sorted(r[0] for r in queries.select(level.alias("level")).distinct().collect()) or [0]
    return reduce(DataFrame.unionByName, [
        join(queries.where(level == k) if len(used) > 1 else queries, BOX_LEVELS[k]) for k in used])


def box_join(queries: DataFrame, points: DataFrame, *, lat: str = "lat", lng: str = "lng",
             cell_degrees: float | None = None) -> DataFrame:
    """Rows of ``queries`` (with south, west, north, east) joined to the points in their box.

    Cells suit the size of a box, so that few of the pairs that share a cell lie apart: each box takes
    the smallest of ``BOX_LEVELS`` that cuts it into ``BOX_SIDE_CELLS`` a side, and boxes of one level
    are joined together. Both sides are dealt by number, as a few bytes of input make many pairs.
    """
    if cell_degrees is None:
        return _by_level(queries, lambda part, size: box_join(part, points, lat=lat, lng=lng, cell_degrees=size))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = expand_to_cells(queries, cell_degrees).repartition(tasks, "_cell")
    right = points.withColumn("_cell", geo.join_cell(lat, lng, cell_degrees)).repartition(tasks, "_cell")
    return left.join(right, "_cell").where(
        geo.in_box(lat, lng, "south", "west", "north", "east")).drop("_cell")


def block_join(queries: DataFrame, points: DataFrame, kind: str, also: Column, *, lat: str = "lat",
               lng: str = "lng", cell_degrees: float | None = None) -> DataFrame:
    """``box_join`` where also ``also`` holds, a condition on column ``kind`` of points and on ``queries``.

    For results of far more rows than both tables. The points of a cell that agree in ``kind`` are cut
    into blocks of neighbours; boxes meet blocks, so most pairs that lie apart are never made. All boxes
    of a block follow each other, each with the same run of points, which files keep in little space.
    """
    if cell_degrees is None:
        return _by_level(queries, lambda part, size: block_join(
            part, points, kind, also, lat=lat, lng=lng, cell_degrees=size))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = Window.partitionBy("_cell", kind).orderBy(F.floor(F.col(lat) / (cell_degrees / 4)), lng)
    inner = [c for c in points.columns if c != kind]
    blocks = points.withColumn("_cell", geo.join_cell(lat, lng, cell_degrees)).where("_cell IS NOT NULL").repartition(
        tasks, "_cell").withColumn("_block", F.floor((F.row_number().over(near) - 1) / BLOCK_POINTS)).groupBy(
        "_cell", kind, "_block").agg(
        F.collect_list(F.struct(*inner)).alias("_points"), F.min(lat).alias("_south"), F.max(lat).alias("_north"),
        F.min(lng).alias("_west"), F.max(lng).alias("_east"))
    # merged, as other joins may go by box, not by block
    boxes = expand_to_cells(queries, cell_degrees).repartition(tasks, "_cell").hint("merge")
    # a lambda keeps the join out of generated code, which would hold all rows of a block at once
    meets = F.forall(F.array(F.col("_south") <= F.col("north"), F.col("_north") >= F.col("south"),
                             F.col("_west") <= F.col("east"), F.col("_east") >= F.col("west")), lambda side: side)
    met = blocks.join(boxes, "_cell").where(also & meets)
    pairs = met.withColumn("_point", F.explode("_points")).where(
        geo.in_box(f"_point.{lat}", f"_point.{lng}", "south", "west", "north", "east"))
    return pairs.select(*queries.columns, *[c if c == kind else f"_point.{c}" for c in points.columns])


def in_any_box(queries: DataFrame, points: DataFrame, also: Column, *, lat: str = "lat", lng: str = "lng",
               cell_degrees: float = BOX_CELL_DEGREES / 4) -> DataFrame:
    """Points in the box of at least one row of ``queries`` for which ``also`` holds, each once."""
    left = expand_to_cells(queries.distinct(), cell_degrees)
    right = points.withColumn("_cell", geo.join_cell(lat, lng, cell_degrees))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = geo.in_box(lat, lng, "south", "west", "north", "east")
    # dealt by number, as a few bytes of points may meet many boxes
    return right.repartition(tasks, "_cell").alias("p").join(
        left.alias("q"), (F.col("p._cell") == F.col("q._cell")) & inside & also, "left_semi").drop("_cell")


def circle_join(queries: DataFrame, points: DataFrame, radius_m: float | Column, *,
                cell_degrees: float, inclusive: bool = True) -> DataFrame:
    """Rows of ``queries`` (q_lat, q_lng) joined to points (lat, lng) within a radius.

    Adds ``distance_m``. The radius may be a column of ``queries``.
    """
    radius = radius_m if isinstance(radius_m, Column) else F.lit(float(radius_m))
    left = expand_reach(queries.withColumn("_radius", radius), "q_lat", "q_lng",
                        F.col("_radius"), cell_degrees)
    right = points.withColumn("_cell", geo.join_cell("lat", "lng", cell_degrees))
    joined = left.join(right, "_cell").withColumn(
        "distance_m", geo.haversine_m("q_lat", "q_lng", "lat", "lng"))
    near = F.col("distance_m") <= F.col("_radius") if inclusive else (
        F.col("distance_m") < F.col("_radius"))
    return joined.where(near).drop("_cell", "_radius")


def first_within(queries: DataFrame, points: DataFrame, radius_m: float) -> DataFrame:
    """For each query row the point of lowest ``ord`` within the radius (left join: null if none).

    First match, not nearest. Copies of a position are folded on both sides before the join: of
    equal positions only the lowest ``ord`` can be the answer. The choice is an aggregate, not a
    window, so that a crowded neighbourhood shrinks before the shuffle.
    """
    fields = [c for c in points.columns if c not in ("lat", "lng")]
    sites = points.groupBy("lat", "lng").agg(F.min_by(F.struct(*fields), F.col("ord"))
                                             .alias("site"))
    spots = queries.select("q_lat", "q_lng").distinct()
    hits = circle_join(spots, sites, radius_m, cell_degrees=cell_degrees_for(radius_m))
    best = hits.groupBy("q_lat", "q_lng").agg(F.min_by(
        F.struct("site.*", "distance_m"), F.col("site.ord")).alias("hit"))
    return queries.join(best, ["q_lat", "q_lng"], "left").select(*queries.columns, "hit")


def nearest_point(queries: DataFrame, points: DataFrame,
                  levels: tuple[float, ...] = (0.001, 0.02, 0.5)) -> DataFrame:
    """Nearest point for each query row, ties to the lowest ``ord``. Adds ``distance_m``.

    Cells grow level by level: a query is answered at the first level where the best distance is
    below the distance that the searched neighbourhood covers completely; only unanswered queries
    go on. Those with no point near descend a pyramid of cells instead. Copies of a position are
    folded first, on both sides, so crowded positions are compared once.
    """
    fields = [c for c in points.columns if c not in ("lat", "lng")]
    sites = cut(points.groupBy("lat", "lng").agg(F.min_by(F.struct(*fields), F.col("ord"))
                                                 .alias("site")))
    open_spots = cut(queries.select("q_lat", "q_lng").distinct())
    answered = None
    for size in (*levels, None):
        if size is None:
            hits = far_pairs(open_spots, sites).withColumn(
                "distance_m", geo.haversine_m("q_lat", "q_lng", "lat", "lng"))
        else:
            hits = circle_join(open_spots, sites, F.lit(size * 111_000.0), cell_degrees=size)
        best = hits.groupBy("q_lat", "q_lng").agg(F.min_by(
            F.struct("site", "lat", "lng", "distance_m"),
            F.struct(F.col("distance_m"), F.col("site.ord"))).alias("best"))
        best = cut(best)
        answered = best if answered is None else answered.unionByName(best)
        open_spots = cut(open_spots.join(best, ["q_lat", "q_lng"], "left_anti"))
        if open_spots.isEmpty():
            break
    flat = answered.select("q_lat", "q_lng", "best.site.*", "best.lat", "best.lng",
                           "best.distance_m")
    return queries.join(flat, ["q_lat", "q_lng"], "left")


#: Cells of the pyramid in degrees, each a whole number of the next; the first has 72 at most.
PYRAMID = (30.0, 7.5, 1.5, 0.3, 0.06, 0.012, 0.003)


def _on_sphere(lat, lng) -> dict[str, Column]:
    """Coordinates on the unit sphere."""
    lat, lng = F.radians(lat), F.radians(lng)
    return {"x": F.cos(lat) * F.cos(lng), "y": F.cos(lat) * F.sin(lng), "z": F.sin(lat)}


def _degree_cell(lat: str, lng: str, size: float) -> Column:
    return F.struct(F.floor((F.col(lat) + 90) / size).alias("r"), F.floor((F.col(lng) + 180) / size).alias("c"))


def far_pairs(spots: DataFrame, sites: DataFrame) -> DataFrame:
    """(q_lat, q_lng, site, lat, lng): for each spot a few sites with the nearest among them.

    A cell of the pyramid knows the box of its sites in space and one of them. Level by level a spot
    keeps the cells whose box is no farther than the nearest site known so far, and looks at the
    cells inside those; straight distances in space order like distances on the ground.
    """
    placed = cut(sites.withColumns(_on_sphere("lat", "lng")))
    box = [f(F.col(f"{s}{c}" if s else c)).alias(f"{t}{c}") for c in "xyz" for t, f, s in (("lo_", F.min, "lo_"), ("hi_", F.max, "hi_"))]
    cells, finer = [], None
    for size, parent in reversed(list(zip(PYRAMID, (None, *PYRAMID[:-1])))):
        source = finer if finer is not None else placed.select(
            "lat", "lng", *[F.col(c).alias(f"{t}{c}") for c in "xyz" for t in ("lo_", "hi_", "")])
        finer = cut(source.withColumn("cell", _degree_cell("lat", "lng", size)).groupBy("cell").agg(
            *box, F.min_by(F.struct("lat", "lng", "x", "y", "z"), F.struct("lat", "lng")).alias("one"))
            .select("cell", *[f"{t}{c}" for c in "xyz" for t in ("lo_", "hi_")], "one.*"))
        inside = _degree_cell("lat", "lng", parent) if parent else F.lit(None)
        cells.insert(0, finer.withColumn("parent", inside))
    sphere = {f"q_{c}": v for c, v in _on_sphere("q_lat", "q_lng").items()}
    first = PYRAMID[0]
    everywhere = F.array(*[F.struct(F.lit(r).cast("bigint").alias("r"), F.lit(c).cast("bigint").alias("c"))
                           for r in range(int(180 / first) + 1) for c in range(int(360 / first) + 1)])
    kept = spots.withColumns(sphere).withColumn("cell", F.explode(everywhere))
    outside = [F.greatest(F.lit(0.0), F.col(f"lo_{c}") - F.col(f"q_{c}"), F.col(f"q_{c}") - F.col(f"hi_{c}")) for c in "xyz"]
    away = [F.col(c) - F.col(f"q_{c}") for c in "xyz"]
    square = lambda parts: sum((d * d for d in parts[1:]), parts[0] * parts[0])
    # each side of a tight box has a site on it, so one is at most as far as the far end of some side
    low_half = {c: F.col(f"q_{c}") * 2 <= F.col(f"lo_{c}") + F.col(f"hi_{c}") for c in "xyz"}
    to_near = {c: F.when(low_half[c], F.col(f"lo_{c}")).otherwise(F.col(f"hi_{c}")) - F.col(f"q_{c}") for c in "xyz"}
    to_far = {c: F.when(low_half[c], F.col(f"hi_{c}")).otherwise(F.col(f"lo_{c}")) - F.col(f"q_{c}") for c in "xyz"}
    sides = [square([to_near[c], *[to_far[o] for o in "xyz" if o != c]]) for c in "xyz"]
    spot = ["q_lat", "q_lng", "q_x", "q_y", "q_z"]
    for level, table in enumerate(cells):
        held = table.select(F.col("parent" if level else "cell").alias("cell"), F.col("cell").alias("own"),
                            *[f"{t}{c}" for c in "xyz" for t in ("lo_", "hi_", "")])
        seen = kept.join(held, "cell").withColumns({"least": square(outside), "sure": F.least(square(away), *sides)})
        seen = cut(seen.select(*spot, F.col("own").alias("cell"), "least", "sure"))
        bound = seen.groupBy("q_lat", "q_lng").agg((F.min("sure") * (1 + 1e-9) + 1e-24).alias("bound"))
        kept = seen.join(bound, ["q_lat", "q_lng"]).where("least <= bound").select(*spot, "cell")
    fine = placed.withColumn("cell", _degree_cell("lat", "lng", PYRAMID[-1])).select("cell", "site", "lat", "lng")
    return kept.join(fine, "cell").select("q_lat", "q_lng", "site", "lat", "lng")


def leader_clusters(points: DataFrame, threshold_m: float) -> DataFrame:
    """Points with the ``leader`` of their position."""
    return points.join(leader_sites(points.select("ord", "lat", "lng"), threshold_m),
                       ["lat", "lng"])


def leader_sites(points: DataFrame, threshold_m: float) -> DataFrame:
    """Greedy leader clustering of (ord, lat, lng) in ``ord`` order: (lat, lng, leader).

    Going through the rows in order, a row joins the first leader closer than the threshold or
    becomes a leader itself. Equal positions are folded, as they always share a leader; ``election``
    finds the leaders in a few rounds, and as leaders lie a threshold apart, a cell of the last join
    meets a bounded number of them, however crowded a spot is.
    """
    size = cell_degrees_for(threshold_m)
    sites = cut(points.groupBy("lat", "lng").agg(F.min("ord").alias("ord")))
    leaders = elect(sites, threshold_m).where("leads").select(
        F.col("ord").alias("c_ord"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    reach = expand_reach(leaders, "c_lat", "c_lng", F.lit(threshold_m), size)
    near = geo.haversine_m("lat", "lng", "c_lat", "c_lng") < threshold_m
    return cut(sites.withColumn("_cell", geo.join_cell("lat", "lng", size)).join(reach, "_cell").where(
        (F.col("c_ord") <= F.col("ord")) & near).groupBy("lat", "lng").agg(
        F.min("c_ord").alias("leader")))
