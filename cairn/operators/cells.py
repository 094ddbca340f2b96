"""Rows expanded to the grid cells that they may touch, for equi-joins on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import geo


def cell_degrees_for(radius_m: float) -> float:
    """Cell height such that a circle of this radius touches about nine cells."""
    return radius_m / 111_000.0


def expand_to_cells(rows: DataFrame, size: float, box: str | None = None,
                    cell: str = "_cell") -> DataFrame:
    """One row per join cell that the row's box touches (columns, or fields of struct ``box``).

    Two plain explodes, rows then columns of cells, which stay in generated code.
    """
    side = (lambda name: F.col(f"{box}.{name}")) if box else F.col
    by_row = rows.withColumn("_row", F.explode(geo.cell_rows(side("south"), side("north"), size)))
    sized = by_row.withColumn("_cells", geo.row_cells("_row", size))
    by_cell = sized.withColumn("_column", F.explode(geo.cell_columns(
        side("west"), side("east"), "_cells")))
    return by_cell.withColumn(cell, geo.cell_id("_row", "_column", "_cells")).drop(
        "_row", "_cells", "_column")


def expand_reach(rows: DataFrame, lat: str, lng: str, radius_m: Column, size: float) -> DataFrame:
    """One row per join cell that can hold a point within the radius."""
    boxed = rows.withColumn("_box", geo.reach_box(lat, lng, radius_m))
    return expand_to_cells(boxed, size, "_box").drop("_box")
