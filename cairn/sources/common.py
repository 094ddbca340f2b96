"""What all place sources share: the output columns, and guarded number parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import strings


def text_map(value: Column | None = None) -> Column:
    if value is None:
        return F.map_from_arrays(strings([]), strings([]))
    return value


def place_columns(source: str, **columns: Column) -> list[Column]:
    """The standard place columns; what a source does not know stays empty."""
    defaults = {
        "description": F.lit(None).cast("string"), "categories": strings([]),
        "category_confidence": F.map_from_arrays(strings([]), F.array().cast("array<double>")),
        "tags": strings([]), "photos": strings([]), "osm_tags": text_map(),
        "metadata": text_map()}
    filled = {**defaults, **columns}
    order = ["ord", "id", "name", "description", "categories", "lat", "lng", "confidence",
             "category_confidence", "tags", "photos", "osm_tags", "metadata"]
    named = [filled[c].alias(c) for c in order]
    return [*named[:2], F.lit(source).alias("source"), F.array(F.lit(source)).alias("sources"),
            *named[2:]]


def on_earth(lat, lng) -> Column:
    return F.coalesce(F.col(lat).between(-90, 90) & F.col(lng).between(-180, 180), F.lit(False))


def payload_ord(position: str = "pos") -> Column:
    """Order of an item: payload first, then position in it."""
    return F.col("payload_id") * F.lit(1_000_000) + F.col(position)


def lookup(table: dict, key: Column, default: list[str] | None = None) -> Column:
    """Categories of ``key`` from a small literal table, without a join."""
    literal = F.create_map(*[x for k, cats in table.items() for x in (F.lit(k), strings(cats))])
    found = F.try_element_at(literal, key)
    return found if default is None else F.coalesce(found, strings(default))


def drop_map_nulls(value: Column) -> Column:
    return F.map_filter(value, lambda k, v: v.isNotNull())


def split_placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with usable coordinates, and the quarantined rest."""
    good = on_earth("lat", "lng")
    return rows.where(good), rows.where(~good)
