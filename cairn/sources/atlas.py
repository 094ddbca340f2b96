"""Curated-atlas JSON and HTML result pages to places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions import text
from cairn.functions.columns import not_empty, strings
from cairn.functions.geo import in_box
from cairn.sources.common import (drop_map_nulls, lookup, payload_ord, place_columns,
                                  split_placed)


def _field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("item", f"$.{path}", kind)


def items(payloads: DataFrame) -> DataFrame:
    """(payload_id, payload) -> one row per item of a root list, ``places`` or ``results``."""
    root = payloads.select("payload_id", F.try_parse_json("payload").alias("v"))
    listed = F.coalesce(*[F.try_variant_get("v", path, "array<variant>")
                          for path in ("$", "$.places", "$.results")])
    return root.select("payload_id", F.posexplode(listed).alias("pos", "item"))


def map_categories(labels: Column) -> Column:
    """Sorted categories of atlas labels, compared trimmed and in lower case."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(labels, lambda label: lookup(
        fv.ATLAS_CATEGORIES, F.lower(F.trim(label)), [])))))


def parse(payloads: DataFrame) -> DataFrame:
    """Items as place columns, including those whose coordinates are unusable (null)."""
    tags = F.coalesce(_field("tags", "array<string>"), strings([]))
    labels = F.concat(F.coalesce(_field("categories", "array<string>"), strings([])), tags)
    mapped = map_categories(labels)
    photo = not_empty(_field("photo"))
    return items(payloads).select(*place_columns(
        "atlas", ord=payload_ord(),
        id=F.concat(F.lit("atlas_"), F.coalesce(_field("id"), _field("slug"), F.lit(""))),
        name=F.coalesce(not_empty(_field("title")), not_empty(_field("name"))),
        description=F.coalesce(not_empty(_field("subtitle")), not_empty(_field("description"))),
        categories=F.when(F.size(mapped) > 0, mapped).otherwise(strings(["landmark"])),
        lat=_field("lat", "double"), lng=_field("lng", "double"), confidence=F.lit(0.85),
        tags=tags, photos=F.when(photo.isNotNull(), F.array(photo)).otherwise(strings([])),
        metadata=drop_map_nulls(F.create_map(F.lit("atlas_url"),
                                             F.coalesce(_field("url"), F.lit(""))))))


def places(payloads: DataFrame) -> DataFrame:
    """Well-formed items only."""
    return split_placed(parse(payloads))[0]


def rejected(payloads: DataFrame) -> DataFrame:
    """Items without usable coordinates."""
    return split_placed(parse(payloads))[1]


def html_places(pages: DataFrame) -> DataFrame:
    """(payload_id, html, south, west, north, east) -> places named in the page, inside the box."""
    def group(index: int) -> Column:
        return F.regexp_extract_all("html", F.lit("(?s)" + fv.HTML_PLACE), F.lit(index))

    found = pages.select(
        "payload_id", "south", "west", "north", "east",
        F.posexplode(F.arrays_zip(group(1).alias("lat"), group(2).alias("lng"),
                                  group(3).alias("name"))).alias("pos", "m"))
    typed = found.select(
        "payload_id", "pos", "south", "west", "north", "east",
        F.col("m.lat").try_cast("double").alias("lat"),
        F.col("m.lng").try_cast("double").alias("lng"), F.trim("m.name").alias("name"))
    inside = typed.where(in_box("lat", "lng", "south", "west", "north", "east"))
    return inside.select(*place_columns(
        "atlas", ord=payload_ord(), id=F.concat(F.lit("atlas_html_"), text.short_hash("name")),
        name=F.col("name"), categories=strings(["landmark"]), lat=F.col("lat"),
        lng=F.col("lng"), confidence=F.lit(0.75)))
