"""OpenStreetMap JSON (Overpass layout) to places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions.columns import as_col, not_empty, strings
from cairn.schemas import OSM_PAYLOAD
from cairn.sources.common import lookup, payload_ord, place_columns


def elements(payloads: DataFrame) -> DataFrame:
    """(payload_id, payload) -> one row per element, with coordinates of nodes or centres.

    Elements without coordinates are dropped.
    """
    parsed = payloads.select("payload_id", F.posexplode(
        F.from_json("payload", OSM_PAYLOAD)["elements"]).alias("pos", "el"))
    own = F.col("el.lat").isNotNull() & F.col("el.lon").isNotNull()
    placed = parsed.select(
        payload_ord().alias("ord"), F.coalesce("el.type", F.lit("n")).alias("type"),
        F.col("el.id").alias("osm_id"), F.coalesce("el.tags", F.map_from_arrays(
            strings([]), strings([]))).alias("tags"),
        F.when(own, F.col("el.lat")).otherwise(F.col("el.center.lat")).alias("lat"),
        F.when(own, F.col("el.lon")).otherwise(F.col("el.center.lon")).alias("lng"))
    return placed.where("lat IS NOT NULL AND lng IS NOT NULL")


def wanted_feature(tags="tags") -> Column:
    """Does an element count as a feature? Any clause of the selection table must hold."""
    tags = as_col(tags)

    def holds(key: str, operator: str, value: str) -> Column:
        tag = F.try_element_at(tags, F.lit(key))
        test = {"=": tag == value, "?": tag.isNotNull(), "~": F.rlike(tag, F.lit(value))}
        return F.coalesce(test[operator], F.lit(False))

    clauses = [reduce(lambda a, b: a & b, [holds(*term) for term in clause])
               for clause in fv.OSM_FEATURE_CLAUSES]
    return reduce(lambda a, b: a | b, clauses)


def tag_categories(tags="tags") -> Column:
    """Sorted categories of a tag map.

    Restaurants and hotels only count with a marker of note; disused industry is abandoned.
    """
    tags = as_col(tags)
    mapped = F.flatten(F.transform(F.map_entries(tags), lambda e: lookup(
        fv.OSM_TAG_CATEGORIES, F.concat_ws(":", e["key"], e["value"]), [])))
    idle = (F.try_element_at(tags, F.lit("building")) == "industrial") & (
        F.try_element_at(tags, F.lit("disused")) == "yes")
    found = F.array_sort(F.array_distinct(F.when(
        idle, F.concat(mapped, strings(["industrial", "abandoned"]))).otherwise(mapped)))
    notable = F.arrays_overlap(F.map_keys(tags), strings(fv.OSM_NOTABLE_MARKERS))
    return F.when(notable, found).otherwise(F.array_except(found, strings(
        ["restaurant_notable", "hotel_notable"])))


def tag_list(tags="tags", limit: int = 100) -> Column:
    """``key=value`` texts of the meaningful tags with values shorter than ``limit``."""
    kept = F.filter(F.map_entries(as_col(tags)), lambda e: ~e["key"].isin(
        fv.OSM_SKIPPED_TAG_KEYS) & (F.length(e["value"]) < limit))
    return F.transform(kept, lambda e: F.concat_ws("=", e["key"], e["value"]))


def places(payloads: DataFrame, only_wanted: bool = False) -> DataFrame:
    rows = elements(payloads)
    if only_wanted:
        rows = rows.where(wanted_feature())

    def tag(*keys: str) -> Column:
        return F.coalesce(*[not_empty(F.try_element_at(F.col("tags"), F.lit(k))) for k in keys])

    rows = rows.withColumn("categories", tag_categories())
    return rows.select(*place_columns(
        "osm", ord=F.col("ord"), id=F.concat_ws("_", F.lit("osm"), "type", "osm_id"),
        name=tag("name", "name:en"), description=tag("description", "note"),
        categories=F.col("categories"), lat=F.col("lat"), lng=F.col("lng"),
        confidence=F.when(F.size("categories") > 0, 0.7).otherwise(0.4), tags=tag_list(),
        osm_tags=F.col("tags"), metadata=F.create_map(F.lit("osm_type"), F.col("type"))))
