"""Wikidata SPARQL-JSON results to places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions.columns import as_col
from cairn.schemas import WIKIDATA_PAYLOAD
from cairn.sources.common import (drop_map_nulls, lookup, on_earth, payload_ord, place_columns)


def parse_point(wkt) -> Column:
    """``struct<lat, lng>`` from ``Point(lng lat)``; nulls for anything else."""
    pattern = r"^Point\(\s*(\S+)\s+(\S+)\s*\)$"

    def part(index: int) -> Column:
        return F.regexp_extract(as_col(wkt), pattern, index).try_cast("double")

    return F.struct(part(2).alias("lat"), part(1).alias("lng"))


def _last_segment(uri: str) -> Column:
    return F.element_at(F.split(F.coalesce(uri, F.lit("")), "/"), -1)


def places(payloads: DataFrame) -> DataFrame:
    """(payload_id, payload) -> one place per entity and payload.

    The first binding of an entity decides, even if its coordinates turn out to be unusable, so
    the coordinates are checked only after that choice.
    """
    bindings = payloads.select("payload_id", F.posexplode(
        F.from_json("payload", WIKIDATA_PAYLOAD)["results"]["bindings"]).alias("pos", "b"))
    keyed = bindings.withColumn("qid", _last_segment("b.item.value"))
    first = keyed.groupBy("payload_id", "qid").agg(
        F.min_by(F.struct("b", "pos"), "pos").alias("f")).select(
        "payload_id", "qid", "f.b", "f.pos").withColumn("at", parse_point("b.coord.value"))
    placed = first.select("*", "at.lat", "at.lng", _last_segment("b.type.value")
                          .alias("type_qid")).where(on_earth("lat", "lng"))
    link = F.col("b.sitelink.value")
    label = F.col("b.itemLabel.value")
    return placed.select(*place_columns(
        "wiki", ord=payload_ord(), id=F.concat(F.lit("wiki_"), "qid"),
        name=F.when(label != F.col("qid"), label), description=F.col("b.itemDescription.value"),
        categories=lookup(fv.WIKIDATA_TYPES, F.col("type_qid"), ["landmark"]),
        lat=F.col("lat"), lng=F.col("lng"),
        confidence=F.when(F.length(link) > 0, 0.6).otherwise(0.7),
        metadata=drop_map_nulls(F.create_map(
            F.lit("wikidata_id"), F.col("qid"), F.lit("wikipedia_url"), link,
            F.lit("type_qid"), F.col("type_qid")))))
