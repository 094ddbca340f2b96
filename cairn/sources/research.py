"""Research answers (JSON or free text) to places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions import text
from cairn.functions.columns import not_empty, strings
from cairn.sources.common import drop_map_nulls, on_earth, payload_ord, place_columns

_NO_ITEMS = "array<variant>"


def _text(item: Column, *keys: str) -> Column:
    """First non-empty text under the keys, empty if none."""
    return F.coalesce(*[not_empty(F.try_variant_get(item, f"$.{k}", "string")) for k in keys],
                      F.lit(""))


def _latitude(item: Column) -> Column:
    """A missing latitude counts as 0, an unreadable one is null."""
    absent = F.try_variant_get(item, "$.lat", "variant").isNull()
    return F.when(absent, F.lit(0.0)).otherwise(F.try_variant_get(item, "$.lat", "double"))


def _longitude(item: Column) -> Column:
    """``lng``, or ``lon`` when ``lng`` is missing, zero or empty."""
    first = F.try_variant_get(item, "$.lng", "double")
    blank = F.coalesce(F.try_variant_get(item, "$.lng", "string"), F.lit("")) == ""
    absent = F.try_variant_get(item, "$.lon", "variant").isNull()
    second = F.when(absent, F.lit(0.0)).otherwise(F.try_variant_get(item, "$.lon", "double"))
    return F.when(blank | F.coalesce(first == 0, F.lit(False)), second).otherwise(first)


def _usable(item: Column) -> Column:
    lat, lng = _latitude(item), _longitude(item)
    return F.coalesce((_text(item, "name", "title") != "") & ((lat != 0) | (lng != 0))
                      & lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))


def answers(payloads: DataFrame) -> DataFrame:
    """(payload_id, provider, payload) -> adds ``items`` and ``prose`` (does it need prose rules?).

    Structured answers are a list, an object with a list under a usual key, or a single object.
    In free text the first JSON array counts, else every object with a name and a latitude.
    """
    root = payloads.withColumn("v", F.try_parse_json("payload"))
    as_list = F.try_variant_get("v", "$", _NO_ITEMS)
    wrapped = F.coalesce(*[F.try_variant_get("v", f"$.{k}", _NO_ITEMS)
                           for k in ("places", "pois", "results", "items")])
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    structured = as_list.isNotNull() | is_object
    in_text = F.try_variant_get(F.try_parse_json(F.regexp_extract(
        "payload", fv.JSON_ARRAY, 0)), "$", _NO_ITEMS)
    objects = F.filter(F.transform(F.regexp_extract_all("payload", F.lit(fv.JSON_OBJECT),
                                                        F.lit(0)), F.try_parse_json), _usable)
    return root.withColumns({"_array": in_text, "_objects": objects}).select(
        "payload_id", "provider", "payload",
        F.when(structured, F.coalesce(as_list, F.when(F.size(wrapped) > 0, wrapped),
                                      F.array("v"))).otherwise(
            F.coalesce("_array", "_objects")).alias("items"),
        (~structured & F.col("_array").isNull() & (F.size("_objects") == 0)).alias("prose"))


def item_places(found: DataFrame) -> DataFrame:
    """Places of parsed items; items without name or coordinates are dropped."""
    rows = found.select("payload_id", "provider", F.posexplode("items").alias("pos", "item")) \
        .where(_usable(F.col("item")))
    item = F.col("item")
    typed = rows.select(
        "payload_id", "pos", "provider", _text(item, "name", "title").alias("name"),
        _latitude(item).alias("lat"), _longitude(item).alias("lng"),
        _text(item, "description", "brief_description").alias("brief"),
        _text(item, "category").alias("hint"), _text(item, "source_url", "url").alias("url"),
        _text(item, "access_info").alias("access"), _text(item, "safety_notes").alias("safety"),
        _text(item, "name_local").alias("local"))
    guessed = typed.withColumn("guess", text.research_categories(
        F.concat_ws(" ", "name", "brief"), "hint"))
    full = F.concat(
        "brief", F.when(F.col("access") != "", F.concat(F.lit("\n\n📍 "), "access"))
        .otherwise(""), F.when(F.col("safety") != "", F.concat(F.lit("\n⚠️ "), "safety"))
        .otherwise(""))
    return guessed.select(*place_columns(
        "deep_research", ord=payload_ord(), id=_place_id(), name=F.col("name"),
        description=not_empty(full), categories=_or_landmark(F.col("guess")), lat=F.col("lat"),
        lng=F.col("lng"), confidence=F.lit(0.75),
        category_confidence=F.map_from_arrays("guess", F.transform("guess", lambda c: F.lit(0.7))),
        tags=F.array(F.concat(F.lit("deep_research:"), "provider")),
        metadata=drop_map_nulls(F.create_map(
            F.lit("research_provider"), F.col("provider"),
            F.lit("source_url"), not_empty("url"), F.lit("access_info"), not_empty("access"),
            F.lit("safety_notes"), not_empty("safety"), F.lit("name_local"),
            not_empty("local")))))


def prose_places(found: DataFrame) -> DataFrame:
    """Places of bold or heading names followed by a coordinate pair."""
    def group(index: int) -> Column:
        return F.regexp_extract_all("payload", F.lit("(?mdU)" + fv.PROSE_PLACE), F.lit(index))

    rows = found.select("payload_id", "provider", F.posexplode(F.arrays_zip(
        group(1).alias("name"), group(2).alias("lat"), group(3).alias("lng"))).alias("pos", "m"))
    typed = rows.select(
        "payload_id", "pos", "provider",
        F.trim(F.rtrim(F.trim("m.name"), F.lit(":"))).alias("name"),
        F.col("m.lat").try_cast("double").alias("lat"),
        F.col("m.lng").try_cast("double").alias("lng")).where(on_earth("lat", "lng"))
    return typed.select(*place_columns(
        "deep_research", ord=payload_ord(), id=_place_id(), name=F.col("name"),
        categories=_or_landmark(text.research_categories("name", F.lit(""))), lat=F.col("lat"),
        lng=F.col("lng"), confidence=F.lit(0.6), metadata=F.create_map(
            F.lit("research_provider"), F.col("provider"))))


def _place_id() -> Column:
    return F.concat(F.lit("dr_"), "provider", F.lit("_"), text.short_hash("name"))


def _or_landmark(categories: Column) -> Column:
    return F.when(F.size(categories) > 0, categories).otherwise(strings(["landmark"]))


def places(payloads: DataFrame) -> DataFrame:
    """Everything an answer mentions; the two readings never apply to the same answer."""
    found = answers(payloads)
    return item_places(found).unionByName(prose_places(found.where("prose")))
