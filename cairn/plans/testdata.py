"""Domain tables derived from the given test tables by plain projections.

The test tables have no coordinates, so positions come from integer arithmetic and one division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions.columns import strings

CATEGORY_LIST = sorted(fv.CATEGORIES)
AS_OF = "2024-01-31"
EMPTY_MAP = "map<string,string>"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    for column, kind in frame.dtypes:
        if kind == "timestamp_ntz":
            frame = frame.withColumn(column, F.col(column).cast("timestamp"))
    return frame


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The same table as a stream of files."""
    raw = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    frame = spark.readStream.schema(raw).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    for column, kind in frame.dtypes:
        if kind == "timestamp_ntz":
            frame = frame.withColumn(column, F.col(column).cast("timestamp"))
    return frame


def lat_of(key: Column, step: int = 0) -> Column:
    return (F.lit(420000 + step) + (key * 7919) % 6000).cast("double") / F.lit(10000.0)


def lng_of(key: Column) -> Column:
    return (F.lit(184000) + (key * 104729) % 8000).cast("double") / F.lit(10000.0)


def category_of(number: Column) -> Column:
    return F.element_at(strings(CATEGORY_LIST), (F.lit(1) + number % len(CATEGORY_LIST))
                        .cast("int"))


def _no_strings() -> Column:
    return strings([])


def _no_map(kind: str = EMPTY_MAP) -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(
        f"array<{kind.split(',')[1][:-1]}>")).cast(kind)


def _place(rank: int, key: Column, step: int, **columns: Column) -> list[Column]:
    filled = {
        "description": F.lit(None).cast("string"), "categories": _no_strings(),
        "tags": _no_strings(), "photos": _no_strings(), "osm_tags": _no_map(),
        "metadata": _no_map(), **columns}
    return [
        (F.lit(rank * 1_000_000_000_000) + key).alias("ord"),
        filled["id"].alias("id"), filled["source"].alias("source"),
        F.array(filled["source"]).alias("sources"), filled["name"].alias("name"),
        filled["description"].alias("description"), filled["categories"].alias("categories"),
        lat_of(key, step).alias("lat"), lng_of(key).alias("lng"),
        filled["confidence"].alias("confidence"),
        _no_map("map<string,double>").alias("category_confidence"),
        filled["tags"].alias("tags"), filled["photos"].alias("photos"),
        filled["osm_tags"].alias("osm_tags"), filled["metadata"].alias("metadata")]


def places_osm(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    categories = F.when(size % 5 == 0, _no_strings()).otherwise(F.array(category_of(size)))
    return read(spark, sf_dir, "part").select(*_place(
        0, key, 0, id=F.concat(F.lit("osm_node_"), key), source=F.lit("osm"),
        name=F.col("p_name"), categories=categories, tags=F.array("p_type", "p_brand"),
        confidence=F.when(F.size(categories) > 0, 0.7).otherwise(0.4),
        metadata=F.create_map(F.lit("osm_type"), F.lit("node"))))


def places_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(*_place(
        1, key, 3, id=F.concat(F.lit("atlas_"), key), source=F.lit("atlas"),
        name=F.col("s_name"),
        description=F.concat(F.lit("Old "), category_of(F.col("s_nationkey") * 7),
                             F.lit(" near "), F.col("s_name")),
        tags=F.array(F.lit("curated")), confidence=F.lit(0.85),
        photos=F.array(F.concat(F.lit("https://img.example/"), key, F.lit(".jpg"))),
        metadata=F.create_map(F.lit("atlas_url"), F.concat(F.lit("https://a.example/"), key))))


def places_wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(*_place(
        2, key, 6, id=F.concat(F.lit("wiki_Q"), key), source=F.lit("wiki"),
        name=F.concat("c_name", F.lit(" "), "c_mktsegment"),
        categories=F.array(F.lit("landmark")), confidence=F.lit(0.7),
        metadata=F.create_map(F.lit("wikidata_id"), F.concat(F.lit("Q"), key))))


def places_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(*_place(
        3, key, 9, id=F.concat(F.lit("dr_"), key), source=F.lit("deep_research"),
        name=F.concat(F.lit("Spot "), "source"),
        description=F.concat(F.lit("A "), category_of(F.col("n_chars")), F.lit(" spot")),
        tags=F.array(F.lit("deep_research:x")), confidence=F.lit(0.75),
        metadata=F.create_map(F.lit("research_provider"), F.lit("x"))))


SOURCE_LOADERS = {"osm": places_osm, "atlas": places_atlas, "wiki": places_wiki,
                  "deep_research": places_research}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        key.alias("request_id"), lat_of(key).alias("lat"), lng_of(key).alias("lng"),
        F.lit(5.0).alias("radius_km"),
        F.array(category_of(F.col("s_nationkey"))).alias("categories"))


def _event_place() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("k")
    week = F.date_format(F.date_trunc("week", "ts"), "yyyyMMdd")
    status = (F.when(F.col("event_type") == "error", "skip")
              .when(F.col("event_type") == "signup", "want_to_visit").otherwise("visited"))
    return read(spark, sf_dir, "events").withColumn("k", _event_place()).select(
        F.col("event_id").alias("id"), "user_id",
        F.concat(F.lit("osm_node_"), place).alias("place_id"),
        F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("Place "), place))
        .alias("place_name"),
        status.alias("status"), lat_of(place).alias("lat"), lng_of(place).alias("lng"),
        F.col("ts").alias("visited_at"), F.col("value").alias("duration_minutes"),
        F.concat(F.lit("trip_"), F.col("user_id"), F.lit("_"), week).alias("trip_id"),
        F.col("event_id").alias("ord"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")

    def digit(power: int) -> Column:
        return (F.floor(key / power) % 6).cast("int")

    return read(spark, sf_dir, "events").where("event_type = 'view'").select(
        key.alias("id"), key.alias("visit_id"), "user_id",
        F.concat(F.lit("osm_node_"), _event_place()).alias("place_id"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("Note <"), key, F.lit(">")))
        .alias("text"),
        F.struct(digit(1).alias("atmosphere"), digit(6).alias("accessibility"),
                 digit(36).alias("photogenic"), digit(216).alias("uniqueness")).alias("rating"),
        F.array(category_of(key), category_of(F.floor(key / 21))).alias("tags"),
        F.when(key % 3 == 0, F.array(F.concat(F.lit("https://img.example/n"), key)))
        .otherwise(_no_strings()).alias("photos"),
        F.col("ts").alias("created_at"), key.alias("ord"))


def gps_points(spark: SparkSession, sf_dir: str, source=read) -> DataFrame:
    return source(spark, sf_dir, "events").withColumn("k", _event_place()).select(
        "user_id", lat_of(F.col("k")).alias("lat"), lng_of(F.col("k")).alias("lng"), "ts",
        F.lit(50.0).alias("radius_m"), F.col("event_id").alias("visit_id"),
        F.col("event_id").alias("ord"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per user and week, with its first and last visit."""
    seen = visits(spark, sf_dir).groupBy("trip_id", "user_id").agg(
        F.min("visited_at").alias("start_date"), F.max("visited_at").alias("end_date"))
    return seen.select("trip_id", "user_id",
                       F.concat(F.lit("Week & "), "trip_id").alias("name"),
                       F.concat(F.lit("Region "), (F.col("user_id") % 7)).alias("region"),
                       "start_date", "end_date")


def moderation_events(spark: SparkSession, sf_dir: str, source=read) -> DataFrame:
    return source(spark, sf_dir, "events").where("event_type IN ('click', 'error')").select(
        _event_place().alias("place_id"), "user_id",
        (F.col("event_type") == "click").alias("confirm"), "ts", F.col("event_id").alias("ord"))


def community_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One submission per part; its author is the user of the same number."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        key.alias("place_id"), key.alias("submitted_by"), F.col("p_name").alias("name"),
        lat_of(key).alias("lat"), lng_of(key).alias("lng"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission log: every event proposes its place under the name of its type."""
    return read(spark, sf_dir, "events").withColumn("k", _event_place()).select(
        F.col("event_id").alias("id"), "user_id",
        F.concat(F.lit("Place "), F.col("k") % 10, F.lit(" "), "event_type").alias("name"),
        lat_of(F.col("k")).alias("lat"), lng_of(F.col("k")).alias("lng"),
        F.col("ts").alias("created_at"), F.col("event_id").alias("ord"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        (F.col("conv_id") % 100).alias("place_id"), F.col("conv_id").alias("author_id"),
        F.when(F.col("role") == "user", "review").otherwise("tip").alias("review_type"), "text",
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Month "), F.col("conv_id") % 12))
        .alias("visit_date"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("created_ord"))


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (F.when(F.col("event_type") == "purchase", "up")
            .when(F.col("event_type") == "error", "down").otherwise("report"))
    return read(spark, sf_dir, "events").where(
        "event_type IN ('purchase', 'error', 'signup')").select(
        (F.col("event_id") % 500).alias("review_id"), "user_id", kind.alias("kind"), "ts",
        F.col("event_id").alias("ord"))


def route_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 200).alias("route_id"), F.col("o_custkey").alias("user_id"),
        (F.lit(1) + F.col("o_orderkey") % 5).alias("score"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("ord"))


def published_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        key.alias("route_id"), F.col("s_nationkey").cast("bigint").alias("author_id"),
        F.col("s_name").alias("title"),
        F.concat(F.lit("Coast "), F.col("s_nationkey")).alias("region"), key.alias("ord"))


def follow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a follow log: status F follows, O answers the request, P unfollows."""
    action = (F.when(F.col("o_orderstatus") == "F", "follow")
              .when(F.col("o_orderstatus") == "O", "consent").otherwise("unfollow"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("follower_id"),
        (F.col("o_custkey") * 7 % 97).alias("following_id"), action.alias("action"),
        (F.col("o_totalprice") > 100000).alias("consent"), F.col("o_orderkey").alias("ord"))


def api_calls(spark: SparkSession, sf_dir: str, source=read) -> DataFrame:
    return source(spark, sf_dir, "events").select(
        F.col("user_id").alias("client"), F.col("event_type").alias("grp"), "ts",
        F.col("event_id").alias("ord"))
