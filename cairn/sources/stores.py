"""Stored JSON: record stores, one-file-per-record folders, saved routes, GeoJSON areas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.ordered import running_totals
from cairn.schemas import GEOJSON_PAYLOAD, ROUTE_FILE
from cairn.session import cut


def _read_tasks(spark: SparkSession) -> int:
    """Tasks for a folder of small files, of which Spark puts only about 32 into a task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Files as (payload_id, payload), one row per file; ids count the files in name order.

    Only names are numbered, by running totals over ranges of them, so no task sees all. Every file is
    opened once.
    """
    files = cut(spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload")).coalesce(_read_tasks(spark)))
    numbered = running_totals(files.select("file"), [], ["file"], {"payload_id": F.lit(1)})
    return files.join(numbered, "file").select("payload_id", "payload")


def unreadable(payloads: DataFrame) -> DataFrame:
    """Payloads that are no JSON, to be kept aside with the file's number."""
    return payloads.where(F.try_parse_json("payload").isNull())


def records(stores: DataFrame, record: str) -> DataFrame:
    """Texts ``{id: record}`` in column ``payload`` -> one row per record, keyed ``store_key``.

    An unreadable text yields no rows.
    """
    schema = T.MapType(T.StringType(), T.StructType.fromDDL(record))
    return stores.select(F.explode(F.from_json("payload", schema)).alias("store_key", "r")).where(
        "r IS NOT NULL").select("store_key", "r.*")


def read_store(spark: SparkSession, path: str, record: str) -> DataFrame:
    """A record store file; a missing one is an empty table, any other failure is one."""
    try:
        payloads = spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        payloads = spark.createDataFrame([], "payload string")
    return records(payloads, record)


def record_files(spark: SparkSession, folder: str, record: str) -> DataFrame:
    """One JSON file per record, each opened once, as a table: ``file``, ``file_bytes``, the text as
    ``value``, the record ``r`` and whether it is a ``good`` one."""
    key = record.split()[0]
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="[!_.]*").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_bytes"), "value")
    parsed = files.withColumn("r", F.from_json("value", T.StructType.fromDDL(record)))
    marked = parsed.withColumn("good", F.try_parse_json("value").isNotNull() & F.col(f"r.{key}").isNotNull())
    return cut(marked.coalesce(_read_tasks(spark)))


def read_records(spark: SparkSession, folder: str, record: str, files: DataFrame | None = None) -> DataFrame:
    """One JSON file per record. Adds the file size in bytes. Files that are no such record are left
    out here and listed by ``rejected_records``. ``files``: what ``record_files`` gave, to read the
    folder once for both."""
    files = record_files(spark, folder, record) if files is None else files
    return files.where("good").select("r.*", "file_bytes")


def rejected_records(spark: SparkSession, folder: str, record: str, files: DataFrame | None = None) -> DataFrame:
    """(file, value) of the files that hold no readable record."""
    files = record_files(spark, folder, record) if files is None else files
    return files.where("NOT good").select("file", "value")


def route_places(routes: DataFrame) -> DataFrame:
    """Saved route texts in ``payload`` -> the places of their waypoints."""
    parsed = routes.select(F.from_json("payload", ROUTE_FILE).alias("r"))
    return parsed.select(F.col("r.id").alias("route_id"), F.posexplode("r.waypoints")
                         .alias("position", "w")).where("w.place IS NOT NULL").select(
        "route_id", "position", "w.place.id", "w.place.name", "w.place.coordinates.lat",
        "w.place.coordinates.lng")


def area_points(areas: DataFrame) -> DataFrame:
    """GeoJSON texts in ``payload`` -> ring points of every polygon."""
    features = areas.select(F.explode(F.from_json("payload", GEOJSON_PAYLOAD)["features"])
                            .alias("f"))
    rings = features.select(F.col("f.properties")["name"].alias("name"), F.posexplode(
        "f.geometry.coordinates").alias("ring", "points"))
    return rings.select("name", "ring", F.posexplode("points").alias("point", "p")).select(
        "name", "ring", "point", F.col("p")[1].alias("lat"), F.col("p")[0].alias("lng"))


def area_boxes(areas: DataFrame) -> DataFrame:
    """Bounding box per named area."""
    return area_points(areas).groupBy("name").agg(
        F.min("lat").alias("min_lat"), F.min("lng").alias("min_lng"),
        F.max("lat").alias("max_lat"), F.max("lng").alias("max_lng"))
