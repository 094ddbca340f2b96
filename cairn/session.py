"""Session settings the operators rely on, and lineage cuts for iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on (UTC, last-wins maps) and keep AQE on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own to ``configure``."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("cairn")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_scratch: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, which all executors must share.

    Only a local master may do without; it gets a scratch folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _scratch:
        _scratch[application] = tempfile.mkdtemp(prefix="cairn-")
    return _scratch[application]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and continue from there.

    Survives lost executors like a reliable checkpoint. The table also has a known size and can be
    read by column, so later joins and scans are planned on facts.
    """
    path = f"{shared_folder(df.sparkSession)}/cairn/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
