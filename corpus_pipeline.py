"""The corpus pipeline: documents to packed training sequences, each stage one of the operators.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the
next stage's input. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import mixing, packing, quality, secrets, shingles
from cairn.session import configure, cut

#: Poor and toxic text gets no share; the budget keeps clean text as it is.
WEIGHTS = {"clean": 1.0, "poor": 0.0, "toxic": 0.0}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or that a learned rule rejects go."""
    return quality.accepted(docs, _labels(spark, sf_dir))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by sharing 0.8 of their five-word shingles, the one with the smallest id
    stays: SimHash fingerprints within 2 bits propose pairs, MinHash bands those farther apart.
    Rows that are equal in all columns are one document; a null id comes first."""
    return shingles.one_of_alike(docs, width=5, least=0.8, distance=2)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays, with its new length."""
    _, model = secrets.scan_secrets(docs)
    return secrets.redact(docs, model).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as their fitted rates say: at most once, as duplicates are gone by now."""
    labelled = mixing.quality_domains(_labels(spark, sf_dir))
    return mixing.resample(docs, labelled, WEIGHTS, budget="clean", bound=1.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("secret scan", secret_scan),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Learned rules, fingerprints and fitted rates have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
