"""All registered queries."""

from __future__ import annotations

import functools
import importlib

from pyspark.sql import DataFrame, SparkSession

from cairn.plans.catalog import Query
from cairn.session import configure

MODULES = ["geo_queries", "discovery_queries", "journal_queries", "gamify_queries",
           "community_queries", "source_queries", "text_queries", "route_queries",
           "service_queries", "stream_queries", "record_queries"]


def _catalogs():
    return [importlib.import_module(f"cairn.plans.catalog.{m}").catalog for m in MODULES]


def _configured(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)
    return run


def all_queries() -> dict[str, Query]:
    return {name: _configured(query) for c in _catalogs() for name, query in c.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for c in _catalogs() for name, sql in c.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.plans.catalog.discovery_queries import flagship as query
    return query(configure(spark), sf_dir)
