"""Named place sources. A source is a function from payload rows to standard place rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.sources import atlas, osm, research, wikidata
from cairn.sources.stores import read_payloads

Source = Callable[[DataFrame], DataFrame]

SOURCES: dict[str, Source] = {
    "osm": osm.places, "atlas": atlas.places, "wiki": wikidata.places,
    "deep_research": research.places}


def register(name: str, source: Source) -> None:
    """Add a source; it takes part in every later ``load_all``."""
    SOURCES[name] = source


def loader(name: str, path: str, provider: str = "import") -> Callable[[SparkSession], DataFrame]:
    """A loader of one source's payload files, for ``plans.discovery.gather_sources``."""
    from pyspark.sql import functions as F

    def load(spark: SparkSession) -> DataFrame:
        payloads = read_payloads(spark, path)
        if name == "deep_research":
            payloads = payloads.withColumn("provider", F.lit(provider))
        return SOURCES[name](payloads)
    return load


def with_global_order(places: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Make ``ord`` comparable across sources: sources in the given order, then position."""
    from pyspark.sql import functions as F
    ranks = F.create_map(*[x for i, s in enumerate(order or list(SOURCES))
                           for x in (F.lit(s), F.lit(i))])
    return places.withColumn("ord", F.coalesce(ranks[F.col("source")], F.lit(99)).cast("bigint")
                             * F.lit(2 ** 56) + F.col("ord"))
