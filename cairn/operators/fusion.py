"""Merging places from several sources: clusters, merged rows, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions import geo, text
from cairn.functions.columns import as_col, clamp, not_empty, round_to
from cairn.operators import spatial
from cairn.session import cut


def richness(name="name", description="description", photos="photos", categories="categories"):
    """How much a row knows: 2 for a name, 2 for a description, 1 per photo, 1 if categorised."""
    return (F.when(not_empty(name).isNotNull(), 2).otherwise(0)
            + F.when(not_empty(description).isNotNull(), 2).otherwise(0)
            + F.greatest(F.size(photos), F.lit(0))
            + F.when(F.size(categories) > 0, 1).otherwise(0))


def confidence(source_count, photos, description, tags, category_confidence) -> Column:
    """Weighted score of sources, photos, description, freshness, tags and category certainty."""
    weights = fv.CONFIDENCE_WEIGHTS
    best = F.when(F.size(category_confidence) > 0, F.array_max(F.map_values(category_confidence)))
    score = (
        F.lit(weights["sources"]) * F.least(as_col(source_count) / F.lit(3.0), F.lit(1.0))
        + F.lit(weights["photos"]) * F.when(F.size(photos) > 0, 1.0).otherwise(0.0)
        + F.lit(weights["description"])
        * F.when(not_empty(description).isNotNull(), 1.0).otherwise(0.0)
        + F.lit(weights["freshness"]) * F.lit(fv.FRESHNESS)
        + F.lit(weights["tags"]) * F.least(F.greatest(F.size(tags), F.lit(0)) / F.lit(5.0),
                                           F.lit(1.0))
        + F.lit(weights["category"]) * F.coalesce(best, F.lit(fv.DEFAULT_CATEGORY_CONFIDENCE)))
    return round_to(clamp(score, 0.0, 1.0), 3)


def with_confidence(places: DataFrame) -> DataFrame:
    """Score again from the current columns; a row without sources counts as one source."""
    return places.withColumn("confidence", confidence(
        F.greatest(F.size("sources"), F.lit(1)), "photos", "description", "tags",
        "category_confidence"))


def _longer(base: Column, other: Column) -> Column:
    return F.when(F.length(other) > F.coalesce(F.length(base), F.lit(0)), other).otherwise(base)


def _longest(column: str) -> Column:
    """Longest non-empty text of a group, first of equals."""
    return F.max_by(column, F.when(F.length(column) > 0,
                                   F.struct(F.length(column), -F.col("ord"))))


def merge_clusters(members: DataFrame) -> DataFrame:
    """One row per ``leader``: the richest row, enriched with what its cluster knows.

    Collections are merged in long form, one (leader, kind, value) per row, so that repeated values
    of a huge cluster are folded before the shuffle and only distinct values are ever collected.
    Single rows skip that path and keep their arrays as they are.
    """
    fields = ["id", "source", "sources", "name", "description", "categories", "lat", "lng",
              "category_confidence", "tags", "photos", "osm_tags", "metadata"]
    base = members.groupBy("leader").agg(
        F.count(F.lit(1)).alias("members"),
        F.max_by(F.struct(*fields), F.struct(richness(), -F.col("ord"))).alias("base"),
        _longest("name").alias("best_name"), _longest("description").alias("best_description"))

    crowded = members.where("ord <> leader").select("leader").distinct()

    def entries(kind: str, values: Column) -> Column:
        return F.transform(values, lambda value, at: F.struct(
            F.lit(kind).alias("kind"), value.alias("value"), at.alias("at"),
            F.lit(None).cast("string").alias("payload")))

    meta = F.transform(F.map_entries(F.coalesce("metadata", F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<string>")))),
        lambda e: F.struct(F.lit("meta").alias("kind"), e["key"].alias("value"),
                           F.lit(0).alias("at"), e["value"].alias("payload")))
    long_form = members.join(crowded, "leader", "left_semi").select(
        "leader", "ord", F.explode(F.concat(
            entries("source", F.array_union(F.array("source"), "sources")),
            entries("category", F.col("categories")), entries("tag", F.col("tags")),
            entries("photo", F.col("photos")), meta)).alias("e")).select("leader", "ord", "e.*")
    values = long_form.groupBy("leader", "kind", "value").agg(
        F.min(F.struct("ord", "at")).alias("first"),
        F.max_by("payload", F.struct("ord", "at")).alias("payload"))

    def texts(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))

    sets = values.groupBy("leader").agg(
        texts("source").alias("sources"), texts("category").alias("categories"),
        texts("tag").alias("tags"),
        F.transform(F.array_sort(F.collect_list(F.when(
            F.col("kind") == "photo", F.struct("first", "value")))),
            lambda p: p["value"]).alias("photos"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(
            F.col("kind") == "meta", F.struct("value", "payload"))))).alias("metadata"))

    joined = base.join(sets, "leader", "left")
    single = F.col("members") == 1

    def pick(column: str) -> Column:
        return F.when(single, F.col(f"base.{column}")).otherwise(F.col(column)).alias(column)

    merged = joined.select(
        F.col("leader").alias("ord"), "members", "base.id", "base.source", pick("sources"),
        _longer(F.col("base.name"), F.col("best_name")).alias("name"),
        _longer(F.col("base.description"), F.col("best_description")).alias("description"),
        pick("categories"), "base.lat", "base.lng", "base.category_confidence", pick("tags"),
        pick("photos"), "base.osm_tags", pick("metadata"))
    return merged.withColumn("confidence", confidence(
        F.when(single, F.lit(1)).otherwise(F.size("sources")), "photos", "description", "tags",
        "category_confidence"))


def fuse_places(places: DataFrame, threshold_m: float | None = None) -> DataFrame:
    """Cluster by distance and merge. ``places`` needs ``ord``; the result keeps the leader's."""
    threshold = fv.DEDUP_DISTANCE_M if threshold_m is None else threshold_m
    return merge_clusters(spatial.leader_clusters(places, threshold))


def fuse_observed(places: DataFrame, sources: list[str], threshold_m: float | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """``(merged places, metrics)``: rows per source and merged rows as (metric, value).

    Counted while the rows are written, by observers on the way, so no table is read again for it.
    ``sources`` names what is counted; rows of other sources are summed under ``source_other``.
    """
    seen, merged = Observation("sources"), Observation("merged")
    counts = [F.count_if(F.col("source") == name).alias(f"source_{name}") for name in sources]
    other = F.count_if(~F.coalesce(F.col("source").isin(sources), F.lit(False))).alias("source_other")
    read = cut(places.observe(seen, *counts, other))
    written = cut(fuse_places(read, threshold_m).observe(merged, F.count(F.lit(1)).alias("merged")))
    found = {name: n for name, n in (seen.get | merged.get).items() if n}
    return written, places.sparkSession.createDataFrame(
        list(found.items()), "metric string, value bigint")


# --- research results: distance and name --------------------------------------------------------


def _neighbour_pairs(items: DataFrame, threshold_m: float, min_similarity: float) -> DataFrame:
    """(ord, near): near rows of smaller ``ord`` whose names share enough words.

    Joined on (cell, shared word), not on cells alone: rows without a common word never meet.
    """
    size = spatial.cell_degrees_for(threshold_m)
    words = items.withColumn("word", F.explode("words"))
    right = words.withColumn("_cell", geo.join_cell("lat", "lng", size))
    left = spatial.expand_reach(words.select(
        F.col("ord").alias("near"), F.col("lat").alias("n_lat"), F.col("lng").alias("n_lng"),
        F.col("words").alias("n_words"), "word"), "n_lat", "n_lng", F.lit(threshold_m), size)
    common = F.array_intersect("words", "n_words")
    # several common words give several hits: keep the one on the first common word
    return right.join(left, ["_cell", "word"]).where(
        (F.col("near") < F.col("ord")) & (F.col("word") == F.array_min(common))
        & (geo.haversine_m("lat", "lng", "n_lat", "n_lng") < threshold_m)
        & (F.size(common) / F.least(F.size("words"), F.size("n_words")) > min_similarity)
    ).select("ord", "near")


def named_leader_clusters(items: DataFrame,
                          threshold_m: float = fv.RESEARCH_DEDUP_DISTANCE_M,
                          min_similarity: float = fv.RESEARCH_NAME_SIMILARITY) -> DataFrame:
    """Greedy leader clustering where neighbours are near *and* similarly named: adds ``leader``.

    Copies (same position and same words) are folded first; they always share a leader.
    """
    worded = items.select("ord", "lat", "lng", F.array_sort(text.words("name")).alias("words"))
    named = worded.where(F.size("words") > 0)
    folded = named.groupBy("lat", "lng", "words").agg(F.min("ord").alias("ord"))
    pairs = cut(_neighbour_pairs(folded, threshold_m, min_similarity))
    undecided, leaders = cut(folded.select("ord")), None
    open_pairs = pairs
    while True:
        elected = cut(undecided.join(open_pairs.select("ord").distinct(), "ord", "left_anti"))
        decided = open_pairs.join(elected.withColumnRenamed("ord", "near"), "near", "left_semi") \
            .select("ord").unionByName(elected).distinct()
        undecided = cut(undecided.join(decided, "ord", "left_anti"))
        leaders = elected if leaders is None else leaders.unionByName(elected)
        if undecided.isEmpty():
            break
        still = undecided.withColumnRenamed("ord", "near")
        open_pairs = cut(open_pairs.join(undecided, "ord", "left_semi")
                         .join(still, "near", "left_semi"))
    owners = pairs.join(leaders.withColumnRenamed("ord", "near"), "near", "left_semi") \
        .join(leaders, "ord", "left_anti").groupBy("ord").agg(F.min("near").alias("leader")) \
        .unionByName(leaders.withColumn("leader", F.col("ord")))
    site_owner = folded.join(owners, "ord").select("lat", "lng", "words", "leader")
    assigned = worded.join(site_owner, ["lat", "lng", "words"], "left")
    return assigned.select("ord", F.coalesce("leader", "ord").alias("leader"))


def dedupe_research(items: DataFrame, **limits) -> DataFrame:
    """Per cluster the row with the longest description, its metadata updated by the leader's."""
    owners = named_leader_clusters(items, **limits)
    fields = [c for c in items.columns if c != "ord"]
    picked = items.join(owners, "ord").groupBy("leader").agg(
        F.max_by(F.struct("ord", *fields), F.struct(
            F.coalesce(F.length("description"), F.lit(0)), -F.col("ord"))).alias("best"),
        F.max_by("metadata", F.col("ord") == F.col("leader")).alias("leader_metadata"))
    kept = picked.select(F.col("leader").alias("ord"), F.col("best.ord").alias("best_ord"),
                         "leader_metadata", *[F.col(f"best.{c}").alias(c) for c in fields])
    updated = F.when(F.col("best_ord") == F.col("ord"), F.col("metadata")).otherwise(
        F.map_concat("metadata", "leader_metadata"))
    return kept.withColumn("metadata", updated).drop("best_ord", "leader_metadata")
