"""Recommendations for a batch of requests by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions.columns import clamp, round_to, strings
from cairn.operators.filters import is_unusual
from cairn.plans import discovery
from cairn.session import cut

MAX_CANDIDATES = 200


def strategy(favorites="favorites", liked="liked", disliked="disliked") -> Column:
    """personalized with favourites, diverse with history only, else cold_start."""
    return (F.when(F.size(favorites) > 0, "personalized")
            .when((F.size(liked) > 0) | (F.size(disliked) > 0), "diverse")
            .otherwise("cold_start"))


def crowding(candidates: DataFrame) -> DataFrame:
    """Per candidate how many of its categories had already come twice before it."""
    seen = Window.partitionBy("request_id", "category").orderBy("position")
    nth = candidates.select("request_id", "position", F.explode("categories").alias("category")) \
        .withColumn("nth", F.row_number().over(seen))
    return nth.where("nth > 2").groupBy("request_id", "position").agg(
        F.count(F.lit(1)).alias("crowded"))


def score_candidates(candidates: DataFrame) -> DataFrame:
    """Relevance and reasons of candidates that carry favorites and time_of_day."""
    joined = candidates.join(crowding(candidates), ["request_id", "position"], "left")
    shared = F.array_intersect("categories", "favorites")
    moment = F.lit(False)
    for name, categories in fv.TIME_OF_DAY_CATEGORIES.items():
        moment = moment | ((F.col("time_of_day") == name)
                           & F.arrays_overlap("categories", strings(categories)))
    moment = F.coalesce(moment, F.lit(False))
    score = (F.col("confidence") + F.size(shared) * F.lit(0.2)
             + F.when(is_unusual(), 0.1).otherwise(0.0) + F.when(moment, 0.1).otherwise(0.0)
             - F.coalesce("crowded", F.lit(0)) * F.lit(0.15)
             - F.when(F.col("distance_m") > 5000, 0.05).otherwise(0.0))
    reasons = F.concat_ws(
        "; ", F.when(F.size(shared) > 0, F.concat(F.lit("matches your interest in "),
                                                  F.array_join(shared, ", "))),
        F.when(is_unusual(), F.lit("unusual find")),
        F.when(moment, F.concat(F.lit("great for "), "time_of_day")))
    return joined.withColumns({
        "relevance_score": round_to(clamp(score, 0.0, 1.0), 2),
        "reason": F.when(reasons == "", "interesting place nearby").otherwise(reasons)})


def recommend(requests: DataFrame, catalogue: DataFrame, excluded: DataFrame | None = None,
              limit: int = 10, most_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """The ``limit`` best places per request.

    Candidates are the best ``3 * limit`` search results, at most ``most_candidates`` but never fewer
    than ``limit``; both cuts are literal rank bounds.
    ``strategy`` is what applies without a model: favourites narrow the search, ranking is diverse.
    """
    planned = requests.withColumn("intended", strategy())
    search = planned.select(
        "request_id", "lat", "lng", "radius_km", F.when(
            F.col("intended") == "personalized", F.col("favorites")).otherwise(strings([]))
        .alias("categories"))
    found = discovery.page(discovery.matches(search, catalogue, excluded), "confidence",
                           max(limit, min(3 * limit, most_candidates)))
    taste = planned.select("request_id", "favorites", "time_of_day", F.when(
        F.col("intended") == "cold_start", "cold_start").otherwise("diverse").alias("strategy"))
    scored = score_candidates(cut(found.join(taste, "request_id")))
    order = Window.partitionBy("request_id").orderBy(F.col("relevance_score").desc(),
                                                     F.col("position").asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
