"""Prompt tables for an external model batch, and parsing of its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions.columns import as_col, clamp, not_empty, strings
from cairn.operators.filters import is_unusual

LANGUAGE_NAMES = {"ru": "Russian", "en": "English", "auto": "Russian"}


def facts(keys: list[str], nothing: str) -> Column:
    """``key: value`` facts of whitelisted tags and the article link, joined by ``; ``."""
    parts = [F.when(F.try_element_at("osm_tags", F.lit(k)).isNotNull(), F.concat(
        F.lit(f"{k}: "), F.try_element_at("osm_tags", F.lit(k)))) for k in keys]
    link = F.try_element_at("metadata", F.lit("wikipedia_url"))
    parts.append(F.when(link.isNotNull(), F.concat(F.lit("Wikipedia: "), link)))
    return F.coalesce(not_empty(F.concat_ws("; ", *parts)), F.lit(nothing))


def _listed(column: str, empty: str, most: int | None = None) -> Column:
    values = F.col(column) if most is None else F.slice(column, 1, most)
    return F.coalesce(not_empty(F.array_join(values, ", ")), F.lit(empty))


def _prompt(task: str, tags: int, keys: list[str], nothing: str) -> Column:
    return F.concat_ws(
        "\n", F.lit(task), F.concat(F.lit("Name: "), F.coalesce(not_empty("name"),
                                                               F.lit("Unnamed place"))),
        F.concat(F.lit("Categories: "), _listed("categories", "unknown")),
        F.format_string("Location: %.4f, %.4f", "lat", "lng"),
        F.concat(F.lit("Tags: "), _listed("tags", "none", tags)),
        F.concat(F.lit("Known facts: "), facts(keys, nothing)))


def description_prompts(places: DataFrame, language: str) -> DataFrame:
    """(id, key, prompt) for atmospheric descriptions."""
    name = LANGUAGE_NAMES.get(language, language)
    return places.select("id", F.concat(F.lit("desc:"), "id", F.lit(f":{language}")).alias("key"),
                         _prompt(f"Describe this place in {name}.", 20, fv.PROMPT_METADATA_KEYS,
                                 "minimal data available").alias("prompt"))


def story_prompts(places: DataFrame, language: str) -> DataFrame:
    """(id, key, prompt) for stories."""
    name = LANGUAGE_NAMES.get(language, language)
    return places.select("id", F.concat(F.lit("story:"), "id", F.lit(f":{language}")).alias("key"),
                         _prompt(f"Tell the story of this place in {name}.", 15,
                                 fv.STORY_METADATA_KEYS, "minimal data").alias("prompt"))


def classification_prompts(places: DataFrame) -> DataFrame:
    """(id, prompt) for the places that the keyword rules could not settle."""
    pairs = F.transform(F.slice(F.map_entries("osm_tags"), 1, 10),
                        lambda e: F.concat_ws("=", e["key"], e["value"]))
    return places.where("needs_review").select("id", F.concat_ws(
        "\n", F.lit("Choose categories for this place and answer as JSON."),
        F.concat(F.lit("Categories: "), F.lit(", ".join(fv.CATEGORIES))),
        F.concat(F.lit("Name: "), F.coalesce(not_empty("name"), F.lit("Unknown"))),
        F.concat(F.lit("Tags: "), _listed("tags", "none", 15)),
        F.concat(F.lit("Known facts: "), F.coalesce(not_empty(F.array_join(pairs, ", ")),
                                                   F.lit("minimal"))),
        F.format_string("Location: %.4f, %.4f", "lat", "lng")).alias("prompt"))


def ranking_prompts(candidates: DataFrame, most: int = 30) -> DataFrame:
    """One prompt per request with its first ``most`` candidates as a JSON list."""
    order = Window.partitionBy("request_id").orderBy("position")
    top = candidates.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    listed = F.struct(
        (F.col("nth") - 1).alias("index"),
        F.coalesce(not_empty("name"), F.lit("Unnamed")).alias("name"), "categories", "confidence",
        "distance_m", is_unusual().alias("is_unusual"))
    return top.groupBy("request_id").agg(F.array_sort(F.collect_list(listed)).alias("places")) \
        .select("request_id", F.concat(
            F.lit("Rank these places for the user and answer as JSON.\n"),
            F.to_json("places")).alias("prompt"))


def route_story_prompts(stops: DataFrame, language: str) -> DataFrame:
    """One prompt per route from its ordered stops (at most 50 by the limits of a route)."""
    name = LANGUAGE_NAMES.get(language, language)
    line = F.concat(F.format_string("Stop %d: ", "position"), F.coalesce(
        not_empty("name"), F.lit("Unnamed")), F.lit(" ["), F.array_join("categories", ", "),
        F.lit("]"), F.format_string("\n  Location: %.4f, %.4f", "lat", "lng"))
    return stops.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct(
        "position", line.alias("line")))).alias("lines")).select("route_id", F.concat(
            F.lit(f"Connect these stops into one journey, in {name}.\n\n"),
            F.array_join(F.transform("lines", lambda s: s["line"]), "\n\n")).alias("prompt"))


# --- answers ------------------------------------------------------------------------------------


def _trim(value: Column) -> Column:
    return F.trim(value, F.lit(fv.WHITE_SPACE))


def strip_fence(answer) -> Column:
    """The inside of a fenced code block, or the trimmed answer itself."""
    plain = _trim(as_col(answer))
    return F.when(F.startswith(plain, F.lit("```")), _trim(F.regexp_replace(
        F.regexp_replace(plain, r"^```[^\n]*\n", ""), r"(?s)```[^`]*$", ""))).otherwise(plain)


def parse_classification(answer) -> Column:
    """``struct<categories, confidence>``: known categories only, confidence within 0.3 and 1.

    Null when nothing usable was answered.
    """
    data = F.from_json(strip_fence(answer), "categories array<string>, confidence double")
    known = F.array_sort(F.filter(data["categories"], lambda c: c.isin(fv.CATEGORIES)))
    return F.when(F.size(known) > 0, F.struct(
        known.alias("categories"),
        clamp(F.coalesce(data["confidence"], F.lit(0.6)), 0.3, 1.0).alias("confidence")))


def apply_classification(places: DataFrame, answers: DataFrame) -> DataFrame:
    """Replace the stop-gap categories of reviewed places by a model's (id, answer)."""
    parsed = answers.select("id", parse_classification("answer").alias("_p"))
    joined = places.join(parsed, "id", "left")
    given = F.col("_p").isNotNull() & F.col("needs_review")
    return joined.withColumns({
        "categories": F.when(given, F.col("_p.categories")).otherwise(F.col("categories")),
        "category_confidence": F.when(given, F.map_from_arrays("_p.categories", F.transform(
            "_p.categories", lambda c: F.col("_p.confidence")))).otherwise(
            F.col("category_confidence")),
        "needs_review": F.col("needs_review") & ~given}).drop("_p")


def parse_intent(answer, message) -> Column:
    """A model's intent with known categories; the keyword rules when it is unreadable."""
    from cairn.functions import text
    data = F.from_json(strip_fence(answer), "categories array<string>, mood array<string>")
    known = F.filter(data["categories"], lambda c: c.isin(fv.CATEGORIES))
    return F.when(data["categories"].isNotNull(), F.struct(
        F.array_sort(F.array_distinct(known)).alias("categories"),
        F.coalesce(data["mood"], strings([])).alias("mood"))).otherwise(text.intent(message))


def parse_description(answer) -> Column:
    """``struct<description, practical>``; without both markers all of it is the description."""
    plain = _trim(as_col(answer))
    first, second = F.instr(plain, "DESCRIPTION:"), F.instr(plain, "PRACTICAL:")
    both = (first > 0) & (second > 0)
    start = first + len("DESCRIPTION:")
    return F.struct(
        F.when(both, _trim(F.substring(plain, start, F.greatest(F.lit(0), second - start))))
        .otherwise(plain).alias("description"),
        F.when(both, _trim(F.substring(plain, second + len("PRACTICAL:"), F.length(plain))))
        .alias("practical"))


def apply_ranking(candidates: DataFrame, answers: DataFrame, most: int = 30) -> DataFrame:
    """A model's ranking (request_id, answer) resolved to candidates; bad indexes are dropped."""
    order = Window.partitionBy("request_id").orderBy("position")
    top = candidates.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    ranked = answers.select("request_id", F.posexplode(F.from_json(
        strip_fence("answer"),
        "array<struct<place_index: int, reason: string, relevance_score: double>>"))
        .alias("rank", "r"))
    picked = ranked.select(
        "request_id", "rank", (F.coalesce("r.place_index", F.lit(0)) + 1).alias("nth"),
        F.coalesce("r.reason", F.lit("Recommended for you")).alias("reason"),
        clamp(F.coalesce("r.relevance_score", F.lit(0.5)), 0.0, 1.0).alias("relevance_score"))
    return picked.join(top, ["request_id", "nth"])
