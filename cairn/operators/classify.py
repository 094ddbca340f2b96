"""Rule-based categories for places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions import text
from cairn.functions.columns import let, strings


def classify_places(places: DataFrame) -> DataFrame:
    """Add categories and their confidence from keywords; adds ``needs_review``.

    Rows that have categories and confidences stay as they are. Keywords match anywhere in the
    text. Rows that end up with nothing become landmarks of low confidence to be reviewed.
    """
    rules = F.array(*[F.struct(strings(k).alias("keywords"), strings(c).alias("categories"))
                      for k, c in fv.KEYWORD_RULES])

    def vote(blob: Column) -> Column:
        scored = F.transform(rules, lambda r: F.struct(r["categories"].alias("categories"), F.size(
            F.filter(r["keywords"], lambda k: F.contains(blob, k))).alias("hits")))
        return F.flatten(F.transform(F.filter(scored, lambda s: s["hits"] > 0), lambda s: (
            F.transform(s["categories"], lambda c: F.struct(c.alias("category"), F.least(
                F.lit(0.5) + s["hits"] * F.lit(0.15), F.lit(1.0)).alias("score"))))))

    def tally(votes: Column) -> Column:
        """Best score per category as ``array<struct<category, score>>``."""
        return let(F.array_distinct(F.transform(votes, lambda v: v["category"])), lambda names: (
            F.transform(names, lambda c: F.struct(c.alias("category"), F.array_max(F.transform(
                F.filter(votes, lambda v: v["category"] == c), lambda v: v["score"]))
                .alias("score")))))

    settled = (F.size("categories") > 0) & (F.size("category_confidence") > 0)
    nothing = F.array().cast("array<struct<category:string,score:double>>")
    frame = places.withColumn("_found", F.when(settled, nothing).otherwise(
        let(let(text.searchable(), vote), tally)))
    known = F.array_sort(F.array_union("categories", F.col("_found.category")))
    empty = ~settled & (F.size("categories") == 0) & (F.size("_found") == 0)
    return frame.select(
        *[c for c in places.columns if c not in ("categories", "category_confidence")],
        F.when(settled, F.col("categories")).when(empty, strings(["landmark"]))
        .otherwise(known).alias("categories"),
        F.when(settled, F.col("category_confidence")).when(empty, F.create_map(
            F.lit("landmark"), F.lit(fv.DEFAULT_CATEGORY_CONFIDENCE))).otherwise(F.map_zip_with(
                "category_confidence", F.map_from_entries("_found"),
                lambda k, a, b: F.greatest(a, b))).alias("category_confidence"),
        empty.alias("needs_review"))
