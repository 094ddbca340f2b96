"""Predicates on places, ids and rows, and splits into good and rejected rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions import text
from cairn.functions.columns import as_col, strings


def is_unusual(categories="categories") -> Column:
    return F.arrays_overlap(as_col(categories), strings(fv.UNUSUAL_CATEGORIES))


def presets() -> dict[str, list[str]]:
    """Filter preset -> categories."""
    groups = {name: [c for c, own in fv.CATEGORY_GROUPS.items() if own == group]
              for name, group in fv.GROUP_PRESETS.items()}
    return {"all": list(fv.CATEGORY_GROUPS), **groups, **fv.NAMED_PRESETS}


def preset_members(places: DataFrame) -> DataFrame:
    """One row per place and preset that accepts it; the seven presets stay inside the row."""
    table = F.array(*[F.struct(F.lit(name).alias("preset"), strings(cats).alias("wanted"))
                      for name, cats in presets().items()])
    accepted = F.filter(table, lambda p: F.arrays_overlap(F.col("categories"), p["wanted"]))
    return places.withColumn("preset", F.explode(F.transform(accepted, lambda p: p["preset"])))


def split_safe_ids(rows: DataFrame, column: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows with a path-safe id, and the others."""
    safe = F.coalesce(text.is_safe_id(F.col(column)), F.lit(False))
    return rows.where(safe), rows.where(~safe)


def unexpired(rows: DataFrame, ts: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Rows not older than their time to live at ``now``."""
    age = F.unix_micros(now) - F.unix_micros(F.col(ts))
    return rows.where(age <= ttl_seconds * 1_000_000)


# --- row validation -----------------------------------------------------------------------------

# A rule is an SQL predicate under the name of the field it guards.
Rules = Mapping[str, str]


def one_of(column: str, values: list[str]) -> str:
    return f"{column} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


_POSITION = {"lat": "lat BETWEEN -90 AND 90", "lng": "lng BETWEEN -180 AND 180"}
PLACE_RULES: Rules = {
    **_POSITION, "confidence": "confidence BETWEEN 0 AND 1",
    "source": one_of("source", fv.SOURCES),
    "categories": "forall(categories, c -> " + one_of("c", fv.CATEGORIES) + ")"}
REQUEST_RULES: Rules = {
    **_POSITION, "radius_km": "radius_km > 0 AND radius_km <= 50",
    "limit": "`limit` BETWEEN 1 AND 200",
    "sort_by": one_of("sort_by", ["confidence", "distance", "name"])}
ROUTE_REQUEST_RULES: Rules = {
    "max_duration_hours": "max_duration_hours > 0 AND max_duration_hours <= 24",
    "corridor_width_km": "corridor_width_km > 0 AND corridor_width_km <= 10",
    "max_waypoints": "max_waypoints BETWEEN 1 AND 50"}
RATING_RULES: Rules = {"score": "score BETWEEN 1 AND 5"}
SUBMISSION_RULES: Rules = {**_POSITION, "name": "length(name) BETWEEN 1 AND 200"}
REVIEW_RULES: Rules = {"text": "length(text) BETWEEN 1 AND 5000"}
FOG_RULES: Rules = {**_POSITION, "radius_m": "radius_m > 0 AND radius_m <= 500"}
PROXIMITY_RULES: Rules = {"radius_m": "radius_m > 0 AND radius_m <= 500"}


def validate(rows: DataFrame, rules: Rules) -> DataFrame:
    """Adds ``errors``: the names of the rules a row breaks (an unknown value breaks its rule)."""
    broken = [F.when(~F.coalesce(F.expr(test), F.lit(False)), F.lit(name))
              for name, test in rules.items()]
    return rows.withColumn("errors", F.filter(F.array(*broken), lambda e: e.isNotNull()))


def split_valid(rows: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with their ``errors``."""
    checked = validate(rows, rules)
    return (checked.where(F.size("errors") == 0).drop("errors"),
            checked.where(F.size("errors") > 0))


def guard_actor(events: DataFrame, owners: DataFrame, key: str, actor: str,
                owner: str) -> tuple[DataFrame, DataFrame]:
    """Split an event log by "nobody acts on what they own": (accepted, rejected).

    Events on unknown keys are rejected as well.
    """
    joined = events.join(owners.select(key, F.col(owner).alias("_owner")), key, "left")
    fine = F.coalesce(F.col(actor) != F.col("_owner"), F.lit(False))
    return joined.where(fine).drop("_owner"), joined.where(~fine).drop("_owner")
