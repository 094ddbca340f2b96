"""Visits, notes and trips: statistics, streaks, heat maps, summaries, grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions import geo, text
from cairn.functions.columns import as_col, round_to
from cairn.operators.ordered import day_runs, previous_row

VISITED = "status = 'visited'"


def rating_average(rating="rating") -> Column:
    """Mean of the given (non-zero) scores, one decimal; 0 without any."""
    scores = F.filter(F.array(*[F.coalesce(F.col(f"{rating}.{part}"), F.lit(0)) for part in (
        "atmosphere", "accessibility", "photogenic", "uniqueness")]), lambda s: s > 0)
    total = F.aggregate(scores, F.lit(0), lambda acc, s: acc + s)
    return F.when(F.size(scores) == 0, 0.0).otherwise(round_to(total / F.size(scores), 1))


def clean_notes(notes: DataFrame) -> DataFrame:
    """Notes as they are stored: text, transcript, tags and photo URLs cleaned."""
    cleaned = {"text": text.clean_note("text"), "tags": text.clean_tags("tags"),
               "photos": text.clean_urls("photos")}
    if "voice_transcript" in notes.columns:
        cleaned["voice_transcript"] = text.clean_note("voice_transcript")
    return notes.withColumns(cleaned)


def list_visits(visits: DataFrame, status: str | None = None, trip_id: str | None = None,
                limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest visits first, one page."""
    if status is not None:
        visits = visits.where(F.col("status") == status)
    if trip_id is not None:
        visits = visits.where(F.col("trip_id") == trip_id)
    return newest_first(visits, "visited_at", limit, offset)


def newest_first(rows: DataFrame, ts: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of rows, newest first, equal times in stored order."""
    return rows.orderBy(F.col(ts).desc(), F.col("ord").asc()).offset(offset).limit(limit)


def status_counts(visits: DataFrame, key: str = "user_id") -> DataFrame:
    visited = F.col("status") == "visited"
    return visits.groupBy(key).agg(
        F.count_if(visited).alias("total_visited"),
        F.count_if(F.col("status") == "want_to_visit").alias("total_want_to_visit"),
        F.count_if(F.col("status") == "skip").alias("total_skipped"),
        round_to(F.sum(F.when(visited, F.coalesce("duration_minutes", F.lit(0.0)))
                       .otherwise(0.0)) / 60.0, 2).alias("total_hours"))


def tag_counts(notes: DataFrame, key: str = "user_id") -> DataFrame:
    """How often each tag occurs per key, with the first note that used it (for ties)."""
    tags = notes.select(key, "ord", F.posexplode("tags").alias("at", "category"))
    return tags.groupBy(key, "category").agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct("ord", "at")).alias("first"))


def path_km(visits: DataFrame, key: str = "user_id") -> DataFrame:
    """Length of the path through a key's visited places in time order."""
    steps = previous_row(visits.where(VISITED).select(key, "lat", "lng", "visited_at", "ord"),
                         [key], ["visited_at", "ord"], ["lat", "lng"])
    leg = geo.haversine_m("previous.lat", "previous.lng", "lat", "lng") / 1000.0
    return steps.groupBy(key).agg(
        round_to(F.sum(F.coalesce(leg, F.lit(0.0))), 2).alias("total_distance_km"))


def visit_days(visits: DataFrame, key: str = "user_id") -> DataFrame:
    return visits.where(VISITED).select(key, F.to_date("visited_at").alias("day")).distinct()


def streaks(visits: DataFrame, as_of: str, key: str = "user_id") -> DataFrame:
    """Longest and current run of days with a visit; current is 0 if it ended before yesterday."""
    runs = day_runs(visit_days(visits, key), key)
    last = runs.groupBy(key).agg(F.max("run_day").alias("longest_streak"),
                                 F.max_by("run_day", "day").alias("last_run"),
                                 F.max("day").alias("last_day"))
    active = F.col("last_day") >= F.date_sub(F.lit(as_of).cast("date"), 1)
    return last.select(key, F.when(active, F.col("last_run")).otherwise(0)
                       .alias("current_streak"), "longest_streak",
                       F.date_format("last_day", "yyyy-MM-dd").alias("last_visit_date"))


def surprises(visits: DataFrame, notes: DataFrame, key: str = "user_id",
              top: int = 5) -> DataFrame:
    """Per key the places rated furthest from the expected 2.5."""
    rated = notes.withColumn("average", rating_average()).where("average > 0")
    places = rated.groupBy(key, "place_id").agg(F.avg("average").alias("mean"),
                                                F.min("ord").alias("first"))
    off = F.abs(F.col("mean") - 2.5)
    scored = places.where(off > 0.5).select(
        key, "place_id", "first", F.lit(2.5).alias("expected_score"),
        round_to("mean", 1).alias("actual_score"), round_to(off, 1).alias("delta"))
    order = Window.partitionBy(key).orderBy(F.col("delta").desc(), F.col("first").asc())
    best = scored.withColumn("position", F.row_number().over(order)).where(
        F.col("position") <= top)
    names = visits.groupBy(key, "place_id").agg(F.min_by(F.struct("place_name"), "ord")
                                                .alias("seen"))
    return best.join(names, [key, "place_id"], "left").select(
        key, "place_id", F.col("seen.place_name").alias("place_name"), "expected_score",
        "actual_score", "delta", "position")


def heat_map(visits: DataFrame, key: str = "user_id") -> DataFrame:
    """Visits per 0.001 degree cell, relative to the key's busiest cell."""
    cells = visits.where(VISITED).groupBy(
        key, round_to("lat", 3).alias("lat"), round_to("lng", 3).alias("lng")).agg(
        F.count(F.lit(1)).alias("visits"))
    peaks = cells.groupBy(key).agg(F.max("visits").alias("peak"))
    return cells.join(peaks, key).select(
        key, "lat", "lng", round_to(F.col("visits") / F.col("peak"), 2).alias("intensity"))


def exploration_stats(visits: DataFrame, notes: DataFrame, as_of: str,
                      key: str = "user_id") -> DataFrame:
    """One row per key: counts, hours, distance, streaks, and its tags by frequency."""
    tags = tag_counts(notes, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(
        F.struct((-F.col("count")).alias("order"), "first", "category", "count"))),
        lambda t: F.struct(t["category"].alias("category"), t["count"].alias("count")))
        .alias("by_category"))
    return status_counts(visits, key).join(path_km(visits, key), key, "left").join(
        streaks(visits, as_of, key), key, "left").join(tags, key, "left").select(
        key, "total_visited", "total_want_to_visit", "total_skipped", "total_hours",
        F.coalesce("total_distance_km", F.lit(0.0)).alias("total_distance_km"),
        F.coalesce("current_streak", F.lit(0)).alias("current_streak"),
        F.coalesce("longest_streak", F.lit(0)).alias("longest_streak"), "last_visit_date",
        "by_category")


# --- trips --------------------------------------------------------------------------------------


def trip_visits(trips: DataFrame, visits: DataFrame) -> DataFrame:
    """Visits of each trip through its id array; ids without a visit are dropped."""
    return trips.select("trip_id", F.explode("visit_ids").alias("id")).join(
        visits.drop("trip_id"), "id")


#: Days are counted from before the first calendar day; so many halvings cover the last one.
DAY_SHIFT, DAY_LEVELS = 1 << 20, 23


def _day_number(moment: str) -> Column:
    return F.unix_date(F.to_date(moment)).cast("bigint") + DAY_SHIFT


def day_pieces(start: str, end: str) -> Column:
    """``array<struct<level, piece>>``: blocks of 2^level days that make up a closed date range, two
    per level at most; empty if it is reversed, null if an end is missing."""
    first, last = _day_number(start), _day_number(end)
    none = F.array().cast("array<struct<level:int,piece:bigint>>")

    def step(held: Column, level: Column) -> Column:
        a, b = held["a"], held["b"]
        one = lambda at: F.array(F.struct(level.alias("level"), at.alias("piece")))
        left, right = (a <= b) & (a % 2 == 1), (a <= b) & (b % 2 == 0)
        low = F.when(left, a + 1).otherwise(a)
        high = F.when(right, b - 1).otherwise(b)
        # nothing left stays so: halving must not bring the ends together again
        return F.struct(F.shiftright(low, 1).alias("a"),
                        F.when(low <= high, F.shiftright(high, 1)).otherwise(-1).alias("b"),
                        F.concat(held["found"], F.when(left, one(a)).otherwise(none),
                                 F.when(right & (low <= b), one(b)).otherwise(none)).alias("found"))

    begin = F.struct(first.alias("a"), last.alias("b"), none.alias("found"))
    return F.when(first.isNotNull() & last.isNotNull(), F.aggregate(
        F.sequence(F.lit(0), F.lit(DAY_LEVELS - 1)), begin, step, lambda held: held["found"]))


def group_visits(trips: DataFrame, visits: DataFrame) -> DataFrame:
    """Assign visits to trips by owner, closed date range and optional circle.

    ``trips``: trip_id, user_id, start_date, end_date and optionally region_lat, region_lng,
    region_radius_km. A visit that several trips claim goes to the last one (highest trip ``ord``),
    as if the trips were grouped one after the other. A range is cut into blocks of days whose
    lengths are powers of two, so a trip of any length has a few rows; a visit looks for the blocks
    that its day lies in, at the lengths that occur.
    """
    ranges = trips.select(
        "user_id", F.explode(day_pieces("start_date", "end_date")).alias("_block"),
        F.struct("ord", F.col("trip_id").alias("id")).alias("claim"),
        "start_date", "end_date", *[F.col(c) if c in trips.columns else F.lit(None).cast("double").alias(c)
                      for c in ("region_lat", "region_lng", "region_radius_km")])
    near = F.col("region_lat").isNull() | F.col("region_lng").isNull() | F.col(
        "region_radius_km").isNull() | (geo.haversine_m(
            "region_lat", "region_lng", "lat", "lng") / 1000.0 <= F.col("region_radius_km"))
    levels = [r["level"] for r in ranges.select("_block.level").distinct().collect()]  # 23 at most
    day = _day_number("visited_at")
    blocks = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(day, n).alias("piece")) for n in sorted(levels)])
    if not levels:
        return visits
    dated = visits.select("id", "user_id", "visited_at", "lat", "lng", F.explode(blocks).alias("_block"))
    claimed = dated.join(ranges, ["user_id", "_block"]).where(
        F.col("visited_at").between(F.col("start_date"), F.col("end_date")) & near)
    owner = claimed.groupBy("id").agg(F.max("claim").alias("claim"))
    return visits.join(owner, "id", "left").withColumn(
        "trip_id", F.coalesce("claim.id", "trip_id")).drop("claim")


def trip_arrays(visits: DataFrame) -> DataFrame:
    """``visit_ids`` per trip, derived from the visits so that it cannot go stale.

    One row per trip and hour (``part``), so a trip of any size stays in rows of bounded size;
    ``trip_visits`` reads all parts.
    """
    hour = F.date_trunc("hour", "visited_at").alias("part")
    return visits.where("trip_id IS NOT NULL").groupBy("trip_id", hour).agg(
        F.array_sort(F.collect_list("id")).alias("visit_ids"))


def trip_summary(visits: DataFrame, notes: DataFrame) -> DataFrame:
    """Per trip: visited places, km, hours, tags by frequency, five best rated places."""
    own = visits.where("trip_id IS NOT NULL")
    counts = status_counts(own, "trip_id").select(
        "trip_id", F.col("total_visited").alias("total_places"), "total_hours")
    by_visit = own.select(F.col("id").alias("visit_id"), "trip_id", F.coalesce(
        "place_name", "place_id").alias("label"), F.col("ord").alias("visit_ord"))
    noted = notes.join(by_visit, "visit_id")
    tags = tag_counts(noted.select("trip_id", "ord", "tags"), "trip_id").groupBy("trip_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(
            (-F.col("count")).alias("order"), "first", "category", "count"))),
            lambda t: F.struct(t["category"].alias("category"), t["count"].alias("count")))
        .alias("categories"))
    best = best_rated(noted).groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("position", "label"))), lambda b: b["label"]).alias("best_rated_places"))
    return counts.join(path_km(own, "trip_id"), "trip_id", "left").join(
        tags, "trip_id", "left").join(best, "trip_id", "left").select(
        "trip_id", "total_places",
        F.coalesce("total_distance_km", F.lit(0.0)).alias("total_distance_km"), "total_hours",
        "categories", "best_rated_places")


def best_rated(noted: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` best notes of each trip; the rank bound prunes each task before the shuffle."""
    rated = noted.withColumn("average", rating_average()).where("average > 0")
    order = Window.partitionBy("trip_id").orderBy(
        F.col("average").desc(), F.col("visit_ord").asc(), F.col("ord").asc())
    return rated.withColumn("position", F.row_number().over(order)).where(
        F.col("position") <= top).select("trip_id", "position", "label", "average")


def dwell_prompts(stays: DataFrame, visits: DataFrame,
                  minutes: float = fv.DWELL_MINUTES) -> DataFrame:
    """Should a stay (user_id, place_id, dwell_minutes) be offered as a visit?"""
    seen = visits.where(VISITED).select("user_id", "place_id").distinct().withColumn(
        "already_visited", F.lit(True))
    joined = stays.join(seen, ["user_id", "place_id"], "left").withColumn(
        "already_visited", F.coalesce("already_visited", F.lit(False)))
    return joined.withColumn("should_prompt", (as_col("dwell_minutes") >= minutes)
                             & ~F.col("already_visited"))
