"""Explored cells, achievements, experience points and levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions import geo
from cairn.functions.columns import as_col, round_to, strings
from cairn.operators import spatial
from cairn.operators.journal import VISITED, path_km, rating_average, visit_days
from cairn.operators.ordered import day_runs, descending_rank, previous_row, running_totals
from cairn.session import cut

# --- explored cells -----------------------------------------------------------------------------


def revealed_cells(points: DataFrame) -> DataFrame:
    """Cells that trail points reveal, each with its first revealer (lowest ``ord``)."""
    step = F.lit(fv.CELL_DEGREES)
    reach = geo.grid_reach("radius_m")
    around = points.withColumn("_dy", F.explode(F.sequence(-reach, reach))).withColumn(
        "_dx", F.explode(F.sequence(-reach, reach)))
    y, x = F.col("lat") + F.col("_dy") * step, F.col("lng") + F.col("_dx") * step
    cells = around.where(geo.haversine_m("lat", "lng", y, x) <= F.col("radius_m")).select(
        "user_id", "ts", "visit_id", "ord", geo.grid_index(y).alias("_y"),
        geo.grid_index(x).alias("_x"))
    # cells are grouped by their integer index; the text key is made once per cell
    first = cells.groupBy("user_id", "_y", "_x").agg(
        F.min_by(F.struct(F.col("ts").alias("explored_at"), "visit_id", "ord"), "ord")
        .alias("first"))
    keyed = first.select("user_id", F.format_string("%.4f_%.4f", F.col("_y") * step,
                                                    F.col("_x") * step).alias("cell_key"),
                         "first.*")
    return keyed.withColumn("at", geo.grid_key_position("cell_key")).select(
        "user_id", "cell_key", "at.lat", "at.lng", "explored_at", "visit_id", "ord")


def new_cells(points: DataFrame, known: DataFrame) -> DataFrame:
    """Revealed cells that the user has not explored yet."""
    return revealed_cells(points).join(known.select("user_id", "cell_key"),
                                       ["user_id", "cell_key"], "left_anti")


def area_km2(cells) -> Column:
    return as_col(cells) * F.lit(fv.CELL_AREA_KM2)


def fog_totals(cells: DataFrame) -> DataFrame:
    """Explored cells and area per user."""
    return cells.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_explored_cells")) \
        .withColumn("total_explored_area_km2", round_to(area_km2("total_explored_cells"), 4))


def reveal_counters(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """Per user: cells revealed now, cells in total, area in total."""
    flagged = fresh.select("user_id", F.lit(1).alias("new")).unionByName(
        known.select("user_id", F.lit(0).alias("new")))
    return flagged.groupBy("user_id").agg(
        F.sum("new").alias("new_cells_revealed"),
        F.count(F.lit(1)).alias("total_explored_cells")).withColumn(
        "total_explored_area_km2", round_to(area_km2("total_explored_cells"), 4))


def latest_cells(cells: DataFrame, count: int = 100) -> DataFrame:
    """The newest explored cells per user, in exploration order."""
    order = Window.partitionBy("user_id").orderBy(F.col("ord").desc(), F.col("cell_key").desc())
    return cells.withColumn("recency", F.row_number().over(order)).where(
        F.col("recency") <= count)


def cells_in_area(regions: DataFrame, cells: DataFrame) -> DataFrame:
    """Explored cells inside each region's circle."""
    queries = regions.select("region_id", F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"),
                             "radius_km")
    return spatial.circle_join(queries, cells, F.col("radius_km") * 1000, cell_degrees=0.05)


def cells_per_region(regions: DataFrame) -> DataFrame:
    """How many cells a region's circle has; rows of cells are spread over tasks."""
    step, radius = F.lit(fv.CELL_DEGREES), F.col("radius_km") * 1000
    reach = geo.grid_reach(radius)
    rows = regions.select("region_id", "lat", "lng", radius.alias("radius"), reach.alias("reach"),
                          F.explode(F.sequence(-reach, reach)).alias("dy"))
    inside = F.filter(F.sequence(-F.col("reach"), F.col("reach")), lambda dx: geo.haversine_m(
        "lat", "lng", F.col("lat") + F.col("dy") * step, F.col("lng") + dx * step)
        <= F.col("radius"))
    return rows.groupBy("region_id").agg(F.sum(F.size(inside)).alias("total_cells"))


def coverage(regions: DataFrame, cells: DataFrame) -> DataFrame:
    """Explored share of each region per user; distortion can push it over 100 %."""
    explored = cells_in_area(regions, cells).groupBy("region_id", "user_id").agg(
        F.count(F.lit(1)).alias("explored_cells"))
    return explored.join(cells_per_region(regions), "region_id").withColumn(
        "coverage_percent", F.when(F.col("total_cells") > 0, round_to(
            F.col("explored_cells") / F.col("total_cells") * 100, 2)).otherwise(0.0))


# --- achievements -------------------------------------------------------------------------------

DEFINITION = ("id string, name string, description string, icon string, category string, "
              "tier string, condition_type string, condition_value double, xp_reward int, "
              "hidden boolean")


def definition_table() -> Column:
    """All achievements as a literal ``array<struct>``; exploding it stays in the row's task."""
    names = [part.split()[0] for part in DEFINITION.split(", ")]
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)])
                     for row in fv.ACHIEVEMENTS])


TAG_METRICS = ["abandoned", "underground", "cave", "viewpoint", "ruins", "military"]


def user_metrics(visits: DataFrame, notes: DataFrame, cells: DataFrame,
                 streak: DataFrame, path: DataFrame) -> DataFrame:
    """One row per user with a visit: every value that an achievement can ask for.

    ``streak`` has current_streak, ``path`` total_distance_km.
    """
    visited = visits.where(VISITED)
    hour = F.hour("visited_at")
    trips = visited.where("trip_id IS NOT NULL").groupBy("user_id", "trip_id").agg(
        F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(
        F.count(F.lit(1)).cast("double").alias("unique_trips"),
        F.max("n").cast("double").alias("region_places"))
    basics = visited.groupBy("user_id").agg(
        F.count(F.lit(1)).cast("double").alias("total_visits"),
        F.count_if(hour < 5).cast("double").alias("night_visit"),
        F.count_if(hour == 5).cast("double").alias("early_visit"),
        F.count_if(F.coalesce(F.length("place_name"), F.lit(0)) == 0).cast("double")
        .alias("no_description_visit"))
    written = notes.groupBy("user_id").agg(
        F.count(F.lit(1)).cast("double").alias("total_notes"),
        F.count_if(F.size("photos") > 0).cast("double").alias("total_photos"))
    tags = notes.select("user_id", F.explode("tags").alias("tag")).groupBy(
        "user_id", F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    tagged = tags.groupBy("user_id").agg(
        F.count(F.lit(1)).cast("double").alias("unique_categories"),
        *[F.sum(F.when(F.col("tag") == t, F.col("n")).otherwise(0)).cast("double")
          .alias(f"category_{t}") for t in TAG_METRICS])
    fog = cells.groupBy("user_id").agg(area_km2(F.count(F.lit(1))).alias("fog_area_km2"))
    joined = basics
    for part in (trips, written, tagged, fog,
                 streak.select("user_id", F.col("current_streak").cast("double")
                               .alias("streak_days")),
                 path.select("user_id", "total_distance_km")):
        joined = joined.join(part, "user_id", "left")
    return joined.na.fill(0.0)


def evaluate_achievements(metrics: DataFrame) -> DataFrame:
    """User x achievement with value, target, completion and progress."""
    values = F.create_map(*[x for c in metrics.columns if c != "user_id"
                            for x in (F.lit(c), F.col(c))])
    rows = metrics.select("user_id", values.alias("values"),
                          F.explode(definition_table()).alias("d")).select(
        "user_id", "d.*", F.coalesce(F.col("values")[F.col("d.condition_type")], F.lit(0.0))
        .alias("current"))
    done = F.col("current") >= F.col("condition_value")
    return rows.withColumns({
        "completed": done,
        "progress": F.when(done, 1.0).when(F.col("condition_value") > 0, F.least(
            F.col("current") / F.col("condition_value"), F.lit(0.99))).otherwise(0.0)})


def achievement_rewards(evaluated: DataFrame) -> DataFrame:
    """Unlocked achievements and their points per user."""
    return evaluated.where("completed").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("achievements_unlocked"), F.sum("xp_reward").alias("reward_xp"))


def list_achievements(users: DataFrame, evaluated: DataFrame) -> DataFrame:
    """What each user sees: hidden achievements stay masked until they have a record."""
    all_rows = users.select("user_id", F.explode(definition_table()).alias("d")).select(
        "user_id", "d.*")
    known = evaluated.select("user_id", "id", "completed", "progress")
    joined = all_rows.join(known, ["user_id", "id"], "left")
    masked = F.col("progress").isNull() & F.col("hidden")
    progress = F.coalesce("progress", F.lit(0.0))
    return joined.select(
        "user_id", "id", F.when(masked, fv.HIDDEN_NAME).otherwise(F.col("name")).alias("name"),
        F.when(masked, fv.HIDDEN_DESCRIPTION).otherwise(F.col("description"))
        .alias("description"),
        F.when(masked, fv.HIDDEN_ICON).otherwise(F.col("icon")).alias("icon"), "category", "tier",
        F.col("condition_value").alias("target_value"),
        (progress * F.col("condition_value")).alias("current_value"),
        round_to(progress * 100, 1).alias("progress_percent"),
        F.coalesce("completed", F.lit(False)).alias("completed"))


def metric_value(total) -> Column:
    """A running total of ``condition_type`` as achievements see it: kilometres to two places."""
    return F.when(F.col("condition_type") == "total_distance_km",
                  round_to(as_col(total), 2)).otherwise(as_col(total))


def first_unlocks(increments: DataFrame) -> DataFrame:
    """When each counted achievement was reached, replaying a log of increments.

    ``increments``: user_id, condition_type, ts, ord, amount. The time is that of the increment
    that reaches the target.
    """
    running = running_totals(increments, ["user_id", "condition_type"], ["ts", "ord"],
                             {"reached": F.col("amount")})
    targets = F.filter(definition_table(), lambda d: d["condition_type"] == F.col(
        "condition_type"))
    hits = running.select("user_id", "condition_type", "ts", "reached", F.explode(targets)
                          .alias("d")).where(metric_value("reached") >= F.col("d.condition_value"))
    return hits.groupBy("user_id", F.col("d.id").alias("achievement_id")).agg(
        F.min("ts").alias("unlocked_at"))


def visit_increments(visits: DataFrame, notes: DataFrame, cells: DataFrame) -> DataFrame:
    """Increment log of every metric, one row per (user, metric, ts, ord) that moves it.

    Counts add one; cells add their area and steps their length. A metric that is a maximum (days in
    a row, places of one trip) adds one whenever a value is reached for the first time.
    """
    visited = visits.where(VISITED).withColumn("ts", F.col("visited_at"))
    moment, one = F.struct("ts", "ord"), F.lit(1.0)
    hour = F.hour("ts")

    def log(rows: DataFrame, metric, amount: Column) -> DataFrame:
        return rows.select("user_id", metric.alias("condition_type"), "ts", "ord",
                           amount.cast("double").alias("amount"))

    def firsts(rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy("user_id", *key).agg(F.min(moment).alias("f")).select(
            "user_id", *key, "f.*")

    def marks(*metrics: Column) -> Column:
        return F.explode(F.filter(F.array(*metrics), lambda c: c.isNotNull()))

    per_visit = visited.select("user_id", "ts", "ord", marks(
        F.lit("total_visits"), F.when(hour < 5, F.lit("night_visit")),
        F.when(hour == 5, F.lit("early_visit")),
        F.when(F.coalesce(F.length("place_name"), F.lit(0)) == 0,
               F.lit("no_description_visit"))).alias("m"))
    in_trips = visited.where("trip_id IS NOT NULL").select("user_id", "trip_id", "ts", "ord")
    trip_sizes = running_totals(in_trips, ["user_id", "trip_id"], ["ts", "ord"],
                                {"nth": F.lit(1)})
    run_days = visited.withColumn("day", F.to_date("ts")).join(
        day_runs(visit_days(visits), "user_id"), ["user_id", "day"])
    legs = previous_row(visited.select("user_id", "lat", "lng", "ts", "ord"), ["user_id"],
                        ["ts", "ord"], ["lat", "lng"]).where("previous IS NOT NULL")
    leg = geo.haversine_m("previous.lat", "previous.lng", "lat", "lng") / 1000.0
    fog = cells.groupBy("user_id", F.col("explored_at").alias("ts"), "ord").agg(
        F.count(F.lit(1)).alias("n"))
    written = notes.withColumn("ts", F.col("created_at"))
    per_note = written.select("user_id", "ts", "ord", marks(
        F.lit("total_notes"), F.when(F.size("photos") > 0, F.lit("total_photos"))).alias("m"))
    tags = written.select("user_id", "ts", "ord", F.explode("tags").alias("tag")).withColumn(
        "tag", F.lower("tag"))
    places = tags.where(F.col("tag").isin(TAG_METRICS)).groupBy(
        "user_id", "tag", "ts", "ord").agg(F.count(F.lit(1)).alias("n"))
    new_tags = firsts(tags, "tag").groupBy("user_id", "ts", "ord").agg(
        F.count(F.lit(1)).alias("n"))
    parts = [log(per_visit, F.col("m"), one), log(per_note, F.col("m"), one),
             log(firsts(in_trips, "trip_id"), F.lit("unique_trips"), one),
             log(firsts(trip_sizes, "nth"), F.lit("region_places"), one),
             log(firsts(run_days, "run_day"), F.lit("streak_days"), one),
             log(legs, F.lit("total_distance_km"), leg),
             log(fog, F.lit("fog_area_km2"), area_km2("n")),
             log(places, F.concat(F.lit("category_"), "tag"), F.col("n")),
             log(new_tags, F.lit("unique_categories"), F.col("n"))]
    return reduce(DataFrame.unionByName, parts)


# --- experience ---------------------------------------------------------------------------------


def xp_ledger(visits: DataFrame, notes: DataFrame) -> DataFrame:
    """Points as events: (user_id, visit_id, source, xp, ts, ord, part)."""
    notes = notes.withColumn("average", rating_average())
    noted = notes.groupBy("visit_id").agg(
        F.max(F.arrays_overlap("tags", strings(fv.RARE_TAGS))).alias("rare"),
        F.count_if(F.length("text") > 0).alias("texts"),
        F.count_if(F.size("photos") > 0).alias("photo_notes"),
        F.count_if(F.col("average") > 0).alias("ratings"))
    runs = day_runs(visit_days(visits), "user_id").select("user_id", "day", "run_day")
    visited = visits.where(VISITED).select(
        "user_id", F.col("id").alias("visit_id"), F.to_date("visited_at").alias("day"),
        F.col("visited_at").alias("ts"), "ord")
    facts = visited.join(noted, "visit_id", "left").join(runs, ["user_id", "day"], "left")

    def bonus(source: str, count: Column, xp: int) -> Column:
        return F.array_repeat(F.struct(F.lit(source).alias("source"), F.lit(xp).alias("xp")),
                              F.coalesce(count, F.lit(0)).cast("int"))

    base = F.array(F.struct(F.lit("visit").alias("source"), F.when(
        F.coalesce("rare", F.lit(False)), fv.XP_VISIT_RARE).otherwise(fv.XP_VISIT).alias("xp")))
    streak = F.when(F.col("run_day") > 1, F.array(F.struct(
        F.lit("streak").alias("source"), (F.least(F.col("run_day"), F.lit(fv.XP_STREAK_MAX_DAYS))
                                          * fv.XP_STREAK_PER_DAY).alias("xp")))).otherwise(
        F.array().cast("array<struct<source:string,xp:int>>"))
    return facts.select("user_id", "visit_id", "ts", "ord", F.posexplode(F.concat(
        base, bonus("note_text", F.col("texts"), fv.XP_NOTE_TEXT),
        bonus("note_photo", F.col("photo_notes"), fv.XP_NOTE_PHOTO),
        bonus("note_rating", F.col("ratings"), fv.XP_NOTE_RATING), streak)).alias("part", "e")) \
        .select("user_id", "visit_id", "ts", "ord", "part", "e.source", "e.xp")


def level_of(xp) -> Column:
    """``struct<level, min_xp, max_xp, unlocked_features, title>`` of the last level reached."""
    table = F.array(*[F.struct(
        F.lit(level).alias("level"), F.lit(low).cast("int").alias("min_xp"),
        F.lit(high).cast("int").alias("max_xp"), strings(features).alias("unlocked_features"),
        F.lit(title).alias("title")) for level, low, high, features, title in fv.LEVELS])
    reached = F.filter(table, lambda level: as_col(xp) >= level["min_xp"])
    return F.element_at(reached, -1)


def next_level_xp(xp) -> Column:
    """Threshold of the level after the current one; null on the last level."""
    starts = F.array(*[F.lit(low) for _, low, *_ in fv.LEVELS])
    return F.array_min(F.filter(starts, lambda low: low > as_col(xp)))


def award_history(ledger: DataFrame) -> DataFrame:
    """Per visit award: points, running total, level and whether it was reached just then."""
    awards = cut(ledger.groupBy("user_id", "ts", "ord", "visit_id").agg(
        F.sum("xp").alias("xp_earned")))
    running = running_totals(awards, ["user_id"], ["ts", "ord"],
                             {"total_xp": F.col("xp_earned")})
    before = level_of(F.col("total_xp") - F.col("xp_earned"))["level"]
    return running.withColumn("level", level_of("total_xp")["level"]).withColumn(
        "leveled_up", F.col("level") != before)


def xp_totals(ledger: DataFrame, rewards: DataFrame | None = None) -> DataFrame:
    """Total points per user, with achievement rewards if given."""
    totals = ledger.groupBy("user_id").agg(F.sum("xp").alias("total_xp"))
    if rewards is None:
        return totals
    return totals.join(rewards, "user_id", "left").select(
        "user_id", (F.col("total_xp") + F.coalesce("reward_xp", F.lit(0))).alias("total_xp"),
        F.coalesce("achievements_unlocked", F.lit(0)).alias("achievements_unlocked"))


def profiles(totals: DataFrame, cells: DataFrame) -> DataFrame:
    """Level, progress to the next one, achievements, explored area and title per user."""
    area = cells.groupBy("user_id").agg(round_to(area_km2(F.count(F.lit(1))), 4)
                                        .alias("fog_explored_km2"))
    here, following = level_of("total_xp"), next_level_xp("total_xp")
    rows = totals.join(area, "user_id", "left").withColumn("_level", here).withColumn(
        "_next", following)
    done = (F.col("total_xp") - F.col("_level.min_xp")) / (
        F.col("_next") - F.col("_level.min_xp")) * 100
    return rows.select(
        "user_id", "total_xp", F.col("_level.level").alias("level"),
        F.coalesce(F.col("_next") - F.col("total_xp"), F.lit(0)).alias("xp_to_next_level"),
        F.when(F.col("_next").isNull(), 100.0).otherwise(round_to(done, 1))
        .alias("level_progress_percent"), "achievements_unlocked",
        F.lit(len(fv.ACHIEVEMENTS)).alias("total_achievements"),
        F.coalesce("fog_explored_km2", F.lit(0.0)).alias("fog_explored_km2"),
        F.col("_level.title").alias("title"))


def leaderboard(profile_rows: DataFrame) -> DataFrame:
    """All users ranked by points."""
    return descending_rank(cut(profile_rows.select(
        "user_id", "total_xp", "level", F.col("fog_explored_km2").alias("explored_km2"),
        F.col("achievements_unlocked").alias("achievements_count"))), "total_xp")


def derive_all(visits: DataFrame, notes: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Everything a visit log implies: explored cells, ledger, achievements, profiles."""
    from cairn.operators.journal import streaks
    points = visits.where(VISITED).select(
        "user_id", "lat", "lng", F.col("visited_at").alias("ts"), F.lit(50.0).alias("radius_m"),
        F.col("id").alias("visit_id"), "ord")
    cells = cut(revealed_cells(points))
    ledger = xp_ledger(visits, notes)
    evaluated = evaluate_achievements(user_metrics(
        visits, notes, cells, streaks(visits, as_of), path_km(visits)))
    totals = xp_totals(ledger, achievement_rewards(evaluated))
    return {"cells": cells, "ledger": ledger, "achievements": evaluated, "totals": totals,
            "profiles": profiles(totals, cells)}
