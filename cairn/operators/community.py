"""Submissions, moderation, reviews, ratings, karma and follows, folded from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions import text
from cairn.functions.columns import round_to
from cairn.operators.election import elect
from cairn.operators.filters import guard_actor
from cairn.operators.ordered import previous_row, running_totals
from cairn.session import cut

# --- submissions --------------------------------------------------------------------------------


def clean_submissions(rows: DataFrame) -> DataFrame:
    """User texts of a submission, sanitized."""
    cleaned = {c: text.sanitize_input(c) for c in ("name", "description") if c in rows.columns}
    if "tags" in rows.columns:
        cleaned["tags"] = F.transform("tags", text.sanitize_input)
    return rows.withColumns(cleaned)


def within_daily_limit(submissions: DataFrame, limit: int = fv.MAX_PLACES_PER_DAY) -> DataFrame:
    """The first ``limit`` submissions of each user and UTC day.

    The literal rank bound lets every task drop what cannot be accepted before the shuffle.
    """
    order = Window.partitionBy("user_id", F.to_date("created_at")).orderBy("created_at", "ord")
    return submissions.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def over_daily_limit(submissions: DataFrame, limit: int = fv.MAX_PLACES_PER_DAY) -> DataFrame:
    """The submissions that the daily limit rejects."""
    accepted = within_daily_limit(submissions, limit)
    return submissions.join(accepted.select("ord"), "ord", "left_anti")


def flag_duplicates(submissions: DataFrame,
                    degrees: float = fv.DUPLICATE_DEGREES) -> DataFrame:
    """Adds ``duplicate``: an accepted earlier row has the same name and lies within the band.

    A row is accepted if no accepted earlier row matches it, which is leader election again; equal
    positions of one name are folded first.
    """
    keyed = submissions.withColumn("_name", F.lower("name"))
    sites = keyed.where("_name <> ''").groupBy("_name", "lat", "lng").agg(F.min("ord").alias("ord"))
    leaders = elect(sites.withColumnRenamed("_name", "name"), degrees, degrees=True).where("leads")
    joined = keyed.join(leaders.select("ord", F.lit(False).alias("_dup")), "ord", "left")
    return joined.withColumn("duplicate", (F.col("_name") != "") & F.coalesce(
        F.col("_dup"), F.lit(True))).select(*submissions.columns, "duplicate")


# --- moderation ---------------------------------------------------------------------------------


def moderation_history(events: DataFrame, places: DataFrame,
                       threshold: int = fv.MODERATION_THRESHOLD) -> DataFrame:
    """Every accepted confirm or reject with the tallies after it and the karma it pays.

    A user has one standing vote per place: a changed vote moves between the tallies. Status turns
    confirmed (rejected) whenever a confirm (reject) finds its tally at the threshold.
    """
    accepted, _ = guard_actor(events, places, "place_id", "user_id", "submitted_by")
    changed = cut(previous_row(accepted, ["place_id", "user_id"], ["ts", "ord"], ["confirm"]))
    was = F.col("previous.confirm")

    def delta(vote: bool) -> Column:
        now = F.col("confirm") == vote
        gained = F.when(now & (was.isNull() | (was != vote)), 1).otherwise(0)
        lost = F.when(~now & F.coalesce(was == vote, F.lit(False)), 1).otherwise(0)
        return gained - lost

    tallied = running_totals(changed, ["place_id"], ["ts", "ord"],
                             {"confirmations": delta(True), "rejections": delta(False)})
    crossing = (F.when(F.col("confirm") & (F.col("confirmations") >= threshold), "confirmed")
                .when(~F.col("confirm") & (F.col("rejections") >= threshold), "rejected"))
    return tallied.select("place_id", "user_id", "confirm", "ts", "ord", "confirmations",
                          "rejections", crossing.alias("crossing"))


def moderation_status(history: DataFrame, places: DataFrame) -> DataFrame:
    """Current tallies and status per place; ``pending`` until a threshold is crossed."""
    when = F.struct("ts", "ord")
    last = history.groupBy("place_id").agg(
        F.max_by("confirmations", when).alias("confirmations"),
        F.max_by("rejections", when).alias("rejections"),
        F.max_by("crossing", F.when(F.col("crossing").isNotNull(), when)).alias("crossing"),
        F.count_if(F.col("crossing") == "confirmed").alias("confirm_awards"))
    return places.join(last, "place_id", "left").select(
        "place_id", "submitted_by", F.coalesce("confirmations", F.lit(0)).alias("confirmations"),
        F.coalesce("rejections", F.lit(0)).alias("rejections"),
        F.coalesce("crossing", F.lit("pending")).alias("status"),
        F.coalesce("confirm_awards", F.lit(0)).alias("confirm_awards"))


def list_places(places: DataFrame, status: str | None = None, author_id=None, limit: int = 50,
                offset: int = 0) -> DataFrame:
    """One page of community places, newest (largest id) first."""
    if status is not None:
        places = places.where(F.col("status") == status)
    if author_id is not None:
        places = places.where(F.col("submitted_by") == author_id)
    return places.orderBy(F.col("place_id").desc()).offset(offset).limit(limit)


def editable(edits: DataFrame, status: DataFrame) -> DataFrame:
    """Edits (place_id, author_id) by the author of a place that is still pending."""
    return edits.join(status.select("place_id", "submitted_by", "status"), "place_id").where(
        (F.col("author_id") == F.col("submitted_by")) & (F.col("status") == "pending")).drop(
        "submitted_by", "status")


# --- reviews ------------------------------------------------------------------------------------


def one_review_each(reviews: DataFrame) -> DataFrame:
    """First review of each author per place; tips are unlimited."""
    first = reviews.where("review_type = 'review'").groupBy("place_id", "author_id").agg(
        F.min("created_ord").alias("created_ord"))
    return reviews.where("review_type <> 'review'").unionByName(
        reviews.where("review_type = 'review'").join(
            first, ["place_id", "author_id", "created_ord"], "left_semi")
        .select(*reviews.columns))


def review_scores(votes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Upvotes minus downvotes per review, from a log of up, down and report.

    The last vote of a user counts; a report adds a downvote unless one stands and leaves an upvote
    in place; a later vote clears both. ``reviews`` has ``review_id, author_id``: votes of an author
    on their own review are rejected (a report is not), and so are events on unknown reviews. The
    guard looks up (review, user) pairs after the fold, so a busy review stays spread over tasks.
    """
    own = reviews.select("review_id", F.col("author_id").alias("user_id"),
                         F.lit(True).alias("own")).distinct()
    vote, report = F.col("kind") != "report", F.col("kind") == "report"
    per_user = votes.groupBy("review_id", "user_id").agg(
        F.max_by("kind", F.when(vote, F.col("ord"))).alias("last_vote"),
        F.max(F.when(vote, F.col("ord"))).alias("voted"),
        F.max(F.when(report, F.col("ord"))).alias("reported"),
        F.count_if(F.col("kind") == "up").alias("up_events"))
    allowed = F.col("own").isNull()
    per_user = per_user.join(own, ["review_id", "user_id"], "left").withColumns({
        "last_vote": F.when(allowed, F.col("last_vote")), "voted": F.when(allowed, F.col("voted")),
        "up_events": F.when(allowed, F.col("up_events")).otherwise(0)}).where(
        "voted IS NOT NULL OR reported IS NOT NULL")
    down = (F.coalesce(F.col("last_vote") == "down", F.lit(False))
            | F.coalesce(F.col("reported") > F.coalesce("voted", F.lit(-1)), F.lit(False)))
    up = F.coalesce(F.col("last_vote") == "up", F.lit(False))
    return per_user.groupBy("review_id").agg(
        F.count_if(up).alias("upvotes"), F.count_if(down).alias("downvotes"),
        (F.count_if(up) - F.count_if(down)).alias("score"),
        F.sum("up_events").alias("helpful_votes")).join(
        reviews.select("review_id"), "review_id", "left_semi")


def place_activity(reviews: DataFrame, scores: DataFrame) -> DataFrame:
    """Reviews, tips, mean score and latest visit date per place."""
    joined = reviews.join(scores.select(F.col("review_id").alias("id"), "score"), "id", "left")
    return joined.groupBy("place_id").agg(
        F.count_if(F.col("review_type") == "review").alias("review_count"),
        F.count_if(F.col("review_type") == "tip").alias("tip_count"),
        round_to(F.avg(F.coalesce("score", F.lit(0))), 1).alias("average_score"),
        F.max_by("visit_date", F.when(F.length("visit_date") > 0, F.col("created_ord")))
        .alias("latest_visit_date"))


def list_reviews(reviews: DataFrame, place_id, review_type: str | None = None,
                 sort_by: str = "score", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a place's reviews, by score or newest first."""
    rows = reviews.where(F.col("place_id") == place_id)
    if review_type is not None:
        rows = rows.where(F.col("review_type") == review_type)
    first = F.col("score") if sort_by == "score" else F.col("created_ord")
    return rows.orderBy(first.desc(), F.col("created_ord").asc()).offset(offset).limit(limit)


# --- routes, karma, follows ---------------------------------------------------------------------


def route_scores(ratings: DataFrame, routes: DataFrame) -> DataFrame:
    """Mean of the latest rating of each user per route; authors cannot rate their own."""
    accepted, _ = guard_actor(ratings, routes, "route_id", "user_id", "author_id")
    latest = accepted.groupBy("route_id", "user_id").agg(
        F.max_by("score", F.struct("ts", "ord")).alias("score"))
    means = latest.groupBy("route_id").agg(
        round_to(F.avg("score"), 1).alias("average_rating"),
        F.count(F.lit(1)).alias("ratings"))
    return routes.join(means, "route_id", "left").withColumns({
        "average_rating": F.coalesce("average_rating", F.lit(0.0)),
        "ratings": F.coalesce("ratings", F.lit(0))})


def list_routes(routes: DataFrame, region: str | None = None, author_id=None,
                sort_by: str = "rating", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of routes whose region contains a text, best rated or newest first."""
    if region:
        routes = routes.where(F.contains(F.lower("region"), F.lit(region.lower())))
    if author_id is not None:
        routes = routes.where(F.col("author_id") == author_id)
    first = F.col("average_rating") if sort_by == "rating" else F.col("ord")
    return routes.orderBy(first.desc(), F.col("ord").asc()).offset(offset).limit(limit)


def karma(events: DataFrame) -> DataFrame:
    """Karma and counters per user from (user_id, reason, times)."""
    points = F.element_at(F.create_map(*[x for k, v in fv.KARMA.items()
                                         for x in (F.lit(k), F.lit(v))]), F.col("reason"))
    return events.groupBy("user_id").agg(
        F.sum(points * F.col("times")).alias("karma"),
        *[F.sum(F.when(F.col("reason") == reason, F.col("times")).otherwise(0)).alias(reason)
          for reason in fv.KARMA])


def karma_events(status: DataFrame, reviews: DataFrame, scores: DataFrame,
                 routes: DataFrame) -> DataFrame:
    """Ledger of what earned karma, already counted per user and reason."""
    def counted(rows: DataFrame, user: str, reason: str, times: Column) -> DataFrame:
        return rows.groupBy(F.col(user).cast("bigint").alias("user_id")).agg(
            F.sum(times).alias("times")).withColumn("reason", F.lit(reason))

    status = cut(status)
    voted = scores.join(reviews.select(F.col("id").alias("review_id"), "author_id"), "review_id")
    one = F.lit(1)
    return (counted(status, "submitted_by", "place_submitted", one)
            .unionByName(counted(status, "submitted_by", "place_confirmed",
                                 F.col("confirm_awards")))
            .unionByName(counted(reviews, "author_id", "review_written", one))
            .unionByName(counted(voted, "author_id", "helpful_vote", F.col("helpful_votes")))
            .unionByName(counted(routes, "author_id", "route_published", one))).where("times > 0")


def followers(edges: DataFrame, user_id) -> DataFrame:
    return edges.where(F.col("following_id") == user_id)


def following(edges: DataFrame, user_id) -> DataFrame:
    return edges.where(F.col("follower_id") == user_id)
