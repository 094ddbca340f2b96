"""Submissions, moderation, reviews, ratings, karma, follows, call limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions.columns import round_to
from cairn.operators import changes, community, filters
from cairn.operators.ordered import trailing_count
from cairn.plans import testdata as td
from cairn.plans.catalog import Catalog
from cairn.plans.catalog import base as q
from cairn.session import cut

catalog = Catalog()

_HISTORY = """accepted AS (SELECT m.* FROM moderation m JOIN community c USING (place_id)
  WHERE m.user_id <> c.submitted_by),
lagged AS (SELECT *, lag(confirm) OVER (PARTITION BY place_id, user_id ORDER BY ts, ord) AS was
  FROM accepted),
deltas AS (SELECT *,
  CASE WHEN confirm AND was IS NOT TRUE THEN 1 ELSE 0 END
    - CASE WHEN NOT confirm AND was THEN 1 ELSE 0 END AS dc,
  CASE WHEN NOT confirm AND (was IS NULL OR was) THEN 1 ELSE 0 END
    - CASE WHEN confirm AND was = false THEN 1 ELSE 0 END AS dr FROM lagged),
history AS (SELECT *,
  (sum(dc) OVER w)::BIGINT AS confirmations, (sum(dr) OVER w)::BIGINT AS rejections
  FROM deltas WINDOW w AS (PARTITION BY place_id ORDER BY ts, ord
    ROWS UNBOUNDED PRECEDING)),
crossed AS (SELECT *, CASE WHEN confirm AND confirmations >= 3 THEN 'confirmed'
  WHEN NOT confirm AND rejections >= 3 THEN 'rejected' END AS crossing FROM history),
status AS (
  SELECT c.place_id, c.submitted_by, coalesce(h.confirmations, 0) AS confirmations,
    coalesce(h.rejections, 0) AS rejections, coalesce(h.crossing, 'pending') AS status,
    coalesce(h.confirm_awards, 0) AS confirm_awards
  FROM community c LEFT JOIN (
    SELECT place_id, arg_max(confirmations, ord) AS confirmations,
      arg_max(rejections, ord) AS rejections,
      arg_max(crossing, ord) FILTER (WHERE crossing IS NOT NULL) AS crossing,
      count(*) FILTER (WHERE crossing = 'confirmed') AS confirm_awards
    FROM crossed GROUP BY place_id) h USING (place_id))"""


def _history(spark, sf_dir):
    return community.moderation_history(td.moderation_events(spark, sf_dir),
                                        td.community_places(spark, sf_dir))


@catalog.add(q.with_ctes(q.MODERATION, _HISTORY) + """
SELECT place_id, user_id, ord, confirmations, rejections, crossing FROM crossed""")
def moderation_history(spark, sf_dir):
    """W-4, FL-20, A-5."""
    return _history(spark, sf_dir).select("place_id", "user_id", "ord", "confirmations",
                                          "rejections", "crossing")


@catalog.add(q.with_ctes(q.MODERATION, _HISTORY) + "SELECT * FROM status")
def moderation_status(spark, sf_dir):
    """AG-21."""
    return community.moderation_status(_history(spark, sf_dir),
                                       td.community_places(spark, sf_dir))


@catalog.add(q.with_ctes(q.MODERATION, _HISTORY) + """
SELECT place_id, submitted_by, status FROM status WHERE status = 'pending'
ORDER BY place_id DESC LIMIT 50 OFFSET 50""")
def listed_places(spark, sf_dir):
    """FL-8: the second page of places that wait for moderation (a page report)."""
    rows = community.moderation_status(_history(spark, sf_dir),
                                       td.community_places(spark, sf_dir))
    return community.list_places(rows, "pending", offset=50).select(
        "place_id", "submitted_by", "status")


@catalog.add(q.with_ctes(q.MODERATION, _HISTORY) + """
SELECT status, count(*) AS places, count(*) FILTER (WHERE author_match) AS editable FROM (
  SELECT s.status, s.status = 'pending' AND e.l_partkey IS NOT NULL AS author_match
  FROM status s LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey = l_suppkey) e
    ON e.l_partkey = s.place_id) GROUP BY status""")
def editable_places(spark, sf_dir):
    """FL-8, FL-20 edits: line items as edit attempts, only the author of a pending place may."""
    status = cut(community.moderation_status(_history(spark, sf_dir),
                                             td.community_places(spark, sf_dir)))
    attempts = td.read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("place_id"), F.col("l_suppkey").alias("author_id"))
    allowed = community.editable(attempts, status).select("place_id").distinct().withColumn(
        "can_edit", F.lit(1))
    return status.join(allowed, "place_id", "left").groupBy("status").agg(
        F.count(F.lit(1)).alias("places"), F.count("can_edit").alias("editable"))


@catalog.add(q.with_ctes(q.SUBMISSIONS) + """
SELECT id, (row_number() OVER (PARTITION BY user_id, created_at::DATE
  ORDER BY created_at, ord))::INTEGER AS nth FROM submissions QUALIFY nth <= 2""")
def daily_limit(spark, sf_dir):
    """AG-29, with a limit of two so that it binds."""
    return community.within_daily_limit(td.submissions(spark, sf_dir), 2).select("id", "nth")


@catalog.add("WITH " + q.SUBMISSIONS + """,
sites AS (SELECT lower(name) AS name, lat, lng, min(ord) AS ord FROM submissions GROUP BY ALL),
pairs AS (SELECT b.ord AS ord, a.ord AS smaller FROM sites a JOIN sites b ON a.name = b.name
  AND a.ord < b.ord AND abs(a.lat - b.lat) < 1e-3 AND abs(a.lng - b.lng) < 1e-3),
lead0 AS (SELECT ord FROM sites EXCEPT SELECT ord FROM pairs),
done0 AS (SELECT ord FROM lead0 UNION
  SELECT p.ord FROM pairs p JOIN lead0 l ON p.smaller = l.ord),
open1 AS (SELECT ord FROM sites EXCEPT SELECT ord FROM done0),
lead1 AS (SELECT ord FROM open1 EXCEPT SELECT p.ord FROM pairs p
  JOIN open1 o ON p.ord = o.ord JOIN open1 s ON p.smaller = s.ord)
SELECT id, ord NOT IN (SELECT ord FROM lead0 UNION ALL SELECT ord FROM lead1) AS duplicate
FROM submissions""")
def duplicate_submissions(spark, sf_dir):
    """JN-5."""
    return community.flag_duplicates(td.submissions(spark, sf_dir)).select("id", "duplicate")


@catalog.add(q.with_ctes(q.REVIEWS) + """
SELECT id, place_id, author_id, review_type FROM reviews
QUALIFY review_type = 'tip' OR row_number() OVER (
  PARTITION BY place_id, author_id, review_type ORDER BY created_ord) = 1""")
def single_reviews(spark, sf_dir):
    """AG-30, FL-9."""
    return community.one_review_each(td.reviews(spark, sf_dir)).select(
        "id", "place_id", "author_id", "review_type")


@catalog.add(q.with_ctes(q.REVIEWS) + """
SELECT id, author_id, review_type FROM reviews WHERE place_id = 7 AND review_type = 'tip'
ORDER BY created_ord DESC LIMIT 50""")
def listed_reviews(spark, sf_dir):
    """FL-9: the newest tips on one place (a page report)."""
    return community.list_reviews(td.reviews(spark, sf_dir), 7, "tip", "newest").select(
        "id", "author_id", "review_type")


_SCORES = """fair_events AS (
  SELECT e.* FROM review_events e JOIN reviews r ON e.review_id * 1000 = r.id
  WHERE kind = 'report' OR user_id <> author_id),
per_user AS (
  SELECT review_id, user_id,
    arg_max(kind, ord) FILTER (WHERE kind <> 'report') AS last_vote,
    max(ord) FILTER (WHERE kind <> 'report') AS voted,
    max(ord) FILTER (WHERE kind = 'report') AS reported,
    count(*) FILTER (WHERE kind = 'up') AS ups FROM fair_events GROUP BY ALL),
scores AS (
  SELECT review_id, count(*) FILTER (WHERE last_vote = 'up') AS upvotes,
    count(*) FILTER (WHERE last_vote = 'down' OR reported > coalesce(voted, -1)) AS downvotes,
    count(*) FILTER (WHERE last_vote = 'up')
      - count(*) FILTER (WHERE last_vote = 'down' OR reported > coalesce(voted, -1)) AS score,
    sum(ups)::BIGINT AS helpful_votes FROM per_user GROUP BY review_id)"""


def _scores(spark, sf_dir):
    """Votes on review n are votes on the first turn of conversation n."""
    first = td.reviews(spark, sf_dir).where(F.col("id") % 1000 == 0).select(
        F.expr("id div 1000").alias("review_id"), "author_id")
    return community.review_scores(td.review_events(spark, sf_dir), first)


def _scores_by_conversation(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("review_id", F.col("review_id") * 1000)


@catalog.add(q.with_ctes(q.REVIEWS, q.REVIEW_EVENTS, _SCORES) + "SELECT * FROM scores")
def review_scores(spark, sf_dir):
    """AG-22, FL-20 votes."""
    return _scores(spark, sf_dir)


@catalog.add(q.with_ctes(q.REVIEWS, q.REVIEW_EVENTS, _SCORES) + f"""
SELECT place_id, count(*) FILTER (WHERE review_type = 'review') AS review_count,
  count(*) FILTER (WHERE review_type = 'tip') AS tip_count,
  {q.rnd('avg(coalesce(score, 0))', 1)} AS average_score,
  arg_max(visit_date, created_ord) FILTER (WHERE visit_date <> '') AS latest_visit_date
FROM reviews LEFT JOIN scores ON review_id * 1000 = id GROUP BY place_id""")
def place_activity(spark, sf_dir):
    """AG-23."""
    return community.place_activity(td.reviews(spark, sf_dir),
                                    _scores_by_conversation(spark, sf_dir))


_MEANS = f"""fair AS (SELECT r.* FROM ratings r JOIN published p USING (route_id)
  WHERE r.user_id <> p.author_id),
latest AS (SELECT route_id, user_id, arg_max(score, struct_pack(ts := ts, ord := ord)) AS score
  FROM fair GROUP BY ALL),
means AS (SELECT route_id, {q.rnd('avg(score)', 1)} AS average_rating, count(*) AS ratings
  FROM latest GROUP BY route_id),
rated_routes AS (SELECT p.*, coalesce(average_rating, 0e0) AS average_rating,
  coalesce(m.ratings, 0) AS ratings FROM published p LEFT JOIN means m USING (route_id))"""


@catalog.add(q.with_ctes(q.RATINGS, _MEANS) + "SELECT * EXCLUDE (ord) FROM rated_routes")
def route_ratings(spark, sf_dir):
    """AG-27, FL-20 ratings."""
    return community.route_scores(td.route_ratings(spark, sf_dir),
                                  td.published_routes(spark, sf_dir)).drop("ord")


@catalog.add(q.with_ctes(q.RATINGS, _MEANS) + """
SELECT route_id, title, region, average_rating FROM rated_routes
WHERE contains(lower(region), 'coast 1') ORDER BY average_rating DESC, ord LIMIT 50""")
def routes_by_region(spark, sf_dir):
    """FL-10, S-3: best rated routes of matching regions (a top-k report)."""
    rated = community.route_scores(td.route_ratings(spark, sf_dir),
                                   td.published_routes(spark, sf_dir))
    return community.list_routes(rated, region="COAST 1").select(
        "route_id", "title", "region", "average_rating")


_KARMA = """karma_log AS (
  SELECT submitted_by AS user_id, 'place_submitted' AS reason, count(*) AS times FROM status GROUP BY 1
  UNION ALL SELECT submitted_by, 'place_confirmed', sum(confirm_awards) FROM status GROUP BY 1
  UNION ALL SELECT author_id, 'review_written', count(*) FROM reviews GROUP BY 1
  UNION ALL SELECT author_id, 'helpful_vote', sum(helpful_votes) FROM scores
    JOIN reviews ON review_id * 1000 = id GROUP BY 1
  UNION ALL SELECT author_id, 'route_published', count(*) FROM published GROUP BY 1)"""


@catalog.add(q.with_ctes(q.MODERATION, _HISTORY, q.REVIEWS, q.REVIEW_EVENTS, _SCORES, q.RATINGS,
                         _KARMA) + f"""
SELECT user_id, sum(times * CASE reason {' '.join(f"WHEN '{r}' THEN {p}" for r, p in fv.KARMA.items())}
    END)::BIGINT AS karma,
  {', '.join(f"coalesce(sum(times) FILTER (WHERE reason = '{r}'), 0)::BIGINT AS {r}" for r in fv.KARMA)}
FROM karma_log WHERE times > 0 GROUP BY user_id""")
def karma(spark, sf_dir):
    """AG-20."""
    status = community.moderation_status(_history(spark, sf_dir),
                                         td.community_places(spark, sf_dir))
    return community.karma(community.karma_events(
        status, td.reviews(spark, sf_dir), _scores_by_conversation(spark, sf_dir),
        td.published_routes(spark, sf_dir)))


_EDGES = """edges AS (
  SELECT follower_id, following_id,
    max(ord) FILTER (WHERE action = 'follow') AS followed,
    max(ord) FILTER (WHERE action = 'unfollow') AS unfollowed,
    max(ord) FILTER (WHERE action = 'consent') AS answered,
    arg_max(consent, ord) FILTER (WHERE action = 'consent') AS answer
  FROM follow_log WHERE follower_id <> following_id GROUP BY ALL),
alive AS (SELECT follower_id, following_id,
  coalesce(answered > followed AND answer, false) AS consent_given, followed AS since
  FROM edges WHERE followed > coalesce(unfollowed, -1))"""


@catalog.add(q.with_ctes(q.FOLLOWS, _EDGES) + "SELECT * FROM alive")
def follow_edges(spark, sf_dir):
    """TF-16, FL-20 follows."""
    return changes.current_edges(td.follow_events(spark, sf_dir))


@catalog.add(q.with_ctes(q.FOLLOWS, _EDGES) + """
SELECT c_custkey AS user_id, coalesce(followers, 0) AS followers,
  coalesce(following, 0) AS following
FROM customer LEFT JOIN (SELECT following_id AS c_custkey, count(*) AS followers FROM alive GROUP BY 1)
  USING (c_custkey)
LEFT JOIN (SELECT follower_id AS c_custkey, count(*) AS following FROM alive GROUP BY 1)
  USING (c_custkey)""")
def follow_counts(spark, sf_dir):
    """JN-19."""
    edges = changes.current_edges(td.follow_events(spark, sf_dir))
    users = td.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    joined = users
    for column, name in (("following_id", "followers"), ("follower_id", "following")):
        joined = joined.join(edges.groupBy(F.col(column).alias("user_id")).agg(
            F.count(F.lit(1)).alias(name)), "user_id", "left")
    return joined.na.fill(0, ["followers", "following"])


@catalog.add("""
SELECT event_id AS ord, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts)
  RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS calls FROM events""")
def trailing_calls(spark, sf_dir):
    """W-9: calls per group in the hour up to each call."""
    calls = td.api_calls(spark, sf_dir)
    return trailing_count(calls, ["grp"], "ts", 3600, "calls").select("ord", "calls")
