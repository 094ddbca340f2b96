"""Set-wise operators against plain sequential folds on random input."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.operators import (admission, changes, community, election, fusion, gamify, journal, ordered,
                             spatial)
from tests.test_geo import haversine

T0 = 1_700_000_000


def greedy(rows, near):
    leaders, owner = [], {}
    for row in rows:
        found = next((lead for lead in leaders if near(lead, row)), None)
        if found is None:
            leaders.append(row)
            found = row
        owner[row[0]] = found[0]
    return owner


@pytest.mark.parametrize("seed,count,spread", [(1, 150, 0.002), (2, 150, 0.0006), (3, 80, 0.01)])
def test_leader_clusters(spark, seed, count, spread):
    rng = random.Random(seed)
    rows = [(i, 42 + rng.uniform(0, spread), 19 + rng.uniform(0, spread)) for i in range(count)]
    # copies of one spot make up a third of the rows
    rows += [(count + i, 42.0001, 19.0001) for i in range(count // 2)]
    rng.shuffle(rows)
    rows = [(i, lat, lng) for i, (_, lat, lng) in enumerate(rows)]
    want = greedy(rows, lambda a, b: haversine(a[1], a[2], b[1], b[2]) < 50)
    points = spark.createDataFrame(rows, "ord bigint, lat double, lng double")
    got = {r["ord"]: r["leader"] for r in spatial.leader_clusters(points, 50.0).collect()}
    assert got == want


def test_day_pieces_cover_a_range_once(spark):
    rng = random.Random(15)
    days = [(a, a + rng.randrange(-2, 900)) for a in (rng.randrange(-5000, 20_000) for _ in range(60))]
    days += [(0, 2_932_896), (7, 7), (5, 4), (-719_162, 2_932_896)]
    frame = spark.createDataFrame(days, "a int, b int").withColumns({
        "start": F.date_from_unix_date("a"), "end": F.date_from_unix_date("b")})
    for a, b, pieces in frame.select("a", "b", journal.day_pieces("start", "end")).collect():
        spans = sorted(((p["piece"] << p["level"]) - journal.DAY_SHIFT, 1 << p["level"]) for p in pieces)
        assert len(spans) < 100 and sum(n for _, n in spans) == max(0, b - a + 1)
        at = a
        for start, n in spans:
            assert start == at
            at += n


def test_grouping_with_long_and_reversed_trips(spark):
    rng = random.Random(16)
    day = lambda n: F.date_from_unix_date(n)
    trips = [(f"t{i}", rng.randrange(3), i, rng.randrange(0, 400), rng.randrange(0, 400)) for i in range(30)]
    trips += [("open", 1, 30, 100, 2_932_896), ("null", 2, 31, None, 5)]
    visits = [(i, rng.randrange(4), rng.randrange(0, 400), 42.0, 19.0) for i in range(200)]
    t = spark.createDataFrame(trips, "trip_id string, user_id int, ord int, a int, b int").withColumns(
        {"start_date": day("a").cast("timestamp"), "end_date": day("b").cast("timestamp")})
    v = spark.createDataFrame(visits, "id int, user_id int, d int, lat double, lng double").withColumns(
        {"visited_at": day("d").cast("timestamp"), "trip_id": F.lit(None).cast("string")})
    got = {r["id"]: r["trip_id"] for r in journal.group_visits(t, v).collect()}
    assert got == {i: max(((o, name) for name, w, o, a, b in trips if w == u and a is not None and a <= d <= b),
                          default=(0, None))[1] for i, u, d, *_ in visits}


def test_far_spots_meet_few_sites(spark):
    rng = random.Random(12)
    sites = [(i, 42 + rng.uniform(0, .6), 19 + rng.uniform(0, .6)) for i in range(50_000)]
    spots = [(-33.0, 151.0), (41.0, 18.0), (89.9, -170.0)]
    points = spark.createDataFrame(sites, "ord bigint, lat double, lng double")
    queries = spark.createDataFrame(spots, "q_lat double, q_lng double")
    folded = points.select("lat", "lng", F.struct("ord").alias("site"))
    assert spatial.far_pairs(queries, folded).count() < 1000
    got = {(r["q_lat"], r["q_lng"]): r["ord"] for r in spatial.nearest_point(queries, points).collect()}
    assert got == {(a, b): min(sites, key=lambda r: haversine(a, b, r[1], r[2]))[0] for a, b in spots}


def test_nearest_around_the_globe(spark):
    rng = random.Random(13)
    sites = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(300, 90.0, 180.0), (301, -90.0, -180.0)]
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)] + [(0.0, 179.99), (90.0, 0.0), (-90.0, 5.0)]
    points = spark.createDataFrame(sites, "ord bigint, lat double, lng double")
    queries = spark.createDataFrame(spots, "q_lat double, q_lng double")
    got = {(r["q_lat"], r["q_lng"]): r["ord"] for r in spatial.nearest_point(queries, points).collect()}
    assert got == {(a, b): min(sites, key=lambda r: (haversine(a, b, r[1], r[2]), r[0]))[0] for a, b in spots}


@pytest.mark.parametrize("tile_rows", [5, 40, 400])
def test_election_is_the_same_with_any_tiles(spark, tile_rows):
    rng = random.Random(4)
    rows = [(i, 42 + rng.uniform(0, .02), 19 + rng.uniform(0, .02)) for i in range(400)]
    rows += [(400 + i, 60 + i * .0003, 5.0) for i in range(150)]  # a trail, each near the next only
    rng.shuffle(rows)
    rows = [(i, lat, lng) for i, (_, lat, lng) in enumerate(rows)]
    want = greedy(rows, lambda a, b: haversine(a[1], a[2], b[1], b[2]) < 50)
    points = spark.createDataFrame(rows, "ord bigint, lat double, lng double")
    got = election.elect(points, 50.0, tile_rows=tile_rows).where("leads")
    assert {r["ord"] for r in got.collect()} == set(want.values())


def test_a_long_trail_in_order_takes_few_jobs(spark):
    n = 100_000
    points = spark.range(n).select(F.col("id").alias("ord"), (F.lit(-30.0) + F.col("id") * .0003).alias("lat"),
                                   F.lit(11.0).alias("lng"))
    group = f"trail-{n}"
    spark.sparkContext.setJobGroup(group, "leaders of a trail")
    leaders = {r["ord"] for r in election.elect(points, 50.0, tile_rows=60_000).where("leads").collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert leaders == set(range(0, n, 2)) and jobs < 20


def test_leaders_across_the_date_line(spark):
    rows = [(0, 0.0, 179.9999), (1, 0.0, -179.9999), (2, 0.0, 179.99)]
    points = spark.createDataFrame(rows, "ord bigint, lat double, lng double")
    got = {r["ord"]: r["leader"] for r in spatial.leader_clusters(points, 50.0).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def similarity(a, b):
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


@pytest.mark.parametrize("seed", [1, 2])
def test_named_leader_clusters(spark, seed):
    rng = random.Random(seed)
    words = ["Old", "mill", "fort", "Bay", "of", "the", "sea"]
    rows = [(i, 42 + rng.uniform(0, .002), 19 + rng.uniform(0, .002),
             " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(90)]
    rows += [(90 + i, 42.001, 19.001, "old MILL") for i in range(40)]
    rows += [(130, 42.001, 19.001, None), (131, 42.001, 19.001, "")]
    want = greedy(rows, lambda a, b: haversine(a[1], a[2], b[1], b[2]) < 100
                  and similarity(a[3] or "", b[3] or "") > 0.3)
    items = spark.createDataFrame(rows, "ord bigint, lat double, lng double, name string")
    got = {r["ord"]: r["leader"] for r in fusion.named_leader_clusters(items).collect()}
    assert got == want


def events(seed, count, keys, users, span):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        # one key owns more than a third of the log
        key = 0 if rng.random() < 0.4 else rng.randrange(keys)
        out.append((key, rng.randrange(users), rng.random() < 0.5, T0 + rng.randrange(span), i))
    return out


def test_moderation_history(spark):
    log = events(7, 600, 6, 9, 40_000)
    places = {k: 1 for k in range(6)}
    standing, state = {}, defaultdict(lambda: [set(), set(), "pending", 0])
    for place, user, confirm, ts, n in sorted(log, key=lambda e: (e[3], e[4])):
        if user == places[place]:
            continue
        yes, no, _, _ = s = state[place]
        (yes if confirm else no).add(user)
        (no if confirm else yes).discard(user)
        if confirm and len(yes) >= 3:
            s[2], s[3] = "confirmed", s[3] + 1
        if not confirm and len(no) >= 3:
            s[2] = "rejected"
    assert not standing
    frame = spark.createDataFrame(log, "place_id bigint, user_id bigint, confirm boolean, "
                                       "s bigint, ord bigint").withColumn(
        "ts", F.timestamp_seconds("s")).drop("s")
    owners = spark.createDataFrame(list(places.items()), "place_id bigint, submitted_by bigint")
    status = community.moderation_status(community.moderation_history(frame, owners), owners)
    got = {r["place_id"]: (r["confirmations"], r["rejections"], r["status"], r["confirm_awards"])
           for r in status.collect()}
    assert got == {p: (len(s[0]), len(s[1]), s[2], s[3]) for p, s in state.items()}


def test_review_scores(spark):
    rng = random.Random(3)
    log = [(rng.randrange(4), rng.randrange(5), rng.choice(["up", "down", "report"]), i)
           for i in range(200)]
    up, down = defaultdict(set), defaultdict(set)
    for review, user, kind, _ in log:
        if kind == "report":
            down[review].add(user)
        else:
            up[review].discard(user)
            down[review].discard(user)
            (up if kind == "up" else down)[review].add(user)
    frame = spark.createDataFrame(log, "review_id bigint, user_id bigint, kind string, ord bigint")
    written = spark.createDataFrame([(k, 99) for k in range(4)], "review_id bigint, author_id bigint")
    got = {r["review_id"]: r["score"] for r in community.review_scores(frame, written).collect()}
    assert got == {k: len(up[k]) - len(down[k]) for k in range(4)}


def test_own_votes_and_unknown_reviews(spark):
    """An author's votes on their own review are rejected, their report is not; review 9 is unknown."""
    log = [(1, 7, "up", 0), (1, 8, "up", 1), (2, 7, "up", 2), (3, 7, "up", 3), (3, 7, "report", 4),
           (9, 8, "up", 5)]
    frame = spark.createDataFrame(log, "review_id bigint, user_id bigint, kind string, ord bigint")
    written = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "review_id bigint, author_id bigint")
    got = {r["review_id"]: (r["upvotes"], r["downvotes"], r["helpful_votes"])
           for r in community.review_scores(frame, written).collect()}
    assert got == {1: (1, 0, 1), 3: (0, 1, 0)}


def test_current_edges(spark):
    rng = random.Random(4)
    log = [(rng.randrange(3), rng.randrange(3), rng.choice(["follow", "unfollow", "consent"]),
            rng.random() < 0.5, i) for i in range(150)]
    edges = {}
    for a, b, action, consent, _ in log:
        if a == b:
            continue
        if action == "follow":
            edges[a, b] = False
        elif action == "unfollow":
            edges.pop((a, b), None)
        elif (a, b) in edges:
            edges[a, b] = consent
    frame = spark.createDataFrame(log, "follower_id bigint, following_id bigint, action string, "
                                       "consent boolean, ord bigint")
    got = {(r["follower_id"], r["following_id"]): r["consent_given"]
           for r in changes.current_edges(frame).collect()}
    assert got == edges


def test_duplicate_submissions(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["Bay", "bay", "Mill", ""]), 42 + rng.uniform(0, .004),
             19 + rng.uniform(0, .004)) for i in range(200)]
    kept, want = [], {}
    for n, name, lat, lng in rows:
        same = any(k[0] == name.lower() and abs(k[1] - lat) < .001 and abs(k[2] - lng) < .001
                   for k in kept if name)
        want[n] = same
        if not same:
            kept.append((name.lower(), lat, lng))
    frame = spark.createDataFrame(rows, "ord bigint, name string, lat double, lng double")
    got = {r["ord"]: r["duplicate"] for r in community.flag_duplicates(frame).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [1, 3])
def test_admission(spark, limit):
    rng = random.Random(8)
    rows = [("a" if rng.random() < .5 else rng.choice("bc"), "g", T0 + rng.randrange(2000), i)
            for i in range(400)]
    taken, want = defaultdict(list), {}
    for client, grp, s, n in sorted(rows, key=lambda r: (r[2], r[3])):
        recent = [t for t in taken[client] if s - t < 60]
        want[n] = len(recent) < limit
        if want[n]:
            taken[client].append(s)
    frame = spark.createDataFrame(rows, "client string, grp string, s bigint, ord bigint") \
        .withColumn("ts", F.timestamp_seconds("s"))
    got = {r["ord"]: r["accepted"] for r in admission.admit_calls(frame, limit).collect()}
    assert got == want and not all(want.values())


def test_running_and_previous_with_a_hot_key(spark):
    rows = [(k, T0 + s, n, v) for n, (k, s, v) in enumerate(
        (0 if i % 3 else i % 4, (i * 7919) % 20_000, i % 5) for i in range(500))]
    frame = spark.createDataFrame(rows, "k bigint, s bigint, ord bigint, v bigint").withColumn(
        "ts", F.timestamp_seconds("s"))
    total, last, want_sum, want_prev = defaultdict(int), {}, {}, {}
    for k, s, n, v in sorted(rows, key=lambda r: (r[1], r[2])):
        total[k] += v
        want_sum[n], want_prev[n], last[k] = total[k], last.get(k), n
    for ranges in (None, 7, 40):
        sums = ordered.running_totals(frame, ["k"], ["ts", "ord"], {"t": F.col("v")}, ranges)
        assert {r["ord"]: r["t"] for r in sums.collect()} == want_sum
        prev = ordered.previous_row(frame, ["k"], ["ts", "ord"], ["ord"], "p", ranges)
        assert {r["ord"]: r["p"] and r["p"]["ord"] for r in prev.collect()} == want_prev


def test_a_million_rows_of_one_minute_spread(spark):
    moment = F.timestamp_seconds(F.lit(T0) + F.col("id") % 60)
    frame = spark.range(1_000_000).select(F.lit(7).alias("k"), moment.alias("ts"),
                                          F.col("id").alias("ord"), (F.col("id") % 3).alias("v"))
    sizes = ordered.in_ranges(frame, ["k"], ["ts", "ord"], 16).groupBy("_range").count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 3 * 1_000_000 / 16
    sums = ordered.running_totals(frame, ["k"], ["ts", "ord"], {"t": F.col("v")}, 16)
    want = sums.agg(F.max("t").alias("t"), F.count_distinct("ord").alias("n")).first()
    assert (want["t"], want["n"]) == (sum(i % 3 for i in range(1_000_000)), 1_000_000)
    # the sum up to a row does not depend on the number of ranges
    again = ordered.running_totals(frame, ["k"], ["ts", "ord"], {"t": F.col("v")}, 3)
    assert sums.exceptAll(again.select(sums.columns)).isEmpty()


def test_rank_has_no_single_partition(spark):
    frame = spark.range(5000).select((F.col("id") % 1700).alias("v"))
    text = ordered.descending_rank(frame, "v")._jdf.queryExecution().toString()
    assert "SinglePartition" not in text


def test_trailing_count_and_rank(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(2), T0 + rng.randrange(300), i, rng.randrange(3000)) for i in range(200)]
    frame = spark.createDataFrame(rows, "k bigint, s bigint, ord bigint, v bigint").withColumn(
        "ts", F.timestamp_seconds("s"))
    got = {r["ord"]: r["n"] for r in ordered.trailing_count(frame, ["k"], "ts", 60, "n").collect()}
    assert got == {n: sum(1 for q, t, *_ in rows if q == k and s - 60 < t <= s)
                   for k, s, n, _ in rows}
    ranks = {r["ord"]: r["rank"] for r in ordered.descending_rank(frame, "v").collect()}
    assert ranks == {n: 1 + sum(1 for r in rows if r[3] > v) for _, _, n, v in rows}


def test_streaks(spark):
    days = [1, 2, 3, 5, 6, 28, 29, 30]
    rows = [(1, "visited", f"2024-01-{d:02d} 10:00:00", d) for d in days] + [
        (2, "visited", "2024-01-10 00:00:00", 99), (3, "skip", "2024-01-30 00:00:00", 100)]
    frame = spark.createDataFrame(rows, "user_id bigint, status string, t string, ord bigint") \
        .withColumn("visited_at", F.col("t").cast("timestamp"))
    got = {r["user_id"]: (r["current_streak"], r["longest_streak"])
           for r in journal.streaks(frame, "2024-01-31").collect()}
    assert got == {1: (3, 3), 2: (0, 1)}


def test_group_visits_last_trip_wins(spark):
    visits = spark.createDataFrame(
        [(1, 7, "2024-01-02 10:00:00", 42.0, 19.0, None), (2, 7, "2024-01-09 10:00:00", 42.0, 19.0,
                                                           "old"),
         (3, 8, "2024-01-02 10:00:00", 42.0, 19.0, None), (4, 7, "2024-01-02 12:00:00", 45.0, 19.0,
                                                           None)],
        "id bigint, user_id bigint, t string, lat double, lng double, trip_id string").withColumn(
        "visited_at", F.col("t").cast("timestamp"))
    trips = spark.createDataFrame(
        [("a", 7, 1, "2024-01-01", "2024-01-03", None), ("b", 7, 2, "2024-01-02", "2024-01-02 11:00:00",
                                                         50.0)],
        "trip_id string, user_id bigint, ord bigint, s string, e string, region_radius_km double") \
        .withColumns({"start_date": F.col("s").cast("timestamp"),
                      "end_date": F.col("e").cast("timestamp"), "region_lat": F.lit(42.0),
                      "region_lng": F.lit(19.0)})
    got = {r["id"]: r["trip_id"] for r in journal.group_visits(trips, visits).collect()}
    assert got == {1: "b", 2: "old", 3: None, 4: "a"}


def test_every_achievement_unlocks(spark):
    """One long journey: a place a day, 11 km apart, five places a trip, notes with every tag."""
    day = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 86_400)  # midnights, UTC
    visits = spark.range(100).select(
        F.lit(1).cast("bigint").alias("user_id"), "id", F.col("id").alias("ord"),
        F.lit("visited").alias("status"), (day + F.expr("make_interval(0,0,0,0,5 * int(id = 1))"))
        .alias("visited_at"), F.when(F.col("id") != 2, "here").alias("place_name"),
        F.floor(F.col("id") / 5).alias("trip_id"), (F.col("id") * 0.1).alias("lat"),
        F.lit(0.0).alias("lng"))
    tags = ["Abandoned", "underground", "cave", "viewpoint", "ruins", "military"]
    notes = spark.range(30).select(
        F.lit(1).cast("bigint").alias("user_id"), F.col("id").alias("ord"), day.alias("created_at"),
        F.array(*map(F.lit, tags)).alias("tags"), F.array(F.lit("p.jpg")).alias("photos"))
    cells = spark.range(90_000).select(
        F.lit(1).cast("bigint").alias("user_id"), F.floor(F.col("id") / 1000).alias("ord"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.floor(F.col("id") / 1000) * 86_400)
        .alias("explored_at"))
    log = gamify.visit_increments(visits, notes, cells)
    days = {r["achievement_id"]: r["day"] for r in gamify.first_unlocks(log).select(
        "achievement_id", (F.floor((F.unix_seconds("unlocked_at") - 1_704_067_200) / 86_400) + 1)
        .alias("day")).collect()}
    assert days == {
        "first_visit": 1, "visits_10": 10, "visits_50": 50, "visits_100": 100, "abandoned_10": 10,
        "underground_5": 5, "cave_3": 3, "viewpoint_10": 10, "ruins_5": 5, "military_3": 3,
        "streak_3": 3, "streak_7": 7, "streak_30": 30, "distance_10": 2, "distance_100": 10,
        "distance_500": 46, "notes_10": 10, "photos_20": 20, "night_explorer": 1, "fog_1km": 9,
        "fog_10km": 82, "early_bird": 2, "no_description": 3, "region_5_places": 5,
        "region_diverse": 1, "multi_region": 11}
