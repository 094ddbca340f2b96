"""Explored cells, achievements, points, levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions.columns import iso_second, round_to
from cairn.operators import gamify, journal
from cairn.plans import testdata as td
from cairn.plans.catalog import Catalog
from cairn.plans.catalog import base as q
from cairn.plans.catalog.journal_queries import PATH_USER, RUNS, STREAKS

catalog = Catalog()

_AREA = repr(fv.CELL_AREA_KM2) + "::DOUBLE"


def _cells(points: str) -> str:
    """Cells reached within 50 m: one step each way is enough for that radius."""
    return f"""offsets AS (SELECT unnest(range(-1, 2)) AS o),
reached AS (
  SELECT user_id, ts, visit_id, ord, {q.grid_key('lat + y.o * 0.001::DOUBLE', 'lng + x.o * 0.001::DOUBLE')}
    AS cell_key
  FROM {points}, offsets y, offsets x
  WHERE {q.hav('lat', 'lng', '(lat + y.o * 0.001::DOUBLE)', '(lng + x.o * 0.001::DOUBLE)')} <= 50),
cells AS (
  SELECT user_id, cell_key, arg_min(ts, ord) AS explored_at, arg_min(visit_id, ord) AS visit_id,
    min(ord) AS ord FROM reached GROUP BY user_id, cell_key)"""


@catalog.add(q.with_ctes(q.GPS, _cells("gps")) + """
SELECT user_id, cell_key, split_part(cell_key, '_', 1)::DOUBLE AS lat,
  split_part(cell_key, '_', 2)::DOUBLE AS lng,
  strftime(explored_at, '%Y-%m-%d %H:%M:%S') AS explored_at, visit_id FROM cells""")
def fog_reveal(spark, sf_dir):
    """TF-1, TF-2, W-6."""
    return gamify.revealed_cells(td.gps_points(spark, sf_dir)).select(
        "user_id", "cell_key", "lat", "lng", iso_second("explored_at").alias("explored_at"),
        "visit_id")


@catalog.add(q.with_ctes(q.GPS, _cells("gps")) + f"""
SELECT user_id, count(*) FILTER (WHERE explored_at >= TIMESTAMP '2024-01-16')
    AS new_cells_revealed, count(*) AS total_explored_cells,
  {q.rnd(f'count(*) * {_AREA}', 4)} AS total_explored_area_km2
FROM cells GROUP BY user_id""")
def fog_increment(spark, sf_dir):
    """JN-16, AG-11, TF-2 counters: the second half of the month on top of the first."""
    points = td.gps_points(spark, sf_dir)
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    known = gamify.revealed_cells(points.where(~late))
    return gamify.reveal_counters(gamify.new_cells(points.where(late), known), known)


@catalog.add(q.with_ctes(q.GPS, _cells("gps")) + """
SELECT user_id, cell_key, (row_number() OVER (PARTITION BY user_id
  ORDER BY ord DESC, cell_key DESC))::INTEGER AS recency FROM cells QUALIFY recency <= 100""")
def fog_latest(spark, sf_dir):
    """AG-11: the last cells of each user."""
    return gamify.latest_cells(gamify.revealed_cells(td.gps_points(spark, sf_dir))).select(
        "user_id", "cell_key", "recency")


_REGIONS = f"""regions AS (
  SELECT n_nationkey::BIGINT AS region_id, {q.lat('n_nationkey')} AS rlat,
    {q.lng('n_nationkey')} AS rlng, 2e0 + n_nationkey % 9 AS radius_km FROM nation)"""


@catalog.add(q.with_ctes(q.GPS, _cells("gps"), _REGIONS, f"""candidates AS (
  SELECT region_id, count(*) AS total_cells FROM (
    SELECT *, unnest(range(-100, 101)) AS dy FROM regions) a, (SELECT unnest(range(-180, 181)) AS dx) b
  WHERE abs(dy) <= floor(radius_km * 1000 / 111) + 1 AND abs(dx) <= floor(radius_km * 1000 / 111) + 1
    AND {q.hav('rlat', 'rlng', '(rlat + dy * 0.001::DOUBLE)', '(rlng + dx * 0.001::DOUBLE)')} <= radius_km * 1000
  GROUP BY region_id),
explored AS (
  SELECT region_id, user_id, count(*) AS explored_cells FROM regions JOIN (
    SELECT *, split_part(cell_key, '_', 1)::DOUBLE AS lat,
      split_part(cell_key, '_', 2)::DOUBLE AS lng FROM cells) c
    ON {q.hav('rlat', 'rlng', 'lat', 'lng')} <= radius_km * 1000 GROUP BY ALL)""") + f"""
SELECT region_id, user_id, explored_cells, total_cells,
  {q.rnd('explored_cells::DOUBLE / total_cells * 100', 2)} AS coverage_percent
FROM explored JOIN candidates USING (region_id)""")
def region_coverage(spark, sf_dir):
    """AG-12, JN-15, FL-5, TF-1."""
    key = F.col("n_nationkey").cast("bigint")
    regions = td.read(spark, sf_dir, "nation").select(
        key.alias("region_id"), td.lat_of(key).alias("lat"), td.lng_of(key).alias("lng"),
        (F.lit(2.0) + key % 9).alias("radius_km"))
    cells = gamify.revealed_cells(td.gps_points(spark, sf_dir)).select(
        "user_id", "cell_key", "lat", "lng")
    return gamify.coverage(regions, cells)


def _visit_points(visits):
    return visits.where("status = 'visited'").select(
        "user_id", "lat", "lng", F.col("visited_at").alias("ts"), F.lit(50.0).alias("radius_m"),
        F.col("id").alias("visit_id"), "ord")


def _derived(spark, sf_dir):
    return gamify.derive_all(td.visits(spark, sf_dir), td.notes(spark, sf_dir), td.AS_OF)


_TAG_METRICS = ",\n    ".join(
    f"(count(*) FILTER (WHERE lower(tag) = '{t}'))::DOUBLE AS category_{t}"
    for t in gamify.TAG_METRICS)
_METRICS = f"""visit_points AS (
  SELECT user_id, lat, lng, visited_at AS ts, id AS visit_id, ord FROM visits
  WHERE status = 'visited'),
{_cells('visit_points')},
basics AS (
  SELECT user_id, count(*)::DOUBLE AS total_visits,
    (count(*) FILTER (WHERE hour(visited_at) < 5))::DOUBLE AS night_visit,
    (count(*) FILTER (WHERE hour(visited_at) = 5))::DOUBLE AS early_visit,
    (count(*) FILTER (WHERE coalesce(place_name, '') = ''))::DOUBLE AS no_description_visit
  FROM visits WHERE status = 'visited' GROUP BY user_id),
trip_counts AS (
  SELECT user_id, count(*)::DOUBLE AS unique_trips, max(n)::DOUBLE AS region_places FROM (
    SELECT user_id, trip_id, count(*) AS n FROM visits WHERE status = 'visited' GROUP BY ALL)
  GROUP BY user_id),
written AS (
  SELECT user_id, count(*)::DOUBLE AS total_notes,
    (count(*) FILTER (WHERE len(photos) > 0))::DOUBLE AS total_photos FROM notes GROUP BY user_id),
tag_metrics AS (
  SELECT user_id, count(DISTINCT lower(tag))::DOUBLE AS unique_categories,
    {_TAG_METRICS}
  FROM (SELECT user_id, unnest(tags) AS tag FROM notes) GROUP BY user_id),
fog AS (SELECT user_id, count(*) * {_AREA} AS fog_area_km2 FROM cells GROUP BY user_id),
metrics AS (
  SELECT b.*, coalesce(unique_trips, 0e0) AS unique_trips,
    coalesce(region_places, 0e0) AS region_places, coalesce(total_notes, 0e0) AS total_notes,
    coalesce(total_photos, 0e0) AS total_photos,
    coalesce(unique_categories, 0e0) AS unique_categories,
    {', '.join(f'coalesce(category_{t}, 0e0) AS category_{t}' for t in gamify.TAG_METRICS)},
    coalesce(fog_area_km2, 0e0) AS fog_area_km2,
    coalesce(current_streak, 0)::DOUBLE AS streak_days,
    coalesce(total_distance_km, 0e0) AS total_distance_km
  FROM basics b LEFT JOIN trip_counts USING (user_id) LEFT JOIN written USING (user_id)
  LEFT JOIN tag_metrics USING (user_id) LEFT JOIN fog USING (user_id)
  LEFT JOIN streaks USING (user_id) LEFT JOIN path USING (user_id))"""
_METRIC_NAMES = ["total_visits", "night_visit", "early_visit", "no_description_visit",
                 "unique_trips", "region_places", "total_notes", "total_photos",
                 "unique_categories", *[f"category_{t}" for t in gamify.TAG_METRICS],
                 "fog_area_km2", "streak_days", "total_distance_km"]
_DEFS = "defs(id, name, icon, cond, target, xp, hidden) AS (VALUES " + ",\n".join(
    "('{}', '{}', '{}', '{}', {}e0, {}, {})".format(
        d[0], d[1].replace("'", "''"), d[3], d[6], d[7], d[8], str(d[9]).lower())
    for d in fv.ACHIEVEMENTS) + ")"
_EVALUATED = f"""long_metrics AS (
  {' UNION ALL '.join(f"SELECT user_id, '{m}' AS cond, {m} AS current FROM metrics" for m in _METRIC_NAMES)}),
evaluated AS (
  SELECT user_id, id, name, icon, target, xp, hidden, current, current >= target AS completed,
    CASE WHEN current >= target THEN 1e0 ELSE least(current / target, 0.99e0) END AS progress
  FROM long_metrics JOIN defs USING (cond))"""
_BASE = (q.VISITS, q.NOTES, RUNS, STREAKS, PATH_USER, _METRICS)


@catalog.add(q.with_ctes(*_BASE) + f"SELECT * REPLACE ({q.rnd('fog_area_km2', 6)} AS fog_area_km2)"
             " FROM metrics")
def achievement_metrics(spark, sf_dir):
    """AG-13, D-2."""
    seen, written = td.visits(spark, sf_dir), td.notes(spark, sf_dir)
    rows = gamify.user_metrics(seen, written, gamify.revealed_cells(_visit_points(seen)),
                               journal.streaks(seen, td.AS_OF), journal.path_km(seen))
    return rows.withColumn("fog_area_km2", round_to("fog_area_km2", 6))


@catalog.add(q.with_ctes(*_BASE, _DEFS, _EVALUATED) + f"""
SELECT user_id, id, {q.rnd('current', 2)} AS current, completed, {q.rnd('progress', 4)} AS progress
FROM evaluated""")
def achievement_progress(spark, sf_dir):
    """AG-14, JN-14."""
    return _derived(spark, sf_dir)["achievements"].select(
        "user_id", "id", round_to("current", 2).alias("current"), "completed",
        round_to("progress", 4).alias("progress"))


@catalog.add(q.with_ctes(*_BASE, _DEFS, _EVALUATED) + f"""
SELECT u.user_id, d.id,
  CASE WHEN e.progress IS NULL AND d.hidden THEN '{fv.HIDDEN_NAME}' ELSE d.name END AS name,
  CASE WHEN e.progress IS NULL AND d.hidden THEN '{fv.HIDDEN_ICON}' ELSE d.icon END AS icon,
  {q.rnd('coalesce(e.progress, 0e0) * 100', 1)} AS progress_percent,
  coalesce(e.completed, false) AS completed
FROM (SELECT c_custkey AS user_id FROM customer) u, defs d
LEFT JOIN evaluated e ON e.user_id = u.user_id AND e.id = d.id""")
def achievement_listing(spark, sf_dir):
    """AG-15: every customer, whether they explored or not."""
    users = td.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return gamify.list_achievements(users, _derived(spark, sf_dir)["achievements"]).select(
        "user_id", "id", "name", "icon", "progress_percent", "completed")


_LEDGER = f"""facts AS (
  SELECT v.user_id, v.id AS visit_id, v.visited_at AS ts, v.ord, r.run_day,
    coalesce(len(list_intersect(n.tags, {q.text_list(fv.RARE_TAGS)})) > 0, false) AS rare,
    coalesce(n.text <> '', false) AS has_text, coalesce(len(n.photos) > 0, false) AS has_photo,
    coalesce(n.average > 0, false) AS has_rating
  FROM visits v LEFT JOIN rated n ON n.visit_id = v.id
  JOIN runs r ON r.user_id = v.user_id AND r.day = v.visited_at::DATE
  WHERE v.status = 'visited'),
ledger AS (
  SELECT user_id, visit_id, ts, ord, 'visit' AS source,
    CASE WHEN rare THEN 25 ELSE 10 END AS xp FROM facts
  UNION ALL SELECT user_id, visit_id, ts, ord, 'note_text', 5 FROM facts WHERE has_text
  UNION ALL SELECT user_id, visit_id, ts, ord, 'note_photo', 8 FROM facts WHERE has_photo
  UNION ALL SELECT user_id, visit_id, ts, ord, 'note_rating', 3 FROM facts WHERE has_rating
  UNION ALL SELECT user_id, visit_id, ts, ord, 'streak', (least(run_day, 30) * 10)::INTEGER
    FROM facts WHERE run_day > 1)"""
_LEVEL = "CASE " + " ".join(f"WHEN {{x}} >= {low} THEN '{level}'" for level, low, *_ in
                            reversed(fv.LEVELS)) + " END"


@catalog.add(q.with_ctes(q.VISITS, q.NOTES, RUNS, _LEDGER) + """
SELECT user_id, visit_id, source, xp::INTEGER AS xp FROM ledger""")
def xp_ledger(spark, sf_dir):
    """AG-16, AG-17."""
    return gamify.xp_ledger(td.visits(spark, sf_dir), td.notes(spark, sf_dir)).select(
        "user_id", "visit_id", "source", "xp")


@catalog.add(q.with_ctes(q.VISITS, q.NOTES, RUNS, _LEDGER, """awards AS (
  SELECT user_id, visit_id, ts, ord, sum(xp)::BIGINT AS xp_earned FROM ledger GROUP BY ALL),
running AS (SELECT *, (sum(xp_earned) OVER (PARTITION BY user_id ORDER BY ts, ord))::BIGINT
  AS total_xp FROM awards)""") + f"""
SELECT user_id, visit_id, xp_earned, total_xp, {_LEVEL.replace('{x}', 'total_xp')} AS level,
  {_LEVEL.replace('{x}', 'total_xp')} <> {_LEVEL.replace('{x}', '(total_xp - xp_earned)')}
    AS leveled_up FROM running""")
def xp_history(spark, sf_dir):
    """W-7, JN-13, AG-17."""
    ledger = gamify.xp_ledger(td.visits(spark, sf_dir), td.notes(spark, sf_dir))
    return gamify.award_history(ledger).select("user_id", "visit_id", "xp_earned", "total_xp",
                                               "level", "leveled_up")


_NEXT = "CASE " + " ".join(f"WHEN {{x}} < {low} THEN {low}" for _, low, *_ in fv.LEVELS[1:]) + " END"
_LOW = "CASE " + " ".join(f"WHEN {{x}} >= {low} THEN {low}" for _, low, *_ in
                          reversed(fv.LEVELS)) + " END"
_TITLE = "CASE " + " ".join(f"WHEN {{x}} >= {low} THEN '{title}'" for _, low, _, _, title in
                            reversed(fv.LEVELS)) + " END"
_PROFILES = f"""totals AS (
  SELECT user_id, (x + coalesce(reward, 0))::BIGINT AS total_xp,
    coalesce(unlocked, 0) AS achievements_unlocked
  FROM (SELECT user_id, sum(xp) AS x FROM ledger GROUP BY user_id)
  LEFT JOIN (SELECT user_id, count(*) AS unlocked, sum(xp) AS reward FROM evaluated
    WHERE completed GROUP BY user_id) USING (user_id)),
profiles AS (
  SELECT user_id, total_xp, {_LEVEL.replace('{x}', 'total_xp')} AS level,
    coalesce(({_NEXT.replace('{x}', 'total_xp')}) - total_xp, 0) AS xp_to_next_level,
    coalesce({q.rnd(f"(total_xp - ({_LOW.replace('{x}', 'total_xp')}))::DOUBLE / (({_NEXT.replace('{x}', 'total_xp')}) - ({_LOW.replace('{x}', 'total_xp')})) * 100", 1)}, 100e0)
      AS level_progress_percent, achievements_unlocked,
    {len(fv.ACHIEVEMENTS)} AS total_achievements,
    coalesce({q.rnd('fog_area_km2', 4)}, 0e0) AS fog_explored_km2,
    {_TITLE.replace('{x}', 'total_xp')} AS title
  FROM totals LEFT JOIN fog USING (user_id))"""


@catalog.add(q.with_ctes(*_BASE, _DEFS, _EVALUATED, _LEDGER, _PROFILES) + "SELECT * FROM profiles")
def explorer_profiles(spark, sf_dir):
    """AG-18, TF-11."""
    return _derived(spark, sf_dir)["profiles"]


@catalog.add(q.with_ctes(*_BASE, _DEFS, _EVALUATED, _LEDGER, _PROFILES) + """
SELECT user_id, total_xp, level, fog_explored_km2 AS explored_km2,
  achievements_unlocked AS achievements_count, rank() OVER (ORDER BY total_xp DESC) AS rank
FROM profiles""")
def leaderboard(spark, sf_dir):
    """AG-19."""
    return gamify.leaderboard(_derived(spark, sf_dir)["profiles"])


_VISIT_POINTS = """visit_points AS (
  SELECT user_id, lat, lng, visited_at AS ts, id AS visit_id, ord FROM visits
  WHERE status = 'visited')"""
_MOMENT = "min({'ts': visited_at, 'ord': ord}) AS f"
_TAGS = ", ".join(f"'{t}'" for t in gamify.TAG_METRICS)


@catalog.add(q.with_ctes(q.VISITS, q.NOTES, RUNS, _VISIT_POINTS, _cells("visit_points"), _DEFS, f"""
seen AS (SELECT * FROM visits WHERE status = 'visited'),
steps AS (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM seen
  WINDOW w AS (PARTITION BY user_id ORDER BY visited_at, ord)),
used AS (SELECT user_id, created_at, ord, lower(tag) AS tag
  FROM (SELECT *, unnest(tags) AS tag FROM notes)),
increments(user_id, ts, ord, cond, amount) AS (
  SELECT user_id, visited_at, ord, 'total_visits', 1e0 FROM seen
  UNION ALL SELECT user_id, visited_at, ord, 'night_visit', 1e0 FROM seen
    WHERE hour(visited_at) < 5
  UNION ALL SELECT user_id, visited_at, ord, 'early_visit', 1e0 FROM seen
    WHERE hour(visited_at) = 5
  UNION ALL SELECT user_id, visited_at, ord, 'no_description_visit', 1e0 FROM seen
    WHERE coalesce(place_name, '') = ''
  UNION ALL SELECT user_id, f.ts, f.ord, 'unique_trips', 1e0 FROM (
    SELECT user_id, {_MOMENT} FROM seen WHERE trip_id IS NOT NULL GROUP BY user_id, trip_id)
  UNION ALL SELECT user_id, f.ts, f.ord, 'region_places', 1e0 FROM (
    SELECT user_id, nth, {_MOMENT} FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id, trip_id ORDER BY visited_at, ord) AS nth FROM seen
      WHERE trip_id IS NOT NULL) GROUP BY user_id, nth)
  UNION ALL SELECT user_id, f.ts, f.ord, 'streak_days', 1e0 FROM (
    SELECT s.user_id, run_day, {_MOMENT} FROM seen s JOIN runs r
      ON r.user_id = s.user_id AND r.day = s.visited_at::DATE GROUP BY s.user_id, run_day)
  UNION ALL SELECT user_id, visited_at, ord, 'total_distance_km',
    {q.hav('plat', 'plng', 'lat', 'lng')} / 1000e0 FROM steps WHERE plat IS NOT NULL
  UNION ALL SELECT user_id, explored_at, ord, 'fog_area_km2', count(*) * {_AREA} FROM cells
    GROUP BY user_id, explored_at, ord
  UNION ALL SELECT user_id, created_at, ord, 'total_notes', 1e0 FROM notes
  UNION ALL SELECT user_id, created_at, ord, 'total_photos', 1e0 FROM notes WHERE len(photos) > 0
  UNION ALL SELECT user_id, created_at, ord, 'category_' || tag, count(*)::DOUBLE FROM used
    WHERE tag IN ({_TAGS}) GROUP BY user_id, created_at, ord, tag
  UNION ALL SELECT user_id, f.ts, f.ord, 'unique_categories', count(*)::DOUBLE FROM (
    SELECT user_id, tag, {_MOMENT.replace('visited_at', 'created_at')} FROM used
    GROUP BY user_id, tag) GROUP BY ALL),
counted AS (SELECT *, sum(amount) OVER (PARTITION BY user_id, cond ORDER BY ts, ord) AS reached
  FROM increments)""".strip()) + f"""
SELECT user_id, id AS achievement_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS unlocked_at
FROM counted JOIN defs USING (cond)
WHERE CASE WHEN cond = 'total_distance_km' THEN {q.rnd('reached', 2)} ELSE reached END >= target
GROUP BY user_id, id""")
def first_unlocks(spark, sf_dir):
    """W-8."""
    seen = td.visits(spark, sf_dir)
    log = gamify.visit_increments(seen, td.notes(spark, sf_dir),
                                  gamify.revealed_cells(_visit_points(seen)))
    return gamify.first_unlocks(log).withColumn("unlocked_at", iso_second("unlocked_at"))
