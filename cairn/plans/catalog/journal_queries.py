"""Journal: visits, notes, trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions import text
from cairn.functions.columns import iso_second, round_to
from cairn.operators import changes, filters, journal
from cairn.plans import testdata as td
from cairn.plans.catalog import Catalog
from cairn.plans.catalog import base as q

catalog = Catalog()
AS_OF = td.AS_OF

_COUNTS = f"""counts AS (
  SELECT {{key}}, count(*) FILTER (WHERE status = 'visited') AS total_visited,
    count(*) FILTER (WHERE status = 'want_to_visit') AS total_want_to_visit,
    count(*) FILTER (WHERE status = 'skip') AS total_skipped,
    {q.rnd("sum(CASE WHEN status = 'visited' THEN coalesce(duration_minutes, 0) ELSE 0 END) / 60e0", 2)}
      AS total_hours
  FROM visits GROUP BY {{key}})"""
_PATH = f"""path AS (
  SELECT {{key}}, {q.rnd("sum(coalesce(" + q.hav('plat', 'plng', 'lat', 'lng') + " / 1000e0, 0e0))", 2)}
    AS total_distance_km
  FROM (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM visits
    WHERE status = 'visited' WINDOW w AS (PARTITION BY {{key}} ORDER BY visited_at, ord))
  GROUP BY {{key}})"""
RUNS = """days AS (SELECT DISTINCT user_id, visited_at::DATE AS day FROM visits
  WHERE status = 'visited'),
islands AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER AS run
  FROM days),
runs AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY day) AS run_day
  FROM islands)"""
STREAKS = f"""streaks AS (
  SELECT user_id, CASE WHEN max(day) >= DATE '{AS_OF}' - 1 THEN max_by(run_day, day)
      ELSE 0 END::INTEGER AS current_streak,
    max(run_day)::INTEGER AS longest_streak, strftime(max(day), '%Y-%m-%d') AS last_visit_date
  FROM runs GROUP BY user_id)"""
PATH_USER = _PATH.replace("{key}", "user_id")


@catalog.add(q.with_ctes(q.VISITS) + _COUNTS.replace("{key}", "user_id").replace(
    "counts AS (", "", 1).strip()[:-1])
def visit_counts(spark, sf_dir):
    """AG-4, AG-6."""
    return journal.status_counts(td.visits(spark, sf_dir))


@catalog.add(q.with_ctes(q.VISITS, RUNS, STREAKS) + "SELECT * FROM streaks")
def visit_streaks(spark, sf_dir):
    """W-1, D-1."""
    return journal.streaks(td.visits(spark, sf_dir), AS_OF)


@catalog.add(q.with_ctes(q.VISITS, PATH_USER) + "SELECT * FROM path")
def path_length(spark, sf_dir):
    """AG-7, W-2."""
    return journal.path_km(td.visits(spark, sf_dir))


@catalog.add(q.with_ctes(q.NOTES) + """
SELECT user_id, category, count(*) AS count, min(ord) AS first_note
FROM (SELECT user_id, ord, unnest(tags) AS category FROM notes) GROUP BY user_id, category""")
def tag_frequencies(spark, sf_dir):
    """AG-5."""
    return journal.tag_counts(td.notes(spark, sf_dir)).select(
        "user_id", "category", "count", F.col("first.ord").alias("first_note"))


_TAG_TEXT = """tagged AS (
  SELECT {key}, string_agg(category || ':' || n, ',' ORDER BY n DESC, first_ord, first_at) AS tags
  FROM (SELECT {key}, category, count(*) AS n, min(ord * 10 + pos) // 10 AS first_ord,
      min(ord * 10 + pos) % 10 AS first_at
    FROM (SELECT {key}, ord, unnest(tags) AS category, unnest([1, 2]) AS pos FROM noted)
    GROUP BY {key}, category) GROUP BY {key})"""


def _tag_text(column: str):
    return F.array_join(F.transform(column, lambda t: F.concat_ws(
        ":", t["category"], t["count"])), ",")


@catalog.add(q.with_ctes(
    q.VISITS, q.NOTES, "noted AS (SELECT * FROM notes)", RUNS, STREAKS, PATH_USER,
    _COUNTS.replace("{key}", "user_id"), _TAG_TEXT.replace("{key}", "user_id")) + """
SELECT c.*, coalesce(p.total_distance_km, 0e0) AS total_distance_km,
  coalesce(current_streak, 0) AS current_streak, coalesce(longest_streak, 0) AS longest_streak,
  last_visit_date, tags
FROM counts c LEFT JOIN path p USING (user_id) LEFT JOIN streaks USING (user_id)
LEFT JOIN tagged USING (user_id)""")
def exploration_stats(spark, sf_dir):
    """AG-4..AG-7 and W-1 in one report per user."""
    stats = journal.exploration_stats(td.visits(spark, sf_dir), td.notes(spark, sf_dir), AS_OF)
    return stats.withColumn("tags", _tag_text("by_category")).drop("by_category")


@catalog.add(q.with_ctes(q.VISITS, q.NOTES, f"""means AS (
  SELECT user_id, place_id, avg(average) AS mean, min(ord) AS first FROM rated WHERE average > 0
  GROUP BY user_id, place_id),
scored AS (SELECT user_id, place_id, first, {q.rnd('mean', 1)} AS actual_score,
  {q.rnd('abs(mean - 2.5e0)', 1)} AS delta FROM means WHERE abs(mean - 2.5e0) > 0.5e0)""") + """
SELECT s.user_id, s.place_id, v.place_name, 2.5e0 AS expected_score, actual_score, delta,
  (row_number() OVER (PARTITION BY s.user_id ORDER BY delta DESC, first))::INTEGER AS position
FROM scored s LEFT JOIN (SELECT user_id, place_id, first(place_name ORDER BY ord) AS place_name
  FROM visits GROUP BY ALL) v USING (user_id, place_id)
QUALIFY position <= 5""")
def surprise_places(spark, sf_dir):
    """AG-8, AG-28."""
    return journal.surprises(td.visits(spark, sf_dir), td.notes(spark, sf_dir))


@catalog.add(q.with_ctes(q.VISITS, f"""cells AS (
  SELECT user_id, {q.rnd('lat', 3)} AS lat, {q.rnd('lng', 3)} AS lng, count(*) AS n FROM visits
  WHERE status = 'visited' GROUP BY ALL)""") + f"""
SELECT user_id, lat, lng,
  {q.rnd('n::DOUBLE / max(n) OVER (PARTITION BY user_id)', 2)} AS intensity FROM cells""")
def heat_map(spark, sf_dir):
    """AG-9."""
    return journal.heat_map(td.visits(spark, sf_dir))


@catalog.add(q.with_ctes(q.NOTES) + "SELECT id, average FROM rated")
def note_averages(spark, sf_dir):
    """AG-28."""
    return td.notes(spark, sf_dir).select("id", journal.rating_average().alias("average"))


@catalog.add(q.with_ctes(q.VISITS) + """
SELECT id, user_id, strftime(visited_at, '%Y-%m-%d %H:%M:%S') AS visited_at FROM visits
WHERE status = 'visited' ORDER BY visits.visited_at DESC, ord LIMIT 50 OFFSET 25""")
def latest_visits(spark, sf_dir):
    """FL-7, S-3: one page of the newest visits (a top-k report)."""
    return journal.list_visits(td.visits(spark, sf_dir), "visited", offset=25).select(
        "id", "user_id", iso_second("visited_at").alias("visited_at"))


_NOTED = """noted AS (
  SELECT n.*, v.trip_id, coalesce(v.place_name, v.place_id) AS label, v.ord AS visit_ord
  FROM rated n JOIN visits v ON n.visit_id = v.id WHERE v.trip_id IS NOT NULL)"""
_BEST = """best AS (
  SELECT trip_id, string_agg(label, ',' ORDER BY position) AS best_rated FROM (
    SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY average DESC, visit_ord, ord)
      AS position FROM noted WHERE average > 0) WHERE position <= 5 GROUP BY trip_id)"""
SUMMARY = ",\n".join([_NOTED, _BEST, _COUNTS.replace("{key}", "trip_id"),
                      _PATH.replace("{key}", "trip_id"), _TAG_TEXT.replace("{key}", "trip_id")])


@catalog.add(q.with_ctes(q.VISITS, q.NOTES, SUMMARY) + """
SELECT trip_id, total_visited AS total_places,
  coalesce(total_distance_km, 0e0) AS total_distance_km, total_hours, tags, best_rated
FROM counts LEFT JOIN path USING (trip_id) LEFT JOIN tagged USING (trip_id)
LEFT JOIN best USING (trip_id)""")
def trip_summaries(spark, sf_dir):
    """AG-10, JN-7, S-4."""
    rows = journal.trip_summary(td.visits(spark, sf_dir), td.notes(spark, sf_dir))
    return rows.select("trip_id", "total_places", "total_distance_km", "total_hours",
                       _tag_text("categories").alias("tags"),
                       F.array_join("best_rated_places", ",").alias("best_rated"))


def _customer_trips(spark, sf_dir):
    """A planned trip per customer: ten days of January, a circle around its position."""
    key = F.col("c_custkey")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (key % 20).cast("int"))
    return td.read(spark, sf_dir, "customer").select(
        F.concat(F.lit("plan_"), key).alias("trip_id"), key.alias("user_id"), key.alias("ord"),
        start.cast("timestamp").alias("start_date"),
        F.date_add(start, 10).cast("timestamp").alias("end_date"),
        td.lat_of(key).alias("region_lat"), td.lng_of(key).alias("region_lng"),
        F.lit(40.0).alias("region_radius_km"))


_PLANS = f"""plans AS (
  SELECT 'plan_' || c_custkey AS plan_id, c_custkey AS user_id, c_custkey AS pord,
    (DATE '2024-01-01' + (c_custkey % 20)::INTEGER)::TIMESTAMP AS start_date,
    (DATE '2024-01-01' + (c_custkey % 20)::INTEGER + 10)::TIMESTAMP AS end_date,
    {q.lat('c_custkey')} AS region_lat, {q.lng('c_custkey')} AS region_lng FROM customer),
grouped AS (
  SELECT v.*, p.plan_id FROM visits v LEFT JOIN plans p ON v.user_id = p.user_id
    AND v.visited_at BETWEEN p.start_date AND p.end_date
    AND {q.hav('region_lat', 'region_lng', 'v.lat', 'v.lng')} / 1000e0 <= 40)"""


@catalog.add(q.with_ctes(q.VISITS, _PLANS) + """
SELECT id, coalesce(plan_id, trip_id) AS trip_id FROM grouped""")
def grouped_visits(spark, sf_dir):
    """TF-12, FL-11, D-3."""
    return journal.group_visits(_customer_trips(spark, sf_dir), td.visits(spark, sf_dir)).select(
        "id", "trip_id")


@catalog.add(q.with_ctes(q.VISITS) + """
SELECT v.trip_id, strftime(date_trunc('hour', visited_at), '%Y-%m-%d %H:%M:%S') AS part,
  string_agg(id, ',' ORDER BY id) AS visit_ids, any_value(t.visits) AS visits,
  any_value(t.visited) AS visited
FROM visits v JOIN (SELECT trip_id, count(*) AS visits,
  count(*) FILTER (WHERE status = 'visited') AS visited FROM visits GROUP BY trip_id) t
  ON v.trip_id = t.trip_id GROUP BY ALL""")
def trip_visit_arrays(spark, sf_dir):
    """JN-8, A-5: id arrays per trip, joined back to their visits."""
    seen = td.visits(spark, sf_dir)
    arrays = journal.trip_arrays(seen)
    joined = journal.trip_visits(arrays, seen).groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("visits"),
        F.count_if(F.col("status") == "visited").alias("visited"))
    return arrays.join(joined, "trip_id").select(
        "trip_id", iso_second("part").alias("part"),
        F.array_join("visit_ids", ",").alias("visit_ids"), "visits", "visited")


@catalog.add(q.with_ctes(q.VISITS) + """
SELECT e.event_id AS id, coalesce(v.seen, false) AS already_visited,
  e.value >= 5 AND NOT coalesce(v.seen, false) AS should_prompt
FROM (SELECT *, 'osm_node_' || (event_id % 100) AS place_id FROM events) e
LEFT JOIN (SELECT DISTINCT user_id, place_id, true AS seen FROM visits WHERE status = 'visited') v
  USING (user_id, place_id)""")
def dwell_prompts(spark, sf_dir):
    """TF-14, JN-6."""
    stays = td.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id",
        F.concat(F.lit("osm_node_"), F.col("event_id") % 100).alias("place_id"),
        F.col("value").alias("dwell_minutes"))
    return journal.dwell_prompts(stays, td.visits(spark, sf_dir)).select(
        "id", "already_visited", "should_prompt")


@catalog.add(q.with_ctes(q.VISITS) + f"""
, patches AS (SELECT o_orderkey AS visit_key, o_custkey % (SELECT count(*) FROM events) AS id,
  CASE WHEN o_orderstatus = 'F' THEN 'skip' END AS status,
  CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS minutes,
  o_orderdate AS ts, o_orderkey AS ord FROM orders),
folded AS (SELECT id, max(ts) AS ts,
  arg_max(status, struct_pack(ts := ts, ord := ord)) FILTER (WHERE status IS NOT NULL) AS status,
  arg_max(minutes, struct_pack(ts := ts, ord := ord)) FILTER (WHERE minutes IS NOT NULL) AS minutes
  FROM patches GROUP BY id)
SELECT v.id, coalesce(f.status, v.status) AS status,
  coalesce(f.minutes, v.duration_minutes) AS duration_minutes,
  strftime(coalesce(f.ts, v.visited_at), '%Y-%m-%d %H:%M:%S') AS updated_at
FROM visits v LEFT JOIN folded f USING (id)""")
def patched_visits(spark, sf_dir):
    """TF-15."""
    seen = td.visits(spark, sf_dir).withColumn("updated_at", F.col("visited_at"))
    total = td.read(spark, sf_dir, "events").count()
    patches = td.read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % total).alias("id"),
        F.when(F.col("o_orderstatus") == "F", "skip").alias("status"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("duration_minutes"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("ord"))
    return changes.apply_patches(seen, patches, "id", ["status", "duration_minutes"]).select(
        "id", "status", "duration_minutes", iso_second("updated_at").alias("updated_at"))


@catalog.add(q.with_ctes(q.VISITS, q.NOTES) + """
, gone AS (SELECT DISTINCT o_custkey AS id FROM orders),
gone_trips AS (SELECT DISTINCT 'trip_' || n_nationkey || '_20240108' AS trip_id FROM nation)
SELECT v.id, CASE WHEN g.trip_id IS NULL THEN v.trip_id END AS trip_id, count(n.id) AS notes
FROM visits v LEFT JOIN gone_trips g ON v.trip_id = g.trip_id LEFT JOIN notes n ON n.visit_id = v.id
WHERE v.id NOT IN (SELECT id FROM gone) GROUP BY ALL""")
def cascade_deletes(spark, sf_dir):
    """JN-17."""
    gone = td.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    gone_trips = td.read(spark, sf_dir, "nation").select(F.concat(
        F.lit("trip_"), "n_nationkey", F.lit("_20240108")).alias("trip_id"))
    kept, kept_notes = changes.delete_cascade(
        td.visits(spark, sf_dir), gone, "id", td.notes(spark, sf_dir), "visit_id")
    per_visit = kept_notes.groupBy(F.col("visit_id").alias("id")).agg(
        F.count(F.lit(1)).alias("notes"))
    return changes.unlink(kept, gone_trips, "trip_id").join(per_visit, "id", "left").select(
        "id", "trip_id", F.coalesce("notes", F.lit(0)).alias("notes"))


_LIMITS = f"""checked AS (
  SELECT event_id, list_filter([
    CASE WHEN NOT (value * 3 - 60 BETWEEN -90 AND 90) THEN 'lat' END,
    CASE WHEN NOT (value > 0 AND value <= 50) THEN 'radius_km' END,
    CASE WHEN NOT (user_id BETWEEN 1 AND 200) THEN 'limit' END,
    CASE WHEN event_type NOT IN ('click', 'view') THEN 'sort_by' END], lambda e: e IS NOT NULL)
    AS errors FROM events)"""


@catalog.add(q.with_ctes(_LIMITS) + """
SELECT event_id, array_to_string(errors, ',') AS errors, len(errors) = 0 AS valid FROM checked""")
def row_validation(spark, sf_dir):
    """FL-19."""
    rows = td.read(spark, sf_dir, "events").select(
        "event_id", (F.col("value") * 3 - 60).alias("lat"), F.col("value").alias("radius_km"),
        F.col("user_id").alias("limit"), F.col("event_type").alias("sort_by"))
    rules = {**filters.REQUEST_RULES, "sort_by": filters.one_of("sort_by", ["click", "view"])}
    del rules["lng"]
    return filters.validate(rows, rules).select(
        "event_id", F.array_join("errors", ",").alias("errors"),
        (F.size("errors") == 0).alias("valid"))


@catalog.add(q.with_ctes(q.NOTES) + """
, dirty AS (SELECT id, '  ' || chr(7) || text || chr(127) || ' tail  ' AS text,
  list_transform(tags, lambda t: ' ' || upper(t) || '!Ж.') AS tags, id % 5 AS kind FROM notes)
SELECT id, trim(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) AS text,
  array_to_string(list_transform(tags, lambda t: regexp_replace(lower(trim(t)),
    '[^a-zA-Zа-яА-ЯёЁ0-9_\\-]', '', 'g')), ',') AS tags,
  CASE WHEN kind = 0 THEN 'https://a/' || id WHEN kind = 1 THEN '/p/' || id
    WHEN kind = 2 THEN './q' ELSE '' END AS photos FROM dirty""")
def clean_note_fields(spark, sf_dir):
    """ST-9, ST-10, FL-18."""
    kind, key = F.col("id") % 5, F.col("id")
    url = (F.when(kind == 0, F.concat(F.lit(" https://a/"), key))
           .when(kind == 1, F.concat(F.lit("/p/"), key)).when(kind == 2, "./q ")
           .when(kind == 3, "ftp://b").otherwise("javascript:x"))
    dirty = td.notes(spark, sf_dir).withColumns({
        "text": F.concat(F.lit("  \x07"), "text", F.lit("\x7f tail  ")),
        "tags": F.transform("tags", lambda t: F.concat(F.lit(" "), F.upper(t), F.lit("!Ж."))),
        "photos": F.array(url)})
    return journal.clean_notes(dirty).select(
        "id", "text", F.array_join("tags", ",").alias("tags"),
        F.array_join("photos", ",").alias("photos"))
