"""Recommendations, offline regions, exports of trips, call admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions.columns import iso_second, strings
from cairn.operators import admission, changes, filters, journal, offline
from cairn.plans import discovery, recommendation
from cairn.plans import testdata as td
from cairn.plans.catalog import Catalog
from cairn.plans.catalog import base as q
from cairn.plans.catalog.journal_queries import SUMMARY
from cairn.sinks import trip_export

catalog = Catalog()

_TIMES = [*fv.TIME_OF_DAY_CATEGORIES, "noon"]


def _taste(spark, sf_dir):
    key = F.col("s_suppkey")
    return td.read(spark, sf_dir, "supplier").select(
        key.alias("request_id"), td.lat_of(key).alias("lat"), td.lng_of(key).alias("lng"),
        F.lit(8.0).alias("radius_km"),
        F.when(key % 3 == 0, F.array(td.category_of(F.col("s_nationkey")), F.lit("landmark")))
        .otherwise(strings([])).alias("favorites"),
        F.when(key % 3 == 1, F.array(F.lit("osm_node_1"))).otherwise(strings([])).alias("liked"),
        strings([]).alias("disliked"),
        F.element_at(strings(_TIMES), (key % 5 + 1).cast("int")).alias("time_of_day"))


_MOMENT = "CASE time_of_day " + " ".join(
    f"WHEN '{t}' THEN len(list_intersect(categories, {q.text_list(c)})) > 0"
    for t, c in fv.TIME_OF_DAY_CATEGORIES.items()) + " ELSE false END"
_RECOMMEND = f"""wishes AS (
  SELECT s_suppkey AS request_id, {q.lat('s_suppkey')} AS r_lat, {q.lng('s_suppkey')} AS r_lng,
    CASE WHEN s_suppkey % 3 = 0 THEN [{q.category('s_nationkey')}, 'landmark']
      ELSE []::VARCHAR[] END AS favorites, {q.text_list(_TIMES)}[s_suppkey % 5 + 1] AS time_of_day,
    CASE WHEN s_suppkey % 3 = 2 THEN 'cold_start' ELSE 'diverse' END AS strategy,
    degrees(8e0 / 6371e0) AS dlat,
    degrees(8e0 / (cos(radians({q.lat('s_suppkey')})) * 6371e0)) AS dlng FROM supplier),
cand AS (
  SELECT w.*, c.id, c.categories, c.confidence, {q.hav('r_lat', 'r_lng', 'lat', 'lng')} AS m,
    row_number() OVER (PARTITION BY request_id ORDER BY c.confidence DESC, c.ord) AS position
  FROM wishes w JOIN catalogue c ON lat BETWEEN r_lat - dlat AND r_lat + dlat
    AND lng BETWEEN r_lng - dlng AND r_lng + dlng
    AND (len(favorites) = 0 OR len(list_intersect(categories, favorites)) > 0)
  QUALIFY position <= 30),
crowd AS (SELECT request_id, position, count(*) AS crowded FROM (
  SELECT request_id, position, row_number() OVER (PARTITION BY request_id, cat ORDER BY position)
    AS nth FROM (SELECT request_id, position, unnest(categories) AS cat FROM cand))
  WHERE nth > 2 GROUP BY ALL),
facts AS (SELECT *, list_sort(list_intersect(categories, favorites)) AS shared,
  len(list_intersect(categories, {q.text_list(fv.UNUSUAL_CATEGORIES)})) > 0 AS unusual,
  {_MOMENT} AS moment FROM cand LEFT JOIN crowd USING (request_id, position)),
scored AS (SELECT *, {q.rnd('''greatest(0e0, least(1e0, confidence + len(shared) * 0.2e0
    + CASE WHEN unusual THEN 0.1e0 ELSE 0e0 END + CASE WHEN moment THEN 0.1e0 ELSE 0e0 END
    - coalesce(crowded, 0) * 0.15e0 - CASE WHEN round_even(m * 10e0, 0) / 10e0 > 5000
      THEN 0.05e0 ELSE 0e0 END))''', 2)} AS relevance_score,
  concat_ws('; ', CASE WHEN len(shared) > 0 THEN 'matches your interest in '
      || array_to_string(shared, ', ') END, CASE WHEN unusual THEN 'unusual find' END,
    CASE WHEN moment THEN 'great for ' || time_of_day END) AS why FROM facts)"""


@catalog.add(q.with_ctes(q.FULL, _RECOMMEND) + """
SELECT request_id, id, strategy, relevance_score,
  CASE WHEN why = '' THEN 'interesting place nearby' ELSE why END AS reason,
  row_number() OVER (PARTITION BY request_id ORDER BY relevance_score DESC, position)::INTEGER AS rank
FROM scored QUALIFY rank <= 10""")
def recommendations(spark, sf_dir):
    """TF-9, M-9, W-3, S-5, JN-20."""
    places = discovery.gather_sources(spark, td.SOURCE_LOADERS, sf_dir)
    found = recommendation.recommend(_taste(spark, sf_dir), discovery.build_catalogue(places))
    return found.select("request_id", "id", "strategy", "relevance_score", "reason", "rank")


def _regions(spark, sf_dir):
    key = F.col("c_custkey")
    return td.read(spark, sf_dir, "customer").select(
        key.alias("region_id"), td.lat_of(key).alias("min_lat"), td.lng_of(key).alias("min_lng"),
        td.lat_of(key, 300).alias("max_lat"), (td.lng_of(key) + 0.04).alias("max_lng"),
        (key % 4).cast("int").alias("min_zoom"), (key % 4 + 10).cast("int").alias("max_zoom"),
        F.when(key % 2 == 0, strings([])).otherwise(F.array(F.lit("landmark")))
        .alias("categories"))


_REGIONS = f"""regions AS (
  SELECT c_custkey AS region_id, {q.lat('c_custkey')} AS min_lat, {q.lng('c_custkey')} AS min_lng,
    {q.lat('c_custkey', 300)} AS max_lat, {q.lng('c_custkey')} + 0.04e0 AS max_lng,
    c_custkey % 4 AS z0, c_custkey % 4 + 10 AS z1, c_custkey % 2 = 0 AS any_category FROM customer)"""


def _tile_y(lat: str) -> str:
    return (f"trunc((1e0 - ln(tan(radians({lat})) + 1e0 / cos(radians({lat}))) / pi()) / 2"
            f" * pow(2e0, z))::BIGINT")


def _tile_x(lng: str) -> str:
    return f"trunc(({lng} + 180) / 360 * pow(2e0, z))::BIGINT"


@catalog.add(q.with_ctes(_REGIONS, "levels AS (SELECT *, unnest(range(z0, z1 + 1)) AS z FROM regions)")
             + f"""
SELECT region_id, tile_count, {q.rnd('tile_count * 15 / 1024e0', 2)} AS size_mb FROM (
  SELECT region_id, sum(({_tile_x('max_lng')} - {_tile_x('min_lng')} + 1)
    * ({_tile_y('min_lat')} - {_tile_y('max_lat')} + 1))::BIGINT AS tile_count
  FROM levels GROUP BY region_id)""")
def region_tiles(spark, sf_dir):
    """AG-25, M-5."""
    return offline.tile_counts(_regions(spark, sf_dir))


@catalog.add(q.with_ctes(q.PLACES, _REGIONS) + """
SELECT region_id, p.id FROM regions JOIN places p ON lat BETWEEN min_lat AND max_lat
  AND lng BETWEEN min_lng AND max_lng AND (any_category OR list_contains(categories, 'landmark'))""")
def region_cache(spark, sf_dir):
    """TF-13, FL-4, FL-6, SK-7."""
    places = discovery.gather_sources(spark, td.SOURCE_LOADERS, sf_dir).select(
        "id", "lat", "lng", "categories")
    return offline.cached_in_region(_regions(spark, sf_dir), places).select("region_id", "id")


def _queue(spark, sf_dir):
    key = F.col("o_orderkey")
    operation = (F.when(F.col("o_orderstatus") == "F", "create")
                 .when(F.col("o_orderstatus") == "O", "update").otherwise("delete"))
    return td.read(spark, sf_dir, "orders").select(
        F.when(key % 9 == 0, F.concat(F.lit("item/"), key)).otherwise(
            F.concat(F.lit("item"), key)).alias("id"),
        operation.alias("operation"), F.col("o_custkey").alias("resource_id"),
        F.when(key % 3 != 0, F.col("o_orderpriority")).alias("note"),
        F.col("o_orderdate").alias("created_at"), key.alias("ord"),
        (key % 4 == 0).alias("synced"),
        F.when(key % 4 == 0, F.col("o_orderdate")).alias("synced_at"))


_QUEUE = """queue AS (
  SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'item/' || o_orderkey ELSE 'item' || o_orderkey END AS id,
    CASE o_orderstatus WHEN 'F' THEN 'create' WHEN 'O' THEN 'update' ELSE 'delete' END AS operation,
    o_custkey AS resource_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS note,
    o_orderdate AS created_at, o_orderkey AS ord, o_orderkey % 4 = 0 AS synced FROM orders)"""


@catalog.add(q.with_ctes(_QUEUE) + """
SELECT id, operation, resource_id, note FROM queue WHERE NOT synced""")
def pending_queue(spark, sf_dir):
    """FL-14: what is still to be sent."""
    return changes.pending_items(_queue(spark, sf_dir)).select("id", "operation", "resource_id",
                                                               "note")


@catalog.add(q.with_ctes(_QUEUE) + """
SELECT id, synced OR id NOT LIKE '%/%' AS synced, CASE WHEN synced THEN
    strftime(created_at, '%Y-%m-%d %H:%M:%S') WHEN id NOT LIKE '%/%' THEN '2024-01-31 00:00:00' END
    AS synced_at FROM queue""")
def synced_queue(spark, sf_dir):
    """TF-17, FL-14."""
    now = F.lit(td.AS_OF).cast("timestamp")
    applied, _ = changes.apply_sync(_queue(spark, sf_dir), now)
    return applied.select("id", "synced", iso_second("synced_at").alias("synced_at"))


@catalog.add(q.with_ctes(_QUEUE) + """
SELECT count(*) FILTER (WHERE NOT synced AND id NOT LIKE '%/%') AS synced_count,
  count(*) FILTER (WHERE NOT synced AND id LIKE '%/%') AS failed_count FROM queue""")
def sync_counters(spark, sf_dir):
    """TF-17."""
    _, counters = changes.apply_sync(_queue(spark, sf_dir), F.lit(td.AS_OF).cast("timestamp"))
    return counters


@catalog.add(q.with_ctes(_QUEUE) + """
, folded AS (SELECT resource_id, arg_max(operation, struct_pack(t := created_at, o := ord)) AS last,
    arg_max(note, struct_pack(t := created_at, o := ord)) FILTER (WHERE note IS NOT NULL) AS note
  FROM queue WHERE NOT synced GROUP BY resource_id)
SELECT coalesce(c.c_custkey, f.resource_id) AS resource_id, coalesce(f.note, c.c_mktsegment) AS note
FROM customer c FULL JOIN folded f ON c.c_custkey = f.resource_id
WHERE f.last IS NULL OR f.last <> 'delete'""")
def merged_resources(spark, sf_dir):
    """TF-17 as a change-log merge, local wins."""
    server = td.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("resource_id"), F.col("c_mktsegment").alias("note"))
    return changes.merge_queue(server, _queue(spark, sf_dir), "resource_id", ["note"])


@catalog.add(q.with_ctes(_QUEUE, _REGIONS) + f"""
, parts AS (SELECT 'r' AS kind, 1 AS n, 100 + region_id % 50 AS b FROM regions
  UNION ALL SELECT 'p', 1, 2048 FROM part
  UNION ALL SELECT 'q', CASE WHEN synced THEN 0 ELSE 1 END, 300 FROM queue)
SELECT count(*) FILTER (WHERE kind = 'r') AS regions_count,
  count(*) FILTER (WHERE kind = 'p') AS cached_places_count,
  sum(n) FILTER (WHERE kind = 'q')::BIGINT AS pending_sync_count,
  sum(b)::BIGINT AS total_disk_usage_bytes, {fv.STORAGE_LIMIT_BYTES}::BIGINT AS storage_limit_bytes,
  {q.rnd(f'sum(b) / {fv.STORAGE_LIMIT_BYTES}e0 * 100', 1)} AS storage_used_percent FROM parts""")
def storage_status(spark, sf_dir):
    """AG-24."""
    regions = _regions(spark, sf_dir).select((F.lit(100) + F.col("region_id") % 50)
                                             .alias("file_bytes"))
    places = td.read(spark, sf_dir, "part").select(
        F.lit(fv.BYTES_PER_CACHED_PLACE).cast("bigint").alias("file_bytes"))
    queue = _queue(spark, sf_dir).select("synced", F.lit(300).cast("bigint").alias("file_bytes"))
    return offline.storage_status(regions, places, queue)


@catalog.add(q.with_ctes(q.PLACES) + f"""
, seekers AS (SELECT o_orderkey, {q.lat('o_orderkey', 1)} AS q_lat, {q.lng('o_orderkey')} AS q_lng,
  'wiki_Q' || o_custkey AS place_id FROM orders)
SELECT o_orderkey, name AS target_name, {q.rnd(q.hav('q_lat', 'q_lng', 'lat', 'lng'), 1)} AS distance_m,
  {q.rnd('''((degrees(atan2(sin(radians(lng - q_lng)) * cos(radians(lat)),
    cos(radians(q_lat)) * sin(radians(lat)) - sin(radians(q_lat)) * cos(radians(lat))
    * cos(radians(lng - q_lng)))) + 360e0) % 360e0)''', 1)} AS bearing_deg
FROM seekers JOIN places_wiki ON id = place_id""")
def navigation(spark, sf_dir):
    """JN-18, M-1, M-2."""
    key = F.col("o_orderkey")
    seekers = td.read(spark, sf_dir, "orders").select(
        "o_orderkey", td.lat_of(key, 1).alias("q_lat"), td.lng_of(key).alias("q_lng"),
        F.concat(F.lit("wiki_Q"), "o_custkey").alias("place_id"))
    return offline.navigate(seekers, td.places_wiki(spark, sf_dir)).select(
        "o_orderkey", "target_name", "distance_m", "bearing_deg")


@catalog.add(f"""
SELECT event_id AS id, epoch_us(TIMESTAMP '{td.AS_OF}') - epoch_us(ts) <= 86400000000 * 7 AS fresh
FROM events WHERE epoch_us(TIMESTAMP '{td.AS_OF}') - epoch_us(ts) <= 86400000000 * 7""")
def unexpired_entries(spark, sf_dir):
    """FL-15, D-5."""
    rows = td.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts")
    return filters.unexpired(rows, "ts", F.lit(td.AS_OF).cast("timestamp"), 7 * 86400).select(
        "id", F.lit(True).alias("fresh"))


_DEC = "regexp_replace(printf('%.2f', {0}), '0$', '')"
_DATE = "strftime({0}, '%Y-%m-%d %H:%M:%S') || '+00:00'"
_STARS = "repeat('⭐', round_even(average, 0)::INTEGER)"
_PARTS = """,
cuts AS (SELECT trip_id, string_split(content, chr(10)) AS l FROM whole),
parts AS (SELECT trip_id, l, unnest(range(0, (len(l) - 1) // 1000 + 1)) AS part FROM cuts)
SELECT trip_id, part::BIGINT AS part,
  md5(array_to_string(l[part * 1000 + 1:part * 1000 + 1000], chr(10))) AS content_hash FROM parts"""
_REPORT = """heads AS (SELECT t.*, coalesce(c.total_visited, 0) AS places,
  coalesce(p.total_distance_km, 0e0) AS km, coalesce(c.total_hours, 0e0) AS hours
  FROM trips t LEFT JOIN counts c USING (trip_id) LEFT JOIN path p USING (trip_id)),
best_rows AS (SELECT trip_id, label, row_number() OVER (PARTITION BY trip_id
  ORDER BY average DESC, visit_ord, ord) AS position FROM noted WHERE average > 0
  QUALIFY position <= 5)"""


@catalog.add(q.with_ctes(q.VISITS, q.NOTES, q.TRIPS, SUMMARY, _REPORT) + f"""
, best_text AS (SELECT trip_id, '## ⭐ Best Places' || chr(10)
    || string_agg('- ' || label, chr(10) ORDER BY position) || chr(10) || chr(10) AS b
  FROM best_rows GROUP BY trip_id),
place_text AS (SELECT v.trip_id, string_agg('- **' || coalesce(v.place_name, v.place_id) || '** — '
    || strftime(v.visited_at, '%Y-%m-%d %H:%M')
    || CASE WHEN r.text <> '' THEN chr(10) || '  > ' || r.text ELSE '' END
    || CASE WHEN r.average > 0 THEN chr(10) || '  Rating: ' || {_STARS} || ' ('
      || {_DEC.format('average')} || '/5)' ELSE '' END, chr(10) ORDER BY v.visited_at, v.ord) AS p
  FROM visits v LEFT JOIN rated r ON r.visit_id = v.id GROUP BY v.trip_id),
whole AS (SELECT trip_id, '# 🌍 ' || name || chr(10) || chr(10) || '**Region:** ' || region
  || chr(10) || '**Dates:** ' || {_DATE.format('start_date')} || ' — ' || {_DATE.format('end_date')}
  || chr(10) || '**Places visited:** ' || places || chr(10) || '**Distance:** ' || {_DEC.format('km')}
  || ' km' || chr(10) || '**Time:** ' || {_DEC.format('hours')} || ' hours' || chr(10) || chr(10)
  || coalesce(b, '') || '## 📍 Places' || chr(10) || p || chr(10) AS content
FROM heads LEFT JOIN best_text USING (trip_id) JOIN place_text USING (trip_id)){_PARTS}""")
def trip_markdown(spark, sf_dir):
    """SK-4, D-6."""
    seen, written = td.visits(spark, sf_dir), td.notes(spark, sf_dir)
    docs = trip_export.markdown(td.trips(spark, sf_dir), seen, written,
                                journal.trip_summary(seen, written))
    return docs.select("trip_id", "part", F.md5("content").alias("content_hash"))


_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@catalog.add(q.with_ctes(q.VISITS, q.NOTES, q.TRIPS, SUMMARY, _REPORT) + f"""
, best_text AS (SELECT trip_id, '<h2>⭐ Best Places</h2>' || chr(10)
    || string_agg('<li>' || label || '</li>', chr(10) ORDER BY position) || chr(10) || chr(10) AS b
  FROM best_rows GROUP BY trip_id),
place_text AS (SELECT v.trip_id, string_agg('<h3>' || coalesce(v.place_name, v.place_id) || '</h3>'
    || chr(10) || '<p class="date">' || strftime(v.visited_at, '%Y-%m-%d %H:%M') || '</p>'
    || CASE WHEN r.text <> '' THEN chr(10) || '<blockquote>' || {_ESC.format('r.text')}
      || '</blockquote>' ELSE '' END
    || CASE WHEN r.average > 0 THEN chr(10) || '<p class=''rating''>' || {_STARS} || ' ('
      || {_DEC.format('average')} || '/5)</p>' ELSE '' END, chr(10) ORDER BY v.visited_at, v.ord) AS p
  FROM visits v LEFT JOIN rated r ON r.visit_id = v.id GROUP BY v.trip_id),
whole AS (SELECT trip_id, '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10)
  || '<meta charset="UTF-8">' || chr(10) || '<title>' || {_ESC.format('name')} || ' — cairn</title>'
  || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '<h1>🌍 ' || {_ESC.format('name')}
  || '</h1>' || chr(10) || '<div class="meta">' || chr(10)
  || '<p><strong>Region:</strong> ' || region || '</p>' || chr(10) || '<p><strong>Dates:</strong> '
  || {_DATE.format('start_date')} || ' — ' || {_DATE.format('end_date')} || '</p>' || chr(10)
  || '<p><strong>Places visited:</strong> ' || places || '</p>' || chr(10)
  || '<p><strong>Distance:</strong> ' || {_DEC.format('km')} || ' km</p>' || chr(10)
  || '<p><strong>Time:</strong> ' || {_DEC.format('hours')} || ' hours</p>' || chr(10) || '</div>'
  || chr(10) || coalesce(b, '') || '<h2>📍 Places</h2>' || chr(10) || p || chr(10) || '</body>'
  || chr(10) || '</html>' AS content
FROM heads LEFT JOIN best_text USING (trip_id) JOIN place_text USING (trip_id)){_PARTS}""")
def trip_html(spark, sf_dir):
    """SK-5, ST-11."""
    seen, written = td.visits(spark, sf_dir), td.notes(spark, sf_dir)
    docs = trip_export.html(td.trips(spark, sf_dir), seen, written,
                            journal.trip_summary(seen, written))
    return docs.select("trip_id", "part", F.md5("content").alias("content_hash"))


@catalog.add(q.with_ctes(q.VISITS, q.TRIPS) + """
SELECT trip_id, name, count(*) FILTER (WHERE status = 'visited') AS total_places
FROM trips JOIN visits USING (trip_id) GROUP BY trip_id, name""")
def trip_json(spark, sf_dir):
    """SK-6, A-7: reports written as JSON and read back."""
    seen, written = td.visits(spark, sf_dir), td.notes(spark, sf_dir)
    docs = trip_export.json(td.trips(spark, sf_dir), journal.trip_summary(seen, written))
    back = docs.withColumn("r", F.from_json("content", "trip struct<name: string>, "
                                            "total_places bigint"))
    return back.select("trip_id", "r.trip.name", "r.total_places")


#: Call after call of each client and group, all clients side by side; the accepted times go along.
ADMISSION = """
WITH RECURSIVE calls AS (
  SELECT user_id, event_type, epoch_us(ts) AS us, event_id AS ord,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts), event_id) AS k FROM events),
walk AS (
  SELECT user_id, event_type, k, ord, true AS accepted, [us] AS times FROM calls WHERE k = 1
  UNION ALL
  SELECT user_id, event_type, k, ord, len(recent) < 5,
    CASE WHEN len(recent) < 5 THEN list_append(recent, us) ELSE recent END
  FROM (SELECT c.user_id, c.event_type, c.k, c.ord, c.us,
      list_filter(w.times, lambda t: c.us - t < 3600000000) AS recent
    FROM walk w JOIN calls c ON c.user_id = w.user_id AND c.event_type = w.event_type AND c.k = w.k + 1))
SELECT ord, accepted FROM walk"""


@catalog.add(ADMISSION)
def admitted_calls(spark, sf_dir):
    """ST-S4 as a batch: at most five calls per group and hour."""
    calls = td.api_calls(spark, sf_dir)
    return admission.admit_calls(calls, 5, 3600).select("ord", "accepted")


@catalog.add(f"""
SELECT event_id AS ord, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts)
    RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) <= {fv.RATE_LIMITS['llm']} AS within_limit
FROM events""")
def call_audit(spark, sf_dir):
    """W-9: sixty-second windows per client and group."""
    from cairn.operators.ordered import trailing_count
    counted = trailing_count(td.api_calls(spark, sf_dir), ["client", "grp"], "ts",
                             fv.RATE_WINDOW_SECONDS, "calls")
    return counted.select("ord", (F.col("calls") <= fv.RATE_LIMITS["llm"]).alias("within_limit"))
