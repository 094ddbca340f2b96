"""Routes: every order is a route from its customer's position through its line items' parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions.columns import strings
from cairn.operators import routes as ops
from cairn.plans import discovery, route_planning
from cairn.plans import testdata as td
from cairn.plans.catalog import Catalog
from cairn.plans.catalog import base as q

catalog = Catalog()

_MODES = ["walking", "cycling", "driving"]


def order_routes(spark, sf_dir):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    one_way = F.col("o_orderstatus") != "F"
    return td.read(spark, sf_dir, "orders").select(
        key.alias("route_id"), td.lat_of(customer).alias("o_lat"),
        td.lng_of(customer).alias("o_lng"), F.when(one_way, td.lat_of(key)).alias("d_lat"),
        F.when(one_way, td.lng_of(key)).alias("d_lng"),
        F.element_at(strings(_MODES), (key % 3 + 1).cast("int")).alias("mode"),
        (F.lit(1.0) + key % 24).alias("max_duration_hours"),
        (F.lit(1) + key % 5).cast("int").alias("max_waypoints"),
        (key % 2 == 0).alias("surprise_mode"), F.col("o_orderdate").alias("created_at"))


def order_stops(spark, sf_dir):
    part = F.col("l_partkey")
    lines = td.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("route_id"),
        F.struct("l_linenumber", "l_partkey").alias("position"), "l_partkey",
        F.concat(F.lit("osm_node_"), part).alias("id"), td.lat_of(part).alias("lat"),
        td.lng_of(part).alias("lng"), F.array(td.category_of(part)).alias("categories"))
    names = td.read(spark, sf_dir, "part").select("p_partkey", F.when(
        F.col("p_size") % 10 != 0, F.concat("p_name", F.lit(" & "), "p_type")).alias("name"),
        F.when(F.col("p_size") % 4 == 0, F.col("p_brand")).alias("description"))
    named = lines.join(names, lines["l_partkey"] == names["p_partkey"]).drop("p_partkey",
                                                                            "l_partkey")
    return route_planning.as_search_result(named)


def stopped_routes(spark, sf_dir):
    return route_planning.with_stops(order_routes(spark, sf_dir), order_stops(spark, sf_dir))


_ROUTES = f"""routes AS (
  SELECT o_orderkey AS route_id, {q.lat('o_custkey')} AS o_lat, {q.lng('o_custkey')} AS o_lng,
    CASE WHEN o_orderstatus <> 'F' THEN {q.lat('o_orderkey')} END AS d_lat,
    CASE WHEN o_orderstatus <> 'F' THEN {q.lng('o_orderkey')} END AS d_lng,
    {q.text_list(_MODES)}[o_orderkey % 3 + 1] AS mode,
    [1.4e0, 4.2e0, 11.1e0][o_orderkey % 3 + 1] AS speed,
    1e0 + o_orderkey % 24 AS hours, 1 + o_orderkey % 5 AS most, o_orderkey % 2 = 0 AS surprise,
    o_orderdate AS created_at FROM orders),
stops AS (
  SELECT l_orderkey AS route_id, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n,
    'osm_node_' || l_partkey AS id, {q.lat('l_partkey')} AS lat, {q.lng('l_partkey')} AS lng,
    CASE WHEN p_size % 10 <> 0 THEN p_name || ' & ' || p_type END AS name,
    CASE WHEN p_size % 4 = 0 THEN p_brand END AS description,
    {q.category('l_partkey')} AS cat
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_ENDS = """(SELECT route_id, 0 AS pos, 'origin_' || (route_id::VARCHAR)[1:8] AS id, 'Start' AS name,
    NULL::VARCHAR AS description, '' AS cat, o_lat AS lat, o_lng AS lng, true AS is_o,
    false AS is_d FROM routes
  UNION ALL SELECT route_id, 1000000, CASE WHEN d_lat IS NULL THEN 'return_' ELSE 'dest_' END
    || (route_id::VARCHAR)[1:8], CASE WHEN d_lat IS NULL THEN 'Return to Start' ELSE 'Destination' END,
    NULL, '', coalesce(d_lat, o_lat), coalesce(d_lng, o_lng), false, true FROM routes)"""
_POINTS = f"""points AS (
  SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY pos) - 1 AS i FROM (
    SELECT route_id, pos, id, name, description, cat, lat, lng, false AS is_o, false AS is_d
    FROM stops UNION ALL SELECT * FROM {_ENDS})),
legs AS (
  SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM points
  WINDOW w AS (PARTITION BY route_id ORDER BY i)),
metres AS (SELECT *, {q.hav('plat', 'plng', 'lat', 'lng')} AS m FROM legs WHERE i > 0),
sums AS (SELECT route_id, sum(m) AS m FROM metres GROUP BY route_id),
built AS (
  SELECT r.*, {q.rnd('s.m', 1)} AS total_m, {q.rnd('s.m / speed', 1)} AS total_s,
    coalesce(c.n, 0) AS n, CASE WHEN c.n IS NULL THEN 0e0 ELSE
      {q.rnd("greatest(0e0, s.m - " + q.hav('o_lat', 'o_lng', 'coalesce(d_lat, o_lat)', 'coalesce(d_lng, o_lng)') + ") / c.n", 1)}
    END AS detour_m
  FROM routes r JOIN sums s USING (route_id)
  LEFT JOIN (SELECT DISTINCT route_id, n FROM stops) c USING (route_id))"""


@catalog.add(q.with_ctes(_ROUTES, _POINTS) + f"""
, named AS (SELECT route_id, list(name ORDER BY pos) FILTER (WHERE name <> '') AS names FROM stops
  GROUP BY route_id)
SELECT route_id, total_m AS total_distance_m, total_s AS total_duration_s,
  n::INTEGER AS places_count, detour_m AS stop_detour_m, {q.rnd('detour_m / speed', 1)} AS stop_detour_s,
  CASE WHEN d_lat IS NULL THEN 'Circular' ELSE 'Point-To-Point' END || ' ' || mode || ' route: '
  || printf('%.1f', {q.rnd('total_m / 1000', 1)}) || ' km, ~' || CASE WHEN total_s >= 3600
    THEN floor(total_s / 3600)::BIGINT || 'h ' || floor((total_s % 3600e0) / 60)::BIGINT || 'min'
    ELSE floor((total_s % 3600e0) / 60)::BIGINT || 'min' END || ', ' || n || ' stops'
  || CASE WHEN coalesce(len(names), 0) = 0 THEN '' ELSE ' (' || array_to_string(names[1:5], ', ')
    || CASE WHEN len(names) > 5 THEN ' +' || (len(names) - 5) || ' more' ELSE '' END || ')' END
    AS summary
FROM built LEFT JOIN named USING (route_id)""")
def route_assembly(spark, sf_dir):
    """TF-7, AG-26, ST-13, D-4."""
    rows = ops.summary(ops.assemble(stopped_routes(spark, sf_dir)))
    return rows.select("route_id", "total_distance_m", "total_duration_s", "places_count",
                       "stop_detour_m", "stop_detour_s", "summary")


@catalog.add(q.with_ctes(_ROUTES, _POINTS) + f"""
SELECT route_id, i::INTEGER AS leg, {q.rnd('m', 1)} AS distance_m,
  {q.rnd('m / speed', 1)} AS duration_s, id AS to_id
FROM metres JOIN routes USING (route_id)""")
def route_segments(spark, sf_dir):
    """W-5."""
    rows = ops.assemble(stopped_routes(spark, sf_dir)).select(
        "route_id", "waypoints", F.posexplode("segments").alias("at", "s"))
    return rows.select("route_id", (F.col("at") + 1).alias("leg"), "s.distance_m", "s.duration_s",
                       F.element_at("waypoints", F.col("at") + 2)["id"].alias("to_id"))


_NUM = "regexp_replace(printf('%.4f', {0}), '0{{1,3}}$', '')"


def _num(value: str) -> str:
    return _NUM.format(value)


@catalog.add(q.with_ctes(_ROUTES, _POINTS) + f"""
, paths AS (SELECT route_id, string_agg({_num('lat')} || ',' || {_num('lng')}, '/' ORDER BY i) AS p
  FROM points GROUP BY route_id)
SELECT route_id, 'https://www.google.com/maps/dir/' || p AS google_maps,
  'geo:' || {_num('coalesce(d_lat, o_lat)')} || ',' || {_num('coalesce(d_lng, o_lng)')} AS geo,
  'osmand://navigate?lat=' || {_num('coalesce(d_lat, o_lat)')} || '&lon='
    || {_num('coalesce(d_lng, o_lng)')} AS osmand,
  'https://api.qrserver.com/v1/create-qr-code/?size=300x300&data='
    || url_encode('https://www.google.com/maps/dir/' || p) AS qr_data
FROM paths JOIN routes USING (route_id)""")
def route_links(spark, sf_dir):
    """ST-14."""
    return ops.links(ops.assemble(stopped_routes(spark, sf_dir))).select(
        "route_id", "google_maps", "geo", "osmand", "qr_data")


@catalog.add(q.with_ctes(_ROUTES).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, walk AS (
  SELECT route_id, 0 AS pos, 0e0 AS elapsed, o_lat AS lat, o_lng AS lng, '' AS kept, 0 AS n
  FROM routes
  UNION ALL
  SELECT route_id, pos, CASE WHEN fits THEN spent ELSE elapsed END,
    CASE WHEN fits THEN s_lat ELSE lat END, CASE WHEN fits THEN s_lng ELSE lng END,
    CASE WHEN fits THEN kept || id || ',' ELSE kept END, CASE WHEN fits THEN n + 1 ELSE n END
  FROM (SELECT *, spent + back <= hours * 3600 AS fits FROM (
    SELECT w.route_id, s.pos, w.elapsed, w.lat, w.lng, w.kept, w.n, s.id, s.lat AS s_lat,
      s.lng AS s_lng, r.hours,
      w.elapsed + {q.hav('w.lat', 'w.lng', 's.lat', 's.lng')} / r.speed + 600e0 AS spent,
      CASE WHEN r.d_lat IS NULL THEN {q.hav('s.lat', 's.lng', 'r.o_lat', 'r.o_lng')} / r.speed
        ELSE 0e0 END AS back
    FROM walk w JOIN stops s ON s.route_id = w.route_id AND s.pos = w.pos + 1
    JOIN routes r ON r.route_id = w.route_id)))
SELECT route_id, arg_max(kept, pos) AS kept, arg_max(n, pos)::INTEGER AS stops FROM walk
GROUP BY route_id""")
def route_budget(spark, sf_dir):
    """TF-4."""
    rows = ops.fit_budget(stopped_routes(spark, sf_dir))
    return rows.select("route_id", F.concat_ws("", F.transform("stops", lambda s: F.concat(
        s["id"], F.lit(",")))).alias("kept"), F.size("stops").alias("stops"))


@catalog.add(q.with_ctes(_ROUTES) + """
SELECT route_id, coalesce(string_agg(CASE WHEN surprise THEN 'Mystery Stop #' || pos || '|'
    || coalesce(name, '-') ELSE coalesce(name, '-') END, ',' ORDER BY pos)
  FILTER (WHERE pos <= most), '') AS shown
FROM routes LEFT JOIN stops USING (route_id) GROUP BY route_id""")
def surprise_stops(spark, sf_dir):
    """ST-15, S-7."""
    rows = ops.mask_stops(ops.cap_stops(stopped_routes(spark, sf_dir)))
    return rows.select("route_id", F.array_join(F.transform("stops", lambda s: F.when(
        F.startswith(s["name"], F.lit("Mystery")), F.concat(s["name"], F.lit("|"), F.coalesce(
            s["metadata"]["_surprise_original_name"], F.lit("-"))))
        .otherwise(F.coalesce(s["name"], F.lit("-")))), ",").alias("shown"))


@catalog.add(q.with_ctes(_ROUTES) + f"""
, asked AS (SELECT route_id, route_id % 7 = 0 AND count(pos) > 0 AS bad
  FROM routes LEFT JOIN stops USING (route_id) GROUP BY route_id),
turned AS (SELECT s.route_id, n - pos AS npos, id, lat, lng FROM stops s),
pts AS (SELECT route_id, npos + 1 AS i, id, lat, lng FROM turned
  UNION ALL SELECT route_id, 0, '', o_lat, o_lng FROM routes
  UNION ALL SELECT route_id, 1000000, '', coalesce(d_lat, o_lat), coalesce(d_lng, o_lng) FROM routes),
sums AS (SELECT route_id, sum(m) AS m FROM (SELECT route_id,
  {q.hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} AS m FROM pts
  WINDOW w AS (PARTITION BY route_id ORDER BY i)) GROUP BY route_id)
SELECT a.route_id, NOT bad AS accepted,
  CASE WHEN NOT bad THEN {q.rnd('m', 1)} END AS total_distance_m,
  CASE WHEN NOT bad THEN coalesce((SELECT string_agg(id, ',' ORDER BY npos) FROM turned t
    WHERE t.route_id = a.route_id), '') END AS stops
FROM asked a JOIN sums USING (route_id)""")
def reordered_routes(spark, sf_dir):
    """TF-8, A-6: routes turned around; every seventh with stops asks for a position that
    does not exist."""
    rows = stopped_routes(spark, sf_dir)
    turned = F.when(F.size("stops") > 0, F.reverse(F.sequence(F.lit(0), F.size("stops") - 1))) \
        .otherwise(F.array().cast("array<int>"))
    asked = rows.withColumn("wanted", F.when(F.col("route_id") % 7 == 0, F.transform(
        turned, lambda i: i + 1)).otherwise(turned))
    good, bad = ops.reorder(asked, "wanted")
    ids = F.array_join(F.transform("stops", lambda s: s["id"]), ",")
    return good.select("route_id", F.lit(True).alias("accepted"), "total_distance_m",
                       ids.alias("stops")).unionByName(bad.select(
                           "route_id", F.lit(False).alias("accepted"),
                           F.lit(None).cast("double").alias("total_distance_m"),
                           F.lit(None).cast("string").alias("stops")))


_XML = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_FACTS = (f"'Mode: ' || mode || ', Distance: ' || printf('%.1f', {q.rnd('total_m / 1000', 1)})"
          f" || ' km, Duration: ' || printf('%.1f', {q.rnd('total_s / 3600', 1)}) || 'h, Stops: ' || n")
_WNAME = _XML.format("coalesce(nullif(name, ''), 'Point ' || i)")
_NL = "chr(10)"


@catalog.add(q.with_ctes(_ROUTES, _POINTS) + f"""
, body AS (SELECT route_id, string_agg('  <wpt lat="' || {_num('lat')} || '" lon="' || {_num('lng')}
    || '">' || {_NL} || '    <name>' || {_WNAME} || '</name>'
    || coalesce({_NL} || '    <desc>' || {_XML.format('description')} || '</desc>', '')
    || CASE WHEN cat <> '' THEN {_NL} || '    <type>' || cat || '</type>' ELSE '' END
    || {_NL} || '  </wpt>', {_NL} ORDER BY i) AS w,
  string_agg('      <trkpt lat="' || {_num('lat')} || '" lon="' || {_num('lng')} || '" />',
    {_NL} ORDER BY i) AS t FROM points GROUP BY route_id)
SELECT route_id, md5('<?xml version="1.0" encoding="UTF-8"?>' || {_NL}
  || '<gpx version="1.1" creator="cairn" xmlns="http://www.topografix.com/GPX/1/1" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://www.topografix.com/GPX/1/1 http://www.topografix.com/GPX/1/1/gpx.xsd">'
  || {_NL} || '  <metadata>' || {_NL} || '    <name>cairn Route (' || n || ' places)</name>' || {_NL}
  || '    <time>' || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || '</time>' || {_NL}
  || '    <desc>' || {_FACTS} || '</desc>' || {_NL} || '  </metadata>' || {_NL} || w || {_NL}
  || '  <trk>' || {_NL} || '    <name>Route (' || mode || ')</name>' || {_NL} || '    <trkseg>'
  || {_NL} || t || {_NL} || '    </trkseg>' || {_NL} || '  </trk>' || {_NL} || '</gpx>') AS gpx_hash
FROM built JOIN body USING (route_id)""")
def gpx_exports(spark, sf_dir):
    """SK-2."""
    return ops.gpx(ops.assemble(stopped_routes(spark, sf_dir))).select(
        "route_id", F.md5("gpx").alias("gpx_hash"))


_KML_STYLES = " || chr(10) || ".join(f"'{line}'" for line in fv.KML_STYLES.split("\n"))


@catalog.add(q.with_ctes(_ROUTES, _POINTS) + f"""
, body AS (SELECT route_id, string_agg('    <Placemark>' || {_NL} || '      <name>' || {_WNAME}
    || '</name>' || {_NL} || '      <styleUrl>#' || CASE WHEN is_o THEN 'startStyle'
      WHEN is_d THEN 'endStyle' ELSE 'waypointStyle' END || '</styleUrl>'
    || coalesce({_NL} || '      <description>' || {_XML.format('description')} || '</description>', '')
    || {_NL} || '      <Point>' || {_NL} || '        <coordinates>' || {_num('lng')} || ',' || {_num('lat')}
    || ',0</coordinates>' || {_NL} || '      </Point>' || {_NL} || '    </Placemark>', {_NL} ORDER BY i) AS w,
  string_agg({_num('lng')} || ',' || {_num('lat')} || ',0', ' ' ORDER BY i) AS t
  FROM points GROUP BY route_id)
SELECT route_id, md5('<?xml version="1.0" encoding="UTF-8"?>' || {_NL}
  || '<kml xmlns="http://www.opengis.net/kml/2.2">' || {_NL} || '  <Document>' || {_NL}
  || '    <name>cairn Route (' || n || ' places)</name>' || {_NL} || '    <description>' || {_FACTS}
  || '</description>' || {_NL} || {_KML_STYLES} || {_NL} || w || {_NL} || '    <Placemark>' || {_NL}
  || '      <name>Route (' || mode || ')</name>' || {_NL} || '      <styleUrl>#routeStyle</styleUrl>'
  || {_NL} || '      <LineString>' || {_NL} || '        <tessellate>1</tessellate>' || {_NL}
  || '        <coordinates>' || t || '</coordinates>' || {_NL} || '      </LineString>' || {_NL}
  || '    </Placemark>' || {_NL} || '  </Document>' || {_NL} || '</kml>') AS kml_hash
FROM built JOIN body USING (route_id)""")
def kml_exports(spark, sf_dir):
    """SK-3."""
    return ops.kml(ops.assemble(stopped_routes(spark, sf_dir))).select(
        "route_id", F.md5("kml").alias("kml_hash"))


@catalog.add(q.with_ctes(_ROUTES) + """
SELECT route_id, 'A route through ' || count(pos) || ' stops: ' || coalesce(string_agg(
  coalesce(nullif(name, ''), 'unnamed stop'), ', ' ORDER BY pos) FILTER (WHERE pos IS NOT NULL), '')
  || '. Explore each one!' AS story
FROM routes LEFT JOIN stops USING (route_id) GROUP BY route_id""")
def route_stories(spark, sf_dir):
    """ST-16 route story."""
    from cairn.functions import text
    rows = stopped_routes(spark, sf_dir)
    return rows.select("route_id", text.route_story(F.transform("stops", lambda s: s["name"]),
                                                    F.lit("en")).alias("story"))


@catalog.add()
def optimized_routes(spark, sf_dir):
    """TF-3: a tour search has no SQL form; tests check it against brute force and a plain walk."""
    rows = ops.assemble(ops.order_stops(stopped_routes(spark, sf_dir)))
    return rows.select("route_id", F.array_join(F.transform("stops", lambda s: s["id"]), ",")
                       .alias("stops"), "total_distance_m")


def _plan_requests(spark, sf_dir):
    key = F.col("s_suppkey")
    one_way = key % 3 != 0
    return td.read(spark, sf_dir, "supplier").select(
        key.alias("route_id"), td.lat_of(key).alias("o_lat"), td.lng_of(key).alias("o_lng"),
        F.when(one_way, td.lat_of(key, 700)).alias("d_lat"),
        F.when(one_way, td.lng_of(key) + 0.05).alias("d_lng"), F.lit("cycling").alias("mode"),
        F.lit(4.0).alias("max_duration_hours"), strings([]).alias("categories"),
        F.lit(2.0).alias("corridor_width_km"), F.lit(10).alias("max_waypoints"),
        F.lit(True).alias("optimize"), F.lit(False).alias("surprise_mode"),
        F.lit(5.0).alias("radius_km"), F.lit(200).alias("max_candidates"))


def _catalogue(spark, sf_dir):
    return discovery.build_catalogue(discovery.gather_sources(spark, td.SOURCE_LOADERS, sf_dir))


_CORRIDOR_SEARCH = f"""plan AS (
  SELECT s_suppkey AS request_id, {q.lat('s_suppkey')} AS o_lat, {q.lng('s_suppkey')} AS o_lng,
    CASE WHEN s_suppkey % 3 <> 0 THEN {q.lat('s_suppkey', 700)} END AS d_lat,
    CASE WHEN s_suppkey % 3 <> 0 THEN {q.lng('s_suppkey')} + 0.05e0 END AS d_lng FROM supplier),
search AS (SELECT *, (o_lat + coalesce(d_lat, o_lat)) / 2 AS r_lat,
    (o_lng + coalesce(d_lng, o_lng)) / 2 AS r_lng,
    least(50e0, greatest(4e0, {q.hav('o_lat', 'o_lng', 'coalesce(d_lat, o_lat)', 'coalesce(d_lng, o_lng)')}
      / 1000e0 + 2e0)) AS radius_km FROM plan),
areas AS (SELECT *, degrees(radius_km / 6371e0) AS dlat,
    degrees(radius_km / (cos(radians(r_lat)) * 6371e0)) AS dlng FROM search),
hit AS (SELECT a.request_id, o_lat, o_lng, d_lat, d_lng, c.id, c.lat, c.lng, c.confidence, c.ord
  FROM areas a JOIN catalogue c ON c.lat BETWEEN r_lat - dlat AND r_lat + dlat
    AND c.lng BETWEEN r_lng - dlng AND r_lng + dlng),
flat AS (SELECT *, cos(radians((o_lat + d_lat) / 2e0)) * 111320e0 AS per_lng FROM hit),
xy AS (SELECT *, (lng - o_lng) * per_lng AS px, (lat - o_lat) * 111320e0 AS py,
  (d_lng - o_lng) * per_lng AS dx, (d_lat - o_lat) * 111320e0 AS dy FROM flat),
u AS (SELECT *, greatest(0e0, least(1e0, (px * dx + py * dy) / (dx * dx + dy * dy))) AS t FROM xy)"""


@catalog.add(q.with_ctes(q.FULL, _CORRIDOR_SEARCH) + """
SELECT request_id AS route_id, id,
  row_number() OVER (PARTITION BY request_id ORDER BY confidence DESC, ord)::INTEGER AS position
FROM u WHERE d_lat IS NULL
  OR sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)) <= 2000e0
QUALIFY request_id % 2 = 0 OR position <= 20""")
def corridor_candidates(spark, sf_dir):
    """TF-5 search and corridor: JN-12, FL-13, M-7, S-1; every second request takes all places."""
    requests = _plan_requests(spark, sf_dir).withColumn(
        "max_candidates", F.when(F.col("route_id") % 2 != 0, 20))
    return route_planning.candidates(requests, _catalogue(spark, sf_dir)).select(
        "route_id", "id", "position")


@catalog.add()
def planned_routes(spark, sf_dir):
    """TF-5: point-to-point and circular routes; ordered by the tour search, so no SQL."""
    return route_planning.build_routes(_plan_requests(spark, sf_dir), _catalogue(
        spark, sf_dir)).select("route_id", "candidates", "places_count", "total_distance_m",
                               "total_duration_s", "summary", "google_maps")


@catalog.add()
def explore_routes(spark, sf_dir):
    """TF-6: circular routes around an origin; ordered by the tour search, so no SQL."""
    return route_planning.build_explore_routes(_plan_requests(spark, sf_dir), _catalogue(
        spark, sf_dir)).select("route_id", "candidates", "places_count", "total_distance_m",
                               "total_duration_s", "summary", "google_maps")
