"""Source parsers, each fed with payloads that Spark derives from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions.columns import strings
from cairn.plans import testdata as td
from cairn.plans.catalog import Catalog
from cairn.plans.catalog import base as q
from cairn.sources import atlas, osm, research, stores, wikidata

catalog = Catalog()

_PAIRS = [pair.split(":") for pair in fv.OSM_TAG_CATEGORIES]


def osm_payloads(spark, sf_dir):
    """One Overpass-like answer per part: nodes, ways with a centre, ways without one."""
    key, size = F.col("p_partkey"), F.col("p_size")
    at = (key % len(_PAIRS) + 1).cast("int")
    tag_key = F.element_at(strings(k for k, _ in _PAIRS), at)
    tag_value = F.element_at(strings(v for _, v in _PAIRS), at)
    tags = F.map_concat(
        F.create_map(F.when(size % 2 == 0, "name").otherwise("name:en"), F.col("p_name"),
                     F.lit("note"), F.col("p_brand")),
        F.when(size % 6 == 0, F.create_map(F.lit("disused"), F.lit("yes")))
        .otherwise(F.create_map(F.lit("source"), F.lit("survey"))),
        F.when(size % 3 == 0, F.create_map(F.lit("wikipedia"), F.lit("en:x")))
        .otherwise(F.create_map(F.lit("stars_note"), F.lit("4"))),
        F.create_map(tag_key, tag_value))
    node = key % 4 < 2
    lost = (key % 4 == 3) & (size % 7 == 0)
    element = F.struct(
        F.when(node, "node").otherwise("way").alias("type"), key.alias("id"),
        F.when(node, td.lat_of(key)).alias("lat"), F.when(node, td.lng_of(key)).alias("lon"),
        F.when(~node & ~lost, F.struct(td.lat_of(key).alias("lat"), td.lng_of(key).alias("lon")))
        .alias("center"), tags.alias("tags"))
    return td.read(spark, sf_dir, "part").select(
        key.alias("payload_id"), F.to_json(F.struct(F.array(element).alias("elements")))
        .alias("payload"))


_TAGS = f"""tagged AS (
  SELECT p_partkey AS k, p_size AS s, p_name, p_brand,
    {q.text_list(k for k, _ in _PAIRS)}[p_partkey % {len(_PAIRS)} + 1] AS tk,
    {q.text_list(v for _, v in _PAIRS)}[p_partkey % {len(_PAIRS)} + 1] AS tv FROM part),
osm_raw AS (
  SELECT k, s, CASE WHEN k % 4 < 2 THEN 'node' ELSE 'way' END AS type, map_concat(
    MAP([CASE WHEN s % 2 = 0 THEN 'name' ELSE 'name:en' END, 'note'], [p_name, p_brand]),
    CASE WHEN s % 6 = 0 THEN MAP(['disused'], ['yes']) ELSE MAP(['source'], ['survey']) END,
    CASE WHEN s % 3 = 0 THEN MAP(['wikipedia'], ['en:x']) ELSE MAP(['stars_note'], ['4']) END,
    MAP([tk], [tv])) AS tags
  FROM tagged WHERE NOT (k % 4 = 3 AND s % 7 = 0)),
tag_rules(tk, tv, cats) AS (VALUES {', '.join(f"('{k}', '{v}', {q.text_list(c)})" for (k, v), c in zip(_PAIRS, fv.OSM_TAG_CATEGORIES.values()))}),
entries AS (SELECT k, unnest(map_entries(tags)) AS e FROM osm_raw),
mapped AS (SELECT k, unnest(cats) AS cat FROM entries JOIN tag_rules
  ON e.key = tk AND e.value = tv
  UNION SELECT k, unnest(['industrial', 'abandoned']) FROM osm_raw
    WHERE tags['building'] = 'industrial' AND tags['disused'] = 'yes'),
kept AS (SELECT m.k, cat FROM mapped m JOIN osm_raw o USING (k)
  WHERE cat NOT IN ('restaurant_notable', 'hotel_notable')
    OR len(list_intersect(map_keys(tags), {q.text_list(fv.OSM_NOTABLE_MARKERS)})) > 0),
cats AS (SELECT k, string_agg(cat, ',' ORDER BY cat) AS categories FROM kept GROUP BY k),
tag_lists AS (SELECT k, string_agg(e.key || '=' || e.value, ',' ORDER BY e.key) AS tag_list
  FROM entries WHERE e.key NOT IN ('source', 'created_by', 'building', 'type')
    AND length(e.value) < 100 GROUP BY k)"""


@catalog.add(q.with_ctes(_TAGS) + f"""
SELECT 'osm_' || o.type || '_' || o.k AS id, coalesce(tags['name'], tags['name:en']) AS name,
  tags['note'] AS description, coalesce(categories, '') AS categories, {q.lat('o.k')} AS lat,
  {q.lng('o.k')} AS lng, CASE WHEN categories IS NULL THEN 0.4e0 ELSE 0.7e0 END AS confidence,
  coalesce(tag_list, '') AS tags
FROM osm_raw o LEFT JOIN cats USING (k) LEFT JOIN tag_lists USING (k)""")
def osm_places(spark, sf_dir):
    """SC-1, SC-2, JN-9, ST-12."""
    return osm.places(osm_payloads(spark, sf_dir)).select(
        "id", "name", "description", F.array_join("categories", ",").alias("categories"), "lat",
        "lng", "confidence", F.array_join(F.array_sort("tags"), ",").alias("tags"))


def _clause_sql() -> str:
    def term(key, operator, value):
        tag = f"tags['{key}']"
        return {"=": f"{tag} = '{value}'", "?": f"{tag} IS NOT NULL",
                "~": f"regexp_matches({tag}, '{value}')"}[operator]
    return " OR ".join("(" + " AND ".join(term(*t) for t in c) + ")"
                       for c in fv.OSM_FEATURE_CLAUSES)


@catalog.add(q.with_ctes(_TAGS) + f"""
SELECT k AS osm_id, coalesce({_clause_sql()}, false) AS wanted FROM osm_raw""")
def osm_features(spark, sf_dir):
    """SC-3."""
    return osm.elements(osm_payloads(spark, sf_dir)).select(
        "osm_id", osm.wanted_feature().alias("wanted"))


_ATLAS_LABELS = [*fv.ATLAS_CATEGORIES, "Nothing Known"]


def atlas_payloads(spark, sf_dir):
    """One answer per customer, as root list, ``places`` or ``results``; some latitudes are bad."""
    key = F.col("c_custkey")
    label = F.element_at(strings(_ATLAS_LABELS), (key % len(_ATLAS_LABELS) + 1).cast("int"))
    item = F.struct(
        key.cast("string").alias("id"), F.when(key % 3 != 0, F.col("c_name")).alias("title"),
        F.concat(F.lit("Alt "), "c_name").alias("name"), F.col("c_mktsegment").alias("subtitle"),
        F.when(key % 11 == 0, F.lit("north")).when(key % 13 == 0, F.lit("91.5")).otherwise(
            F.format_string("%.4f", td.lat_of(key))).alias("lat"),
        td.lng_of(key).alias("lng"), F.array(F.concat(F.lit(" "), F.upper(label)))
        .alias("categories"), F.array(F.col("c_mktsegment"), F.lit("caves")).alias("tags"),
        F.when(key % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("p"), key)).alias("photo"))
    one = F.to_json(F.array(item))
    payload = (F.when(key % 3 == 0, one)
               .when(key % 3 == 1, F.concat(F.lit('{"places": '), one, F.lit("}")))
               .otherwise(F.concat(F.lit('{"results": '), one, F.lit("}"))))
    return td.read(spark, sf_dir, "customer").select(key.alias("payload_id"),
                                                     payload.alias("payload"))


@catalog.add(f"""
WITH labels(label, cats) AS (VALUES {', '.join("('{}', {})".format(k, q.text_list(c)) for k, c in fv.ATLAS_CATEGORIES.items())}),
items AS (SELECT *, [lower({q.text_list(_ATLAS_LABELS)}[c_custkey % {len(_ATLAS_LABELS)} + 1]),
  lower(c_mktsegment), 'caves'] AS names FROM customer
  WHERE NOT (c_custkey % 11 = 0 OR c_custkey % 13 = 0)),
cats AS (SELECT c_custkey, string_agg(cat, ',' ORDER BY cat) AS categories FROM (
  SELECT DISTINCT c_custkey, unnest(cats) AS cat FROM (
    SELECT c_custkey, unnest(names) AS label FROM items) JOIN labels USING (label))
  GROUP BY c_custkey)
SELECT 'atlas_' || c_custkey AS id,
  CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE 'Alt ' || c_name END AS name,
  c_mktsegment AS description, coalesce(categories, 'landmark') AS categories,
  {q.lat('c_custkey')} AS lat, {q.lng('c_custkey')} AS lng,
  CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'p' || c_custkey END AS photos
FROM items LEFT JOIN cats USING (c_custkey)""")
def atlas_places(spark, sf_dir):
    """SC-4, JN-10."""
    return atlas.places(atlas_payloads(spark, sf_dir)).select(
        "id", "name", "description", F.array_join("categories", ",").alias("categories"), "lat",
        "lng", F.array_join("photos", ",").alias("photos"))


@catalog.add("""SELECT 'atlas_' || c_custkey AS id FROM customer
WHERE c_custkey % 11 = 0 OR c_custkey % 13 = 0""")
def atlas_rejects(spark, sf_dir):
    """SC-4: the quarantined items."""
    return atlas.rejected(atlas_payloads(spark, sf_dir)).select("id")


@catalog.add(f"""
WITH spots AS (SELECT page_id, {q.lat('page_id')} AS lat, {q.lng('page_id')} AS lng FROM pages)
SELECT 'atlas_html_' || md5('Place ' || page_id)[1:8] AS id, 'Place ' || page_id AS name, lat, lng
FROM spots WHERE lat BETWEEN 42.1::DOUBLE AND 42.5::DOUBLE
  AND lng BETWEEN 18.5::DOUBLE AND 19.1::DOUBLE""")
def html_places(spark, sf_dir):
    """SC-5: a result entry appended to each page; the whole page is searched."""
    key = F.col("page_id")
    entry = F.format_string(
        '<div data-lat="%.4f"\n data-lng="%.4f"><b>x</b>\n<h3 class="title big" id="t"> Place %d </h3></div>',
        td.lat_of(key), td.lng_of(key), key)
    pages = td.read(spark, sf_dir, "pages").select(
        key.alias("payload_id"), F.concat("html", entry).alias("html"), F.lit(42.1).alias("south"),
        F.lit(18.5).alias("west"), F.lit(42.5).alias("north"), F.lit(19.1).alias("east"))
    return atlas.html_places(pages).select("id", "name", "lat", "lng")


_TYPES = [*fv.WIKIDATA_TYPES, "Q999"]


def wikidata_payloads(spark, sf_dir):
    """One answer per supplier; every entity comes twice, the second time under another name."""
    key = F.col("s_suppkey")
    qid = F.concat(F.lit("Q"), key)

    def value(column):
        return F.struct(column.alias("value"))

    def binding(extra):
        return F.struct(
            value(F.concat(F.lit("http://www.example.org/entity/"), qid)).alias("item"),
            value(F.when(key % 4 == 0, qid).otherwise(F.concat("s_name", extra)))
            .alias("itemLabel"),
            value(F.when(key % 10 == 0, F.lit("Punkt(1 2)")).otherwise(F.format_string(
                "Point(%.4f %.4f)", td.lng_of(key), td.lat_of(key)))).alias("coord"),
            value(F.concat(F.lit("http://www.example.org/entity/"), F.element_at(
                strings(_TYPES), (key % len(_TYPES) + 1).cast("int")))).alias("type"),
            F.when(key % 3 == 0, value(F.concat(F.lit("https://en/"), key))).alias("sitelink"))

    bindings = F.array(binding(F.lit("")), binding(F.lit(" again")))
    return td.read(spark, sf_dir, "supplier").select(
        key.alias("payload_id"),
        F.to_json(F.struct(F.struct(bindings.alias("bindings")).alias("results")))
        .alias("payload"))


@catalog.add(f"""
WITH types(qid, cats) AS (VALUES {', '.join(f"('{k}', '{','.join(c)}')" for k, c in fv.WIKIDATA_TYPES.items())}),
s AS (SELECT *, {q.text_list(_TYPES)}[s_suppkey % {len(_TYPES)} + 1] AS type_qid FROM supplier
  WHERE s_suppkey % 10 <> 0)
SELECT 'wiki_Q' || s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name,
  coalesce(cats, 'landmark') AS categories, {q.lat('s_suppkey')} AS lat,
  {q.lng('s_suppkey')} AS lng, CASE WHEN s_suppkey % 3 = 0 THEN 0.6e0 ELSE 0.7e0 END AS confidence,
  CASE WHEN s_suppkey % 3 = 0 THEN 'https://en/' || s_suppkey END AS url, type_qid
FROM s LEFT JOIN types ON qid = type_qid""")
def wikidata_places(spark, sf_dir):
    """SC-6, SC-7, JN-11, W-6."""
    return wikidata.places(wikidata_payloads(spark, sf_dir)).select(
        "id", "name", F.array_join("categories", ",").alias("categories"), "lat", "lng",
        "confidence", F.try_element_at("metadata", F.lit("wikipedia_url")).alias("url"),
        F.col("metadata")["type_qid"].alias("type_qid"))


_HINTS = ["street art", "Cave", "unknown", "", "museum"]


def research_payloads(spark, sf_dir):
    """One answer per document, in turn: list, wrapper, single object, list in text, objects in
    text, prose. The document's own text is part of every free-text answer."""
    key = F.col("doc_id")
    item = F.struct(
        F.concat(F.lit("Old fort "), key).alias("name"),
        F.when(key % 9 == 0, F.lit(0.0)).otherwise(td.lat_of(key)).alias("lat"),
        F.when(key % 9 == 0, F.lit(0.0)).otherwise(td.lng_of(key)).alias("lng"),
        F.concat(F.lit("wine near "), "source").alias("description"),
        F.element_at(strings(_HINTS), (key % 5 + 1).cast("int")).alias("category"),
        F.when(key % 2 == 0, F.lit("by boat")).otherwise("").alias("access_info"),
        F.when(key % 4 == 0, F.lit("slippery")).alias("safety_notes"))
    one = F.to_json(item)
    # free text must not contain brackets of its own
    prose = F.regexp_replace("text", r"[\[\]{}*#]", " ")
    kind = key % 6
    payload = (
        F.when(kind == 0, F.concat(F.lit("["), one, F.lit("]")))
        .when(kind == 1, F.concat(F.lit('{"pois": ['), one, F.lit("]}")))
        .when(kind == 2, one)
        .when(kind == 3, F.concat(prose, F.lit("\n```json\n["), one, F.lit("]\n```")))
        .when(kind == 4, F.concat(prose, F.lit("\n"), one, F.lit("\nend")))
        .otherwise(F.concat(prose, F.lit("\n## Old fort "), key, F.lit(": \n**Old fort "), key,
                            F.lit(":** at "), F.format_string("(%.4f, %.4f)", td.lat_of(key),
                                                              td.lng_of(key)))))
    return td.read(spark, sf_dir, "documents").select(
        key.alias("payload_id"), F.lit("x").alias("provider"), payload.alias("payload"))


@catalog.add(f"""
WITH d AS (SELECT *, doc_id % 6 = 5 AS prose,
    CASE WHEN doc_id % 6 = 5 THEN 'O' ELSE 'Old fort ' || doc_id END AS name FROM documents
  WHERE doc_id % 6 = 5 OR doc_id % 9 <> 0),
hints AS (SELECT *, {q.text_list(_HINTS)}[doc_id % 5 + 1] AS hint FROM d)
SELECT 'dr_x_' || md5(name)[1:8] AS id, name,
  CASE WHEN NOT prose THEN 'wine near ' || source
    || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '📍 by boat' ELSE '' END
    || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '⚠️ slippery' ELSE '' END END AS description,
  CASE WHEN prose THEN 'landmark' ELSE array_to_string(list_sort(list_distinct(list_concat(
    ['culinary', 'military'], CASE hint WHEN 'street art' THEN ['nature_hidden', 'street_art']
      WHEN 'Cave' THEN ['cave'] WHEN 'museum' THEN ['museum'] ELSE []::VARCHAR[] END))), ',') END
    AS categories,
  {q.lat('doc_id')} AS lat, {q.lng('doc_id')} AS lng,
  CASE WHEN prose THEN 0.6e0 ELSE 0.75e0 END AS confidence,
  CASE WHEN prose THEN 0 ELSE 1 END AS tags
FROM hints""")
def research_places(spark, sf_dir):
    """SC-8, SC-9, SC-10, SC-11, ST-3. The prose pattern is lazy: it names a place by one letter."""
    return research.places(research_payloads(spark, sf_dir)).select(
        "id", "name", "description", F.array_join("categories", ",").alias("categories"), "lat",
        "lng", "confidence", F.size("tags").alias("tags"))


_STORE = ("id string, place_id string, coordinates struct<lat: double, lng: double>, "
          "visited_at timestamp")


@catalog.add(q.with_ctes(q.VISITS) + f"""
SELECT 'visit_' || id AS store_key, id::VARCHAR AS id, place_id, lat, lng,
  strftime(visited_at, '%Y-%m-%d %H:%M:%S') AS visited_at FROM visits WHERE id % 50 <> 7""")
def visit_store(spark, sf_dir):
    """SC-13, A-7: a store text per visit (every fiftieth is cut off), read back as a table."""
    text = F.to_json(F.create_map(F.concat(F.lit("visit_"), "id"), F.struct(
        F.col("id").cast("string").alias("id"), "place_id",
        F.struct("lat", "lng").alias("coordinates"),
        F.date_format("visited_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("visited_at"))))
    broken = F.when(F.col("id") % 50 == 7, F.substring(text, 1, 25)).otherwise(text)
    rows = stores.records(td.visits(spark, sf_dir).select(broken.alias("payload")), _STORE)
    return rows.select("store_key", "id", "place_id", "coordinates.lat", "coordinates.lng",
                       F.date_format("visited_at", "yyyy-MM-dd HH:mm:ss").alias("visited_at"))


@catalog.add(f"""
SELECT l_orderkey::VARCHAR AS route_id, (row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey) - 1)::INTEGER AS position, 'osm_node_' || l_partkey AS id,
  {q.lat('l_partkey')} AS lat, {q.lng('l_partkey')} AS lng FROM lineitem""")
def saved_route_places(spark, sf_dir):
    """SC-15: a saved route text per order with its line items, read back as places."""
    key = F.col("l_partkey")
    place = F.struct(F.concat(F.lit("osm_node_"), key).alias("id"), F.lit("n").alias("name"),
                     F.struct(td.lat_of(key).alias("lat"), td.lng_of(key).alias("lng"))
                     .alias("coordinates"))
    lines = td.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", F.struct(
            place.alias("place"), F.col("l_linenumber").alias("order")).alias("w")).alias("stop"))
    files = lines.groupBy("l_orderkey").agg(F.transform(
        F.array_sort(F.collect_list("stop")), lambda s: s["w"]).alias("waypoints"))
    texts = files.select(F.to_json(F.struct(
        F.col("l_orderkey").cast("string").alias("id"), "waypoints")).alias("payload"))
    return stores.route_places(texts).drop("name")


@catalog.add(f"""
SELECT 'area_' || s_suppkey AS name, {q.lat('s_suppkey')} AS min_lat, {q.lng('s_suppkey')} AS min_lng,
  {q.lat('s_suppkey', 500)} AS max_lat, {q.lng('s_suppkey')} + 0.25e0 AS max_lng FROM supplier""")
def area_boxes(spark, sf_dir):
    """SC-12: one GeoJSON rectangle per supplier, read back as boxes."""
    key = F.col("s_suppkey")
    south, north, west = td.lat_of(key), td.lat_of(key, 500), td.lng_of(key)
    east = west + F.lit(0.25)
    ring = F.array(*[F.array(x, y) for x, y in (
        (west, south), (east, south), (east, north), (west, north), (west, south))])
    feature = F.struct(
        F.struct(F.concat(F.lit("area_"), key).alias("name")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
        .alias("geometry"))
    texts = td.read(spark, sf_dir, "supplier").select(F.to_json(F.struct(
        F.array(feature).alias("features"))).alias("payload"))
    return stores.area_boxes(texts)


@catalog.add("""
SELECT o_orderkey, regexp_matches(o_orderpriority || '', '^[a-zA-Z0-9_-]{1,64}$') AS safe,
  sha256('key ' || o_orderkey)[1:24] AS cache_key,
  printf('atlas_%.3f_%.3f_%.1f', """ + q.rnd(q.lat("o_orderkey"), 3) + ", "
             + q.rnd(q.lng("o_orderkey"), 3) + """, 5e0)
    AS area_key
FROM orders""")
def resource_keys(spark, sf_dir):
    """FL-17, ST-20."""
    from cairn.functions import text
    key = F.col("o_orderkey")
    return td.read(spark, sf_dir, "orders").select(
        "o_orderkey", text.is_safe_id("o_orderpriority").alias("safe"),
        text.cache_key(F.concat(F.lit("key "), key)).alias("cache_key"),
        text.coordinate_key("atlas", td.lat_of(key), td.lng_of(key), F.lit(5.0), 3, 1)
        .alias("area_key"))
