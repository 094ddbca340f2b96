"""Files written and read back, model answers applied, and rules for every kind of record."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions.columns import strings
from cairn.operators import filters, offline, prompts
from cairn.plans import discovery, testdata as td
from cairn.plans.catalog import Catalog
from cairn.plans.catalog import base as q
from cairn.plans.catalog.service_queries import _REGIONS, _regions
from cairn.plans.catalog.source_queries import osm_payloads
from cairn.session import shared_folder
from cairn.sinks import tables
from cairn.sources import registry, stores

catalog = Catalog()


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/cairn-records/{uuid.uuid4().hex}"


def _payload_files(spark, sf_dir) -> str:
    """One file of map elements per 25 parts, every seventh broken."""
    home, number = _folder(spark), F.floor(F.col("payload_id") / 25)
    elements = osm_payloads(spark, sf_dir).select(
        number.alias("file"), "payload_id", F.regexp_extract("payload", r"^\{\"elements\":\[(.*)\]\}$", 1).alias("element"))
    listed = elements.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("payload_id", "element"))), lambda e: e["element"]), ",").alias("body"))
    text = F.concat(F.lit('{"elements":['), "body", F.when(F.col("file") % 7 == 3, F.lit("")).otherwise("]}"))
    tables.write_files(listed.select(F.format_string("f%08d", "file").alias("name"), text.alias("value")),
                       home, "name", "value")
    return home


_KEPT_PARTS = "p_partkey // 25 % 7 <> 3 AND NOT (p_partkey % 4 = 3 AND p_size % 7 = 0)"


@catalog.add(f"""
SELECT 'osm_' || CASE WHEN p_partkey % 4 < 2 THEN 'node_' ELSE 'way_' END || p_partkey AS id,
  {q.lat('p_partkey')} AS lat, {q.lng('p_partkey')} AS lng,
  row_number() OVER (ORDER BY p_partkey) AS nth FROM part WHERE {_KEPT_PARTS}""")
def loaded_places(spark, sf_dir):
    """SC-16, SC-17: payload files through the registry, one source missing, in a global order."""
    from cairn.operators.ordered import running_totals
    failed: list[str] = []
    places = registry.with_global_order(discovery.gather_sources(spark, {
        "osm": registry.loader("osm", _payload_files(spark, sf_dir)),
        "wiki": registry.loader("wiki", f"{_folder(spark)}/missing")}, failed=failed))
    if failed != ["wiki"]:
        raise RuntimeError(f"sources that failed: {failed}")
    return running_totals(places.select("id", "lat", "lng", "ord"), [], ["ord"], {"nth": F.lit(1)}).drop("ord")


@catalog.add("""
SELECT nth, parts FROM (SELECT p_partkey // 25 AS file, count(*) AS parts,
  row_number() OVER (ORDER BY p_partkey // 25) AS nth FROM part GROUP BY file) WHERE file % 7 = 3""")
def unreadable_payloads(spark, sf_dir):
    """SC-16: the broken files are listed, with the number of elements they held."""
    payloads = stores.read_payloads(spark, _payload_files(spark, sf_dir))
    return stores.unreadable(payloads).select(
        F.col("payload_id").alias("nth"), F.regexp_count("payload", F.lit('"type":')).cast("bigint").alias("parts"))


@catalog.add(q.with_ctes(q.PLACES, _REGIONS) + f"""
, cached AS (SELECT DISTINCT p.id, p.lat, p.lng FROM regions JOIN places p ON lat BETWEEN min_lat AND max_lat
  AND lng BETWEEN min_lng AND max_lng AND (any_category OR list_contains(categories, 'landmark')))
SELECT id, lat, lng, 1 AS data_version, (SELECT count(*) FROM cached) * {fv.BYTES_PER_CACHED_PLACE}
  <= {fv.STORAGE_LIMIT_BYTES} AS fits FROM cached""")
def cached_snapshot(spark, sf_dir):
    """TF-13, SK-1, SK-7: region places cached as a table, read back, with the storage verdict."""
    places = discovery.gather_sources(spark, td.SOURCE_LOADERS, sf_dir).select("id", "lat", "lng", "categories")
    hits = offline.cached_in_region(_regions(spark, sf_dir), places, once=True)
    home = _folder(spark)
    tables.overwrite(offline.snapshot(hits, F.lit(td.AS_OF).cast("timestamp")), home)
    back = spark.read.parquet(home)
    size = back.agg(F.count(F.lit(1)).alias("n"))
    fits = size.select(F.lit(1).alias("data_version"), offline.fits_storage(F.lit(0), F.col("n")).alias("fits"))
    return back.join(fits, "data_version").select("place.id", "place.lat", "place.lng", "data_version", "fits")


@catalog.add("SELECT o_orderkey AS id, o_custkey AS resource_id FROM orders WHERE o_orderkey % 50 = 0 AND o_custkey % 5 <> 0")
def queue_files(spark, sf_dir):
    """SC-14: one JSON file per record, every fifth customer's cut short; those are listed apart."""
    home, record = _folder(spark), "id bigint, resource_id bigint"
    rows = td.read(spark, sf_dir, "orders").where("o_orderkey % 50 = 0")
    text = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("resource_id")))
    whole = rows.select(F.format_string("r%012d", "o_orderkey").alias("name"), F.when(
        F.col("o_custkey") % 5 == 0, F.left(text, F.lit(8))).otherwise(text).alias("value"))
    tables.write_files(whole, home, "name", "value")
    files = stores.record_files(spark, home, record)
    found = stores.read_records(spark, home, record, files).drop("file_bytes")
    lost = stores.rejected_records(spark, home, record, files).count()
    if found.count() + lost != rows.count():
        raise RuntimeError("records are neither read nor rejected")
    return found


#: Per kind of record: its rules, and the columns that its rows get from an event.
_RECORDS = {
    "place": (filters.PLACE_RULES, ["lat", "lng", "confidence", "source", "categories"]),
    "request": (filters.REQUEST_RULES, ["lat", "lng", "radius_km", "limit", "sort_by"]),
    "route_request": (filters.ROUTE_REQUEST_RULES, ["max_duration_hours", "corridor_width_km", "max_waypoints"]),
    "rating": (filters.RATING_RULES, ["score"]),
    "submission": (filters.SUBMISSION_RULES, ["lat", "lng", "name"]),
    "review": (filters.REVIEW_RULES, ["text"]),
    "fog": (filters.FOG_RULES, ["lat", "lng", "radius_m"]),
    "proximity": (filters.PROXIMITY_RULES, ["radius_m"])}
#: Column of a record: its value from an event in Spark, and the test that SQL applies to it.
_FIELDS = {
    "lat": ("value * 3 - 60", "value * 3 - 60 BETWEEN -90 AND 90"),
    "lng": ("value * 7 - 150", "value * 7 - 150 BETWEEN -180 AND 180"),
    "confidence": ("value / 40", "value / 40 BETWEEN 0 AND 1"),
    "source": ("CASE WHEN event_type = 'view' THEN 'osm' ELSE event_type END", "event_type = 'view'"),
    "categories": ("CASE WHEN user_id % 3 = 0 THEN array('cave', 'x') ELSE array('cave') END", "user_id % 3 <> 0"),
    "radius_km": ("value", "value > 0 AND value <= 50"),
    "limit": ("user_id * 3", "user_id * 3 BETWEEN 1 AND 200"),
    "sort_by": ("CASE WHEN event_type = 'view' THEN 'name' ELSE event_type END", "event_type = 'view'"),
    "max_duration_hours": ("value / 2", "value / 2 > 0 AND value / 2 <= 24"),
    "corridor_width_km": ("value / 5", "value / 5 > 0 AND value / 5 <= 10"),
    "max_waypoints": ("user_id", "user_id BETWEEN 1 AND 50"),
    "score": ("event_id % 8", "event_id % 8 BETWEEN 1 AND 5"),
    "name": ("repeat('n', int(event_id % 250))", "event_id % 250 BETWEEN 1 AND 200"),
    "text": ("repeat('t', int(event_id % 7 * 1000))", "event_id % 7 BETWEEN 1 AND 5"),
    "radius_m": ("value * 10", "value * 10 > 0 AND value * 10 <= 500")}


def _broken(fields: list[str]) -> str:
    return ", ".join(f"CASE WHEN NOT coalesce({_FIELDS[f][1]}, false) THEN '{f}' END" for f in fields)


@catalog.add(" UNION ALL ".join(f"""
SELECT '{kind}' AS kind, event_id, array_to_string(list_filter([{_broken(fields)}], lambda e: e IS NOT NULL), ',')
  AS errors FROM events""" for kind, (_, fields) in _RECORDS.items()))
def record_rules(spark, sf_dir):
    """FL-19: all eight rule sets."""
    events, found = td.read(spark, sf_dir, "events"), None
    for kind, (rules, fields) in _RECORDS.items():
        rows = events.select("event_id", *[F.expr(_FIELDS[f][0]).alias(f) for f in fields])
        part = filters.validate(rows, rules).select(
            F.lit(kind).alias("kind"), "event_id", F.array_join("errors", ",").alias("errors"))
        found = part if found is None else found.unionByName(part)
    return found


@catalog.add("""
SELECT o_orderkey AS request_id, l.l_partkey AS id, a.rank::INTEGER AS rank, a.reason, a.score AS relevance_score
FROM orders JOIN (SELECT 0 AS rank, 'far' AS reason, 1e0 AS score UNION ALL SELECT 1, 'Recommended for you', 0.5e0
  UNION ALL SELECT 2, 'last', 0e0) a ON true
JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nth FROM lineitem) l
  ON l_orderkey = o_orderkey AND nth = CASE a.rank WHEN 0 THEN o_orderkey % 9 WHEN 1 THEN 0 ELSE 2 END + 1
WHERE o_orderkey % 4 <> 3""")
def ranked_candidates(spark, sf_dir):
    """JN-21: ranked indexes of a model, fenced, plain or unreadable, resolved to candidates."""
    key = F.col("o_orderkey")
    body = F.concat(F.lit('[{"place_index": '), key % 9, F.lit(', "reason": "far", "relevance_score": 1.7}, {}, '
                                                              '{"place_index": 2, "reason": "last", "relevance_score": -1}]'))
    answers = td.read(spark, sf_dir, "orders").select(key.alias("request_id"), F.when(
        key % 4 == 3, "I cannot say").when(key % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body).alias("answer"))
    candidates = td.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), (F.col("l_linenumber") * (1 << 40) + F.col("l_partkey")).alias("position"), F.col("l_partkey").alias("id"))
    return prompts.apply_ranking(candidates, answers).select("request_id", "id", "rank", "reason", "relevance_score")


@catalog.add(f"""
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 < 2 AND c_custkey % 3 <> 0 THEN
    array_to_string(list_sort(['cave', {q.category('c_nationkey')}]), ',') ELSE 'landmark' END AS categories,
  c_custkey % 4 < 2 AND c_custkey % 3 = 0 AS needs_review,
  CASE WHEN c_custkey % 4 < 2 AND c_custkey % 3 <> 0 THEN 0.6e0 ELSE 0.1e0 END AS certainty FROM customer""")
def reviewed_places(spark, sf_dir):
    """ST-18: a classifier's answers replace the stop-gap categories of places that wait for review."""
    key = F.col("c_custkey")
    rows = td.read(spark, sf_dir, "customer")
    places = rows.select(key.alias("id"), strings(["landmark"]).alias("categories"), (key % 4 < 2).alias("needs_review"),
                         F.create_map(F.lit("landmark"), F.lit(0.1)).alias("category_confidence"))
    answers = rows.select(key.alias("id"), F.when(key % 3 == 0, "no idea").otherwise(
        F.format_string('{"categories": ["cave", "%s", "?"]}', td.category_of(F.col("c_nationkey")))).alias("answer"))
    certainty = F.element_at(F.map_values("category_confidence"), 1)
    return prompts.apply_classification(places, answers).select(
        "id", F.array_join("categories", ",").alias("categories"), "needs_review", certainty.alias("certainty"))


@catalog.add(f"""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN array_to_string(list_sort(list_distinct(
    ['cave', {q.category('o_custkey')}])), ',') ELSE '{','.join(sorted(fv.INTENT_DEFAULT))}' END AS categories,
  CASE WHEN o_orderkey % 2 = 0 THEN 'calm,dark' ELSE '' END AS mood FROM orders""")
def model_intents(spark, sf_dir):
    """ST-18: a model's intent, or the keyword rules where its answer is unreadable."""
    key = F.col("o_orderkey")
    answer = F.when(key % 2 == 0, F.format_string(
        '```\n{"categories": ["cave", "%s", "nothing"], "mood": ["calm", "dark"]}\n```',
        td.category_of(F.col("o_custkey")))).otherwise("Sorry!")
    rows = td.read(spark, sf_dir, "orders").select(key.alias("id"), prompts.parse_intent(answer, F.lit("zzz")).alias("i"))
    return rows.select("id", F.array_join("i.categories", ",").alias("categories"), F.array_join("i.mood", ",").alias("mood"))
