"""Fusion, classification and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions import text
from cairn.functions.columns import round_to
from cairn.operators import fusion, spatial
from cairn.operators.classify import classify_places
from cairn.plans import discovery, testdata as td
from cairn.plans.catalog import Catalog
from cairn.plans.catalog import base as q

catalog = Catalog()


def _places(spark, sf_dir):
    return discovery.gather_sources(spark, td.SOURCE_LOADERS, sf_dir)


@catalog.add(q.with_ctes(q.PLACES, q.CLUSTERS) + "SELECT ord, leader FROM owners")
def place_clusters(spark, sf_dir):
    """JN-1."""
    points = _places(spark, sf_dir).select("ord", "lat", "lng")
    return spatial.leader_clusters(points, fv.DEDUP_DISTANCE_M).select("ord", "leader")


@catalog.add(q.with_ctes(q.PLACES, q.CLUSTERS, q.MERGED) + """
SELECT ord, members, id, source, array_to_string(sources, ',') AS sources, name, description,
  array_to_string(raw_categories, ',') AS categories, lat, lng,
  array_to_string(tags, ',') AS tags, array_to_string(photos, ',') AS photos,
  array_to_string(meta, ',') AS meta FROM merged""")
def merged_places(spark, sf_dir):
    """AG-1, AG-3, U-2, A-1, A-2, A-3, S-6."""
    fused = fusion.fuse_places(_places(spark, sf_dir))
    meta = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws(
        "=", e["key"], e["value"])))
    return fused.select(
        "ord", "members", "id", "source", "name", "description", "lat", "lng",
        *[F.array_join(c, ",").alias(c) for c in ("sources", "categories", "tags", "photos")],
        F.array_join(meta, ",").alias("meta"))


@catalog.add(q.with_ctes(q.FULL) + """
SELECT ord, id, array_to_string(categories, ',') AS categories, conf_text, needs_review, confidence
FROM catalogue""")
def scored_catalogue(spark, sf_dir):
    """ST-1, ST-2, AG-32, A-4, M-8."""
    catalogue = discovery.build_catalogue(_places(spark, sf_dir))
    certainty = F.array_sort(F.transform(F.map_entries("category_confidence"), lambda e: F.concat(
        e["key"], F.lit("="), F.format_string("%.2f", e["value"]))))
    return catalogue.select("ord", "id", F.array_join("categories", ",").alias("categories"),
                            F.array_join(certainty, ",").alias("conf_text"), "needs_review",
                            "confidence")


_MATCHES = q.REQUESTS + f""",
matched AS (
  SELECT request_id, ord, id, name, categories, confidence,
    {q.hav('r_lat', 'r_lng', 'lat', 'lng')} AS exact_m, wanted
  FROM boxes JOIN catalogue ON lat BETWEEN r_lat - dlat AND r_lat + dlat
    AND lng BETWEEN r_lng - dlng AND r_lng + dlng)"""


def _page_sql(order: str, start: int, limit: int, where: str = "true") -> str:
    end = start + limit
    return q.with_ctes(q.FULL, _MATCHES, f"hit AS (SELECT * FROM matched WHERE {where})",
                       f"""ranked AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS total,
    row_number() OVER (PARTITION BY request_id ORDER BY {order}, ord) AS position FROM hit)""") + f"""
SELECT request_id, id, name, array_to_string(categories, ',') AS categories, confidence,
  {q.rnd('exact_m', 1)} AS distance_m, position::INTEGER AS position, total,
  total > {end} AS has_more, CASE WHEN total > {end} THEN
    translate(base64('{end}'::BLOB), '+/', '-_') END AS cursor
FROM ranked WHERE position > {start} AND position <= {end}"""


def _page_columns(found):
    return found.select(
        "request_id", "id", "name", F.array_join("categories", ",").alias("categories"),
        "confidence", "distance_m", "position", "total", "has_more", "cursor")


@catalog.add(_page_sql("confidence DESC", 0, 50))
def discover_by_confidence(spark, sf_dir):
    """TF-10, SC-16, S-1, S-2: all categories, best first."""
    wide = td.requests(spark, sf_dir).withColumn("categories", F.array().cast("array<string>"))
    return _page_columns(discovery.discover(wide, _places(spark, sf_dir)))


@catalog.add(_page_sql("exact_m", 5, 10))
def discover_by_distance(spark, sf_dir):
    """S-1 distance, S-2 second page from a cursor."""
    wide = td.requests(spark, sf_dir).withColumn("categories", F.array().cast("array<string>"))
    return _page_columns(discovery.discover(wide, _places(spark, sf_dir), sort_by="distance",
                                            limit=10, cursor="NQ=="))


@catalog.add(_page_sql("lower(coalesce(name, ''))", 0, 20,
                       "len(list_intersect(categories, wanted)) > 0 AND NOT EXISTS (SELECT 1 "
                       "FROM visits v WHERE v.user_id = request_id AND v.status = 'visited' "
                       "AND v.place_id = matched.id)").replace("WITH ", f"WITH {q.VISITS},\n", 1))
def discover_unvisited_by_name(spark, sf_dir):
    """FL-1, FL-2, U-4, JN-6, S-1 name: wanted categories without the user's visited places."""
    seen = td.visits(spark, sf_dir).where("status = 'visited'").select(
        F.col("user_id").alias("request_id"), "place_id").distinct()
    return _page_columns(discovery.discover(
        td.requests(spark, sf_dir), _places(spark, sf_dir), excluded=seen, sort_by="name",
        limit=20))


@catalog.add(q.with_ctes(q.FULL) + """
SELECT 'source_' || source AS metric, count(*) AS value FROM places GROUP BY source
UNION ALL SELECT 'merged', count(*) FROM merged""")
def fusion_run_metrics(spark, sf_dir):
    """AG-31."""
    _, metrics = fusion.fuse_observed(_places(spark, sf_dir), list(td.SOURCE_LOADERS))
    return metrics


_OFFSETS = f"""
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '*' || o_orderkey
  WHEN o_orderkey % 3 = 1 THEN translate(base64(o_orderkey::VARCHAR::BLOB), '+/', '-_')
  ELSE o_orderpriority END AS cursor FROM orders)
SELECT o_orderkey, cursor, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey ELSE 0 END AS start FROM c"""


@catalog.add(_OFFSETS)
def cursor_offsets(spark, sf_dir):
    """S-2: cursors written and read as columns, bad ones count as 0."""
    key = F.col("o_orderkey")
    cursor = (F.when(key % 3 == 0, F.concat(F.lit("*"), key))
              .when(key % 3 == 1, discovery.encode_cursor(key)).otherwise(F.col("o_orderpriority")))
    rows = td.read(spark, sf_dir, "orders").select("o_orderkey", cursor.alias("cursor"))
    return rows.withColumn("start", discovery.decode_cursor_column("cursor"))


_RESEARCH = f"""research AS (
  SELECT doc_id AS ord, {q.lat('doc_id // 4')} AS lat, {q.lng('doc_id // 4')} AS lng,
    CASE WHEN doc_id % 4 = 3 THEN 'Old ' || source || ' ruin' ELSE 'Old mill of ' || lang END AS name,
    repeat('x', (n_chars % 50)::INTEGER) AS description, doc_id AS doc FROM documents)"""
_NEAR_NAMED = f"""pairs AS (
  SELECT b.ord AS ord, a.ord AS smaller FROM research a JOIN research b ON a.ord < b.ord
    AND abs(a.lat - b.lat) < 1e-3 AND abs(a.lng - b.lng) < 2e-3
  WHERE {q.hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} < 100
    AND len(list_intersect(str_split(lower(a.name), ' '), str_split(lower(b.name), ' ')))::DOUBLE
      / least(len(list_distinct(str_split(lower(a.name), ' '))),
              len(list_distinct(str_split(lower(b.name), ' ')))) > 0.3e0)"""


def _named_rounds(count: int) -> str:
    parts = []
    for i in range(count):
        left = " UNION ALL ".join(f"SELECT ord FROM done{j}" for j in range(i))
        parts.append(f"""open{i} AS MATERIALIZED (SELECT ord FROM research{f' EXCEPT ({left})' if i else ''}),
lead{i} AS MATERIALIZED (SELECT ord FROM open{i} EXCEPT SELECT n.ord FROM pairs n
  JOIN open{i} o ON n.ord = o.ord JOIN open{i} s ON n.smaller = s.ord),
done{i} AS MATERIALIZED (SELECT ord FROM lead{i} UNION SELECT n.ord FROM pairs n
  JOIN lead{i} l ON n.smaller = l.ord JOIN open{i} o ON o.ord = n.ord)""")
    parts.append("leaders AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT ord FROM lead{i}" for i in range(count)) + ")")
    parts.append("""owned AS (SELECT ord, ord AS leader FROM leaders UNION ALL
  SELECT n.ord, min(n.smaller) FROM pairs n JOIN leaders l ON n.smaller = l.ord
  WHERE n.ord NOT IN (SELECT ord FROM leaders) GROUP BY n.ord)""")
    return ",\n".join(parts)


@catalog.add(q.with_ctes(_RESEARCH, _NEAR_NAMED, _named_rounds(4)) + """
SELECT leader AS ord, first(name ORDER BY length(description) DESC, ord) AS name,
  first(description ORDER BY length(description) DESC, ord) AS description,
  first('doc=' || doc ORDER BY length(description) DESC, ord) <> 'doc=' || leader
    AS from_other,
  'doc=' || leader AS meta
FROM research JOIN owned USING (ord) GROUP BY leader""")
def research_dedupe(spark, sf_dir):
    """JN-2, AG-2, ST-8, A-3: near and similarly named research items."""
    key, quarter = F.col("doc_id"), F.floor(F.col("doc_id") / 4)
    items = td.read(spark, sf_dir, "documents").select(
        key.alias("ord"), td.lat_of(quarter).alias("lat"), td.lng_of(quarter).alias("lng"),
        F.when(key % 4 == 3, F.concat(F.lit("Old "), "source", F.lit(" ruin")))
        .otherwise(F.concat(F.lit("Old mill of "), "lang")).alias("name"),
        F.repeat(F.lit("x"), (F.col("n_chars") % 50).cast("int")).alias("description"),
        F.create_map(F.lit("doc"), key.cast("string")).alias("metadata"),
        key.alias("doc"))
    kept = fusion.dedupe_research(items)
    return kept.select("ord", "name", "description", (F.col("doc") != F.col("ord"))
                       .alias("from_other"),
                       F.concat(F.lit("doc="), F.col("metadata")["doc"]).alias("meta"))


@catalog.add(f"""
SELECT l_orderkey, l_linenumber, {q.rnd('''
  CASE WHEN wa = 0 OR wb = 0 THEN 0e0 ELSE common::DOUBLE / least(wa, wb) END''', 4)} AS similarity
FROM (SELECT l_orderkey, l_linenumber,
    len(list_distinct(str_split(lower(a.p_name), ' '))) AS wa,
    len(list_distinct(str_split(lower(b.p_name), ' '))) AS wb,
    len(list_intersect(list_distinct(str_split(lower(a.p_name), ' ')),
                       list_distinct(str_split(lower(b.p_name), ' ')))) AS common
  FROM lineitem JOIN part a ON l_partkey = a.p_partkey
  JOIN part b ON l_suppkey = b.p_partkey)""")
def name_overlap(spark, sf_dir):
    """ST-8."""
    parts = td.read(spark, sf_dir, "part")
    lines = td.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    named = lines.join(parts.select(F.col("p_partkey").alias("l_partkey"),
                                    F.col("p_name").alias("a")), "l_partkey").join(
        parts.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("b")),
        "l_suppkey")
    return named.select("l_orderkey", "l_linenumber",
                        round_to(text.name_similarity("a", "b"), 4).alias("similarity"))


def flagship(spark, sf_dir):
    return discover_by_confidence(spark, sf_dir)
