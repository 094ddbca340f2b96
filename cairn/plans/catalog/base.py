"""SQL fragments for the DuckDB side: the adapters of ``plans/testdata.py`` as CTEs."""

from __future__ import annotations

from cairn import fixed_values as fv
from cairn.plans.testdata import CATEGORY_LIST

R = "6371000e0"


def text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CATS = text_list(CATEGORY_LIST)


def lat(key: str, step: int = 0) -> str:
    return f"(({420000 + step} + (({key}) * 7919) % 6000)::DOUBLE / 10000e0)"


def lng(key: str) -> str:
    return f"((184000 + (({key}) * 104729) % 8000)::DOUBLE / 10000e0)"


def category(number: str) -> str:
    return f"({CATS})[1 + ({number}) % {len(CATEGORY_LIST)}]"


def hav(a_lat: str, a_lng: str, b_lat: str, b_lng: str) -> str:
    h = (f"(sin(radians({b_lat} - {a_lat}) / 2e0) * sin(radians({b_lat} - {a_lat}) / 2e0)"
         f" + cos(radians({a_lat})) * cos(radians({b_lat}))"
         f" * sin(radians({b_lng} - {a_lng}) / 2e0) * sin(radians({b_lng} - {a_lng}) / 2e0))")
    return f"(atan2(sqrt({h}), sqrt(1e0 - {h})) * {2 * 6371000}e0)"


def rnd(value: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(round_even(({value})::DOUBLE * {scale}, 0) / {scale} + 0e0)"


def grid(value: str) -> str:
    return f"(round_even(({value}) / 0.001::DOUBLE, 0)::BIGINT)"


def grid_key(lat_sql: str, lng_sql: str) -> str:
    return (f"printf('%.4f_%.4f', {grid(lat_sql)} * 0.001::DOUBLE,"
            f" {grid(lng_sql)} * 0.001::DOUBLE)")


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


PLACES = f"""places_osm AS (
  SELECT p_partkey AS ord, 'osm_node_' || p_partkey AS id, 'osm' AS source, p_name AS name,
    NULL::VARCHAR AS description,
    CASE WHEN p_size % 5 = 0 THEN []::VARCHAR[] ELSE [{category('p_size')}] END AS categories,
    {lat('p_partkey')} AS lat, {lng('p_partkey')} AS lng, [p_type, p_brand] AS tags,
    []::VARCHAR[] AS photos, 'osm_type=node' AS meta
  FROM part),
places_atlas AS (
  SELECT 1000000000000 + s_suppkey AS ord, 'atlas_' || s_suppkey AS id, 'atlas' AS source,
    s_name AS name, 'Old ' || {category('s_nationkey * 7')} || ' near ' || s_name AS description,
    []::VARCHAR[] AS categories, {lat('s_suppkey', 3)} AS lat, {lng('s_suppkey')} AS lng,
    ['curated'] AS tags, ['https://img.example/' || s_suppkey || '.jpg'] AS photos,
    'atlas_url=https://a.example/' || s_suppkey AS meta
  FROM supplier),
places_wiki AS (
  SELECT 2000000000000 + c_custkey AS ord, 'wiki_Q' || c_custkey AS id, 'wiki' AS source,
    c_name || ' ' || c_mktsegment AS name, NULL::VARCHAR AS description,
    ['landmark'] AS categories, {lat('c_custkey', 6)} AS lat, {lng('c_custkey')} AS lng,
    []::VARCHAR[] AS tags, []::VARCHAR[] AS photos, 'wikidata_id=Q' || c_custkey AS meta
  FROM customer),
places_research AS (
  SELECT 3000000000000 + doc_id AS ord, 'dr_' || doc_id AS id, 'deep_research' AS source,
    'Spot ' || source AS name, 'A ' || {category('n_chars')} || ' spot' AS description,
    []::VARCHAR[] AS categories, {lat('doc_id', 9)} AS lat, {lng('doc_id')} AS lng,
    ['deep_research:x'] AS tags, []::VARCHAR[] AS photos, 'research_provider=x' AS meta
  FROM documents),
places AS (
  SELECT * FROM places_osm UNION ALL SELECT * FROM places_atlas
  UNION ALL SELECT * FROM places_wiki UNION ALL SELECT * FROM places_research)"""

# greedy leaders need three rounds on these tables at most; a fourth would change nothing
NEAR = f"""near AS (
  SELECT b.ord AS ord, a.ord AS smaller FROM places a JOIN places b
    ON a.ord < b.ord AND b.lat BETWEEN a.lat - 6e-4 AND a.lat + 6e-4
    AND b.lng BETWEEN a.lng - 9e-4 AND a.lng + 9e-4
  WHERE {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} < 50)"""


def _rounds(count: int) -> str:
    parts = []
    for i in range(count):
        left = " UNION ALL ".join(f"SELECT ord FROM done{j}" for j in range(i))
        open_rows = "SELECT ord FROM places" + (f" EXCEPT ({left})" if i else "")
        parts.append(f"""open{i} AS MATERIALIZED ({open_rows}),
lead{i} AS MATERIALIZED (
  SELECT ord FROM open{i} EXCEPT
  SELECT n.ord FROM near n JOIN open{i} o ON n.ord = o.ord JOIN open{i} s ON n.smaller = s.ord),
done{i} AS MATERIALIZED (
  SELECT ord FROM lead{i} UNION
  SELECT n.ord FROM near n JOIN lead{i} l ON n.smaller = l.ord JOIN open{i} o ON o.ord = n.ord)""")
    leaders = " UNION ALL ".join(f"SELECT ord FROM lead{i}" for i in range(count))
    parts.append(f"leaders AS MATERIALIZED ({leaders})")
    parts.append("""owners AS MATERIALIZED (
  SELECT ord, ord AS leader FROM leaders UNION ALL
  SELECT n.ord, min(n.smaller) AS leader FROM near n JOIN leaders l ON n.smaller = l.ord
  WHERE n.ord NOT IN (SELECT ord FROM leaders) GROUP BY n.ord)""")
    return ",\n".join(parts)


CLUSTERS = NEAR + ",\n" + _rounds(4)

_RICH = ("(CASE WHEN length(name) > 0 THEN 2 ELSE 0 END"
         " + CASE WHEN length(description) > 0 THEN 2 ELSE 0 END"
         " + len(photos) + CASE WHEN len(categories) > 0 THEN 1 ELSE 0 END)")

MERGED = f"""members AS (
  SELECT p.*, o.leader, {_RICH} AS rich FROM places p JOIN owners o USING (ord)),
base AS (
  SELECT * FROM members
  QUALIFY row_number() OVER (PARTITION BY leader ORDER BY rich DESC, ord) = 1),
merged_parts AS (
  SELECT leader, count(*) AS members,
    first(name ORDER BY length(name) DESC, ord) AS best_name,
    first(description ORDER BY length(description) DESC NULLS LAST, ord) AS best_description,
    list_sort(list_distinct(list(source))) AS sources,
    list_sort(list_distinct(flatten(list(categories)))) AS categories,
    list_sort(list_distinct(flatten(list(tags)))) AS tags,
    flatten(list(photos ORDER BY ord)) AS photos,
    list_sort(list(meta)) AS meta
  FROM members GROUP BY leader),
merged AS (
  SELECT b.leader AS ord, m.members, b.id, b.source, m.sources,
    CASE WHEN length(m.best_name) > coalesce(length(b.name), 0) THEN m.best_name
      ELSE b.name END AS name,
    CASE WHEN length(m.best_description) > coalesce(length(b.description), 0)
      THEN m.best_description ELSE b.description END AS description,
    CASE WHEN m.members = 1 THEN b.categories ELSE m.categories END AS raw_categories,
    b.lat, b.lng, CASE WHEN m.members = 1 THEN b.tags ELSE m.tags END AS tags, m.photos, m.meta
  FROM base b JOIN merged_parts m USING (leader))"""


def _rules() -> str:
    rows = []
    for i, (keywords, cats) in enumerate(fv.KEYWORD_RULES):
        rows.append(f"({i}, {text_list(keywords)}, {text_list(cats)})")
    return "rules(rule, keywords, cats) AS (VALUES " + ",\n".join(rows) + ")"


SCORE = ("0.2e0 * least(len(sources) / 3e0, 1e0)"
         " + 0.15e0 * (CASE WHEN len(photos) > 0 THEN 1e0 ELSE 0e0 END)"
         " + 0.15e0 * (CASE WHEN length(description) > 0 THEN 1e0 ELSE 0e0 END)"
         " + 0.1e0 * 0.8e0 + 0.15e0 * least(len(tags) / 5e0, 1e0)"
         " + 0.25e0 * coalesce(best_conf, 0.3e0)")

CATALOGUE = _rules() + f""",
texts AS (
  SELECT *, lower(concat_ws(' ', name, description, array_to_string(tags, ' '))) AS blob
  FROM merged),
hits AS (
  SELECT ord, cats, least(0.5e0 + 0.15e0 * len(list_filter(keywords,
    lambda k: contains(blob, k))), 1e0) AS conf
  FROM texts, rules WHERE len(list_filter(keywords, lambda k: contains(blob, k))) > 0),
votes AS (
  SELECT ord, cat, max(conf) AS conf FROM (SELECT ord, unnest(cats) AS cat, conf FROM hits)
  GROUP BY ord, cat),
voted AS (
  SELECT ord, list_sort(list(cat)) AS cats, max(conf) AS best_conf,
    array_to_string(list_sort(list(cat || '=' || printf('%.2f', conf))), ',') AS conf_text
  FROM votes GROUP BY ord),
classified AS (
  SELECT t.* EXCLUDE (blob),
    CASE WHEN v.ord IS NULL AND len(raw_categories) = 0 THEN ['landmark']
      ELSE list_sort(list_distinct(list_concat(raw_categories, coalesce(v.cats, []::VARCHAR[]))))
    END AS categories,
    CASE WHEN v.ord IS NULL AND len(raw_categories) = 0 THEN 'landmark=0.30'
      ELSE coalesce(v.conf_text, '') END AS conf_text,
    CASE WHEN v.ord IS NULL AND len(raw_categories) = 0 THEN 0.3e0 ELSE v.best_conf END AS best_conf,
    v.ord IS NULL AND len(raw_categories) = 0 AS needs_review
  FROM texts t LEFT JOIN voted v USING (ord)),
catalogue AS (
  SELECT *, {rnd('least(greatest(' + SCORE + ', 0e0), 1e0)', 3)} AS confidence FROM classified)"""

FULL = ",\n".join([PLACES, CLUSTERS, MERGED, CATALOGUE])

REQUESTS = f"""requests AS (
  SELECT s_suppkey AS request_id, {lat('s_suppkey')} AS r_lat, {lng('s_suppkey')} AS r_lng,
    5e0 AS radius_km, [{category('s_nationkey')}] AS wanted FROM supplier),
boxes AS (
  SELECT *, degrees(radius_km / 6371e0) AS dlat,
    degrees(radius_km / (cos(radians(r_lat)) * 6371e0)) AS dlng FROM requests)"""

_K = "CAST(props->>'$.k' AS BIGINT)"

VISITS = f"""visits AS (
  SELECT event_id AS id, user_id, 'osm_node_' || k AS place_id,
    CASE WHEN event_id % 17 <> 0 THEN 'Place ' || k END AS place_name,
    CASE event_type WHEN 'error' THEN 'skip' WHEN 'signup' THEN 'want_to_visit'
      ELSE 'visited' END AS status,
    {lat('k')} AS lat, {lng('k')} AS lng, ts AS visited_at, value AS duration_minutes,
    'trip_' || user_id || '_' || strftime(date_trunc('week', ts), '%Y%m%d') AS trip_id,
    event_id AS ord
  FROM (SELECT *, {_K} AS k FROM events))"""

NOTES = f"""notes AS (
  SELECT event_id AS id, event_id AS visit_id, user_id, 'osm_node_' || {_K} AS place_id,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE 'Note <' || event_id || '>' END AS text,
    [event_id % 6, (event_id // 6) % 6, (event_id // 36) % 6, (event_id // 216) % 6] AS scores,
    [{category('event_id')}, {category('event_id // 21')}] AS tags,
    CASE WHEN event_id % 3 = 0 THEN ['https://img.example/n' || event_id]
      ELSE []::VARCHAR[] END AS photos,
    ts AS created_at, event_id AS ord
  FROM events WHERE event_type = 'view'),
rated AS (
  SELECT *, CASE WHEN len(list_filter(scores, lambda s: s > 0)) = 0 THEN 0e0 ELSE
    {rnd('list_sum(list_filter(scores, lambda s: s > 0))::DOUBLE / '
         'len(list_filter(scores, lambda s: s > 0))', 1)} END AS average FROM notes)"""

GPS = f"""gps AS (
  SELECT user_id, {lat('k')} AS lat, {lng('k')} AS lng, ts, event_id AS visit_id, event_id AS ord
  FROM (SELECT *, {_K} AS k FROM events))"""

TRIPS = """trips AS (
  SELECT trip_id, user_id, 'Week & ' || trip_id AS name, 'Region ' || (user_id % 7) AS region,
    min(visited_at) AS start_date, max(visited_at) AS end_date
  FROM visits GROUP BY trip_id, user_id)"""

MODERATION = f"""moderation AS (
  SELECT {_K} AS place_id, user_id, event_type = 'click' AS confirm, ts, event_id AS ord
  FROM events WHERE event_type IN ('click', 'error')),
community AS (SELECT p_partkey AS place_id, p_partkey AS submitted_by FROM part)"""

SUBMISSIONS = f"""submissions AS (
  SELECT event_id AS id, user_id, 'Place ' || (k % 10) || ' ' || event_type AS name,
    {lat('k')} AS lat, {lng('k')} AS lng, ts AS created_at, event_id AS ord
  FROM (SELECT *, {_K} AS k FROM events))"""

REVIEWS = """reviews AS (
  SELECT conv_id * 1000 + turn AS id, conv_id % 100 AS place_id, conv_id AS author_id,
    CASE WHEN role = 'user' THEN 'review' ELSE 'tip' END AS review_type, text,
    CASE WHEN turn % 2 = 0 THEN 'Month ' || (conv_id % 12) END AS visit_date,
    conv_id * 1000 + turn AS created_ord
  FROM conversations)"""

REVIEW_EVENTS = """review_events AS (
  SELECT event_id % 500 AS review_id, user_id,
    CASE event_type WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' ELSE 'report' END AS kind,
    event_id AS ord
  FROM events WHERE event_type IN ('purchase', 'error', 'signup'))"""

RATINGS = """ratings AS (
  SELECT o_orderkey % 200 AS route_id, o_custkey AS user_id, 1 + o_orderkey % 5 AS score,
    o_orderdate AS ts, o_orderkey AS ord FROM orders),
published AS (
  SELECT s_suppkey AS route_id, s_nationkey::BIGINT AS author_id, s_name AS title,
    'Coast ' || s_nationkey AS region, s_suppkey AS ord FROM supplier)"""

FOLLOWS = """follow_log AS (
  SELECT o_custkey AS follower_id, o_custkey * 7 % 97 AS following_id,
    CASE o_orderstatus WHEN 'F' THEN 'follow' WHEN 'O' THEN 'consent' ELSE 'unfollow' END AS action,
    o_totalprice > 100000 AS consent, o_orderkey AS ord FROM orders)"""


def event_key() -> str:
    return _K
