from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cairn import schemas
from cairn.plans.discovery import build_catalogue, gather_sources
from cairn.sinks import tables
from cairn.sources import atlas, osm, registry, research, stores, wikidata


def payload(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "payload_id bigint, payload string")


def test_osm(spark):
    text = json.dumps({"elements": [
        {"type": "node", "id": 1, "lat": 42.4, "lon": 18.7,
         "tags": {"military": "bunker", "name": "", "name:en": "Old bunker", "source": "x"}},
        {"type": "way", "id": 2, "center": {"lat": 42.5, "lon": 18.8},
         "tags": {"building": "industrial", "disused": "yes", "note": "empty"}},
        {"type": "node", "id": 3, "lat": 42.4, "lon": 18.7, "tags": {"tourism": "hotel"}},
        {"type": "node", "id": 4, "lat": 42.4, "lon": 18.7, "tags": {"tourism": "hotel",
                                                                     "stars": "5"}},
        {"type": "relation", "id": 5, "tags": {"ruins": "yes"}}]})
    rows = {r["id"]: r for r in osm.places(payload(spark, text, "not json")).collect()}
    assert set(rows) == {"osm_node_1", "osm_way_2", "osm_node_3", "osm_node_4"}
    assert rows["osm_node_1"]["name"] == "Old bunker"
    assert rows["osm_node_1"]["categories"] == ["military", "underground"]
    assert sorted(rows["osm_node_1"]["tags"]) == ["military=bunker", "name:en=Old bunker", "name="]
    assert rows["osm_way_2"]["categories"] == ["abandoned", "industrial"]
    assert rows["osm_way_2"]["description"] == "empty" and rows["osm_way_2"]["lat"] == 42.5
    assert rows["osm_node_3"]["categories"] == [] and rows["osm_node_3"]["confidence"] == 0.4
    assert rows["osm_node_4"]["categories"] == ["hotel_notable"]
    wanted = {r["id"] for r in osm.places(payload(spark, text), only_wanted=True).collect()}
    assert wanted == {"osm_node_1", "osm_way_2", "osm_node_4"}


def test_atlas(spark):
    item = {"id": 7, "title": "Cave", "subtitle": "deep", "lat": "42.1", "lng": 19,
            "categories": [" Caves "], "tags": ["forts"], "photo": "p.jpg", "url": "u"}
    bad = {"id": 8, "title": "x", "lat": 95, "lng": 19}
    texts = [json.dumps([item, bad]), json.dumps({"places": [item]}), json.dumps(
        {"results": [{**item, "categories": [], "tags": [], "photo": ""}]}), "{"]
    rows = atlas.places(payload(spark, *texts)).orderBy("ord").collect()
    assert [r["id"] for r in rows] == ["atlas_7"] * 3
    assert rows[0]["categories"] == ["cave", "landmark", "military", "underground"]
    assert rows[0]["photos"] == ["p.jpg"] and rows[2]["photos"] == []
    assert rows[2]["categories"] == ["landmark"]
    assert [r["id"] for r in atlas.rejected(payload(spark, *texts)).collect()] == ["atlas_8"]


def test_wikidata(spark):
    def binding(qid, coord, label="Bay", link=None, kind="Q12323"):
        out = {"item": {"value": f"http://e/{qid}"}, "coord": {"value": coord},
               "itemLabel": {"value": label}, "type": {"value": f"http://e/{kind}"}}
        return {**out, **({"sitelink": {"value": link}} if link else {})}
    text = json.dumps({"results": {"bindings": [
        binding("Q1", "Point(19.1 42.1)"), binding("Q1", "Point(1 1)"),
        binding("Q2", "bad"), binding("Q2", "Point(19 42)"),
        binding("Q3", "Point(19 42)", label="Q3", link="w", kind="Q0"),
        binding("Q4", "point(19 42)")]}})
    rows = {r["id"]: r for r in wikidata.places(payload(spark, text)).collect()}
    assert set(rows) == {"wiki_Q1", "wiki_Q3"}
    assert (rows["wiki_Q1"]["lat"], rows["wiki_Q1"]["lng"]) == (42.1, 19.1)
    assert rows["wiki_Q1"]["categories"] == ["water", "nature_hidden"]
    assert rows["wiki_Q3"]["name"] is None and rows["wiki_Q3"]["confidence"] == 0.6
    assert rows["wiki_Q3"]["categories"] == ["landmark"]


@pytest.mark.parametrize("text,ids", [
    ('[{"name": "A", "lat": 42, "lng": 19}, {"title": "B", "lat": "42.5", "lon": 19.5}]', 2),
    ('{"items": [{"name": "A", "lat": 42, "lng": 19}]}', 1),
    ('{"name": "A", "lat": 42, "lng": 0, "lon": 19}', 1),
    ('{"name": "A", "lat": 0, "lng": 0}', 0),
    ('{"name": "", "lat": 42, "lng": 19}', 0),
    ('{"name": "A", "lat": 99, "lng": 19}', 0),
    ('Found: [{"name": "A", "lat": 42, "lng": 19}] ok', 1),
    ('x {"name": "A", "lat": 42, "lng": 19} and {"name": "B", "lat": 43, "lng": 19}', 2),
    ("nothing here", 0),
    ("## Bay\n**Bay**: 42.0934, 19.1005", 1)])
def test_research(spark, text, ids):
    rows = payload(spark, text).withColumn("provider", F.lit("x"))
    assert research.places(rows).count() == ids


def test_research_fields(spark):
    text = json.dumps([{"name": "Fort", "lat": 42, "lng": 19, "description": "old",
                        "category": "Street Art", "access_info": "boat", "safety_notes": "wet",
                        "name_local": "Tvrđava"}])
    row = research.places(payload(spark, text).withColumn("provider", F.lit("x"))).first()
    assert row["description"] == "old\n\n📍 boat\n⚠️ wet"
    assert row["categories"] == ["military", "nature_hidden", "street_art"]
    assert row["category_confidence"]["military"] == 0.7
    assert row["metadata"]["name_local"] == "Tvrđava"


def test_record_store_and_missing_files(spark, tmp_path):
    good = {"visit_1": {"id": "visit_1", "place_id": "p", "status": "visited",
                        "coordinates": {"lat": 42.0, "lng": 19.0},
                        "visited_at": "2024-01-02T03:04:05Z"}}
    (tmp_path / "visits.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "broken.json").write_text("{oops")
    rows = stores.read_store(spark, str(tmp_path / "visits.json"), schemas.VISIT_RECORD).collect()
    assert [(r["store_key"], r["coordinates"]["lat"]) for r in rows] == [("visit_1", 42.0)]
    for name in ("broken.json", "absent.json"):
        assert stores.read_store(spark, str(tmp_path / name), schemas.VISIT_RECORD).count() == 0


def test_record_folder_skips_corrupt_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({
            "id": f"i{i}", "operation": "create", "resource_type": "visit", "resource_id": "r",
            "synced": i == 0}, indent=2))
    (tmp_path / "bad.json").write_text("{nope")
    rows = stores.read_records(spark, str(tmp_path), schemas.QUEUE_RECORD)
    assert sorted(r["id"] for r in rows.collect()) == ["i0", "i1", "i2"]
    assert all(r["file_bytes"] > 0 for r in rows.collect())


def test_loaders_isolate_failures_and_fuse(spark, tmp_path):
    (tmp_path / "osm").mkdir()
    (tmp_path / "osm" / "a.json").write_text(json.dumps({"elements": [
        {"type": "node", "id": 1, "lat": 42.0, "lon": 19.0, "tags": {"historic": "fort"}}]}))
    (tmp_path / "atlas").mkdir()
    (tmp_path / "atlas" / "a.json").write_text(json.dumps([
        {"id": 1, "title": "The fort", "lat": 42.000001, "lng": 19.0, "photo": "x"}]))
    loaders = {"osm": registry.loader("osm", str(tmp_path / "osm")),
               "wiki": registry.loader("wiki", str(tmp_path / "missing")),
               "atlas": registry.loader("atlas", str(tmp_path / "atlas"))}
    places = registry.with_global_order(gather_sources(spark, loaders))
    row = build_catalogue(places).collect()
    assert len(row) == 1
    assert row[0]["sources"] == ["atlas", "osm"] and row[0]["name"] == "The fort"
    assert row[0]["categories"] == ["landmark", "military"]


def test_catalogue_file_is_sorted_by_cell(spark, tmp_path):
    rows = spark.range(500).select(
        F.col("id").cast("string").alias("id"), (F.col("id") % 90).cast("double").alias("lat"),
        (F.col("id") % 170).cast("double").alias("lng"))
    tables.write_catalogue(rows, str(tmp_path / "c"), files=4)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 500
    docs = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")],
                                 "trip_id string, part bigint, content string")
    tables.write_documents(docs, str(tmp_path / "d"), "trip_id", "content")
    back = spark.read.text(str(tmp_path / "d")).collect()
    assert sorted((r["name"], r["part"], r["value"]) for r in back) == [
        ("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]
