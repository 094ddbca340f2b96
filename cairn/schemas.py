"""Explicit schemas of payloads and stored tables."""

from __future__ import annotations

OSM_PAYLOAD = ("elements array<struct<type string, id bigint, lat double, lon double, "
               "center struct<lat: double, lon: double>, tags map<string,string>>>")

_VALUE = "struct<value: string>"
WIKIDATA_PAYLOAD = (f"results struct<bindings: array<struct<item: {_VALUE}, itemLabel: {_VALUE}, "
                    f"itemDescription: {_VALUE}, coord: {_VALUE}, type: {_VALUE}, "
                    f"sitelink: {_VALUE}>>>")

GEOJSON_PAYLOAD = ("features array<struct<properties: map<string,string>, "
                   "geometry: struct<type: string, coordinates: array<array<array<double>>>>>>")

PLACE = ("ord bigint, id string, source string, sources array<string>, name string, "
         "description string, categories array<string>, lat double, lng double, "
         "confidence double, category_confidence map<string,double>, tags array<string>, "
         "photos array<string>, osm_tags map<string,string>, metadata map<string,string>")

_COORDINATES = "coordinates struct<lat: double, lng: double>"

# stored records as they appear in a JSON store: {id: record}
VISIT_RECORD = (f"id string, place_id string, place_name string, status string, {_COORDINATES}, "
                "visited_at timestamp, duration_minutes double, auto_detected boolean, "
                "trip_id string, created_at timestamp, updated_at timestamp")
NOTE_RECORD = ("id string, visit_id string, place_id string, text string, rating struct<"
               "atmosphere: int, accessibility: int, photogenic: int, uniqueness: int>, "
               "tags array<string>, photos array<string>, voice_transcript string, "
               "created_at timestamp, updated_at timestamp")
TRIP_RECORD = ("id string, name string, region string, start_date timestamp, end_date timestamp, "
               "visit_ids array<string>, created_at timestamp, updated_at timestamp")
FOG_RECORD = "lat double, lng double, explored_at timestamp, visit_id string"
COMMUNITY_PLACE_RECORD = (
    f"id string, submitted_by string, name string, description string, "
    f"categories array<string>, {_COORDINATES}, photos array<string>, tags array<string>, "
    "moderation_status string, confirmations array<string>, rejections array<string>, "
    "osm_suggested boolean, created_at timestamp, updated_at timestamp")
REVIEW_RECORD = ("id string, place_id string, author_id string, review_type string, text string, "
                 "photos array<string>, visit_date string, upvotes array<string>, "
                 "downvotes array<string>, created_at timestamp, updated_at timestamp")

# one JSON file per record
REGION_RECORD = ("region_id string, name string, bbox struct<min_lat: double, min_lng: double, "
                 "max_lat: double, max_lng: double>, tile_source string, min_zoom int, "
                 "max_zoom int, tile_count bigint, disk_usage_bytes bigint, status string")
CACHED_PLACE_RECORD = (
    "place struct<id: string, source: string, name: string, description: string, "
    "categories: array<string>, coordinates: struct<lat: double, lng: double>, "
    "confidence: double, tags: array<string>, photos: array<string>>, cached_at timestamp, "
    "expires_at timestamp, has_llm_description boolean, data_version int")
QUEUE_RECORD = ("id string, operation string, resource_type string, resource_id string, "
                "data map<string,string>, created_at timestamp, retry_count int, "
                "last_error string, synced boolean, synced_at timestamp")
ROUTE_FILE = ("id string, waypoints array<struct<place: struct<id: string, name: string, "
              "coordinates: struct<lat: double, lng: double>>, `order`: int, is_origin: boolean, "
              "is_destination: boolean>>")
