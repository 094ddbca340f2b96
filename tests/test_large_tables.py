"""What keeps queries in bounds on large tables: few folders, batches of routes, small exchanges."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from cairn.operators import offline, routes, spatial
from cairn.sinks import tables
from cairn.sources import stores


def test_record_files_share_folders_and_are_opened_once(spark, tmp_path):
    rows = [(f"r{i:06d}", f'{{"id": {i}}}' if i % 5 else '{"id"') for i in range(60)] + [("r000001", '{"id": 7}')]
    home = str(tmp_path / "files")
    written = tables.write_files(spark.createDataFrame(rows, "name string, value string"), home, "name", "value")
    assert written.agg({"files": "sum"}).first()[0] == 60
    assert len([p for p in Path(home).rglob("*") if p.is_dir()]) == 1
    files = stores.record_files(spark, home, "id bigint")
    for path in Path(home).rglob("r*"):
        path.unlink()
    good = {r["id"] for r in stores.read_records(spark, home, "id bigint", files).collect()}
    assert good == {i for i in range(60) if i % 5}
    assert stores.rejected_records(spark, home, "id bigint", files).count() == 60 - len(good)


def test_payload_files_are_numbered_in_name_order(spark, tmp_path):
    home = str(tmp_path / "files")
    rows = [(f"f{i:08d}", str(i)) for i in (3, 20_000, 10_001, 7)]
    tables.write_files(spark.createDataFrame(rows, "name string, value string"), home, "name", "value")
    found = {r["payload_id"]: r["payload"].strip() for r in stores.read_payloads(spark, home).collect()}
    assert found == {1: "3", 2: "7", 3: "10001", 4: "20000"}


def test_routes_ordered_together_are_those_ordered_alone():
    random = np.random.default_rng(4)
    for stops in range(13):
        lat, lng = 42 + random.random((50, stops + 2)), 18 + random.random((50, stops + 2))
        lat[:9, -1], lng[:9, -1] = lat[:9, 0], lng[:9, 0]
        together = routes._tours(routes._distances(lat, lng))
        alone = [routes._tour(routes._distances(a, b)) for a, b in zip(lat, lng)]
        assert (together == np.array(alone).reshape(together.shape)).all()


def test_cached_places_come_once_without_pairs(spark):
    regions = spark.createDataFrame([(i, ["a"] if i % 2 else [], 42.0, 18.0, 42.3 + i / 1e4, 18.3) for i in range(300)],
                                    "region_id long, categories array<string>, min_lat double, min_lng double, max_lat double, max_lng double")
    places = spark.createDataFrame([(f"p{i}", 42 + i / 1000, 18.1, ["a"] if i % 3 else ["b"]) for i in range(400)],
                                   "id string, lat double, lng double, categories array<string>")
    once = offline.cached_in_region(regions, places, once=True)
    assert once.columns == places.columns
    pairs = offline.cached_in_region(regions, places)
    assert sorted(r["id"] for r in once.collect()) == sorted({r["id"] for r in pairs.collect()})
    assert "LeftSemi" in once._jdf.queryExecution().toString()


def test_boxes_of_all_sizes_meet_their_points_in_fitting_cells(spark):
    random = np.random.default_rng(6)
    spots = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(random.uniform(40, 44, 600), random.uniform(16, 20, 600)))]
    boxes = [(i, 42 - s, 18 - s, 42 + s, 18 + s) for i, s in enumerate((0.0, 0.02, 0.06, 0.1, 0.5, 1.5, 30.0, 48.0))]
    queries = spark.createDataFrame(boxes, "q long, south double, west double, north double, east double")
    joined = spatial.box_join(queries, spark.createDataFrame(spots, "p long, lat double, lng double"))
    assert sorted((r["q"], r["p"]) for r in joined.collect()) == sorted(
        (q, p) for q, s, w, n, e in boxes for p, a, b in spots if s <= a <= n and w <= b <= e)
    small = spatial.box_join(queries.where("q = 2"), spark.createDataFrame(spots, "p long, lat double, lng double"))
    # the old cells of 0.05 degrees are too coarse for a box of 0.12
    assert "0.0125" in small._jdf.queryExecution().toString()


def test_places_of_regions_take_little_space_and_are_whole(spark, tmp_path):
    random = np.random.default_rng(8)
    spots = [(f"place_{i:06d}", float(a), float(b), ["a"] if i % 3 else []) for i, (a, b) in enumerate(
        zip(random.uniform(42, 42.03, 3000), random.uniform(18, 18.04, 3000)))]
    spots += [spots[7], (None, 42.02, 18.02, ["a"]), ("no_kind", 42.02, 18.02, None), ("edge", 42.02, 18.03, ["a", "b"]),
              ("nowhere", None, 18.02, ["a"]), ("also_nowhere", 42.02, None, [])]
    boxes = [(i, [["a"], [], ["b", "c"]][i % 3], float(a), float(b), float(a) + 0.03, float(b) + 0.04)
             for i, (a, b) in enumerate(zip(random.uniform(41.99, 42.01, 600), random.uniform(17.99, 18.01, 600)))]
    boxes += [boxes[0], (600, None, 42.0, 18.0, 42.03, 18.03), (601, [], 42.02, 18.03, 42.02, 18.03),
              (602, [], 42.0, 18.0, 44.0, 19.0), (603, [], None, 18.0, 42.03, 18.03)]
    regions = spark.createDataFrame(boxes, "region_id long, categories array<string>, min_lat double, min_lng double, max_lat double, max_lng double")
    places = spark.createDataFrame(spots, "id string, lat double, lng double, categories array<string>")
    pairs = offline.cached_in_region(regions, places)
    assert pairs.columns == ["region_id", *places.columns]
    want = [(r, p) for r, w, s, b, n, e in boxes if None not in (w, s) for p, x, y, k in spots if None not in (x, y)
            and s <= x <= n and b <= y <= e and (not w or (k is not None and set(w) & set(k)))]
    narrow = pairs.select("region_id", "id")
    got = narrow.collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > 300_000
    # generated code would hold all rows of a block at once
    final = narrow._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    joins = [line for line in final if "SortMergeJoin" in line]
    assert joins and not any("*(" in line for line in joins)
    narrow.write.parquet(str(tmp_path / "pairs"))
    stored = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert stored < 0.6 * len(want), stored / len(want)
