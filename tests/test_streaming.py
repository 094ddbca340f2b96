"""A stream in several micro-batches ends where the batch operator ends."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import admission, community, filters, gamify
from cairn.streaming import jobs

T0 = 1_704_067_200


@pytest.fixture()
def feed(spark, tmp_path):
    """Write rows as files in time order and read them one file per micro-batch."""
    def build(rows, schema, name, files=3):
        frame = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
        folder = str(tmp_path / name)
        step = len(rows) // files + 1
        ordered = sorted(rows, key=lambda r: r[schema.replace(",", "").split().index("s") // 2])
        for i in range(0, len(ordered), step):
            spark.createDataFrame(ordered[i:i + step], schema).withColumn(
                "ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(
            folder)
        return frame, stream, str(tmp_path / f"{name}-check")
    return build


def test_reveal_cells(spark, tmp_path, feed):
    rng = random.Random(1)
    rows = [(rng.randrange(3), 42 + rng.randrange(8) / 1000, 19.0, T0 + i * 60, 50.0, i, i)
            for i in range(60)]
    batch, stream, check = feed(rows, "user_id bigint, lat double, lng double, s bigint, "
                                      "radius_m double, visit_id bigint, ord bigint", "gps")
    table = jobs.cells_table(str(tmp_path / "cells"))
    jobs.reveal_cells(stream, table, check).awaitTermination()
    got = {tuple(r) for r in table.rows(spark).select("user_id", "cell_key", "visit_id").collect()}
    want = {tuple(r) for r in gamify.revealed_cells(batch).select(
        "user_id", "cell_key", "visit_id").collect()}
    assert got == want


@pytest.mark.parametrize("files", [1, 20])
def test_award_xp(spark, tmp_path, feed, files):
    rng = random.Random(2)
    rows = [(rng.randrange(3), i, rng.choice([10, 25, 80]), T0 + i * 600, i) for i in range(90)]
    batch, stream, check = feed(rows, "user_id bigint, visit_id bigint, xp bigint, s bigint, "
                                      "ord bigint", "xp", files)
    history = str(tmp_path / "history")
    jobs.append(jobs.award_xp(stream), history, check).awaitTermination()
    columns = ["user_id", "visit_id", "total_xp", "level", "leveled_up"]
    got = {tuple(r) for r in spark.read.parquet(history).select(*columns).collect()}
    want = {tuple(r) for r in gamify.award_history(batch).select(*columns).collect()}
    assert got == want and any(r[4] for r in want)


def test_unlock_achievements(spark, tmp_path, feed):
    rng = random.Random(3)
    rows = [(rng.randrange(2), rng.choice(["total_visits", "total_notes", "night_visit"]), 1,
             T0 + i * 60, i) for i in range(120)]
    batch, stream, check = feed(rows, "user_id bigint, condition_type string, amount bigint, "
                                      "s bigint, ord bigint", "inc")
    unlocks = str(tmp_path / "unlocks")
    jobs.append(jobs.unlock_achievements(stream), unlocks, check).awaitTermination()
    columns = ["user_id", "achievement_id", "unlocked_at"]
    got = [tuple(r) for r in spark.read.parquet(unlocks).select(*columns).collect()]
    want = [tuple(r) for r in gamify.first_unlocks(batch).select(*columns).collect()]
    assert sorted(got) == sorted(want) and want


def test_moderate(spark, tmp_path, feed):
    rng = random.Random(4)
    rows = [(0 if rng.random() < .4 else rng.randrange(4), rng.randrange(6), rng.random() < .6,
             T0 + i * 60, i) for i in range(150)]
    batch, stream, check = feed(rows, "place_id bigint, user_id bigint, confirm boolean, "
                                      "s bigint, ord bigint", "mod")
    owners = spark.createDataFrame([(k, 1) for k in range(4)],
                                   "place_id bigint, submitted_by bigint")
    tallies = jobs.tallies_table(str(tmp_path / "tallies"))
    jobs.moderate(stream, owners, jobs.votes_table(str(tmp_path / "votes")), tallies,
                  check).awaitTermination()
    columns = ["place_id", "confirmations", "rejections", "status", "confirm_awards"]
    want = community.moderation_status(community.moderation_history(batch, owners), owners)
    assert {tuple(r) for r in tallies.rows(spark).select(*columns).collect()} == {
        tuple(r) for r in want.select(*columns).collect()}


def test_keep_latest(spark, tmp_path, feed):
    rows = [(f"k{i % 5}", f"v{i}", T0 + i * 60) for i in range(40)]
    _, stream, check = feed(rows, "key string, data string, s bigint", "cache")
    table = jobs.cache_table(str(tmp_path / "cache"))
    jobs.keep_latest(stream.select("key", "data", "ts"), table, check).awaitTermination()
    latest = table.rows(spark)
    assert {r["key"]: r["data"] for r in latest.collect()} == {f"k{i % 5}": f"v{i}"
                                                               for i in range(35, 40)}
    now = F.timestamp_seconds(F.lit(T0 + 39 * 60))
    assert {r["key"] for r in filters.unexpired(latest, "ts", now, 120).collect()} == {
        "k2", "k3", "k4"}


def test_keep_latest_ignores_late_entries(spark, tmp_path, feed):
    """The second run goes on from the first; what it brings for ``a`` is older or ties."""
    schema, table = "key string, data string, s bigint", jobs.cache_table(str(tmp_path / "late"))
    for rows in ([("a", "new", T0 + 600), ("b", "one", T0)],
                 [("a", "old", T0), ("a", "more", T0 + 600), ("b", "two", T0 + 60)]):
        _, stream, check = feed(rows, schema, "entries")
        jobs.keep_latest(stream.select("key", "data", "ts"), table, check).awaitTermination()
    assert {r["key"]: r["data"] for r in table.rows(spark).collect()} == {"a": "new", "b": "two"}


def test_state_does_not_grow_with_repeated_keys(spark, tmp_path, feed):
    rows = [(f"k{i % 5}", f"v{i}", T0 + i * 60) for i in range(250)]
    _, stream, check = feed(rows, "key string, data string, s bigint", "flat", 50)
    query = jobs.keep_latest(stream.select("key", "data", "ts"), jobs.cache_table(str(tmp_path / "flat-out")), check)
    query.awaitTermination()
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert len(sizes) >= 40 and set(sizes) == {5}


@pytest.mark.parametrize("files", [1, 20])
def test_admit_stream(spark, tmp_path, feed, files):
    rng = random.Random(5)
    rows = [(rng.randrange(2), "g", T0 + i * 7, i) for i in range(150)]
    batch, stream, check = feed(rows, "client bigint, grp string, s bigint, ord bigint", "calls", files)
    out = str(tmp_path / "decisions")
    jobs.append(jobs.admit_stream(stream, 3), out, check).awaitTermination()
    got = {r["ord"]: r["accepted"] for r in spark.read.parquet(out).where("NOT late").collect()}
    want = {r["ord"]: r["accepted"] for r in admission.admit_calls(batch, 3).collect()}
    assert got == want and not all(want.values())


def test_late_calls_are_decided(spark, tmp_path):
    schema, folder = "client bigint, grp string, s bigint, ord bigint", str(tmp_path / "calls")
    for rows in ([(1, "g", T0 + 100, 1)], [(1, "g", T0, 2), (1, "g", T0 + 101, 3), (2, "g", T0, 4)]):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode(
            "append").parquet(folder)
    stream = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.append(jobs.admit_stream(stream, 5), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r["ord"]: (r["accepted"], r["late"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (True, False), 4: (True, False)}
