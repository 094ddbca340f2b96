"""The streaming jobs over the events table read as a stream; results must equal the batch ones."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn.functions.columns import iso_second
from cairn.operators import gamify
from cairn.plans import testdata as td
from cairn.plans.catalog import Catalog
from cairn.plans.catalog import base as q
from cairn.plans.catalog.community_queries import _HISTORY
from cairn.plans.catalog.gamify_queries import _cells, _visit_points
from cairn.plans.catalog.gamify_queries import catalog as gamify_catalog
from cairn.plans.catalog.service_queries import ADMISSION
from cairn.session import shared_folder
from cairn.streaming import jobs

catalog = Catalog()


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/cairn-streams/{uuid.uuid4().hex}"


@catalog.add(q.with_ctes(q.GPS, _cells("gps")) + """
SELECT user_id, cell_key, visit_id, strftime(explored_at, '%Y-%m-%d %H:%M:%S') AS explored_at
FROM cells""")
def stream_fog_reveal(spark, sf_dir):
    """ST-S1."""
    home = _folder(spark)
    table = jobs.cells_table(f"{home}/cells")
    points = td.gps_points(spark, sf_dir, td.read_stream)
    jobs.reveal_cells(points, table, f"{home}/check").awaitTermination()
    return table.rows(spark).select("user_id", "cell_key", "visit_id",
                                    iso_second("explored_at").alias("explored_at"))


def _stream_of(rows, path: str):
    """Write ``rows`` to the shared folder and read them back as a stream."""
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


@catalog.add(gamify_catalog.sql["xp_history"])
def stream_xp(spark, sf_dir):
    """ST-S2."""
    home = _folder(spark)
    ledger = gamify.xp_ledger(td.visits(spark, sf_dir), td.notes(spark, sf_dir))
    history = jobs.award_xp(_stream_of(ledger, f"{home}/ledger"))
    jobs.append(history, f"{home}/history", f"{home}/check").awaitTermination()
    return spark.read.parquet(f"{home}/history").select(
        "user_id", "visit_id", "xp_earned", "total_xp", "level", "leveled_up")


@catalog.add(gamify_catalog.sql["first_unlocks"])
def stream_unlocks(spark, sf_dir):
    """ST-S3."""
    home = _folder(spark)
    seen = td.visits(spark, sf_dir)
    log = gamify.visit_increments(seen, td.notes(spark, sf_dir),
                                  gamify.revealed_cells(_visit_points(seen)))
    unlocked = jobs.unlock_achievements(_stream_of(log, f"{home}/log"))
    jobs.append(unlocked, f"{home}/unlocks", f"{home}/check").awaitTermination()
    return spark.read.parquet(f"{home}/unlocks").select(
        "user_id", "achievement_id", iso_second("unlocked_at").alias("unlocked_at"))


@catalog.add(q.with_ctes(q.MODERATION, _HISTORY) + """
SELECT place_id, confirmations, rejections, status, confirm_awards FROM status
WHERE place_id IN (SELECT place_id FROM accepted)""")
def stream_moderation(spark, sf_dir):
    """ST-S5."""
    home = _folder(spark)
    tallies = jobs.tallies_table(f"{home}/tallies")
    events = td.moderation_events(spark, sf_dir, td.read_stream)
    jobs.moderate(events, td.community_places(spark, sf_dir), jobs.votes_table(f"{home}/votes"),
                  tallies, f"{home}/check").awaitTermination()
    return tallies.rows(spark)


@catalog.add("""
SELECT user_id || ':' || event_type AS key, arg_max(event_id, ts)::VARCHAR AS data FROM events
GROUP BY user_id, event_type""")
def stream_latest_values(spark, sf_dir):
    """ST-S6."""
    home = _folder(spark)
    table = jobs.cache_table(f"{home}/cache")
    entries = td.api_calls(spark, sf_dir, td.read_stream).select(
        F.concat_ws(":", "client", "grp").alias("key"), F.col("ord").cast("string").alias("data"),
        "ts")
    jobs.keep_latest(entries, table, f"{home}/check").awaitTermination()
    return table.rows(spark).select("key", "data")


@catalog.add(ADMISSION)
def stream_admission(spark, sf_dir):
    """ST-S4."""
    home = _folder(spark)
    calls = td.api_calls(spark, sf_dir, td.read_stream)
    jobs.append(jobs.admit_stream(calls, 5, 3600), f"{home}/decisions", f"{home}/check").awaitTermination()
    return spark.read.parquet(f"{home}/decisions").select("ord", "accepted")
