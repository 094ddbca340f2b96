"""Change logs: upserts, deletes with their dependants, and edge logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_patches(rows: DataFrame, patches: DataFrame, key: str, fields: Sequence[str],
                  ts: str = "ts", updated: str = "updated_at") -> DataFrame:
    """Patch ``fields`` with the latest non-null value per key and move ``updated`` forward.

    ``patches`` has key, ts, ord and the fields; patches on unknown keys have no effect. An
    aggregate per field (``max_by`` skips null orderings), so no window over a busy key.
    """
    def latest(field: str) -> Column:
        return F.max_by(field, F.when(F.col(field).isNotNull(), F.struct(ts, "ord")))

    folded = patches.groupBy(key).agg(
        F.max(ts).alias("_updated"), *[latest(f).alias(f"_new_{f}") for f in fields])
    joined = rows.join(folded, key, "left").withColumns(
        {f: F.coalesce(f"_new_{f}", f) for f in fields})
    if updated in rows.columns:
        joined = joined.withColumn(updated, F.coalesce("_updated", updated))
    return joined.select(*rows.columns)


def delete_cascade(rows: DataFrame, deleted: DataFrame, key: str, dependants: DataFrame,
                   foreign_key: str) -> tuple[DataFrame, DataFrame]:
    """Remove deleted keys from a table and from the table that depends on it."""
    gone = deleted.select(key).distinct()
    return (rows.join(gone, key, "left_anti"),
            dependants.join(gone.withColumnRenamed(key, foreign_key), foreign_key, "left_anti"))


def unlink(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Keep rows whose parent was deleted, but clear the reference."""
    gone = deleted.select(key).distinct().withColumn("_gone", F.lit(True))
    return rows.join(gone, key, "left").withColumn(
        key, F.when(F.col("_gone").isNull(), F.col(key))).select(*rows.columns)


def current_edges(log: DataFrame) -> DataFrame:
    """Follow log -> current edges with consent.

    An edge exists when its last follow is later than its last unfollow. Consent counts only if
    given after that follow; following again resets it; consent without an edge is ignored.
    Self-edges are dropped. Two aggregates per edge, no ordering of the whole log.
    """
    clean = log.where("follower_id <> following_id")
    edge = ["follower_id", "following_id"]
    folded = clean.groupBy(*edge).agg(
        F.max(F.when(F.col("action") == "follow", F.col("ord"))).alias("followed"),
        F.max(F.when(F.col("action") == "unfollow", F.col("ord"))).alias("unfollowed"),
        F.max_by(F.when(F.col("action") == "consent", F.struct("ord", "consent")),
                 F.when(F.col("action") == "consent", F.col("ord"))).alias("answer"))
    alive = F.col("followed") > F.coalesce("unfollowed", F.lit(-1))
    given = (F.col("answer.ord") > F.col("followed")) & F.col("answer.consent")
    return folded.where(alive).select(*edge, F.coalesce(given, F.lit(False))
                                      .alias("consent_given"), F.col("followed").alias("since"))


def apply_sync(queue: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Mark pending items as synced: (new queue, one row of counters).

    Items with an id that is not path-safe fail and stay pending.
    """
    pending = ~F.col("synced")
    fine = F.rlike("id", F.lit("^[a-zA-Z0-9_-]{1,64}$"))
    done = pending & fine
    applied = queue.withColumns({
        "synced": F.col("synced") | done,
        "synced_at": F.when(done, now).otherwise(F.col("synced_at"))})
    counters = queue.agg(F.count_if(done).alias("synced_count"),
                         F.count_if(pending & ~fine).alias("failed_count"))
    return applied, counters


def pending_items(queue: DataFrame, include_synced: bool = False) -> DataFrame:
    """Queue in id order; by default only what is not synced."""
    kept = queue if include_synced else queue.where(~F.col("synced"))
    return kept.orderBy("id")


def purge_synced(queue: DataFrame) -> DataFrame:
    return queue.where(~F.col("synced"))


def merge_queue(server: DataFrame, queue: DataFrame, key: str,
                fields: Sequence[str]) -> DataFrame:
    """Bring pending queue items into the server table, local values winning.

    Per resource the last operation decides: delete removes it, create and update write the last
    non-null value of each field.
    """
    pending = queue.where(~F.col("synced"))
    folded = pending.groupBy(key).agg(
        F.max_by("operation", F.struct("created_at", "ord")).alias("_last"),
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.struct("created_at", "ord")))
          .alias(f"_new_{f}") for f in fields])
    joined = server.join(folded, key, "full_outer").where(
        F.coalesce(F.col("_last") != "delete", F.lit(True)))
    return joined.select(key, *[F.coalesce(f"_new_{f}", f).alias(f) for f in fields])
