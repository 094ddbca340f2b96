"""Structured Streaming versions of the incremental parts, on Spark's own state.

Explored cells and cache entries are streaming aggregates in update mode. Points, unlocks and
admission keep a few numbers per key in group state and append what they decide. Both give the same
result however the input is cut into micro-batches, as long as a key's events arrive in time order;
cells and cache entries in any order. No row is dropped for being late. Bound a batch by the source's
``maxFilesPerTrigger``; a key's rows of one batch are held together.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn import fixed_values as fv
from cairn.operators import gamify
from cairn.operators.admission import admit
from cairn.operators.filters import guard_actor
from cairn.operators.ordered import previous_row, running_totals


class Upserts:
    """Sink for streams in update mode: rows by key, the latest batch wins. Batches write under their
    own id, so one that is run again counts once."""

    def __init__(self, path: str, keys: list[str], schema: str) -> None:
        self.path, self.keys, self.schema = path, keys, schema

    def rows(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Current rows, or those as of the start of batch ``before``."""
        stored = f"{self.schema}, batch bigint"
        try:
            changes = spark.read.schema(stored).parquet(self.path)
        except AnalysisException as error:  # nothing written yet; any other error is one
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            changes = spark.createDataFrame([], stored)
        if before is not None:
            changes = changes.where(F.col("batch") < before)
        values = [c for c in changes.columns if c not in (*self.keys, "batch")]
        newest = changes.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
        return newest.select(*self.keys, "v.*")

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def follow(self, changed: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take up all changed rows of a streaming aggregate."""
        fields = [c.split()[0] for c in self.schema.split(", ")]
        return changed.select(*fields).writeStream.outputMode("update").foreachBatch(self.write).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of decisions as Parquet; a batch that is run again counts once."""
    return rows.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]
         ) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


CELLS = "user_id bigint, cell_key string, lat double, lng double, explored_at timestamp, " \
        "visit_id bigint, ord bigint"


def cells_table(path: str) -> Upserts:
    return Upserts(path, ["user_id", "cell_key"], CELLS)


def reveal_cells(points: DataFrame, table: Upserts, checkpoint: str) -> StreamingQuery:
    """Trail points to explored cells; the first revealer of a cell stays, in whatever order points
    come. State: one row per cell."""
    return table.follow(gamify.revealed_cells(points), checkpoint)


AWARDS = "user_id bigint, ts timestamp, ord bigint, visit_id bigint, xp_earned bigint, total_xp bigint"


def award_xp(ledger: DataFrame) -> DataFrame:
    """Point events to running totals, levels and level-ups per award, in append mode.

    State: a user's total. Awards of one batch are taken in time order.
    """
    def each(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).groupby(["ts", "ord", "visit_id"], as_index=False)["xp"].sum()
        reached = total + rows["xp"].cumsum()
        state.update((int(reached.iloc[-1]),))
        yield pd.DataFrame({"user_id": key[0], "ts": rows["ts"], "ord": rows["ord"], "visit_id": rows["visit_id"],
                            "xp_earned": rows["xp"], "total_xp": reached})

    totals = ledger.select("user_id", "ts", "ord", "visit_id", "xp").groupBy("user_id").applyInPandasWithState(
        each, AWARDS, "total bigint", "append", GroupStateTimeout.NoTimeout)
    earlier = gamify.level_of(F.col("total_xp") - F.col("xp_earned"))["level"]
    level = gamify.level_of("total_xp")["level"]
    return totals.withColumns({"level": level, "leveled_up": level != earlier})


#: Groups that the keys of a stream are dealt into: a state holds the keys of its group, as a state
#: and a call of Python for every key would cost more than the work.
KEY_GROUPS = 1 << 12


def _key_group(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS)).alias("key_group")


def _slices(rows: pd.DataFrame, keys: list[str], order: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """(key, its rows in order) of every key; null keys are keys like others."""
    numbers = rows.groupby(keys, sort=False, dropna=False).ngroup()
    rows = rows.assign(_key=numbers).sort_values(["_key", *order], ignore_index=True)
    ends = [*(np.flatnonzero(np.diff(rows["_key"].to_numpy())) + 1).tolist(), len(rows)]
    named = [[None if pd.isna(v) else v for v in rows[k].to_numpy()[[0, *ends[:-1]]]] for k in keys]
    for key, start, end in zip(zip(*named), [0, *ends[:-1]], ends):
        yield key, rows.iloc[start:end]


COUNTS = "user_id string, condition_type string, ts timestamp, amount double, reached double"


def unlock_achievements(increments: DataFrame) -> DataFrame:
    """Metric increments to achievements, each unlocked exactly once, in append mode.

    State: what a user has reached of a metric, for a group of users and metrics.
    """
    def each(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(u, c): r for u, c, r in zip(*state.get)} if state.exists else {}
        done = []
        for name, rows in _slices(pd.concat(list(frames)), ["user_id", "condition_type"], ["ts", "ord"]):
            reached = held.get(name, 0.0) + rows["amount"].cumsum()
            held[name] = float(reached.iloc[-1])
            done.append(rows.assign(reached=reached))
        state.update(([u for u, _ in held], [c for _, c in held], [*held.values()]))
        yield pd.concat(done)[["user_id", "condition_type", "ts", "amount", "reached"]]

    counted = increments.select(
        _key_group("user_id", "condition_type"), F.col("user_id").cast("string"), "condition_type", "ts", "ord",
        F.col("amount").cast("double")).groupBy("key_group").applyInPandasWithState(
            each, COUNTS, "user_id array<string>, condition_type array<string>, reached array<double>", "append",
            GroupStateTimeout.NoTimeout).withColumn("user_id", F.col("user_id").cast("bigint"))
    targets = F.filter(gamify.definition_table(), lambda d: (
        d["condition_type"] == F.col("condition_type"))
        & (gamify.metric_value("reached") >= d["condition_value"])
        & (gamify.metric_value(F.col("reached") - F.col("amount")) < d["condition_value"]))
    return counted.select("user_id", "ts", F.explode(targets).alias("d")).select(
        "user_id", F.col("d.id").alias("achievement_id"), F.col("ts").alias("unlocked_at"))


def votes_table(path: str) -> Upserts:
    return Upserts(path, ["place_id", "user_id"],
                       "place_id bigint, user_id bigint, confirm boolean")


def tallies_table(path: str) -> Upserts:
    return Upserts(path, ["place_id"], "place_id bigint, confirmations bigint, "
                       "rejections bigint, status string, confirm_awards bigint")


def moderate(events: DataFrame, places: DataFrame, votes: Upserts, tallies: Upserts,
             checkpoint: str, threshold: int = fv.MODERATION_THRESHOLD) -> StreamingQuery:
    """Confirm and reject events to tallies and status per place.

    State is the standing vote per (place, user) and the tallies per place; a busy place is one
    tally row and its votes are spread by user.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark, pair = batch.sparkSession, ["place_id", "user_id"]
        accepted, _ = guard_actor(batch, places, "place_id", "user_id", "submitted_by")
        standing = votes.rows(spark, batch_id).withColumnRenamed("confirm", "stood")
        changed = previous_row(accepted, pair, ["ts", "ord"], ["confirm"]).join(
            standing, pair, "left").withColumn("was", F.coalesce("previous.confirm", "stood"))
        now, was = F.col("confirm"), F.col("was")
        sign = F.when(was.isNull() | (was != now), 1).otherwise(0)
        moved = F.when(was.isNotNull() & (was != now), 1).otherwise(0)
        running = running_totals(
            changed.drop("previous", "stood"), ["place_id"], ["ts", "ord"], {
                "confirmations": F.when(now, sign).otherwise(-moved),
                "rejections": F.when(~now, sign).otherwise(-moved)})
        before = tallies.rows(spark, batch_id).select(
            "place_id", F.col("confirmations").alias("c0"), F.col("rejections").alias("r0"),
            F.col("status").alias("s0"), F.col("confirm_awards").alias("a0"))
        zero = F.lit(0)
        full = running.join(before, "place_id", "left").withColumns({
            "confirmations": F.col("confirmations") + F.coalesce("c0", zero),
            "rejections": F.col("rejections") + F.coalesce("r0", zero)})
        crossing = (F.when(now & (F.col("confirmations") >= threshold), "confirmed")
                    .when(~now & (F.col("rejections") >= threshold), "rejected"))
        full = full.withColumn("crossing", crossing)
        when = F.struct("ts", "ord")
        tallies.write(full.groupBy("place_id").agg(
            F.max_by("confirmations", when).alias("confirmations"),
            F.max_by("rejections", when).alias("rejections"),
            F.coalesce(F.max_by("crossing", F.when(F.col("crossing").isNotNull(), when)),
                       F.max("s0"), F.lit("pending")).alias("status"),
            (F.coalesce(F.max("a0"), zero) + F.count_if(F.col("crossing") == "confirmed"))
            .alias("confirm_awards")), batch_id)
        votes.write(accepted.groupBy(*pair).agg(F.max_by("confirm", when).alias("confirm")),
                    batch_id)
    return _run(events, checkpoint, each)


def cache_table(path: str) -> Upserts:
    return Upserts(path, ["key"], "key string, data string, ts timestamp")


def keep_latest(entries: DataFrame, table: Upserts, checkpoint: str) -> StreamingQuery:
    """Cache entries to the latest value per key; ``filters.unexpired`` applies the lifetime.

    Latest means by time, then by value, whatever batch brings it: an entry that arrives late does
    not replace a newer one. State: one row per key.
    """
    newest = entries.groupBy("key").agg(F.max_by(F.struct("data", "ts"), F.struct("ts", "data")).alias("v"))
    return table.follow(newest.select("key", "v.*"), checkpoint)


def admit_stream(calls: DataFrame, limit: int, window_seconds: int = fv.RATE_WINDOW_SECONDS
                 ) -> DataFrame:
    """Accept or reject each call (client, grp, ts, ord) against the client's last accepted calls.

    Every call gets a decision. A call that arrives in a later batch than a newer one of its client is
    marked ``late`` and rejected: the calls after it are decided, and admitting it could break the
    limit among them. State: at most ``limit`` times per client and group, and the newest time, for a group of clients.
    """
    width = window_seconds * 1_000_000

    def each(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(c, g): (t, n) for c, g, t, n in zip(*state.get)} if state.exists else {}
        done = []
        for name, rows in _slices(pd.concat(list(frames)), ["client", "grp"], ["us", "ord"]):
            times, newest = held.get(name, ((), -(1 << 62)))
            us = rows["us"].to_numpy()
            late, accepted = us < newest, deque(times)
            decisions = np.zeros(len(us), bool)
            decisions[~late] = admit(us[~late], accepted, limit, width)
            held[name] = ([int(t) for t in accepted], int(max(newest, rows["us"].max())))
            done.append((rows, decisions, late))
        state.update(([c for c, _ in held], [g for _, g in held], [t for t, _ in held.values()],
                      [n for _, n in held.values()]))
        rows = pd.concat([rows for rows, _, _ in done])
        yield pd.DataFrame({"client": rows["client"], "grp": rows["grp"], "ord": rows["ord"],
                            "accepted": np.concatenate([x for _, x, _ in done]),
                            "late": np.concatenate([x for _, _, x in done])})

    timed = calls.select(_key_group("client", "grp"), F.col("client").cast("string"), "grp",
                         F.unix_micros("ts").alias("us"), "ord")
    decided = timed.groupBy("key_group").applyInPandasWithState(
        each, "client string, grp string, ord bigint, accepted boolean, late boolean",
        "client array<string>, grp array<string>, accepted array<array<bigint>>, newest array<bigint>", "append",
        GroupStateTimeout.NoTimeout)
    return decided.withColumn("client", F.col("client").cast("bigint"))
