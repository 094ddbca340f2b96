"""Shards from fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cairn.session import cut

#: Slots never change; only the map from slots to shards is edited.
SLOTS = 4096
#: Parts of a slot in which rows are numbered, so that no task numbers a whole slot.
PARTS = 16


def slotted(docs: DataFrame, id: str = "doc_id", text: str = "text", slots: int = SLOTS,
            parts: int = PARTS) -> DataFrame:
    """Narrow rows: id, ``size`` (UTF-8 bytes of the text + 8), ``text_crc32``, ``virtual_slot``
    and its ``part``. The hash takes id and text, so neither a repeated id nor a group of equal
    texts fills one slot. Null text: no bytes."""
    body = F.coalesce(F.col(text), F.lit(""))
    mixed = F.xxhash64(F.col(id), body)
    return docs.select(
        F.col(id).alias("id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.pmod(mixed, F.lit(slots)).cast("int").alias("virtual_slot"),
        F.pmod(F.shiftrightunsigned(mixed, 40), F.lit(parts)).cast("int").alias("part"))


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: slots dealt in turn."""
    return [slot % shards for slot in range(slots)]


def rebalanced(owner: list[int], weight: list[int], shards: int) -> list[int]:
    """Edit a map until no move and no swap between the fullest and the emptiest shard evens them.

    ``weight`` has the bytes of each slot. Work is bounded by the number of slots. The largest
    slots of an overfull shard go first, so a very long document finds its own room.
    """
    owner, load = list(owner), [0] * shards
    mine: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(owner):
        load[shard] += weight[slot]
        mine[shard].add(slot)

    def hand(slot: int, to: int) -> None:
        load[owner[slot]] -= weight[slot]
        load[to] += weight[slot]
        mine[owner[slot]].discard(slot)
        mine[to].add(slot)
        owner[slot] = to

    mean = sum(load) / shards
    heap = []
    for shard in range(shards):  # overfull shards give slots away, largest first, down to the mean
        for slot in sorted(mine[shard], key=lambda s: (-weight[s], s)):
            if load[shard] - weight[slot] >= mean and weight[slot]:
                heapq.heappush(heap, (-weight[slot], slot))
                load[shard] -= weight[slot]
    spare = [slot for _, slot in sorted(heap)]
    lowest = [(load[s], s) for s in range(shards)]
    heapq.heapify(lowest)
    for slot in spare:
        _, to = heapq.heappop(lowest)
        load[owner[slot]] += weight[slot]  # taken off above; hand() takes it off again
        hand(slot, to)
        heapq.heappush(lowest, (load[to], to))
    for _ in range(8 * len(owner)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        # a slot of half the gap, or a swap whose difference is half the gap, evens the two best
        moves = [(abs(gap - 2 * weight[s]), s, -1) for s in mine[high] if 0 < weight[s] < gap]
        theirs = sorted(mine[low], key=lambda s: (weight[s], s))
        best = min(moves, default=(gap, -1, -1))
        at = 0
        for s in sorted(mine[high], key=lambda s: (weight[s], s)):
            while at + 1 < len(theirs) and (abs(gap - 2 * (weight[s] - weight[theirs[at + 1]]))
                                            <= abs(gap - 2 * (weight[s] - weight[theirs[at]]))):
                at += 1
            if theirs:
                best = min(best, (abs(gap - 2 * (weight[s] - weight[theirs[at]])), s, theirs[at]))
        if best[0] >= gap:
            break
        hand(best[1], low)
        if best[2] >= 0:
            hand(best[2], high)
    return owner


def write_map(spark: SparkSession, versions: list[list[int]]) -> DataFrame:
    """Store the map's versions as a table ``(version, virtual_slot, shard)`` and read it back."""
    rows = [(v, slot, shard) for v, owner in enumerate(versions, 1)
            for slot, shard in enumerate(owner)]
    return cut(spark.createDataFrame(rows, "version int, virtual_slot int, shard int").coalesce(1))


def assign_shards(docs: DataFrame, shards: int = 24, id: str = "doc_id", text: str = "text",
                  slots: int = SLOTS, parts: int = PARTS) -> DataFrame:
    """Put all rows into shards of nearly equal bytes; ``slot`` is a row's place in its shard.

    Bytes are summed per slot with map-side partial sums; only ``slots`` sums reach the driver,
    which edits version 1 of the map into version 2; both are stored. Places are gapless: rows
    are numbered inside a part of a slot, and small tables of ``slots * parts`` counts give each
    part its start. Null ids and texts are hashed like values; repeated rows get places of their
    own; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    base = cut(slotted(docs, id, text, slots, parts))
    counted = cut(base.groupBy("virtual_slot", "part")
                  .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    weight = [0] * slots
    for row in counted.groupBy("virtual_slot").agg(F.sum("bytes").alias("b")).collect():
        weight[row[0]] = row[1]
    one = first_map(shards, slots)
    two = rebalanced(one, weight, shards)
    current = write_map(spark, [one, two]).filter("version = 2").drop("version")
    order = W.Window.partitionBy("shard").orderBy("virtual_slot", "part")
    starts = (counted.join(F.broadcast(current), "virtual_slot")
              .withColumn("start", F.sum("rows").over(order) - F.col("rows"))
              .select("virtual_slot", "part", "shard", "start"))
    within = W.Window.partitionBy("virtual_slot", "part").orderBy("id", "text_crc32", "size")
    return (base.withColumn("n", F.row_number().over(within))
            .join(F.broadcast(starts), ["virtual_slot", "part"])
            .select(F.col("id").alias(id), "size", "text_crc32", F.lit("bytes").alias("law"),
                    "shard", (F.col("start") + F.col("n") - 1).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"))
