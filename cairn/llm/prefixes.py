"""Conversation prefix trie: sequences in range shards, padded turn-id matrices, change masks that mark
node starts, reduceat per depth, and nodes that cross a shard's edge put together again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import cut

#: Bytes of a turn's identity: two hashes of role and text, big-endian, so that bytes order like turns.
TURN = 16
#: Conversations whose ids one row of the first folding step may hold.
SPAN = 4096
#: Entries of a padded matrix; a shard that would need more is cut into several.
CELLS = 1 << 21

SEQUENCE = "conv long, ids binary, sizes binary"
NODE = ("conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string, parent_conv_id long, shard int, chunk int, key binary, parent_key binary")
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def _assembled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns sorted by conversation to one row per conversation; only identities are held."""
    conv, ids, sizes = None, [], []

    def row() -> pd.DataFrame:
        return pd.DataFrame({"conv": [conv], "ids": [b"".join(ids)], "sizes": [b"".join(sizes)]})

    for batch in batches:
        convs = batch["conv"].to_numpy()
        packed = batch[["a", "b"]].to_numpy(np.int64).view(np.uint64).astype(">u8").tobytes()
        lengths = batch["bytes"].to_numpy("<i8").tobytes()
        edges = [0, *(np.flatnonzero(convs[1:] != convs[:-1]) + 1).tolist(), len(convs)]
        done = []
        for a, b in zip(edges, edges[1:]):
            if a < b:
                if conv is not None and convs[a] != conv:
                    done.append(row())
                    ids, sizes = [], []
                conv = int(convs[a])
                ids.append(packed[TURN * a:TURN * b])
                sizes.append(lengths[8 * a:8 * b])
        if done:
            yield pd.concat(done)
    if conv is not None:
        yield row()


def sequences(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """``conv, ids, sizes``: a conversation's turns in order (null first, ties by role and text), as
    16 bytes of identity and the UTF-8 length of each text. Texts are sorted, but not collected."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    turns = (conversations.filter(F.col(conv).isNotNull())
             .select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), said[0].alias("role"), said[1].alias("text"))
             .withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit("second"), "text", "role"),
                           "bytes": F.octet_length("text").cast("long")}))
    return (turns.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
            .select("conv", "a", "b", "bytes").mapInPandas(_assembled, SEQUENCE))


def rebuilt(own: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Every conversation ``c`` starts with the first ``h`` turns of ``c - c % family`` and goes on with
    its own after the first ``h``; ``h`` is the CRC-32 of its number modulo ``most``."""
    heads = own.select(F.col("conv").alias("base"), F.substring("ids", 1, TURN * (most - 1)).alias("head_ids"),
                       F.substring("sizes", 1, 8 * (most - 1)).alias("head_sizes"))
    nothing = F.lit(b"")

    def joined(head: str, mine: str, width: int):
        h = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
        return F.concat(F.coalesce(F.col(head).substr(F.lit(1), h * width), nothing),
                        F.col(mine).substr(h * width + 1, F.length(mine)))

    return (own.withColumn("base", F.col("conv") - F.col("conv") % family).join(heads, "base", "left")
            .select("conv", joined("head_ids", "ids", TURN).alias("ids"), joined("head_sizes", "sizes", 8).alias("sizes")))


def _ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted runs of ids of one sequence to its digest; nothing but the open digest is held."""
    name, digest, n, first = None, None, 0, None

    def row() -> tuple:
        return (*name, n, first, digest.hexdigest())

    for batch in batches:
        done = []
        for k1, k2, line, count, least in zip(*(batch[c].tolist() for c in ("k1", "k2", "line", "count", "least"))):
            if name != (k1, k2):
                if name is not None:
                    done.append(row())
                name, digest, n, first = (k1, k2), hashlib.sha256(), 0, least
            else:
                digest.update(b",")
            digest.update(line.encode())
            n += count
        if done:
            yield pd.DataFrame(done, columns=["k1", "k2", "n", "conv", "ends"])
    if name is not None:
        yield pd.DataFrame([row()], columns=["k1", "k2", "n", "conv", "ends"])


def folded(whole: DataFrame) -> DataFrame:
    """Equal sequences as one row: ``ids, sizes, n, conv`` (the smallest) ``, ends``.

    The digest of all members in order needs them one after the other. They come in runs of up to
    ``SPAN`` numbers, so a sequence that a third of all conversations share brings few rows.
    """
    named = cut(whole.withColumns({"k1": F.xxhash64("ids"), "k2": F.xxhash64(F.lit("second"), "ids")}))
    runs = (named.groupBy("k1", "k2", F.floor(F.col("conv") / SPAN).alias("span"))
            .agg(F.sort_array(F.collect_list("conv")).alias("convs"))
            .select("k1", "k2", "span", F.array_join(F.col("convs").cast("array<string>"), ",").alias("line"),
                    F.size("convs").cast("long").alias("count"), F.col("convs")[0].alias("least")))
    ended = (runs.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "span")
             .mapInPandas(_ended, "k1 long, k2 long, n long, conv long, ends string"))
    bodies = named.groupBy("k1", "k2").agg(F.first("ids").alias("ids"), F.first("sizes").alias("sizes"))
    return ended.join(bodies, ["k1", "k2"]).select("ids", "sizes", "n", "conv", "ends")


def _prefix_keys(ids: bytes) -> list[bytes]:
    """Name of every prefix, the empty one first."""
    state = xxhash.xxh3_128()
    keys = [state.digest()]
    for at in range(0, len(ids), TURN):
        state.update(ids[at:at + TURN])
        keys.append(state.digest())
    return keys


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from the start."""
    n = min(len(a), len(b)) // TURN
    x, y = (np.frombuffer(s, f"S{TURN}", n) for s in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def _chunks(ids: list[bytes]) -> list[np.ndarray]:
    """Rows in ranges whose matrices fit; one range if all do."""
    longest = max(map(len, ids)) // TURN
    if len(ids) * longest <= CELLS or len(ids) == 1:
        return [np.arange(len(ids))]
    order, found, start, width = sorted(range(len(ids)), key=ids.__getitem__), [], 0, 0
    for i, row in enumerate(order):
        grown = max(width, len(ids[row]) // TURN)
        if i > start and (i + 1 - start) * grown > CELLS:
            found.append(np.array(order[start:i]))
            start, grown = i, len(ids[row]) // TURN
        width = grown
    return [*found, np.array(order[start:])]


def _nodes(ids: list[bytes], sizes: list[bytes], n: np.ndarray, conv: np.ndarray, ends: np.ndarray,
           before: bytes | None, after: bytes | None) -> Iterator[dict]:
    """Nodes of one range of distinct sequences; ``before`` and ``after`` are its neighbours' rows."""
    lens = np.fromiter((len(x) // TURN for x in ids), np.int64, len(ids))
    width = int(lens.max())
    ranks = np.unique(np.frombuffer(b"".join(ids), f"S{TURN}"), return_inverse=True)[1]
    inside = np.arange(width) < lens[:, None]
    matrix, size = np.full((len(ids), width), -1, np.int64), np.zeros((len(ids), width), np.int64)
    matrix[inside] = ranks
    size[inside] = np.frombuffer(b"".join(sizes), "<i8")
    order = np.lexsort(matrix.T[::-1]) if width else np.arange(len(ids))
    matrix, size, lens, n, conv, ends = matrix[order], size[order], lens[order], n[order], conv[order], ends[order]
    first, last = ids[order[0]], ids[order[-1]]
    # a depth that a row shares with the row before starts no node; -1: there is no such row
    shared_before = -1 if before is None else _common(before, first)
    shared_after = -1 if after is None else _common(last, after)
    differs = np.ones(matrix.shape, bool)
    differs[1:] = matrix[1:] != matrix[:-1]
    differs[0, :max(shared_before, 0)] = False
    starts = np.logical_or.accumulate(differs, axis=1) & (matrix >= 0)
    shared = np.append((lens - starts.sum(axis=1))[1:], shared_after)
    leaf = shared != lens
    below = lambda x: np.concatenate(  # noqa: E731  sums from a column to the end of the row
        [np.cumsum(x[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1), np.int64)], axis=1)
    whole, once = below(size) * n[:, None], below(np.where(starts, size, 0))
    keys_first = _prefix_keys(first[:TURN * max(shared_before, 0)])
    keys_last = _prefix_keys(last[:TURN * max(shared_after, 0)])
    rows, upper = np.arange(len(lens)), None
    for depth in range(width + 1):
        rows = rows[lens[rows] >= depth]
        begins = np.ones(len(rows), bool) if depth else np.zeros(len(rows), bool)
        if depth:
            begins = starts[rows, depth - 1]
        begins[0] = True
        at = np.flatnonzero(begins)
        add = lambda x: np.add.reduceat(x[rows], at)
        column = max(depth - 1, 0)
        least = np.minimum.reduceat(conv[rows], at)
        head = rows[at]
        key = np.full(len(at), None, object)
        if depth <= shared_before:
            key[0] = keys_first[depth]
        if depth <= shared_after:
            key[-1] = keys_last[depth]
        found = {"conv_id": least, "depth": np.full(len(at), depth), "n_convs": add(n),
                 "n_children": add(starts[:, depth].astype(np.int64)) if depth < width else np.zeros(len(at), np.int64),
                 "n_leaves": add(leaf.astype(np.int64)), "saved_tokens": add(whole[:, column]) - add(once[:, column]),
                 "ends_sha256": np.where(lens[head] == depth, ends[head], None), "key": key}
        if upper is None:
            found |= {"parent_conv_id": np.full(len(at), None, object), "parent_key": np.full(len(at), None, object)}
        else:
            of, names, opened = upper[0][head], upper[1], upper[2]
            is_open = np.array([opened[i] is not None for i in of])
            found |= {"parent_conv_id": np.where(is_open, None, names[of].astype(object)),
                      "parent_key": opened[of]}
        yield found
        group = np.full(len(lens), -1)
        group[rows] = np.cumsum(begins) - 1
        upper = (group, least, key)


def shard_nodes(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a shard. Those that reach beyond a range carry a key and only this range's share."""
    names = [c.split()[0] for c in NODE.split(", ")]
    if not len(rows):
        return pd.DataFrame(columns=names)
    ids, sizes = rows["ids"].tolist(), rows["sizes"].tolist()
    n, conv, ends = rows["n"].to_numpy(np.int64), rows["conv"].to_numpy(np.int64), rows["ends"].to_numpy(object)
    chunks = _chunks(ids)
    lows = [None if pd.isna(x) else x for x in edges["before"]] + [max(ids[i] for i in c) for c in chunks[:-1]]
    highs = [min(ids[i] for i in c) for c in chunks[1:]] + [None if pd.isna(x) else x for x in edges["after"]]
    found = []
    for number, (c, low, high) in enumerate(zip(chunks, lows, highs)):
        for part in _nodes([ids[i] for i in c], [sizes[i] for i in c], n[c], conv[c], ends[c], low, high):
            found.append(pd.DataFrame(part | {"shard": rows["shard"].iloc[0], "chunk": number}))
    return pd.concat(found)[names]


def trie(seqs: DataFrame, shard_turns: int = 500_000) -> DataFrame:
    """All nodes of the trie over distinct sequences ``ids, sizes, n, conv, ends``.

    Sequences are dealt into ranges of their order of about ``shard_turns`` turns. A node starts in
    exactly one range (a range knows the row before it), so every figure of a node that crosses edges
    is the sum of its shares: ``saved_tokens`` too, as members' bytes below a node less the bytes of
    the distinct nodes there. Crossing nodes lie on the paths of a range's first and last row only.
    """
    seqs = cut(seqs)
    turns = seqs.agg(F.sum(F.length("ids") / TURN + 1)).first()[0] or 0
    placed = cut(seqs.repartitionByRange(int(turns // shard_turns) + 1, "ids").withColumn("shard", F.spark_partition_id()))
    in_order = Window.orderBy("shard")  # one row per shard
    edges = (placed.groupBy("shard").agg(F.min("ids").alias("low"), F.max("ids").alias("high"))
             .select("shard", F.lag("high").over(in_order).alias("before"), F.lead("low").over(in_order).alias("after")))
    parts = cut(placed.groupBy("shard").cogroup(cut(edges).groupBy("shard")).applyInPandas(shard_nodes, NODE))
    crossing = cut(parts.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *[F.sum(c).alias(c) for c in _SUMS],
        F.max("ends_sha256").alias("ends_sha256"), F.max("parent_key").alias("parent_key")))
    figures = ["conv_id", "depth", "parent_conv_id", *_SUMS, "ends_sha256"]
    # a crossing parent is looked up by range, so that the children of the root do not meet in one task
    names = crossing.select("key", F.col("conv_id").alias("parent_conv_id"))
    here = (parts.filter("key IS NOT NULL").select("shard", "chunk", "key").distinct().join(names, "key")
            .withColumnRenamed("key", "parent_key"))
    closed = parts.filter("key IS NULL")
    return (closed.filter("parent_key IS NULL").select(figures)
            .unionByName(closed.filter("parent_key IS NOT NULL").drop("parent_conv_id")
                         .join(here, ["shard", "chunk", "parent_key"]).select(figures))
            .unionByName(crossing.join(names.withColumnRenamed("key", "parent_key"), "parent_key", "left").select(figures)))


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", family: int | None = 5, most: int = 9, shard_turns: int = 500_000) -> DataFrame:
    """One row per distinct prefix of the (rebuilt) conversations, the empty one included: ``conv_id``
    (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens`` (bytes
    spared if each node of the subtree were kept once) and ``ends_sha256`` of those that end there.

    ``family=None`` takes conversations as they are. Null roles and texts are empty; null turns come
    first; equal turn numbers are ordered by role, then text; repeated rows are turns of their own.
    Rows with a null conversation are left out. An empty table gives no rows, not even the root. Other
    columns are not read. One conversation's turns (24 bytes each) are held by one task.
    """
    own = sequences(conversations, conv, turn, role, text)
    whole = own if family is None else rebuilt(cut(own), family, most)
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return trie(folded(whole), shard_turns).withColumn("ends_sha256", F.coalesce("ends_sha256", nobody))
