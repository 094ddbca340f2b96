"""Repeated byte strings by difference-cover blockwise suffix sorting.

Texts lie in blocks: ranges of ids of bounded bytes. A suffix matters to the depth of ``length`` bytes
only. Positions whose residue is in a difference cover are the sample: any two positions have a common
shift at which both meet it, so two equal strings of ``length`` bytes share a sample string of
``length - period + 1`` bytes there. First the sample is sorted, one bucket at a time, and each sample
string learns whether another block has it. A suffix none of whose sample strings is shared is told
apart by that alone, however long its tie with others seems. Only the rest go into the second sort,
again one bucket at a time, at full depth.

Blocks are ranges of ids, so "an earlier block has it" is all a bucket must answer: no ids travel. A
block sends sorted names as gaps, a few bytes each, and gets one bit each back; the order of names
within a block is made again from its text. No bucket holds more than one entry per block and string,
so a passage that every document has is as small as any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.substrings import COVERS
from cairn.session import cut

#: Text of a block, in bytes; one longer document is a block of its own.
BLOCK = 8 << 20
#: Names sorted at once in a bucket, at most, as planned from the corpus.
BUCKET = 4 << 20
#: Bits by which a sample name is longer than needed to number the sample: one of 2^SPARE_BITS strings
#: that no other block has is taken for shared, and costs a place in the second sort, no more.
SPARE_BITS = 10
#: Positions whose names are made at once; bounds the memory of a block.
SLICE = 1 << 20
ENTRY = "kind int, bucket int, block int, size int, blob binary"
#: Fixed odd multipliers that mix eight bytes at a time.
_M1, _M2, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29)


def names_at(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64-bit names of the ``width`` bytes at each place; equal strings have equal names."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    steps = [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]
    names = np.empty(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(at), SLICE):
            here, x = at[a:a + SLICE], np.full(min(SLICE, len(at) - a), width, np.uint64)
            for step in steps:
                x ^= words[here + step]
                x *= _M1
                x ^= x >> _SHIFT
                x *= _M2
                x ^= x >> _SHIFT
            names[a:a + SLICE] = x
    return names


def packed(names: np.ndarray) -> bytes:
    """Sorted distinct names as gaps, byte by byte of all gaps, so that the upper bytes vanish."""
    gaps = np.diff(names, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(blob: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, size)
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def bucket_edges(buckets: int) -> np.ndarray:
    """Where buckets of equal width end, the last open."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


class Block:
    """The texts of one block end to end, with what the sorts need of them."""

    def __init__(self, rows: pd.DataFrame, copies: set[tuple[int, bytes]], length: int, period: int):
        rows = rows.sort_values("doc", kind="stable")
        self.docs = rows["doc"].to_numpy(np.int64)
        self.texts = [t.encode() for t in rows["text"]]
        self.copy = [bool(copies) and (d, hashlib.sha256(t).digest()) in copies for d, t in zip(self.docs.tolist(), self.texts)]
        self.length, self.period, self.width = length, period, length - period + 1
        kept = [i for i, c in enumerate(self.copy) if not c and len(self.texts[i]) >= length]
        sizes = np.array([len(self.texts[i]) for i in kept], np.int64)
        self.rows = np.array(kept, np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.data = np.frombuffer(b"".join(self.texts[i] for i in kept) + bytes(length + 8), np.uint8)
        cover = np.zeros(period, bool)
        cover[list(COVERS[period])] = True
        # sample places: their residue within the document is in the cover, and a whole string fits
        places = []
        for a, n in zip(self.start.tolist(), sizes.tolist()):
            at = np.flatnonzero(np.resize(cover, n - self.width + 1))
            places.append(at + a)
        self.sample = np.concatenate(places) if places else np.zeros(0, np.int64)

    def sorted_names(self, at: np.ndarray, width: int, shift: int = 0):
        """``(distinct names in order, which of them each place has, whether several documents have it
        here, the row of the first document that has it)``."""
        names = names_at(self.data, at, width) >> np.uint64(shift)
        order = np.argsort(names, kind="stable")  # places ascend, so ids do within a name
        ranked = names[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        group = np.empty(len(at), np.int64)
        group[order] = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        doc = self.docs[self.rows[np.searchsorted(self.start, at[order], "right") - 1]] if len(at) else np.zeros(0, np.int64)
        last = np.append(begins[1:], len(doc)) - 1
        return ranked[begins], group, doc[begins], doc[begins] != doc[last] if len(doc) else np.zeros(0, bool)

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Suffixes that hold one of the given sample places' strings whole, at a shift below the period."""
        at = self.sample[shared]
        if not len(at):
            return at
        of = np.searchsorted(self.start, at, "right") - 1
        low = np.maximum(at - self.period + 1, self.start[of])
        high = np.minimum(at, self.start[of + 1] - self.length)
        low, high = low[high >= low], high[high >= low]
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, low, 1)
        np.add.at(edge, high + 1, -1)
        return np.flatnonzero(np.cumsum(edge) > 0)


def _sent(kind: int, names: np.ndarray, block: int, buckets: int, shift: int = 0) -> Iterator[tuple]:
    """A block's names by bucket."""
    edges = [0, *np.searchsorted(names, bucket_edges(buckets) >> np.uint64(shift)).tolist(), len(names)]
    for bucket, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            yield kind, bucket, block, b - a, packed(names[a:b])


def _bits(replies: pd.DataFrame, kind: int) -> np.ndarray:
    """The answers to a block's names in order; none where nothing was sent."""
    found = replies[replies["kind"] == kind].sort_values("bucket")
    if not len(found):
        return np.zeros(0, bool)
    return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
                           for b, n in zip(found["blob"], found["size"])])


def meet(earlier_only: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Sort one bucket: all blocks' names together, blocks in order within a name. The answer to each
    is whether another block has it, or whether an earlier one has."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ignore_index=True)
        names = np.concatenate([unpacked(b, n) for b, n in zip(rows["blob"], rows["size"])])
        order = np.argsort(names, kind="stable")
        ranked = names[order]
        again = np.zeros(len(ranked), bool)
        again[1:] = ranked[1:] == ranked[:-1]
        if not earlier_only:
            again[:-1] |= again[1:].copy()
        answer = np.empty(len(ranked), bool)
        answer[order] = again
        parts = np.split(answer, np.cumsum(rows["size"].to_numpy())[:-1])
        return rows.assign(blob=[np.packbits(p).tobytes() for p in parts])[[c.split()[0] for c in ENTRY.split(", ")]]
    return run


#: Kinds of small rows that come back to a block.
COPY, SAMPLE, SUFFIX = 0, 1, 2


def remove_repeated_bytes(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50,
                          period: int = 31) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a
    smaller id. A text equal to that of a smaller id takes no part: the other has all its strings.
    Strings are compared by 64-bit names, after their sample string has met its like in the same way;
    at 30 GB of text about one pair of different strings is expected to share a name.

    Null and empty texts have no bytes. Rows with equal ids do not remove each other's bytes; repeated
    rows get the same answer. A row with a null id neither removes nor loses bytes. An empty table
    gives no rows. Other columns are not read. A task holds one block at a time and a few numbers per
    byte of it; a single text over ``BLOCK`` bytes is held whole. The driver gets the first id of each
    block, eight bytes for eight megabytes of text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).cast("long").alias("doc"), body.alias("text"))
    narrow = cut(rows.filter("doc IS NOT NULL").select(
        "doc", F.octet_length("text").cast("long").alias("size"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha")))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    first_ids = block_starts(narrow)
    width = length - period + 1
    places = int(total * len(COVERS[period]) / period)
    sample_buckets = places // BUCKET + 1
    shift = max(0, 64 - places.bit_length() - SPARE_BITS)
    suffix_buckets = int(total) // BUCKET + 1

    @F.pandas_udf("int")
    def block_of(doc: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(first_ids, doc.to_numpy(), "right").astype("int32"))

    firsts = narrow.groupBy("sha").agg(F.min("doc").alias("least"))
    copies = cut(narrow.join(firsts, "sha").filter("doc > least").select("doc", "sha").distinct()
                 .groupBy(block_of("doc").alias("block"), F.pmod(F.hash("sha"), F.lit(64)).alias("bucket"))
                 .agg(F.collect_list(F.struct("doc", "sha")).alias("found")))
    copies = copies.select(F.lit(COPY).alias("kind"), "bucket", "block", F.size("found").alias("size"),
                           F.unhex(F.array_join(F.transform("found", lambda x: F.concat(
                               F.lpad(F.hex(x["doc"]), 16, "0"), x["sha"])), "")).alias("blob"))
    placed = rows.filter("doc IS NOT NULL").withColumn("block", block_of("doc")).groupBy("block")

    def opened(texts: pd.DataFrame, small: pd.DataFrame) -> Block:
        entries = b"".join(small[small["kind"] == COPY]["blob"])
        known = {(int.from_bytes(entries[i:i + 8], "big", signed=True), entries[i + 8:i + 40]) for i in range(0, len(entries), 40)}
        return Block(texts, known, length, period)

    def table(found: Iterator[tuple]) -> pd.DataFrame:
        return pd.DataFrame(list(found), columns=[c.split()[0] for c in ENTRY.split(", ")])

    def send_sample(texts: pd.DataFrame, small: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return table(iter(()))
        block = opened(texts, small)
        names, _, _, _ = block.sorted_names(block.sample, width, shift)
        return table(_sent(SAMPLE, names, int(texts["block"].iloc[0]), sample_buckets, shift))

    def suffixes(block: Block, small: pd.DataFrame):
        """Candidate suffixes, and which of them might meet one of another block."""
        _, group, _, several = block.sorted_names(block.sample, width, shift)
        elsewhere = _bits(small, SAMPLE)
        far = elsewhere[group] if len(group) else np.zeros(0, bool)
        at = block.candidates(far | several[group])
        return at, np.isin(at, block.candidates(far), assume_unique=True)

    def send_suffixes(texts: pd.DataFrame, small: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return table(iter(()))
        block = opened(texts, small)
        at, far = suffixes(block, small)
        names = np.unique(names_at(block.data, at[far], length))
        return table(_sent(SUFFIX, names, int(texts["block"].iloc[0]), suffix_buckets))

    def answer(texts: pd.DataFrame, small: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if not len(texts):
            return pd.DataFrame(columns=columns)
        block = opened(texts, small)
        at, far = suffixes(block, small)
        names, group, least, _ = block.sorted_names(at, length)
        sent = np.zeros(len(names), bool)
        sent[group[far]] = True
        earlier = np.zeros(len(names), bool)
        earlier[sent] = _bits(small, SUFFIX)
        mine = block.docs[block.rows[np.searchsorted(block.start, at, "right") - 1]] if len(at) else np.zeros(0, np.int64)
        gone = at[earlier[group] | (least[group] < mine)]
        edge = np.zeros(len(block.data) + 1, np.int32)
        edge[gone] += 1  # places are distinct
        edge[gone + length] -= 1
        removed = np.cumsum(edge) > 0
        where = {int(row): i for i, row in enumerate(block.rows)}
        found = []
        for i, (doc, body, copy) in enumerate(zip(block.docs.tolist(), block.texts, block.copy)):
            if copy and len(body) >= length:
                found.append((doc, len(body), len(body), 1, hashlib.sha256().hexdigest()))
            elif i in where:
                a, b = block.start[where[i]], block.start[where[i] + 1]
                mask = removed[a:b]
                kept = block.data[a:b][~mask].tobytes() if mask.any() else body
                spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                found.append((doc, len(body), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
            else:
                found.append((doc, len(body), 0, 0, hashlib.sha256(body).hexdigest()))
        return pd.DataFrame(found, columns=columns)

    def told(small: DataFrame, step: Callable, schema: str) -> DataFrame:
        return placed.cogroup(small.groupBy("block")).applyInPandas(step, schema)

    # one plan from here on: the texts are exchanged once, and all three steps read that exchange
    sample = told(copies, send_sample, ENTRY).groupBy("bucket").applyInPandas(meet(False), ENTRY)
    known = copies.unionByName(sample)
    suffix = told(known, send_suffixes, ENTRY).groupBy("bucket").applyInPandas(meet(True), ENTRY)
    judged = told(known.unionByName(suffix), answer,
                  "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    nameless = rows.filter("doc IS NULL").select(
        "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
    return judged.unionByName(nameless).withColumnRenamed("doc", id)


def block_starts(narrow: DataFrame) -> np.ndarray:
    """First ids of the blocks but the first: ids in order, cut whenever ``BLOCK`` bytes are full. Rows
    of one id stay together."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full, last = 0, None
        for batch in batches:
            found = []
            for doc, size in zip(batch["doc"].tolist(), batch["size"].tolist()):
                if doc != last and (last is None or full + size > BLOCK):
                    found.append(doc)
                    full = 0
                full, last = full + size, doc
            if found:
                yield pd.DataFrame({"doc": found})
    total = narrow.agg(F.sum("size")).first()[0] or 0
    ranges = int(total // (16 * BLOCK)) + 1
    starts = (narrow.select("doc", "size").repartitionByRange(ranges, "doc").sortWithinPartitions("doc")
              .mapInPandas(run, "doc long").collect())
    return np.array(sorted(r["doc"] for r in starts)[1:], np.int64)
