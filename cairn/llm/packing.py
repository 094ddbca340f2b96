"""Best-fit packing of token sequences with large-item matching."""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from tokenizers import Tokenizer

from cairn.session import cut

CAPACITY = 1024
END = 2
SPECIAL = "<|endoftext|>"


@functools.cache
def _ranks(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


@functools.cache
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def token_ids(text: str | None, vocabulary: str | None = None, ranks: str | None = None) -> list[int]:
    """The ids of byte_bpe_50k.json. The rank file holds the same vocabulary and its encoder is
    four times as fast; only texts with the special token's string, which the two treat
    differently, go through the tokenizer itself."""
    if not text:
        return []
    if SPECIAL in text:
        path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        return _tokenizer(path).encode(text, add_special_tokens=False).ids
    return _ranks(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_ordinary(text)


def piece_bounds(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; the first takes the remainder."""
    first = (length - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


PIECES = "doc long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None,
               ranks: str | None = None) -> DataFrame:
    """``(doc, text)`` rows to one row per piece of at most ``capacity`` tokens."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc"].array, batch["text"].array):
                ids = np.array([*token_ids(text, vocabulary, ranks), END], dtype="<u4")
                rows += [(doc, k, at, n, zlib.crc32(ids[at:at + n].tobytes()))
                         for k, (at, n) in enumerate(piece_bounds(len(ids), capacity))]
            yield pd.DataFrame(rows, columns=["doc", "piece", "start", "length", "ids_crc32"]
                               ).astype({"doc": "Int64"})
    return docs.select("doc", "text").mapInPandas(run, PIECES)


#: length, first rank, last rank + 1, first sequence, items per sequence, offset of the first
Run = tuple[int, int, int, int, int, int]


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Pack items, given as counts per length, and describe the packing by runs.

    Items over a third of the capacity are matched first: the longest with the longest partner that
    fits, two per sequence at most. Then smaller items, longest first, fill the tightest gap that
    takes them; a new sequence is opened only when none does. Sequences filled alike are handled
    as one run, so the work depends on the number of lengths, never on the number of items.
    """
    third = capacity // 3
    left = {s: n for s, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    runs: list[Run] = []
    opened = 0

    def place(size: int, items: int, first: int, per: int, offset: int) -> None:
        runs.append((size, used[size], used[size] + items, first, per, offset))
        used[size] += items
        left[size] -= items

    large = sorted((s for s in left if s > third), reverse=True)
    for size in large:
        while left[size]:
            partner = next((p for p in large if p <= min(size, capacity - size)
                            and left[p] > (p == size)), None)
            many = left[size] if partner is None else (
                left[size] // 2 if partner == size else min(left[size], left[partner]))
            place(size, many, opened, 1, 0)
            if partner is not None:
                place(partner, many, opened, 1, size)
            gaps.setdefault(capacity - size - (partner or 0), []).append((opened, many))
            opened += many
    for size in sorted((s for s in left if s <= third), reverse=True):
        while left[size]:
            gap = min((g for g in gaps if g >= size), default=None)
            if gap is None:
                gap, per = capacity, capacity // size
                gaps[gap] = [(opened, -(-left[size] // per))]
                opened += gaps[gap][0][1]
            per = gap // size
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            full = min(many, left[size] // per)
            if full:
                place(size, full * per, first, per, capacity - gap)
                gaps.setdefault(gap - per * size, []).append((first, full))
            rest = left[size] if full < many else 0
            if rest:
                place(size, rest, first + full, rest, capacity - gap)
                gaps.setdefault(gap - rest * size, []).append((first + full, 1))
            if full + bool(rest) < many:
                gaps.setdefault(gap, []).append((first + full + bool(rest),
                                                 many - full - bool(rest)))
    return runs


RUNS = "length long, low long, high long, first long, per long, at long"


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, rows_per_part: int = 100_000,
                 least_parts: int = 64) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc, piece, length, ids_crc32``.

    The driver sees one count per length (at most ``capacity`` rows). Pieces of one length are
    numbered in parts of about ``rows_per_part`` rows, whatever length half of the corpus may have;
    part sizes give each part its first number. The runs are a few thousand rows at most, bounded by
    the number of lengths, and are broadcast.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in
              pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = max(least_parts, -(-sum(counts.values()) // rows_per_part))
    runs = spark.createDataFrame(best_fit(counts, capacity), RUNS)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc", "piece"), F.lit(parts)))
    order = W.Window.partitionBy("length").orderBy("part")
    starts = (dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(order) - F.col("n")).drop("n"))
    within = W.Window.partitionBy("length", "part").orderBy("doc", "piece", "ids_crc32")
    ranked = (dealt.withColumn("n", F.row_number().over(within))
              .join(starts, ["length", "part"])
              .withColumn("rank", F.col("before") + F.col("n") - 1).drop("n", "before", "part"))
    k = F.col("rank") - F.col("low")
    return (ranked.join(F.broadcast(runs.withColumnRenamed("length", "run_length")),
                        (F.col("length") == F.col("run_length"))
                        & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
            .withColumn("sequence_id", F.col("first") + F.floor(k / F.col("per")))
            .withColumn("offset", F.col("at") + F.pmod(k, F.col("per")) * F.col("length"))
            .drop("run_length", "low", "high", "first", "per", "at", "rank"))


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece: id, ``piece, start, length, ids_crc32, sequence_id, offset``.

    Every document is tokenized whole, closed by one end token, cut only if it is longer than
    ``capacity`` (the first piece takes the remainder), and packed. Null and empty texts are one
    end token; repeated rows and null ids are packed like others; an empty table gives no rows.
    Other columns are not read.
    """
    pieces = cut(cut_pieces(docs.select(F.col(id).cast("long").alias("doc"),
                                        F.col(text).alias("text")), capacity, vocabulary, ranks))
    return place_pieces(pieces, capacity).select(
        F.col("doc").alias(id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
