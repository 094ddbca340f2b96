"""SimHash near-duplicates: pigeonhole blocks, join on blocks, verify the Hamming distance."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.components import connected_components
from cairn.llm.tokens import joined, lower_words_of
from cairn.session import cut

BITS = 64
SEED = 42
#: Hashes whose bits are counted at once; bounds the memory of a very long text.
SLICE = 1 << 15


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every ``width``-word shingle, repeats included; fewer words: the whole sequence."""
    words = lower_words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    line, starts = joined(words)
    last = max(1, len(words) - width + 1)
    ends = starts[width:] if len(words) >= width else starts[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in
                        zip(starts[:last].tolist(), (ends - 1).tolist())), np.uint64, last)


def majority(hashes: np.ndarray) -> int:
    """64 bits as a signed long; a bit is one if it is set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = np.ascontiguousarray(hashes[at:at + SLICE]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """Add ``fp``, the fingerprint as a long. Null and wordless texts have fingerprint zero."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([majority(shingle_hashes(t, width)) for t in texts], dtype="int64")

    return docs.withColumn("fp", simhash(F.col(text)))


def block_masks(blocks: int, distance: int) -> list[int]:
    """Of ``blocks`` blocks, fingerprints within ``distance`` bits share ``blocks - distance``:
    one mask per choice of so many blocks, as signed longs."""
    if blocks <= distance:
        raise ValueError("more blocks than differing bits are needed")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    whole = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    masks = [sum(c) for c in itertools.combinations(whole, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _ball(fp: Column, radius: int) -> Column:
    """All longs within ``radius`` bits of ``fp``."""
    flips = [sum(1 << i for i in c) for r in range(radius + 1)
             for c in itertools.combinations(range(BITS), r)]
    return F.array(*[fp.bitwiseXOR(F.lit(f - (1 << BITS) if f >> (BITS - 1) else f))
                     for f in flips])


def close_pairs(fps: DataFrame, distance: int = 2, blocks: int = 5, crowd: int = 64) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of ``fp`` within ``distance`` bits.

    ``fps`` holds distinct fingerprints. Each is expanded to its block keys; only keys that two
    fingerprints share go on. Up to ``crowd`` fingerprints under one key are compared in pairs and
    their distance verified. Under a fuller key (a family of near copies) no pairs are made: every
    fingerprint meets the points within half the distance around it, and those that meet in a point
    are tied to the smallest of them. Two fingerprints are within an even distance exactly if they
    meet so, hence ``distance`` must be even. Both ways give the same components.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    masks = block_masks(blocks, distance)
    fp = F.col("fp")
    keys = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(masks)])).alias("k")).select("fp", "k.choice", "k.key")
    shared = cut(keys.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = cut(keys.join(shared, ["choice", "key"]))
    few = met.filter(F.col("n") <= crowd)
    other = few.select("choice", "key", F.col("fp").alias("b"))
    pairs = (few.select("choice", "key", F.col("fp").alias("a")).join(other, ["choice", "key"])
             .filter("a < b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
             .select("a", "b"))
    crowded = met.filter(F.col("n") > crowd).select("fp").distinct()
    points = crowded.select("fp", F.explode(_ball(fp, distance // 2)).alias("point"))
    least = cut(points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n"))
                .filter("n > 1").select("point", "b"))
    tied = points.join(least, "point").filter("fp > b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(tied).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3,
                    distance: int = 2, blocks: int = 5) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Equal fingerprints are folded before anything is compared, so exact copies cost one row. Null
    and empty texts have fingerprint zero and are linked like any other; repeated rows come back
    as often as they came; a null id takes part, but never names a component unless all its ids
    are null; an empty table gives no rows. Other columns are not read, whatever their names.
    """
    base = cut(fingerprints(docs.select(F.col(id).alias("doc"), F.col(text).alias("text")),
                            "text", width).select("doc", "fp"))
    fps = cut(base.groupBy("fp").agg(F.min("doc").alias("first")))
    named = connected_components(close_pairs(fps.select("fp"), distance, blocks))
    placed = cut(fps.join(named, F.col("fp") == F.col("node"), "left")
                 .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    answer = cut(placed.join(least, "root").select("fp", "component_id"))
    return base.join(answer, "fp").select(
        F.col("doc").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id")


def fresh_name(docs: DataFrame) -> str:
    """A column name that the table does not have, for a mark of its rows."""
    name = "_row"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5,
                distance: int = 2, blocks: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest id, then the
    smallest hash of the row. Rows equal in all columns are one; null ids come first."""
    mark = fresh_name(docs)
    whole = docs.withColumn(mark, F.xxhash64(*docs.columns))
    name = F.struct(F.col(id).alias("id"), F.col(mark).alias("row"))
    found = near_duplicates(whole.select(name.alias("name"), F.col(text).alias("text")), "name",
                            "text", width, distance, blocks)
    kept = cut(found.filter("name = component_id").select(F.col("name.row").alias(mark)).distinct())
    return whole.join(kept, mark, "left_semi").dropDuplicates([mark]).drop(mark)
