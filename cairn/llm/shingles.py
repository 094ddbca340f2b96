"""Near copies by the Jaccard similarity of word shingles: SimHash fingerprints and, for what they do not
reach, MinHash bands propose pairs; every pair is verified on the whole shingle sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import simhash
from cairn.llm.components import connected_components
from cairn.llm.simhash import SEED, fresh_name, majority, shingle_hashes
from cairn.session import cut

#: 40 bands of 5 minima: a pair at 0.8 shares no band with probability (1 - 0.8^5)^40 = 1.3e-7.
BANDS, ROWS = 40, 5
#: Shingles hashed at once; bounds the memory of a very long text.
SLICE = 1 << 12
#: Classes of shingle hashes (a power of two) whose counts bound what two nodes of a full block share.
RESIDUES = 64
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; wordless texts have none."""
    return np.unique(shingle_hashes(text, width))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least hash under each of ``BANDS * ROWS`` hash functions of a set that is not empty."""
    mixed = hashes ^ (hashes >> np.uint64(29))
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(mixed), SLICE):
        product = mixed[at:at + SLICE, None] * _FACTORS
        np.minimum(least, product.min(axis=0), out=least)
    return least


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band as a signed long, the number of the band hashed in; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = minima(hashes).reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least)),
                       np.uint64, BANDS).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Add ``sig``: ``node``, a hash of the shingle set of ``text``, its ``size``, its SimHash
    fingerprint ``fp`` and its ``keys``."""
    @F.pandas_udf("node long, size int, fp long, keys array<long>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        nodes, sizes, fps, keys = [], [], [], []
        for t in texts:
            hashes = shingle_set(t, width)
            nodes.append(int(np.array(xxhash.xxh64_intdigest(hashes.tobytes(), SEED), np.uint64).view(np.int64)))
            sizes.append(len(hashes))
            fps.append(majority(hashes))
            keys.append(band_keys(hashes))
        return pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "size": pd.Series(sizes, dtype="int32"),
                             "fp": pd.Series(fps, dtype="int64"), "keys": keys})

    return docs.withColumn("sig", sign("text"))


def simhash_pairs(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Candidates ``(a, b)`` of ``nodes`` (``node, fp``) by SimHash: nodes of one fingerprint meet its
    smallest node, and the smallest nodes of fingerprints within ``distance`` bits meet."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    close = simhash.close_pairs(first.select("fp"), distance)
    one = first.select(F.col("fp").alias("a"), F.col("first").alias("x"))
    two = first.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    near = close.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return cut(same.unionByName(near))


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of the candidates ``(a, b)`` those whose sets share ``least`` of their union, as a table."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return cut(pairs.join(right, "b").join(left, "a")
               .filter(shared >= least * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"))


def own_shingles(full: DataFrame, sets: DataFrame) -> DataFrame:
    """``(node, own, common)`` of the nodes in the blocks ``full``: how many shingles of a node no other
    of these nodes has, and how many of the others there are per residue of their hash."""
    def per_residue(hashes) -> np.ndarray:
        return np.bincount(np.asarray(hashes, np.int64) & (RESIDUES - 1), minlength=RESIDUES)

    @F.pandas_udf("array<int>")
    def counts(hashes: pd.Series, alone: pd.Series) -> pd.Series:
        return pd.Series([per_residue(h) - per_residue(o) for h, o in zip(hashes, alone)], dtype="object")

    held = sets.join(full.select("node").distinct(), "node")
    own = (held.select("node", F.explode("hashes").alias("hash"))
           .groupBy("hash").agg(F.min("node").alias("node"), F.count("*").alias("n")).filter("n = 1")
           .groupBy("node").agg(F.collect_list("hash").alias("alone")))
    alone = F.coalesce("alone", F.array().cast("array<long>"))
    return cut(held.join(own, "node", "left").select("node", F.size(alone).alias("own"), counts("hashes", alone).alias("common")))


def _may_be_alike(least: float):
    """What two sets of ``m`` and ``n`` shingles share at most, of what their union holds at least: the
    ``p`` and ``q`` of them that no other node has are in the union, but never shared."""
    one, two = F.col("m") - F.col("p"), F.col("n") - F.col("q")
    return F.least(one, two) >= least * (F.col("p") + F.col("q") + F.greatest(one, two)) - 1e-9


def _may_share(least: float):
    """The same by residues of the shingles' hashes: of each residue two sets share no more than the
    smaller count of ``u`` and ``v``. Null counts allow everything."""
    shared = F.aggregate(F.zip_with("u", "v", lambda u, v: F.least(u, v)), F.lit(0), lambda total, n: total + n)
    return F.coalesce(shared >= least * (F.col("m") + F.col("n") - shared) - 1e-9, F.lit(True))


def close_pairs(met: DataFrame, sets: DataFrame, least: float = 0.8, leaders: int = 4,
                first_bands: int = 4, crowd: int = 16, tied: DataFrame | None = None) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all alike pairs that share a block, and of the
    alike pairs ``tied`` that are known already.

    ``met`` has ``key, band, node, size``: blocks of two nodes or more; ``sets`` has ``node, hashes``.
    In a full block the nodes come in the order of the shingles that they have alone, so those that
    differ least from their family lead it. First the leader of each block of the first bands meets its
    block, then the ``leaders`` first of every block do, then all nodes outside their block's largest
    component. What the verified pairs tie into one component needs no more comparing, which leaves next
    to nothing of a family of near copies, however large: each step takes only pairs of two components
    whose sizes and own shingles allow the similarity. No pair of two components that could be alike is
    left untested.
    """
    full = met.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("key", F.lit(True).alias("full"))
    marked = cut(met.join(full, "key", "left"))
    own = own_shingles(marked.filter("full"), sets)
    met = cut(marked.join(own.select("node", "own"), "node", "left").select(
        "key", "band", "node", "size", F.when(F.col("full"), F.col("own")).otherwise(0).alias("own"), "full"))
    in_order = Window.partitionBy("key").orderBy("own", "node")
    ranked = cut(met.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= leaders)
                 .select("key", "band", "rank", F.col("node").alias("a"), F.col("size").alias("m"), F.col("own").alias("p")))
    other = met.select("key", F.col("node").alias("b"), F.col("size").alias("n"), F.col("own").alias("q"))

    def rooted(rows: DataFrame, node: str, root: str) -> DataFrame:
        return rows.join(roots.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left") \
            .withColumn(root, F.coalesce(root, node))

    start = ranked.filter((F.col("rank") == 1) & (F.col("band") < first_bands))
    for leading in (start, ranked):
        if tied is not None:
            roots = cut(connected_components(tied))
        left, right = leading.select("key", "a", "m", "p"), other
        if tied is None:
            left, right = left.withColumn("x", F.col("a")), right.withColumn("y", F.col("b"))
        else:
            left, right = rooted(left, "a", "x"), rooted(right, "b", "y")
        led = cut(right.join(left, (left["key"] == right["key"]) & (F.col("x") != F.col("y")) & _may_be_alike(least))
                  .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = alike(led, sets, least)
        tied = found if tied is None else cut(tied.unionByName(found))
    roots = cut(connected_components(tied))
    leads = ranked.select("key", F.col("a").alias("node"), F.lit(True).alias("led"))
    placed = cut(met.select("key", "node", "size", "own", "full").join(roots, "node", "left").join(leads, ["key", "node"], "left")
                 .select("key", "node", "size", "own", "full", F.coalesce("root", "node").alias("root"), F.coalesce("led", F.lit(False)).alias("led")))
    counted = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = cut(counted.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts"))
                .filter("parts > 1").select("key", F.col("top.root").alias("main")))
    common = own.select("node", "common", F.lit(True).alias("full"))
    open_ = cut(placed.filter("NOT led").join(mixed, "key").join(common, ["node", "full"], "left"))
    outside = open_.filter("root <> main").select("key", F.col("node").alias("a"), F.col("size").alias("m"), F.col("own").alias("p"), F.col("root").alias("x"), F.col("common").alias("u"))
    rest = open_.select("key", F.col("node").alias("b"), F.col("size").alias("n"), F.col("own").alias("q"), F.col("root").alias("y"), F.col("common").alias("v"))
    pairs = cut(rest.join(outside, (rest["key"] == outside["key"]) & (F.col("x") != F.col("y")) & _may_be_alike(least) & _may_share(least))
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return tied.unionByName(alike(pairs, sets, least))


def one_of_alike(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5,
                 least: float = 0.8, distance: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near copies, that is of each component of the pairs
    whose sets of ``width``-word shingles share ``least`` of their union: the row with the smallest
    id, then the smallest hash of the row. Rows equal in all columns are one; null ids come first;
    texts without words have equal (empty) sets.

    Equal sets are folded before anything is compared. SimHash fingerprints within ``distance`` bits
    propose the first pairs; MinHash bands then propose those that so few bits do not reach. Every pair
    is verified on the whole shingle sets, which only nodes of a proposed pair or block get written.
    """
    mark = fresh_name(docs)
    whole = docs.withColumn(mark, F.xxhash64(*docs.columns))
    named = whole.select(F.struct(F.col(id).alias("id"), F.col(mark).alias("row")).alias("name"),
                         F.col(text).alias("text"))
    signed = signatures(named, width).select("name", "sig.*")
    base = cut(signed.groupBy("node").agg(F.min("name").alias("first"), *[
        F.any_value(c).alias(c) for c in ("size", "fp", "keys")]))
    firsts = base.select("node", "first")
    seen = cut(simhash_pairs(base.filter("size > 0").select("node", "fp"), distance))
    blocks = base.select("node", "size", F.posexplode("keys").alias("band", "key"))
    met = cut(blocks.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
              .select("key", "band", "node", "size"))
    proposed = met.select("node").unionByName(seen.select(F.col("a").alias("node"))) \
        .unionByName(seen.select(F.col("b").alias("node"))).distinct()
    wanted = cut(proposed.join(firsts, "node").select("node", F.col("first.row").alias(mark)))

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width).view(np.int64) for t in texts], dtype="object")

    sets = cut(whole.select(mark, F.col(text).alias(f"{mark}t")).join(wanted, mark).dropDuplicates(["node"])
               .select("node", hashes(f"{mark}t").alias("hashes")))
    roots = connected_components(close_pairs(met, sets, least, tied=alike(seen, sets, least)))
    placed = cut(firsts.join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root")))
    kept = cut(placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(mark)).distinct())
    return whole.join(kept, mark, "left_semi").dropDuplicates([mark]).drop(mark)
