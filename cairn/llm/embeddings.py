"""Near-duplicate vectors by a forest of random-projection trees with spilling splits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.components import connected_components
from cairn.session import cut


@dataclass
class Forest:
    """Flat trees over a sample. Node i sends x right if its projection on the line between the sample
    rows ``ends[i]`` is over ``threshold[i]``. A child below zero is the leaf ``-1 - child``."""
    sample: np.ndarray
    roots: list[int] = field(default_factory=list)
    ends: list[tuple[int, int]] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    margin: float = 0.0

    def line(self, node: int) -> np.ndarray:
        a, b = self.ends[node]
        line = self.sample[a] - self.sample[b]
        return line / np.linalg.norm(line)

    def route(self, x: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs: the leaf of each tree, then the nearest of those that one turn within
        ``margin`` of its threshold leads to, ``visits`` for a row at most."""
        found = []
        stack = [(root, np.arange(len(x)), np.zeros(len(x))) for root in self.roots]
        while stack:
            node, at, off = stack.pop()
            if node < 0:
                found.append((at, np.full(len(at), -1 - node), off))
            elif len(at):
                side = x[at] @ self.line(node) - self.threshold[node]
                turned = (off == 0) & (side != 0) & (np.abs(side) <= self.margin)
                for child, own in zip(self.children[node], (side <= 0, side > 0)):
                    take = own | turned
                    stack.append((child, at[take], np.where(own, off, np.abs(side))[take]))
        rows, leaves, off = (np.concatenate(part) for part in zip(*found))
        order = np.lexsort((leaves, off, rows))
        rows, leaves = rows[order], leaves[order]
        starts = np.cumsum(np.bincount(rows, minlength=len(x))) - np.bincount(rows, minlength=len(x))
        near = np.arange(len(rows)) - starts[rows] < visits
        return rows[near], leaves[near]


def fit_forest(sample: np.ndarray, rows: int, trees: int, leaf_rows: int, margin: float,
               seed: int = 11) -> Forest:
    """Recursive splits of a sample of unit vectors at the median of a projection on the difference
    of two of its points. A leaf stands for about ``leaf_rows`` of all ``rows``, or for one of the
    sample if that is more."""
    random, forest = np.random.default_rng(seed), Forest(sample, margin=margin)
    least = max(1, round(leaf_rows * len(sample) / max(rows, 1)))

    def build(at: np.ndarray, depth: int) -> int:
        if len(at) > least and depth < 60:
            for _ in range(4):
                a, b = random.choice(at, 2, replace=False).tolist()
                size = np.linalg.norm(sample[a] - sample[b])
                if size < 1e-9:
                    continue
                side = sample[at] @ ((sample[a] - sample[b]) / size)
                order = np.sort(side)
                cut_at = float(order[(len(order) - 1) // 2] + order[len(order) // 2]) / 2
                if (side <= cut_at).any() and (side > cut_at).any():
                    node = len(forest.children)
                    forest.ends.append((a, b))
                    forest.threshold.append(cut_at)
                    forest.children.append([0, 0])
                    forest.children[node] = [build(at[side <= cut_at], depth + 1),
                                             build(at[side > cut_at], depth + 1)]
                    return node
        forest.leaves += 1
        return -forest.leaves

    forest.roots = [build(np.arange(len(sample)), 0) for _ in range(trees)]
    return forest


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1)[:, None]


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in a byte per component, the step of each row and how far its code is off at most."""
    step = (np.abs(x).max(axis=1) / 126.9).astype(np.float32)
    code = np.rint(x / step[:, None]).astype(np.int8)
    off = np.linalg.norm(x - code * step[:, None].astype(np.float64), axis=1)
    return code, step, (off * (1 + 1e-6) + 1e-9).astype(np.float32)


def _components(linked: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        low = [np.where(linked[i:i + SLAB], label[None, :], len(label)).min(axis=1) for i in range(0, len(label), SLAB)]
        new = np.minimum(label, np.concatenate(low))
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: Rows of a leaf compared at once with all others of the task.
SLAB = 256
#: A leaf is dealt into parts of so many blocks.
BLOCKS = 4
LINKS = "node long, links long, root long, other long"


def compare_leaves(routed: DataFrame, sizes: DataFrame, similarity: float, block: int) -> DataFrame:
    """``(node, links, root, other)``: per node and part of a leaf the links counted there and the
    smallest row tied to it there; with ``other``, a pair that the codes leave open. A leaf of over
    ``BLOCKS * block`` rows is dealt into parts and every two parts are compared, so no task holds more
    than two. A pair that meets in several leaves counts in the first that it shares."""
    parts = F.coalesce(F.col("parts"), F.lit(1))
    full = sizes.filter(F.col("n") > BLOCKS * block).select("leaf", F.ceil(F.col("n") / (BLOCKS * block)).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda other: F.struct(
        F.least("mine", other).alias("i"), F.greatest("mine", other).alias("j")))
    dealt = (routed.join(full, "leaf", "left").withColumn("mine", mine).withColumn("pair", F.explode(pairs))
             .select("leaf", "pair.i", "pair.j", "mine", "node", "copies", "code", "step", "off",
                     F.filter("leaves", lambda k: k < F.col("leaf")).alias("earlier")))

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("node", ignore_index=True)
        x = np.stack([np.frombuffer(c, np.int8) for c in batch["code"]]) * batch["step"].to_numpy(np.float64)[:, None]
        node, mine, off = batch["node"].to_numpy(), batch["mine"].to_numpy(), batch["off"].to_numpy(np.float64)
        copies, length = batch["copies"].to_numpy(np.int64), np.linalg.norm(x, axis=1)
        cross, earlier = batch["i"][0] != batch["j"][0], [np.asarray(ks, np.int64) for ks in batch["earlier"]]
        known = {k: i for i, k in enumerate(sorted({k for ks in earlier for k in ks.tolist()}))}
        member = np.zeros((len(node), max(len(known), 1)), np.float32) if len(known) < 4 * SLAB else None
        if member is not None:
            for i, ks in enumerate(earlier):
                member[i, [known[k] for k in ks.tolist()]] = 1
        linked, links, open_ = np.zeros((len(node), len(node)), bool), np.zeros(len(node), np.int64), []
        for i in range(0, len(node), SLAB):
            at = slice(i, i + SLAB)
            cosine = x[at] @ x.T
            wide = off[at, None] * length[None, :] + length[at, None] * off[None, :] + off[at, None] * off[None, :] + 1e-9
            near = cosine + wide >= similarity
            near[np.arange(near.shape[0]), np.arange(i, i + near.shape[0])] = False
            if cross:
                near &= mine[at, None] != mine[None, :]
            sure = near & (cosine - wide >= similarity)
            linked[at] = sure
            if member is not None:
                first = ~(member[at] @ member.T > 0)
                one, two = np.nonzero(near & ~sure & first)
                links[at] = (sure & first) @ copies
            else:
                one, two = np.nonzero(near)
                new = np.array([not np.intersect1d(earlier[i + a], earlier[b]).size for a, b in zip(one, two)], bool)
                counted = new & sure[one, two]
                links[at] = np.bincount(one[counted], copies[two[counted]], near.shape[0]).astype(np.int64)
                one, two = one[new & ~sure[one, two]], two[new & ~sure[one, two]]
            open_.append(np.stack([one + i, two], axis=1)[one + i < two])
        some = linked.any(axis=1)
        out = pd.DataFrame({"node": node[some], "links": links[some],
                            "root": node[some][_components(linked[np.ix_(some, some)])] if some.any() else node[some]})
        asked = np.concatenate(open_)
        asked = pd.DataFrame({"node": node[asked[:, 0]], "other": node[asked[:, 1]]})
        names = ["node", "links", "root", "other"]  # 64-bit names must not pass through floats
        return pd.concat([part.astype("Int64").reindex(columns=names).astype("Int64") for part in (out, asked)])

    return dealt.groupBy("leaf", "i", "j").applyInPandas(compare, LINKS)


def linked_pairs(asked: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs ``(a, b)`` those whose whole vectors are similar, with the copies of each."""
    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series((unit(x) * unit(y)).sum(axis=1)) if len(x) else pd.Series([], dtype="float64")

    one = nodes.select(F.col("node").alias("a"), F.col("vector").alias("x"), F.col("copies").alias("m"))
    two = nodes.select(F.col("node").alias("b"), F.col("vector").alias("y"), F.col("copies").alias("n"))
    return cut(asked.join(one, "a").join(two, "b").filter(cosine("x", "y") >= similarity).select("a", "b", "m", "n"))


def near_duplicate_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding",
                           similarity: float = 0.9, trees: int = 6, leaf_rows: int = 256,
                           margin: float = 0.04, sample_rows: int = 20_000,
                           block: int = 1024, visits: int = 10) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id``, ``kept``.

    Equal vectors are folded into one node with a count. The forest is fitted on at most
    ``sample_rows`` nodes (a documented bound) and every node is routed through it, to ``visits`` leaves
    at most: that of each tree, then those nearest to it. What travels to a leaf is a byte per component
    with a bound of its error: pairs surely at ``similarity`` or above are counted and united there, pairs
    surely below are not, and the few between are compared in double precision on the whole vectors.
    Approximate: pairs that share no leaf are missed; a pair below the bound is never linked.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, as do
    those of another length than the commonest in the sample and rows with a null id; each is a
    component of its own. Repeated rows count as other vectors. An empty table gives no rows. Other
    columns are not read.
    """
    base = vectors.select(F.col(id).alias("id"), F.col(vector).alias("given"),
                          F.col(vector).cast("array<double>").alias("vector"))
    good = (F.col("id").isNotNull() & (F.size("vector") > 0) & F.coalesce(F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.exists("vector", lambda x: x != 0))
    base = base.withColumn("node", F.when(good, F.xxhash64("vector"))).select("id", "node", F.col("given").alias("vector"))
    nodes = cut(base.filter("node IS NOT NULL").groupBy("node").agg(
        F.any_value("vector").alias("vector"), F.min("id").alias("first"), F.count("*").alias("copies")))
    sample = nodes.select("vector").orderBy("node").limit(sample_rows).toPandas()["vector"]
    lengths = sample.map(len)
    if not len(sample):
        return base.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    size = int(lengths.mode()[0])
    forest = fit_forest(unit(sample[lengths == size]), nodes.count(), trees, leaf_rows, margin)

    def leaves_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, list[np.ndarray]]]:
        for batch in batches:
            x = unit(batch["vector"])
            rows, leaves = forest.route(x, visits)
            yield batch, x, np.split(leaves, np.cumsum(np.bincount(rows, minlength=len(batch)))[:-1])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, leaves in leaves_of(batches):
            leaf, n = np.unique(np.concatenate(leaves), return_counts=True)
            yield pd.DataFrame({"leaf": leaf, "n": n})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, x, leaves in leaves_of(batches):
            code, step, off = codes(x)
            yield batch[["node", "copies"]].assign(code=[c.tobytes() for c in code], step=step, off=off,
                                                   leaves=[np.sort(k) for k in leaves])

    same_size = nodes.filter(F.size("vector") == size).select("node", "copies", "vector")
    sizes = cut(same_size.select("vector").mapInPandas(count, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")))
    routed = (same_size.mapInPandas(route, "node long, copies long, code binary, step float, off float, leaves array<int>")
              .withColumn("leaf", F.explode("leaves")))
    met = cut(compare_leaves(routed, sizes, similarity, block))
    sure = met.filter("other IS NULL")
    pairs = linked_pairs(met.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), nodes, similarity)
    links = (sure.select("node", "links").unionByName(pairs.select(F.col("a").alias("node"), F.col("n").alias("links")))
             .unionByName(pairs.select(F.col("b").alias("node"), F.col("m").alias("links")))
             .groupBy("node").agg(F.sum("links").alias("links")))
    named = connected_components(sure.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(pairs.select("a", "b")))
    placed = cut(nodes.select("node", "first", "copies").join(links, "node", "left")
                 .join(named, "node", "left").select(
        "node", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root")))
    least = placed.groupBy("root").agg(F.min("first").alias("component"))
    answer = cut(placed.join(least, "root").select("node", "n_links", "component"))
    found = base.select("id", "node").join(answer, "node", "left")
    component = F.coalesce("component", "id")
    return found.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                        component.alias("component_id"),
                        F.col("id").eqNullSafe(component).alias("kept"))
