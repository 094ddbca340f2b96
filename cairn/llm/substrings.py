"""Substring duplicates: anchors at difference-cover positions, extended to whole windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cairn.llm.tokens import joined, words_of
from cairn.session import cut

#: Perfect difference sets: any two residues of the period meet the set at a common shift.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def _mixed(doc: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Spread keys for rows that need not meet any other."""
    with np.errstate(over="ignore"):
        x = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + position.astype(np.uint64)
        x ^= x >> np.uint64(29)
        return (x * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _first_of_groups(doc: np.ndarray, keys: tuple[np.ndarray, ...]):
    """Sort by ``keys`` then ``doc``: (order, smallest document of each row's group, group has several)."""
    order = np.lexsort((doc, *reversed(keys)))
    d = doc[order]
    new = np.ones(len(d), bool)
    if len(d):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(d)) - 1
    return order, d[starts][group], (d[ends] != d[starts])[group]


def anchors(docs: DataFrame, window: int, period: int) -> DataFrame:
    """``(k, pos, doc, row)`` of hashed anchors at cover positions; ``pos`` is twice the position,
    plus one if the anchor is known to be shared.

    What a batch can settle stays out of the shuffle: where several documents of a batch share an
    anchor, all are known, and only those of the smallest document travel under the anchor's hash;
    the others get keys of their own. So a passage of a third of all documents brings a few rows per
    batch to its key.
    """
    width, cover = window - period + 1, COVERS[period]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            hashes, docs_of, rows_of, places = [], [], [], []
            for doc, row, text in zip(batch["doc"], batch["row"], batch["text"]):
                words = words_of(text)
                if len(words) < window:
                    continue
                line, starts = joined(words)
                at = np.arange(len(words) - width + 1)
                at = at[np.isin(at % period, cover)]
                hashes.append(np.fromiter(
                    (digest(line[a:b]) for a, b in zip(starts[at].tolist(),
                                                       (starts[at + width] - 1).tolist())),
                    np.uint64, len(at)).view(np.int64))
                docs_of.append(np.full(len(at), doc, np.int64))
                rows_of.append(np.full(len(at), row, np.int64))
                places.append(at)
            if not hashes:
                continue
            h, d, r, p = map(np.concatenate, (hashes, docs_of, rows_of, places))
            order, least, several = _first_of_groups(d, (h,))
            k, pos = np.empty_like(h), np.empty(len(h), np.int32)
            k[order] = np.where(d[order] == least, h[order], _mixed(d[order], p[order]))
            pos[order] = 2 * p[order] + several
            # what varies first, in text order: shuffle blocks then compress best
            yield pd.DataFrame({"k": k, "pos": pos, "doc": d, "row": r})
    return docs.mapInPandas(run, "k long, pos int, doc long, row long")


WINDOWS = "h1 long, h2 long, start int, doc long, row long, known array<int>"


def candidate_windows(touched: DataFrame, window: int, period: int) -> DataFrame:
    """Extend shared anchors: 128-bit hashes of every whole window around one.

    Again what a batch settles is not sent by hash: a window that a smaller document of the batch
    has as well is known, and a document's known starts travel as one row.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        names = [part.split()[0] for part in WINDOWS.split(", ")]
        for batch in batches:
            raw, docs_of, rows_of, places = [], [], [], []
            for doc, row, text, shared in zip(batch["doc"], batch["row"], batch["text"], batch["shared"]):
                words = words_of(text)
                last = len(words) - window
                near = np.asarray(shared, np.int64)[:, None] - np.arange(period)
                at = np.unique(near[(near >= 0) & (near <= last)])
                if not len(at):
                    continue
                line, starts = joined(words)
                raw.append(b"".join(digest(line[a:b]) for a, b in
                                    zip(starts[at].tolist(), (starts[at + window] - 1).tolist())))
                docs_of.append(np.full(len(at), doc, np.int64))
                rows_of.append(np.full(len(at), row, np.int64))
                places.append(at)
            if not raw:
                continue
            h = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
            d, r, p = map(np.concatenate, (docs_of, rows_of, places))
            order, least, _ = _first_of_groups(d, (h[:, 0], h[:, 1]))
            first, p = np.empty(len(d), bool), p.astype(np.int32)
            first[order] = d[order] == least
            yield pd.DataFrame({"h1": h[first, 0], "h2": h[first, 1], "start": p[first],
                                "doc": d[first], "row": r[first], "known": None})
            d, r, p = d[~first], r[~first], p[~first]
            if len(d):
                new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1])))
                yield pd.DataFrame({"h1": _mixed(d[new], r[new]), "h2": r[new], "doc": d[new],
                                    "row": r[new], "start": p[new],
                                    "known": np.split(p, new[1:])})[names]
    return touched.mapInPandas(run, WINDOWS)


def _kept(words: list[bytes], starts: np.ndarray | None, window: int) -> tuple[int, str]:
    """(words removed, SHA-256 of the kept words joined by one space)."""
    if starts is None or not len(starts):
        return 0, hashlib.sha256(b" ".join(words)).hexdigest()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts) + window, -1)
    gone = np.cumsum(edge)[:-1] > 0
    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
    return int(gone.sum()), hashlib.sha256(kept).hexdigest()


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 13,
                   period: int = 7) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_sha256``.

    A word goes if a window of ``window`` words that covers it also starts in a document with a
    smaller id. Anchors of ``window - period + 1`` words are hashed at positions whose residue is in
    a difference cover of the period, so two equal windows at any positions share an anchor at the
    same shift. Windows around shared anchors are compared by 128-bit hashes. A text equal to that
    of a smaller id loses all its windows and takes no part in the second half, so exact copies cost
    one narrow row. Texts are shuffled once; both joins with them read the same exchange.

    Null and empty texts have no words. Rows with equal ids do not remove each other's words;
    repeated rows get the same answer. A row with a null id neither removes nor loses words. An
    empty table gives no rows. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).cast("long").alias("doc"), body.alias("text"))
    named = rows.filter("doc IS NOT NULL").select("doc", F.xxhash64("text").alias("row"), "text")
    narrow = cut(named.select("doc", "row", F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    firsts = cut(narrow.groupBy("sha").agg(F.min("doc").alias("least")))
    copies = cut(narrow.join(firsts, "sha").filter("doc > least").select("doc", "row").distinct())
    same = W.Window.partitionBy("k")
    shared = cut(anchors(named, window, period)
                 .withColumn("low", F.min("doc").over(same)).withColumn("high", F.max("doc").over(same))
                 .filter("pos % 2 = 1 OR low < high")
                 .groupBy("doc", "row").agg(F.collect_set(F.shiftright("pos", 1)).alias("shared"))
                 .join(copies, ["doc", "row"], "left_anti"))
    equal = W.Window.partitionBy("h1", "h2")
    starts = F.coalesce("known", F.array("start"))
    repeated = (candidate_windows(named.join(shared, ["doc", "row"]), window, period)
                .withColumn("low", F.min("doc").over(equal))
                .filter("known IS NOT NULL OR low < doc")
                .select("doc", "row", F.explode(starts).alias("start"))
                .groupBy("doc", "row").agg(F.collect_set("start").alias("starts"))
                .withColumn("copy", F.lit(False)))
    marks = repeated.unionByName(copies.withColumn("starts", F.lit(None).cast("array<int>"))
                                 .withColumn("copy", F.lit(True)))

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def answer(texts: pd.Series, starts: pd.Series, copies: pd.Series) -> pd.DataFrame:
        found = []
        for text, at, copy in zip(texts, starts, copies):
            words = words_of(text)
            if copy and len(words) >= window:
                at = np.arange(len(words) - window + 1)
            found.append((len(words), *_kept(words, at, window)))
        return pd.DataFrame(found, columns=["n_words", "n_removed", "kept_sha256"])

    nameless = rows.filter("doc IS NULL").select(
        "doc", "text", F.lit(None).cast("array<int>").alias("starts"), F.lit(False).alias("copy"))
    judged = named.join(marks, ["doc", "row"], "left").select(
        "doc", "text", "starts", F.coalesce("copy", F.lit(False)).alias("copy"))
    return (judged.unionByName(nameless)
            .select(F.col("doc").alias(id), answer("text", "starts", "copy").alias("a"))
            .select(id, "a.*"))
