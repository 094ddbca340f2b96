"""Filter interaction audit: files as available-now micro-batches, a state keyed by text that knows
the smallest id, and counters from which earlier masks are taken back when a smaller id arrives."""

from __future__ import annotations

import itertools
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.session import cut, shared_folder

#: The audited filters; bit i of a mask says that a document fails the i-th.
FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")

#: Texts that share a group of the state: a group costs a millisecond in Python however small it is,
#: and is stored anew when a batch touches one of its texts.
TEXTS_PER_GROUP = 64

PARTIAL = "key binary, part string, good boolean, toxic boolean, mask int, least long, n_least long, n long"
STATE = "texts binary"
DELTA = "part string, mask int, good boolean, toxic boolean, delta long"


def own_mask(text: Column) -> Column:
    """Filters A to D, which a text fails by itself, as bits."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    count = F.size(words)
    fails = (count < 100, 100 * F.size(F.array_distinct(words)) < 80 * count,
             100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text), F.rlike(text, F.lit(r"[#$%&*|]")))
    return sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(fails)), F.lit(0))


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per Arrow batch one row per text, part and labels: a text that a third of all documents share
    brings a few rows per batch to its state. Rows without an id have ``least`` null."""
    by = ["key", "part", "good", "toxic", "mask"]
    for batch in batches:
        named = batch.dropna(subset="doc")
        named = named.assign(least=named.groupby(by)["doc"].transform("min")) if len(named) else named.assign(least=named["doc"])
        found = named.assign(first=named["doc"] == named["least"]).groupby([*by, "least"], as_index=False).agg(
            n_least=("first", "sum"), n=("doc", "size"))
        loose = batch[batch["doc"].isna()].groupby(by, as_index=False).size().rename(columns={"size": "n"})
        for part in (found, loose.assign(least=None, n_least=0)):
            if len(part):
                yield part[[c.split()[0] for c in PARTIAL.split(", ")]]


def settle(group: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Count the new rows of some texts. Who holds a text's smallest id so far passes E, all others
    fail it; a smaller id takes the earlier holders' masks back and counts them again with E."""
    texts: dict[bytes, tuple[int, Counter]] = pickle.loads(state.get[0]) if state.exists else {}
    changed, delta = False, Counter()
    for frame in frames:
        for key, part, good, toxic, mask, low, n_low, n in zip(*(frame[c].tolist() for c in (
                "key", "part", "good", "toxic", "mask", "least", "n_least", "n"))):
            cell = (part, bool(good), bool(toxic))
            if low is None or pd.isna(low):
                delta[cell, mask] += n
                continue
            least, holders = texts.get(key, (None, None))
            if least is None or low < least:
                for other, count in (holders or {}).items():
                    delta[other, mask] -= count
                    delta[other, mask | REPEATED] += count
                least, holders = int(low), Counter()
                texts[key], changed = (least, holders), True
            firsts = n_low if low == least else 0
            if firsts:
                holders[cell] += firsts
                delta[cell, mask] += firsts
                changed = True
            delta[cell, mask | REPEATED] += n - firsts
    if changed:
        state.update((pickle.dumps(texts),))
    rows = [(part, mask, good, toxic, n) for ((part, good, toxic), mask), n in delta.items() if n]
    if rows:
        yield pd.DataFrame(rows, columns=["part", "mask", "good", "toxic", "delta"])


def label_flags(labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """``doc, good, toxic``: whether some label of the document says quality 1, toxic 1."""
    return (labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("doc"))
            .agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
                 F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")))


def _as_pattern(path: str) -> str:
    """The same path as a pattern: a stream takes a plain path for a folder, a pattern also for a file."""
    return path if re.search(r"[*?\[{]", path) else f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"


def _groups(documents: DataFrame, folder: str) -> int:
    """Groups of the state, from the rows of the first call; later calls on a folder keep its number."""
    spark, path = documents.sparkSession, f"{folder}/groups"
    try:
        return spark.read.schema("n long").parquet(path).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    groups = documents.count() // TEXTS_PER_GROUP + 1  # the count is in the files' footers
    spark.createDataFrame([(groups,)], "n long").write.parquet(path)
    return groups


def stream_counters(spark: SparkSession, path: str, labels: DataFrame, folder: str,
                    id: str = "doc_id", text: str = "text", part: str = "lang",
                    files_per_batch: int | None = None) -> None:
    """Process the Parquet files under ``path`` that ``folder`` has not seen, at most
    ``files_per_batch`` per micro-batch (default: the cluster's parallelism), and append the changes
    of the counters. A later call takes up new files only. Sources, state and output are Spark's
    own; the file sink makes a batch that is run again count once."""
    documents = spark.read.parquet(path)
    schema = documents.schema
    files = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch or max(1, spark.sparkContext.defaultParallelism))
             .parquet(_as_pattern(path)))
    body = F.coalesce(F.col(text), F.lit(""))
    # texts become a key and a mask at once, so only narrow rows go on
    looked = files.select(F.col(id).cast("long").alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                          F.unhex(F.left(F.sha2(body.cast("binary"), 256), F.lit(32))).alias("key"), own_mask(body).alias("mask"))
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}
    deltas = (looked.join(cut(label_flags(labels)), "doc", "left").withColumns(flags)
              .mapInPandas(_combined, PARTIAL)
              .withColumn("texts", F.pmod(F.xxhash64("key"), F.lit(_groups(documents, folder)))).groupBy("texts")
              .applyInPandasWithState(settle, DELTA, STATE, "append", GroupStateTimeout.NoTimeout))
    query = (deltas.writeStream.format("parquet").option("path", f"{folder}/deltas")
             .option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """``part, mask, good, toxic, n``: what the changes add up to."""
    return (spark.read.schema(DELTA).parquet(f"{folder}/deltas").groupBy("part", "mask", "good", "toxic")
            .agg(F.sum("delta").alias("n")).filter("n <> 0"))


def _steps() -> Column:
    """All orders of the filters, each step with the mask before it and its own bit."""
    found = []
    for order in itertools.permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order):
            found.append(f"named_struct('filter_order', '{name}', 'step', {step + 1}, 'before', {before}, 'own', {1 << i})")
            before |= 1 << i
    return F.expr(f"array({', '.join(found)})")


def interactions(counted: DataFrame) -> DataFrame:
    """One row per part, order and step from the counters (at most 128 rows per part)."""
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    here = fails & ~earlier
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long")
    orders = 1
    for i in range(len(FILTERS)):
        orders *= i + 1
    # in an order picked at random each of the filters that a document fails comes first equally often
    share = F.when(fails, F.col("n") * F.expr(f"{orders} div greatest(bit_count(mask), 1)")).otherwise(0)
    return (counted.withColumn("s", F.explode(_steps())).select(*counted.columns, "s.*")
            .groupBy("part", "filter_order", "step")
            .agg(total(~earlier & ~fails).alias("kept"), total(here).alias("removed"),
                 total(fails & earlier).alias("redundant"),
                 total(F.col("mask") == F.col("own")).alias("unique_fails"),
                 total(here & F.col("good")).alias("good_lost"),
                 total(here & F.col("toxic")).alias("toxic_lost"),
                 F.sum(share).cast("long").alias("shapley")))


def audit(spark: SparkSession, path: str, labels: DataFrame, id: str = "doc_id", text: str = "text",
          part: str = "lang", files_per_batch: int | None = None, folder: str | None = None) -> DataFrame:
    """How five filters interact on the documents under ``path``, per part, for all orders.

    A: under 100 words; B: less than 80 % of the words distinct; C: over 10 % capitals; D: holds any
    of ``#$%&*|``; E: equal to the text of a smaller id in the whole table. One row per part, order
    and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    Null texts are empty, null parts the empty string. Rows with one id do not repeat each other; a
    row with a null id neither fails E nor makes others fail. Rows that come twice count twice. An
    empty table gives no rows; other columns are not read. State: for each distinct text (by 128 bits
    of its SHA-256) its smallest id and who holds it, in groups of texts; the counters: 128 per part. With a ``folder`` of an earlier call
    only new files are read, and the report is that of all files so far.
    """
    folder = folder or f"{shared_folder(spark)}/cairn/audit-{uuid.uuid4().hex}"
    stream_counters(spark, path, labels, folder, id, text, part, files_per_batch)
    return interactions(cut(counters(spark, folder)))
