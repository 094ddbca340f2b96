"""Running totals, previous rows and ranks that stay balanced when one key owns most rows.

A plain window sends all rows of a key to one task. Here the rows are dealt into ranges of
(key, order), about equal in rows whatever the keys and times are: windows run inside (key, range),
and one small row per key and range carries the state on, so a window across ranges sees at most as
many rows of a key as there are ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import cut


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
              ranges: int | None = None) -> DataFrame:
    """Rows with the number of their range, ascending in (keys, order), as a stored table.

    Stored, since range bounds are sampled and every reader has to see the same ones. ``ranges``
    defaults to the session's shuffle partitions; AQE then folds small ranges.
    """
    columns = [*keys, *order]
    dealt = rows.repartitionByRange(ranges, *columns) if ranges else rows.repartitionByRange(*columns)
    return cut(dealt.withColumn("_range", F.spark_partition_id()))


def _before(blocks: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per (key, range) the sums of all earlier ranges, as ``_c_<name>``.

    Without keys there is one row per range; each is added to the later ones by a grouped sum, as a
    window over all rows would run in one task.
    """
    if keys:
        earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
            Window.unboundedPreceding, -1)
        return blocks.select(*keys, "_range", *[
            F.coalesce(F.sum(f"_b_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in names])
    last = blocks.agg(F.max("_range")).first()[0] or 0
    later = blocks.withColumn("_to", F.explode(F.sequence(F.col("_range"), F.lit(last))))
    own = F.col("_to") == F.col("_range")
    return later.groupBy(F.col("_to").alias("_range")).agg(*[
        F.sum(F.when(own, 0).otherwise(F.col(f"_b_{n}"))).alias(f"_c_{n}") for n in names])


def running_totals(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                   values: Mapping[str, Column], ranges: int | None = None) -> DataFrame:
    """Adds inclusive running sums of ``values`` per key (no keys: over all rows).

    ``order`` must identify a row within its key, so that the running order is total.
    """
    dealt = in_ranges(rows.withColumns({f"_v_{name}": value for name, value in values.items()}),
                      keys, order, ranges)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    blocks = dealt.groupBy(*keys, "_range").agg(
        *[F.sum(f"_v_{name}").alias(f"_b_{name}") for name in values])
    summed = dealt.withColumns({f"_s_{name}": F.sum(f"_v_{name}").over(inside) for name in values})
    joined = summed.join(_before(blocks, keys, list(values)), [*keys, "_range"])
    return joined.select(*rows.columns, *[
        (F.col(f"_s_{name}") + F.col(f"_c_{name}")).alias(name) for name in values])


def previous_row(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                 fields: Sequence[str], name: str = "previous",
                 ranges: int | None = None) -> DataFrame:
    """Adds struct ``name`` with the previous row's ``fields`` per key, null on the first row."""
    dealt = in_ranges(rows, keys, order, ranges)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_range")
    ends = dealt.groupBy(*keys, "_range").agg(
        F.max_by(F.struct(*fields), F.struct(*order)).alias("_end"))
    carried = ends.select(*keys, "_range", F.lag("_end").over(across).alias("_carried"))
    lagged = dealt.withColumn("_lag", F.lag(F.struct(*fields)).over(inside))
    joined = lagged.join(carried, [*keys, "_range"])
    return joined.select(*rows.columns, F.coalesce("_lag", "_carried").alias(name))


def trailing_count(rows: DataFrame, keys: Sequence[str], ts: str, seconds: int,
                   name: str) -> DataFrame:
    """Adds the number of rows of the key in the half-open interval of ``seconds`` up to each row.

    Rows are copied into the next block of the same width, where they only serve as history, so a
    window never needs more than two blocks of a key.
    """
    width = seconds * 1_000_000
    moment = F.unix_micros(F.col(ts))
    block = F.floor(moment / width)
    copies = rows.withColumn("_us", moment).withColumn("_copy", F.explode(
        F.array(F.lit(0), F.lit(1)))).withColumn("_block", block + F.col("_copy"))
    window = Window.partitionBy(*keys, "_block").orderBy("_us").rangeBetween(
        -(width - 1), Window.currentRow)
    counted = copies.withColumn(name, F.count(F.lit(1)).over(window))
    return counted.where("_copy = 0").select(*rows.columns, name)


def descending_rank(rows: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Adds the competition rank by descending ``value`` over all rows.

    Equal values are counted first; the running totals of the counts over ranges of the values give
    the ranks. No window and no exchange brings all values together.
    """
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_down", -F.col(value))
    ranked = running_totals(counts, [], ["_down"], {"_upto": F.col("_n")})
    return rows.join(ranked.select(value, (F.col("_upto") - F.col("_n") + 1).alias(name)), value)


def day_runs(days: DataFrame, key: str, day: str = "day") -> DataFrame:
    """Runs of consecutive days: adds ``run`` (its id) and ``run_day`` (1, 2, ... within the run).

    ``days`` holds distinct (key, day) rows, so a key has at most one row per calendar day.
    """
    order = Window.partitionBy(key).orderBy(day)
    numbered = days.withColumn("run", F.date_sub(F.col(day), F.row_number().over(order)))
    return numbered.withColumn("run_day", F.row_number().over(
        Window.partitionBy(key, "run").orderBy(day)))
