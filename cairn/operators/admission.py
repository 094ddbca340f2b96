"""Sliding-window admission of calls: a call is accepted while fewer than ``limit`` accepted calls
of the same client lie in the window before it. Rejected calls do not count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.operators.ordered import previous_row, running_totals
from cairn.session import cut


def admit(times: np.ndarray, accepted: deque, limit: int, window_us: int) -> np.ndarray:
    """Decide calls in time order; ``accepted`` carries the accepted times still in the window."""
    decisions = np.zeros(len(times), bool)
    for i, now in enumerate(times):
        while accepted and now - accepted[0] >= window_us:
            accepted.popleft()
        if len(accepted) < limit:
            accepted.append(now)
            decisions[i] = True
    return decisions


def admit_calls(calls: DataFrame, limit: int, window_seconds: int = fv.RATE_WINDOW_SECONDS
                ) -> DataFrame:
    """Adds ``accepted`` to calls (client, grp, ts, ord).

    A pause of a window empties the window, so calls split into bursts that are independent of
    each other. A burst of at most ``limit`` calls is accepted as a whole without leaving the JVM;
    only longer bursts are walked through, as a stream of sorted batches with at most ``limit``
    times of state.
    """
    width, keys = window_seconds * 1_000_000, ["client", "grp"]
    timed = calls.withColumn("us", F.unix_micros("ts"))
    gap = previous_row(timed, keys, ["ts", "ord"], ["us"], "before")
    opens = F.when(F.col("us") - F.col("before.us") < width, 0).otherwise(1)
    bursts = cut(running_totals(gap, keys, ["ts", "ord"], {"burst": opens}).drop("before"))
    sizes = bursts.groupBy(*keys, "burst").agg(F.count(F.lit(1)).alias("calls"))
    sized = bursts.join(sizes, [*keys, "burst"])
    group = [*keys, "burst"]
    longer = sized.where(F.col("calls") > limit).select(*group, "us", "ord") \
        .repartition(*group).sortWithinPartitions(*group, "us", "ord")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        accepted: deque = deque()
        for batch in batches:
            yield pd.DataFrame({"ord": batch["ord"], "accepted": admit(
                batch["us"].to_numpy(), accepted, limit, width)})

    walked = longer.groupBy(*group).applyInPandas(walk, "ord bigint, accepted boolean")
    return sized.where(F.col("calls") <= limit).select(
        "ord", F.lit(True).alias("accepted")).unionByName(walked).join(calls, "ord")
