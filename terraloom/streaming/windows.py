"""Windows over events that also run as streams: tumbling and sliding counts, sessions, running moments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, key: str, value: str, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(key, start, end, n, total) by windows of a size. On a stream, events over `late` behind are dropped."""
    if late:
        events = events.withWatermark(at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = events.groupBy(F.col(key), w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def deduplicated(events: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """Events without repeats of keys; a stream forgets keys after `late`."""
    events = events.withWatermark(at, late)
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def running_moments(points: DataFrame, size: float) -> DataFrame:
    """A stream of points (x, y, z) as a stream of (i, j, k, n, sz, szz): each voxel's sums so far.

    Moments merge, so a voxel's state is three numbers, whatever the stream has brought.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from ..operators.voxels import assign

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s, ss = state.get if state.exists else (0, 0.0, 0.0)
        for b in batches:
            n, s, ss = n + len(b), s + float(b["z"].sum()), ss + float((b["z"] ** 2).sum())
        state.update((n, s, ss))
        yield pd.DataFrame({"i": [key[0]], "j": [key[1]], "k": [key[2]], "n": [n], "sz": [s], "szz": [ss]})

    keyed = assign(points, size).groupBy("i", "j", "k")
    return keyed.applyInPandasWithState(update, "i long, j long, k long, n long, sz double, szz double", "n long, sz double, szz double", "update", GroupStateTimeout.NoTimeout)
