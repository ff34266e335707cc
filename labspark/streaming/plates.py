"""Structured Streaming over laboratory streams. The batch operators define the results; this is an extension."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_qc(events: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """n, mean and sd of value by event type in tumbling windows; what is later than late is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def sessions(events: DataFrame, time: str, gap: str, late: str) -> DataFrame:
    """n and value total by user in sessions that end after a gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def running_exposure(points: DataFrame) -> DataFrame:
    """subject, t and the trapezoid so far, updated with each batch of (subject, t, c).

    State is the last point and the total of each subject; points earlier than the last one
    of their subject come too late and are left out.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, c, total = state.get if state.exists else (None, None, 0.0)
        rows = pd.concat(list(batches)).sort_values("t")
        for r in rows.itertuples(index=False):
            if t is not None and r.t <= t:
                continue
            if t is not None:
                total += (r.t - t) * (c + r.c) / 2
            t, c = float(r.t), float(r.c)
        state.update((t, c, total))
        yield pd.DataFrame({"subject": [key[0]], "t": [t], "auc": [total]})

    return points.groupBy("subject").applyInPandasWithState(update, "subject long, t double, auc double", "t double, c double, total double", "update", GroupStateTimeout.NoTimeout)
