"""Transition graphs from a stream of events: windows of event time are graphs, consecutive events of a user are edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def consecutive(events: DataFrame) -> DataFrame:
    """user_id, ts, src, dst for each event after a user's first; the last event of each user is the state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        before = [last, *rows["event_type"].tolist()[:-1]]
        out = pd.DataFrame({"user_id": key[0], "ts": rows["ts"].array, "src": before, "dst": rows["event_type"].array})
        state.update((rows["event_type"].iloc[-1],))
        yield out[out["src"].notna()]

    kept = events.select("user_id", "ts", "event_id", "event_type")
    return kept.groupBy("user_id").applyInPandasWithState(step, "user_id long, ts timestamp, src string, dst string", "last string", "append", GroupStateTimeout.NoTimeout)


def windowed_degrees(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of each type in each window, with a watermark: the nodes' weights of a window's graph."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def pooled_batches(stream: DataFrame, pool: Callable[[DataFrame, int], None]):
    """A writer that hands each micro-batch to a batch pooler."""
    return stream.writeStream.foreachBatch(pool)
