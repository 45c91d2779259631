"""Decaying weights of keys, kept as state over a stream of reads.

Within a micro-batch a key's reads are played in order of (sec, event_id); a
read older than the last one seen counts as if it came at that time.  Keys
without reads for longer than the window lose their state by event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "group_id int, id string, weight long, frequency double, last long"


def _fold(window: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        weight, frequency, last = state.get if state.exists else (0, 0.0, None)
        rows = pd.concat(list(parts)).sort_values(["sec", "event_id"])
        for sec, size in zip(rows["sec"], rows["size"], strict=True):
            keep = 0.0 if last is None else max(0.0, 1.0 - max(0, sec - last) / window)
            weight, frequency = int(weight * keep) + int(size), frequency * keep + 1.0
            last = int(sec) if last is None else max(last, int(sec))
        state.update((weight, frequency, last))
        state.setTimeoutTimestamp(max((last + window) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"group_id": [key[0]], "id": [key[1]], "weight": [weight], "frequency": [frequency], "last": [last]})

    return run


def hot_keys(log: DataFrame, window: int, late: str = "1 hour") -> DataFrame:
    """A row (OUT) for each key and micro-batch in which it was read; ``log`` is a stream with group_id, id, event_id, sec, cmd, status, size."""
    reads = log.filter("cmd = 'READ' AND status = 0 AND size > 0").withColumn("at", F.timestamp_seconds("sec")).withWatermark("at", late)
    return reads.groupBy("group_id", "id").applyInPandasWithState(_fold(window), OUT, "weight long, frequency double, last long", "update", GroupStateTimeout.EventTimeTimeout)
