"""Cache entries with a time to live, and unfinished transactions, as state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import ETIMEDOUT


def _live(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        until = state.get[2]
        state.remove()
        yield pd.DataFrame({"id": [key[0]], "event": ["expired"], "until": [until]})
        return
    rows = pd.concat(list(parts)).sort_values(["sec", "event_id"])
    sec, event, ttl = (int(rows[c].iloc[-1]) for c in ("sec", "event_id", "ttl"))
    if state.exists and tuple(state.get[:2]) >= (sec, event):  # a later batch may bring older writes
        sec, event, until = state.get
    else:
        until = sec + ttl if ttl else 0  # 0: forever
    state.update((sec, event, until))
    if until:
        state.setTimeoutTimestamp(max(until * 1000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"id": [key[0]], "event": ["written"], "until": [until]})


def cache_events(writes: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(id, event, until): "written" for each batch that writes an id, with the time to live of its newest write so far; "expired" when that is over.

    ``writes`` is a stream (id, event_id, sec, ttl); ttl 0 never expires.
    """
    rows = writes.withColumn("at", F.timestamp_seconds("sec")).withWatermark("at", late)
    return rows.groupBy("id").applyInPandasWithState(_live, "id string, event string, until long", "sec long, event_id long, until long", "update", GroupStateTimeout.EventTimeTimeout)


#: Timeouts without a reply between them after which a client counts as stalled.
STALLS = 3


def _stalls(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (run,) = state.get if state.exists else (0,)
    rows, out = pd.concat(list(parts)).sort_values(["sec", "event_id"]), []
    for event, status in zip(rows["event_id"], rows["status"], strict=True):
        run = run + 1 if status == -ETIMEDOUT else 0
        if run == STALLS:
            out.append(int(event))
            run = 0
    state.update((run,))
    yield pd.DataFrame({"client": [key[0]] * len(out), "event_id": out})


def stalls(log: DataFrame) -> DataFrame:
    """(client, event_id): the timeout at which a client is reset, the third in a row; then the count begins anew.

    ``log`` is a stream of ended transactions; within a batch they are taken in order of (sec, event_id).
    """
    return log.groupBy("client").applyInPandasWithState(_stalls, "client string, event_id long", "run int", "append", GroupStateTimeout.NoTimeout)


def stalls_of(log: DataFrame) -> DataFrame:
    """The same of a table."""
    by = Window.partitionBy("client").orderBy("sec", "event_id")
    late = F.col("status") == -ETIMEDOUT
    rows = log.select("client", "sec", "event_id", late.alias("late")).withColumn("run", F.sum(F.when(F.col("late"), 0).otherwise(1)).over(by))
    rows = rows.filter("late").withColumn("n", F.row_number().over(Window.partitionBy("client", "run").orderBy("sec", "event_id")))
    return rows.filter(F.col("n") % STALLS == 0).select("client", "event_id")


def windowed_counts(log: DataFrame, width: str, late: str) -> DataFrame:
    """Commands per tumbling window, closed by the watermark."""
    rows = log.withColumn("at", F.timestamp_seconds("sec")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("w"), "cmd").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("slot"), "cmd", "n")


def sessions(log: DataFrame, gap: str, late: str) -> DataFrame:
    """Transactions of a client without a pause longer than ``gap``: a stalled client's session ends."""
    rows = log.withColumn("at", F.timestamp_seconds("sec")).withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap).alias("w"), "client").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("begin"), F.unix_timestamp("w.end").alias("end"), "client", "n")
