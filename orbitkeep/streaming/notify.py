"""Notifications: successful writes of watched ids, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def notifications(log: DataFrame, watches: DataFrame) -> DataFrame:
    """Each successful write in ``log`` (a stream or a table) for each watcher of its id.

    ``watches`` is a table (id, watcher); a watch that was dropped is not in it.
    """
    writes = log.filter((F.col("cmd") == "WRITE") & (F.col("status") == 0))
    return writes.join(watches.select("id", "watcher"), "id").select("watcher", "id", "event_id", "sec", "size")
