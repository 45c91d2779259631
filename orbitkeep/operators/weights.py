"""Load-aware choice of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded_rows
from .replies import with_each


def folded(access: DataFrame, keys: tuple[str, ...] = ("group_id", "backend_id"), start: float = 1.0) -> DataFrame:
    """(keys, weight) after each place's log in order of (sec, event_id).

    A successful read turns the weight w into the harmonic mean of w and its
    speed: 1 / ((1 / w + time / size) / 2); a timeout (status -110) divides a weight of 2
    or more by 10; other entries change nothing.
    """
    read = (F.col("cmd") == "READ") & (F.col("status") == 0) & (F.col("size") > 0) & (F.col("time_us") > 0)
    slow = F.when(read, F.col("time_us").cast("double") / F.col("size").cast("double"))  # null: a timeout, or nothing
    log = access.select(*keys, "sec", "event_id", slow.alias("slow"), (F.col("status") == -110).alias("late"))

    def step(w: float, slow: float | None, late: bool) -> float:
        if slow is not None:
            return 1.0 / ((1.0 / w + slow) / 2.0)
        return w / 10.0 if late and w >= 2.0 else w

    return folded_rows(log, keys, ("sec", "event_id"), ("slow", "late"), start, step, lambda w: (w,), "weight double")


def mixed(requests: DataFrame, groups: DataFrame, seed: int) -> DataFrame:
    """The order in which each request asks the groups: weighted random without replacement, by seeded exponential keys.

    ``groups`` is (group_id, weight).  The draw is 32 bits of a digest of id, group and seed.
    """
    rows = with_each(requests, groups.select("group_id", "weight"))
    digest = F.md5(F.concat_ws(":", "id", F.col("group_id").cast("string"), F.lit(str(seed))).cast("binary"))
    draw = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 1) / F.lit(float((1 << 32) + 1))
    return rows.withColumn("_key", -F.log(draw) / F.col("weight")).withColumn("prio", F.row_number().over(Window.partitionBy("id").orderBy("_key", "group_id"))).drop("_key")
