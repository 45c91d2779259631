"""Scan results as sorted containers: order, first of each key, difference, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .routes import BROADCAST_ROWS, prefix, prefix_digits


#: Newest first; sizes are compared downwards, as the sort of containers does.
def newest_first(size_order: str = "desc") -> list:
    return [F.col("ts_sec").desc(), F.col("size").desc() if size_order == "desc" else F.col("size").asc()]


def in_order(rows: DataFrame, size_order: str = "desc") -> DataFrame:
    """By key, newest first."""
    return rows.orderBy("id", *newest_first(size_order))


def ranked(rows: DataFrame, size_order: str = "desc", tie: tuple[str, ...] = ("group_id",)) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*newest_first(size_order), *tie)))


def first_of_key(rows: DataFrame, size_order: str = "desc", tie: tuple[str, ...] = ("group_id",)) -> DataFrame:
    return ranked(rows, size_order, tie).filter("place = 1").drop("place")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The newest right row of each key that the left side lacks, or has in an older (or equally old, smaller) version only."""
    have = left.groupBy("id").agg(F.max(F.struct("ts_sec", "size")).alias("have"))
    return first_of_key(right).join(have, "id", "left").filter(F.col("have").isNull() | (F.struct("ts_sec", "size") > F.col("have"))).drop("have")


def merged(rows: DataFrame, size_order: str = "desc") -> DataFrame:
    """One winner of each key over all containers, with the group it came from: newest, then by size, then with the largest user flags."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(*newest_first(size_order), F.desc("user_flags"), "group_id"))
    return rows.withColumn("place", place).filter("place = 1").drop("place")


def bucketed(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each row with the disjoint (start, stop) range that holds its id, ends included; null range_id outside of all.

    Ranges are met by as many leading digits as their count asks for, and are
    broadcast within the bound of routes.
    """
    n = ranges.count()
    digits = prefix_digits(n)
    spans = ranges.withColumn("_prefix", F.explode(F.sequence(prefix(F.col("start"), digits), prefix(F.col("stop"), digits))))
    if n + 16**digits <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    own = rows.withColumn("_own", prefix(F.col("id"), digits))
    return own.join(spans, (F.col("_own") == F.col("_prefix")) & F.col("id").between(F.col("start"), F.col("stop")), "left").drop("_own", "_prefix", "start", "stop")


def transposed(results: DataFrame) -> DataFrame:
    """(range_id, nodes): of (node, range_id) results, the nodes that have something in each range, in order."""
    return results.select("range_id", "node").distinct().groupBy("range_id").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
