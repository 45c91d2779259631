"""Scans of record tables: key ranges, time ranges, projections, progress, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ENOTSUP, ERANGE, ScanFlag, StoreError, uncommitted

#: Leading hex digits of ids by which a partition of the store is ordered in parallel.
DIGITS = 3


def check_flags(flags: int) -> ScanFlag:
    if flags & ~int(sum(ScanFlag)):
        raise StoreError(ENOTSUP, f"unknown scan flags: {flags:#x}")
    return ScanFlag(flags)


def in_ranges(ranges: list[tuple[str, str]], column: str = "id") -> Column:
    """True within any of the ranges, both ends included; without ranges, or if all are zero, always."""
    for begin, end in ranges:
        if begin > end:
            raise StoreError(ERANGE, f"range ends before it begins: {begin} > {end}")
    if all(not begin.strip("0") and not end.strip("0") for begin, end in ranges):
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.col(column).between(begin, end) for begin, end in ranges])


def in_time(begin: int, end: int, column: str = "ts_sec") -> Column:
    """True within the times, both ends included; 0 and 0 mean any time."""
    if begin > end:
        raise StoreError(ERANGE, f"time range ends before it begins: {begin} > {end}")
    return F.lit(True) if begin == end == 0 else F.col(column).between(begin, end)


def scan(records: DataFrame, ranges: list[tuple[str, str]] = (), time: tuple[int, int] = (0, 0), no_meta: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Records within the ranges.  With no_meta, times and user flags are 0 unless a record is uncommitted or times are asked for."""
    rows = records.filter(in_ranges(list(ranges)) & in_time(*time))
    if no_meta and time == (0, 0):
        rows = rows.withColumns({c: F.when(uncommitted(), F.col(c)).otherwise(F.lit(0).cast("long")) for c in ("ts_sec", "user_flags")})
    return rows.select(*columns) if columns else rows


def placed(records: DataFrame, by: str = "group_id", digits: int = DIGITS) -> DataFrame:
    """Adds place, an id's number from 1 within its partition of the store in order of ids, and total.

    Ids are digests, so their leading digits cut each partition into many parts
    of like size: parts are counted, counts added up, and only the rows of one
    part are ordered in a task.
    """
    part = F.substring("id", 1, digits)
    sizes = records.groupBy(F.col(by).alias("_by"), part.alias("_part")).agg(F.count("*").alias("_n"))
    own = Window.partitionBy("_by")
    sizes = sizes.select("_by", "_part", (F.sum("_n").over(own.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(own).alias("total"))
    rows = records.withColumns({"_part_of": part, "_place": F.row_number().over(Window.partitionBy(by, part).orderBy("id"))})
    rows = rows.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part_of") == F.col("_part")))
    return rows.select(*records.columns, (F.col("_before") + F.col("_place")).cast("long").alias("place"), F.col("total").cast("long").alias("total"))


def progress(records: DataFrame, match: Column, by: str = "group_id") -> DataFrame:
    """Matching records with how many were gone through up to each, and how many there are, per partition of the store."""
    return placed(records, by).withColumnsRenamed({"place": "iterated_keys", "total": "total_keys"}).filter(match)


def page(records: DataFrame, begin: str, end: str, start: int, num: int, by: str = "group_id") -> DataFrame:
    """Of each partition the records of a key range, without the first ``start``, ``num`` at most (0: all), whatever backends hold them."""
    rows = placed(records.filter(F.col("id").between(begin, end)), by).drop("total").filter(F.col("place") > start)
    return rows.filter(F.col("place") <= start + num) if num else rows


def count_range(records: DataFrame, begin: str, end: str, start: int, by: str = "group_id") -> DataFrame:
    return records.filter(F.col("id").between(begin, end)).groupBy(by).agg(F.greatest(F.count("*") - start, F.lit(0)).alias("n"))


def delete_range(records: DataFrame, begin: str, end: str) -> DataFrame:
    """The records left when a range is removed (start and num do not apply)."""
    return records.filter(~F.col("id").between(begin, end))


def removed_range(records: DataFrame, begin: str, end: str, by: str = "group_id") -> DataFrame:
    """(by, removed): how many records the removal of a range takes from each partition; 0 where it finds none."""
    return records.groupBy(by).agg(F.count_if(F.col("id").between(begin, end)).alias("removed"))
