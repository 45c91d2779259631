"""Copying and moving keyed records between groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EBADFD, EILSEQ, ENXIO, ScanFlag, StoreError, uncommitted
from . import routes as rt
from .reads import of_group
from .scan import check_flags, scan


def outcomes(source: DataFrame, target: DataFrame, destinations: tuple[int, ...], overwrite: bool = False) -> DataFrame:
    """(id, group_id, status) of writing each source record to each destination group.

    A write fails where the destination has a newer version, unless it
    overwrites; uncommitted records, and those whose value does not fit its
    checksum (a column valid, where there is one), are reported and not written.
    """
    rows = _meeting(source, target, destinations, [], [], overwrite)
    return rows.select("id", F.explode("_done").alias("x")).select("id", "x.*")


def _meeting(source: DataFrame, target: DataFrame, destinations: tuple[int, ...], own: list[str], have: list[str], overwrite: bool) -> DataFrame:
    """(id, _new, _have, _done): of each id the source's and the target's records (with columns own, have) and what ``outcomes`` tells, as arrays.

    All records of an id meet in one shuffle by the id; records without an id meet nothing.
    """
    if not destinations:
        raise StoreError(ENXIO, "no destination groups")
    valid = F.col("valid") if "valid" in source.columns else F.lit(True)
    new = source.select("id", F.struct(F.col("ts_sec").alias("_ts"), uncommitted().alias("_open"), valid.alias("_valid"), *own).alias("_new"))
    old = target.select("id", F.struct("group_id", F.col("ts_sec").alias("_ts"), *[c for c in have if c not in ("id", "group_id")]).alias("_have"))
    rows = new.select("*", F.lit(None).cast(old.schema["_have"].dataType).alias("_have")).union(old.select("id", F.lit(None).cast(new.schema["_new"].dataType), "_have"))
    rows = rows.withColumn("_alone", F.when(F.col("id").isNull(), F.monotonically_increasing_id())).repartition("id")
    rows = rows.groupBy("id", "_alone").agg(F.collect_list("_new").alias("_new"), F.collect_list("_have").alias("_have"))

    def told(new: Column, group: int) -> Column:
        def status(have: Column) -> Column:
            newer = F.lit(not overwrite) & have["_ts"].isNotNull() & (have["_ts"] > new["_ts"])
            return F.when(new["_open"], F.lit(-ENXIO)).when(~new["_valid"], F.lit(-EILSEQ)).when(newer, F.lit(-EBADFD)).otherwise(F.lit(0))

        return F.transform(of_group("_have", F.lit(group)), lambda have: F.struct(F.lit(group).alias("group_id"), status(have).alias("status")))

    done = F.flatten(F.transform("_new", lambda new: F.concat(*[told(new, g) for g in destinations])))
    return rows.select("id", "_new", "_have", done.alias("_done"))


def results(done: DataFrame) -> DataFrame:
    """(id, status): one result a key, 0 if all its destinations took it."""
    return done.groupBy("id").agg(F.coalesce(F.min_by("status", F.when(F.col("status") != 0, F.col("group_id"))), F.lit(0)).alias("status"))


def copied(target: DataFrame, source: DataFrame, destinations: tuple[int, ...], overwrite: bool = False) -> DataFrame:
    """The target table after the writes that succeed (as ``outcomes`` tells)."""
    own = [c for c in target.columns if c not in ("id", "group_id")]
    rows = _meeting(source, target, destinations, own, own, overwrite).withColumn("_done", F.filter("_done", lambda x: x["status"] == 0))
    kept = F.filter("_have", lambda x: ~F.exists("_done", lambda done: done["group_id"].eqNullSafe(x["group_id"])))
    columns = lambda group, x: F.struct(group.alias("group_id"), *[x[c].alias(c) for c in own])
    new = F.flatten(F.transform(F.filter("_new", lambda x: F.col("id").isNotNull()), lambda x: F.transform("_done", lambda done: columns(done["group_id"].cast(target.schema["group_id"].dataType), x))))
    both = F.concat(F.transform(kept, lambda x: columns(x["group_id"], x)), new)
    return rows.select("id", F.explode(both).alias("x")).select("id", "x.*").select(*target.columns)


def left_after_move(source: DataFrame, done: DataFrame) -> DataFrame:
    """The source table after a move: a record goes only if every destination took it."""
    return source.join(results(done).filter("status = 0"), "id", "left_anti")


def requests(source: DataFrame, routes: DataFrame, group: int) -> DataFrame:
    """(address, backend_id, keys): the requests that sending keys takes, one for each backend of the group that holds some."""
    owners = rt.lookup(source.select("id").distinct().withColumn("group_id", F.lit(group)), routes)
    return owners.groupBy("address", "backend_id").agg(F.count("*").alias("keys"))


def copy_scan(records: DataFrame, group: int, destinations: tuple[int, ...], ranges: list[tuple[str, str]] = (), time: tuple[int, int] = (0, 0), flags: int = 0) -> tuple[DataFrame, DataFrame]:
    """Scan a group and send what is found to the destinations: (outcomes, all records afterwards).

    Flags of a scan: with MOVE a record that every destination took leaves the
    source; with OVERWRITE newer versions at a destination are replaced.
    """
    flags = check_flags(flags)
    source = scan(records.filter(F.col("group_id") == group), ranges, time)
    target = records.filter(F.col("group_id").isin(list(destinations)))
    done = outcomes(source, target, destinations, bool(flags & ScanFlag.OVERWRITE))
    own = records.filter(F.col("group_id") == group)
    if flags & ScanFlag.MOVE:
        own = left_after_move(own, done)
    rest = records.filter((F.col("group_id") != group) & ~F.col("group_id").isin(list(destinations)))
    return done, copied(target, source, destinations, bool(flags & ScanFlag.OVERWRITE)).unionByName(own).unionByName(rest)
