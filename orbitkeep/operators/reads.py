"""Reads over replicas: fallback by group order, latest, quorum, bulk, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import E2BIG, EBADFD, EILSEQ, EINVAL, ENOENT, StoreError, uncommitted

REPLICA = ("group_id", "ts_sec", "size", "user_flags")


def visible(records: DataFrame) -> DataFrame:
    """Records that a reader sees: committed ones."""
    return records.filter(~uncommitted())


def present(records: DataFrame) -> DataFrame:
    """Records that a lookup sees: visible and not empty."""
    return visible(records).filter("size > 0")


def priority(groups: tuple[int, ...]) -> Column:
    """Place of the row's group in an order of groups; null for others."""
    return F.coalesce(*[F.when(F.col("group_id") == g, F.lit(i)) for i, g in enumerate(groups)])


def first_group(records: DataFrame, groups: tuple[int, ...], columns: tuple[str, ...] = REPLICA) -> DataFrame:
    """Of each id the replica in the first group, by the given order, that has one."""
    rows = visible(records).withColumn("prio", priority(groups)).filter("prio IS NOT NULL")
    return rows.groupBy("id").agg(F.min_by(F.struct(*columns), "prio").alias("r")).select("id", "r.*")


def bulk_read(records: DataFrame, wanted: DataFrame, groups: tuple[int, ...]) -> DataFrame:
    """first_group of the wanted ids, each once; missing ids give no row, and no ids at all are an error."""
    if not wanted.limit(1).count():
        raise StoreError(EINVAL, "no ids are asked for")
    return first_group(records.join(wanted.select("id").distinct(), "id", "left_semi"), groups)


def _gathered(wanted: DataFrame, groups: tuple[int, ...], more: dict[str, DataFrame], numbers: tuple[str, ...] = ()) -> DataFrame:
    """Of each wanted id one row: ``numbers`` of wanted (the largest), and by name the rows of each of ``more`` in the asked groups, as an array.

    All rows of an id meet in one shuffle by the id alone.  An id has a few rows
    in each group, so nothing is combined before the shuffle: that would sort
    each map task's rows for arrays of three or five.
    """
    kept = {name: rows.filter(F.col("id").isNotNull() & F.col("group_id").isin(list(groups))) for name, rows in more.items()}
    types = {name: F.struct(*[c for c in rows.columns if c != "id"]) for name, rows in kept.items()}
    schemas = {name: rows.select(types[name].alias("x")).schema["x"].dataType for name, rows in kept.items()}
    whole = wanted.select("id", F.lit(True).alias("_asked"), *numbers, *[F.lit(None).cast(t).alias(name) for name, t in schemas.items()])
    numbers_of = {f.name: f.dataType for f in wanted.schema.fields if f.name in numbers}
    for name, rows in kept.items():
        others = [types[n].alias(n) if n == name else F.lit(None).cast(t).alias(n) for n, t in schemas.items()]
        whole = whole.union(rows.select("id", F.lit(False), *[F.lit(None).cast(numbers_of[n]) for n in numbers], *others))
    lists = [F.collect_list(name).alias(name) for name in schemas]
    return whole.repartition("id").groupBy("id").agg(F.max("_asked").alias("_asked"), *[F.max(n).alias(n) for n in numbers], *lists).filter("_asked").drop("_asked")


def of_group(rows: str, group: Column) -> Column:
    """The rows of a group in an array of them; without any, one null, as a left join has it."""
    own = F.filter(rows, lambda x: x["group_id"] == group)
    return F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(None)))


def _tried(records: DataFrame, wanted: DataFrame, groups: tuple[int, ...], failures: DataFrame | None, columns: tuple[str, ...], numbers: tuple[str, ...] = ()) -> DataFrame:
    """(id, numbers, tried): what ``attempts`` returns, as an array of (prio, group_id, status, columns) for each id."""
    more = {"_held": visible(records).select("id", "group_id", *columns)}
    if failures is not None:
        more["_failed"] = failures.select("id", "group_id", "status")
    rows = _gathered(wanted, groups, more, numbers)

    def tries(prio: int, group: int) -> Column:
        def told(held: Column, failed: Column | None) -> Column:
            status = F.when(held.isNull(), F.lit(-ENOENT)).otherwise(F.lit(0))
            status = status if failed is None else F.coalesce(failed["status"], status)
            return F.struct(F.lit(prio).alias("prio"), F.lit(group).alias("group_id"), status.alias("status"), *[held[c].alias(c) for c in columns])

        held = of_group("_held", F.lit(group))
        if failures is None:
            return F.transform(held, lambda h: told(h, None))
        return F.flatten(F.transform(held, lambda h: F.transform(of_group("_failed", F.lit(group)), lambda f: told(h, f))))

    rows = rows.select("id", *numbers, F.concat(*[tries(i, g) for i, g in enumerate(groups)]).alias("_all"))
    rows = rows.withColumn("_first", F.array_min(F.transform(F.filter("_all", lambda x: x["status"] == 0), lambda x: x["prio"])))
    return rows.select("id", *numbers, F.filter("_all", lambda x: F.col("_first").isNull() | (x["prio"] <= F.col("_first"))).alias("tried"))


def attempts(records: DataFrame, wanted: DataFrame, groups: tuple[int, ...], failures: DataFrame | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """(id, prio, group_id, status, columns): the groups that a read of each id asks, up to the first that has it.

    ``failures`` (id, group_id, status) are groups that answer with an error though they hold the id.
    """
    return _tried(records, wanted, groups, failures, columns).select("id", F.explode("tried").alias("t")).select("id", "t.*")


def lookup(records: DataFrame, wanted: DataFrame, groups: tuple[int, ...], failures: DataFrame | None = None) -> DataFrame:
    """(id, prio, group_id, status, ts_sec, size): what a lookup of each id is told, group by group, up to the first that has it and is not empty."""
    return attempts(records.filter("size > 0"), wanted, groups, failures, ("ts_sec", "size"))


def repairs(records: DataFrame, wanted: DataFrame, groups: tuple[int, ...], failures: DataFrame | None = None) -> DataFrame:
    """(id, from_group, to_group): writes that a successful read owes to the groups that failed before it.

    Only a read of the whole object repairs: ``wanted`` may have offset and
    size, of which offset has to be 0 and size 0 or the object's at least.  Only
    groups that lack the object, hold a bad version or a corrupt one are
    repaired, not those that were out of reach.
    """
    numbers = ("offset", "size") if {"offset", "size"} <= set(wanted.columns) else ()
    tried = _tried(records, wanted, groups, failures, ("size",), numbers).filter("id IS NOT NULL")
    good = tried.select("id", *numbers, F.filter("tried", lambda x: x["status"].isin(-ENOENT, -EBADFD, -EILSEQ)).alias("_bad"), F.explode(F.filter("tried", lambda x: x["status"] == 0)).alias("_good"))
    if numbers:
        good = good.filter("offset = 0 AND (size = 0 OR size >= _good.size)")
    return good.select("id", F.col("_good.group_id").alias("from_group"), F.explode("_bad").alias("_to")).select("id", "from_group", F.col("_to.group_id").alias("to_group"))


def slice_of(data: Column, offset: Column, size: Column) -> Column:
    """Bytes of a value from ``offset``; size 0 means to the end."""
    return F.when(size == 0, F.substring(data, offset + 1, F.length(data))).otherwise(F.substring(data, offset + 1, size))


def slice_status(length: Column, offset: Column) -> Column:
    """0, or an error if an offset other than 0 is beyond the value."""
    return F.when((offset > 0) & (offset >= length), F.lit(-E2BIG)).otherwise(F.lit(0))


def latest(records: DataFrame, columns: tuple[str, ...] = REPLICA) -> DataFrame:
    """The newest visible replica of each id; of equally new ones the lowest group's."""
    newest = F.max_by(F.struct(*columns), F.struct(F.col("ts_sec"), -F.col("group_id")))
    return visible(records).groupBy("id").agg(newest.alias("r")).select("id", "r.*")


def latest_order(replies: DataFrame) -> DataFrame:
    """Replies ranked: bodies by time, newest first, then acknowledgements, then errors; by group among equals."""
    kind = F.when(F.col("status") != 0, F.lit(2)).when(F.col("data_size") == 0, F.lit(1)).otherwise(F.lit(0))
    w = Window.partitionBy("id").orderBy("kind", F.when(F.col("kind") == 0, -F.col("ts_sec")), "group_id", "is_final")
    return replies.withColumn("kind", kind).withColumn("place", F.row_number().over(w))


def quorum(records: DataFrame, wanted: DataFrame, groups: tuple[int, ...]) -> DataFrame:
    """(id, group_id, status, ts_sec, size): of each wanted id the replicas of the time on which more than half of the ``groups`` agree; without one, those of the newest time.

    Groups without a visible replica count for the half and are rows with an error.
    """
    rows = _gathered(wanted, groups, {"_held": visible(records).select("id", "group_id", "ts_sec", "size")})

    def told(group: int) -> Column:
        return F.transform(of_group("_held", F.lit(group)), lambda h: F.struct(F.lit(group).alias("group_id"), h["ts_sec"].alias("ts_sec"), h["size"].alias("size")))

    rows = rows.select("id", F.concat(*[told(g) for g in groups]).alias("_all")).withColumn("_times", F.filter(F.transform("_all", lambda x: x["ts_sec"]), lambda t: t.isNotNull()))
    agreed = F.filter("_times", lambda t: F.size(F.filter("_times", lambda u: u == t)) >= len(groups) // 2 + 1)
    rows = rows.withColumn("_chosen", F.coalesce(F.array_max(agreed), F.array_max("_times")))
    rows = rows.select("id", F.explode(F.filter("_all", lambda x: x["ts_sec"].isNull() | (x["ts_sec"] == F.col("_chosen")))).alias("x"))
    status = F.when(F.col("x.ts_sec").isNull(), F.lit(-ENOENT)).otherwise(F.lit(0))
    return rows.select("id", "x.group_id", status.alias("status"), "x.ts_sec", "x.size")


def misplaced(holders: DataFrame) -> DataFrame:
    """Records that are held elsewhere than where the routes put them."""
    return holders.filter("holder_n <> owner_n")


def checksum(data: Column, bits: int = 512) -> Column:
    """Digest of a value; of an empty one, zeros."""
    return F.when(F.length(data) == 0, F.lit("0" * (bits // 4))).otherwise(F.sha2(data.cast("binary"), bits))
