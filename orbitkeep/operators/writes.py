"""Writes as logs: last writer wins, compare and swap, append, prepare and commit, expiry.

A log is a table of (id, seq, ...).  Order within an id matters, so what makes up
an id's value is gathered in one row, as the value itself is; entries that a
later one replaced are left out before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import EBADFD, EINVAL, EROFS, StoreError, uncommitted
from .reads import of_group


def last_writer(stored: DataFrame, writes: DataFrame, keys: tuple[str, ...] = ("id", "group_id")) -> DataFrame:
    """The table after the writes: a write holds if it is as new as what is stored, or newer."""
    rows = stored.withColumn("_new", F.lit(0)).unionByName(writes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    other = [c for c in stored.columns if c not in keys]
    best = F.max_by(F.struct(*other), F.struct("ts_sec", "_new", *[c for c in other if c != "ts_sec"]))
    return rows.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def cas_status(stored_digest: Column, given_digest: Column) -> Column:
    """0 if a write that carries the digest of what it read may go on; a missing record accepts it."""
    return F.when(stored_digest.isNull() | (stored_digest == given_digest), F.lit(0)).otherwise(F.lit(-EBADFD))


def cas_time_status(stored_ts: Column, new_ts: Column) -> Column:
    return F.when(stored_ts.isNull() | (stored_ts <= new_ts), F.lit(0)).otherwise(F.lit(-EBADFD))


def convert(records: DataFrame, converter, column: str = "data") -> DataFrame:
    """Read, convert, write back: a converter is a function of columns (or an Arrow function); changed tells what was written."""
    return records.withColumn("_new", converter(F.col(column))).withColumn("changed", ~F.col("_new").eqNullSafe(F.col(column))).withColumn(column, F.col("_new")).drop("_new")


def appended(log: DataFrame) -> DataFrame:
    """All entries of an id in order, as one value."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "data")))
    return log.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["data"]), "").alias("data"), F.count("*").alias("parts"))


def chunks(size: Column, chunk: int) -> Column:
    """(offset, size, phase) of the requests that write a value: plain if it fits, else prepare, plain ..., commit."""
    n = F.greatest(F.ceil(size / chunk), F.lit(1)).cast("int")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("offset"), size.cast("long").alias("size"), F.lit("write").alias("phase")))
    phase = lambda i: F.when(i == 0, "prepare").when(i == n - 1, "commit").otherwise("plain")
    many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i.cast("long") * chunk).alias("offset"), F.least(F.lit(chunk).cast("long"), size - i.cast("long") * chunk).alias("size"), phase(i).alias("phase")))
    return F.when((size <= chunk) | F.lit(chunk == 0), whole).otherwise(many)


def folded(log: DataFrame) -> DataFrame:
    """(id, data, visible): each id's log of prepare, plain, commit, write and remove entries, played in order.

    prepare starts a new, invisible value; plain adds to it; commit adds, cuts
    the value to csize characters (a column that the log may have; null or 0:
    all) and shows it; write replaces it and shows it; remove takes it away.
    """
    base = log.groupBy("id").agg(F.max(F.when(F.col("op").isin("prepare", "write", "remove"), F.col("seq"))).alias("base"))
    csize = F.col("csize") if "csize" in log.columns else F.lit(None)
    live = log.withColumn("csize", csize.cast("int")).join(base, "id").filter("base IS NULL OR seq >= base")
    entries = F.array_sort(F.collect_list(F.struct("seq", "op", "data", "csize")))
    zero = F.struct(F.lit(None).cast("string").alias("data"), F.lit(False).alias("visible"))

    def step(a, x):
        adds = F.concat(F.coalesce(a["data"], F.lit("")), x["data"])
        whole = F.when(x["csize"] > 0, F.substring(adds, F.lit(1), x["csize"])).otherwise(adds)
        return (
            F.when(x["op"] == "remove", zero)
            .when(x["op"] == "write", F.struct(x["data"].alias("data"), F.lit(True).alias("visible")))
            .when(x["op"] == "prepare", F.struct(x["data"].alias("data"), F.lit(False).alias("visible")))
            .when(x["op"] == "commit", F.struct(whole.alias("data"), F.lit(True).alias("visible")))
            .otherwise(F.struct(adds.alias("data"), a["visible"].alias("visible")))
        )

    rows = live.groupBy("id").agg(F.aggregate(entries, zero, step).alias("r"))
    return rows.select("id", "r.data", "r.visible").filter("data IS NOT NULL")


def to_groups(writes: DataFrame, groups: tuple[int, ...]) -> DataFrame:
    """Each write to each of the groups."""
    return writes.withColumn("group_id", F.explode(F.array(*[F.lit(g) for g in groups])))


def bulk(requests: DataFrame, values: DataFrame, groups: tuple[int, ...]) -> DataFrame:
    """(n, id, ts_sec, data, size, group_id): numbered requests (n, id, ts_sec) with their values (n, data), to each of the groups; as many of one as of the other."""
    have, given = requests.count(), values.count()
    if have != given:
        raise StoreError(EINVAL, f"{have} requests with {given} values")
    return to_groups(requests.join(values, "n").withColumn("size", F.length("data").cast("long")), groups)


def offset_writes(log: DataFrame) -> DataFrame:
    """(id, data): the values that (id, seq, offset, data) writes leave, laid over each other in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "offset", "data"))), lambda x: F.struct(x["offset"].cast("int").alias("offset"), x["data"].alias("data")))
    return log.groupBy("id").agg(overlaid(parts).alias("data"))


def cas_convert(replicas: DataFrame, converter, groups: tuple[int, ...], attempts: int = 10) -> DataFrame:
    """(id, group_id, status, data): read the latest value, convert it, and swap it in each group against the digest that the group had.

    ``replicas`` has id, group_id, ts_sec, record_flags, size, data, and
    meanwhile: how often a group's value is changed by others between the read
    and the write of one attempt and the next.  Such a group fails with an error
    and is tried again; it fails for good after ``attempts``.  A converter that
    changes nothing writes nothing (status 0, data as they were).  Groups
    without the id take the write.
    """
    # one shuffle by the id, of the latest value alone and of all groups' counts; both meet before the value is there for each group
    seen = F.when(~uncommitted(), F.struct(F.col("ts_sec"), -F.col("group_id")))
    counts = F.collect_list(F.when(F.col("id").isNotNull() & F.col("group_id").isin(list(groups)), F.struct("group_id", "meanwhile")))
    base = replicas.groupBy("id").agg(F.max_by("data", seen).alias("_old"), F.count(seen).alias("_seen"), counts.alias("_counts")).filter("_seen > 0")
    asked = base.select("id", "_old", converter(F.col("_old")).alias("_new"), F.explode(F.concat(*[_told(g) for g in groups])).alias("x"))
    rows = asked.select("id", "_old", "_new", "x.*")
    lost = F.coalesce("meanwhile", F.lit(0)) >= attempts
    same = F.col("_new").eqNullSafe(F.col("_old"))
    status = F.when(~same & lost, F.lit(-EBADFD)).otherwise(F.lit(0))
    return rows.select("id", "group_id", status.alias("status"), F.when(status == 0, F.col("_new")).otherwise(F.col("_old")).alias("data"))


def _told(group: int) -> Column:
    return F.transform(of_group("_counts", F.lit(group)), lambda x: F.struct(F.lit(group).alias("group_id"), x["meanwhile"].alias("meanwhile")))


def overlaid(parts: Column) -> Column:
    """(offset, data) writes of a string value laid over each other in order; gaps are spaces."""

    def step(a, x):
        end = F.length(x["data"]) + x["offset"]
        return F.concat(F.rpad(F.substring(a, 1, x["offset"]), x["offset"], " "), x["data"], F.substring(a, end + 1, F.length(a)))

    return F.aggregate(parts, F.lit(""), step)


def unexpired(log: DataFrame, now: Column | int, ttl: Column) -> DataFrame:
    """The last cached write of each id that has not outlived its time to live (0: forever); ``now`` is a number or a column of one (a scalar subquery)."""
    rows = log.withColumn("ttl", ttl).groupBy("id").agg(F.max_by(F.struct("sec", "ttl", "event_id"), F.struct("sec", "event_id")).alias("r")).select("id", "r.*")
    return rows.filter((F.col("ttl") == 0) | (F.col("sec") + F.col("ttl") > now))


def without(records: DataFrame, removed: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Records after a (bulk) remove."""
    return records.join(removed.select(*keys).distinct(), list(keys), "left_anti")


def read_only_status(writes: DataFrame, places: DataFrame) -> DataFrame:
    """Writes and removes with status: an error where their (group, backend) is read-only."""
    return writes.join(places.select("group_id", "backend_id", "read_only"), ["group_id", "backend_id"], "left").withColumn("status", F.when(F.col("read_only") & F.col("cmd").isin("WRITE", "DEL"), F.lit(-EROFS)).otherwise(F.lit(0))).drop("read_only")


def in_order(log: DataFrame) -> DataFrame:
    """Entries of an id in their order of execution."""
    return log.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy("seq")))
