"""Routing: who owns a key, by the greatest boundary at or under it on a ring.

A ring wraps: keys under the first boundary belong to the last.  Range joins
become equi-joins: intervals and keys are cut by their leading hex digits, as many
as give each group's boundaries a prefix each on average, so a key meets the few
intervals of its own prefix, whatever the number of boundaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import leading, ring_percent
from ..model import EEXIST

#: Intervals, cut by prefix, broadcast at most; beyond that the join on prefix and group is shuffled.
BROADCAST_ROWS = 500_000
#: Digits of a prefix at most: 28 bits.
MOST_DIGITS = 7


def prefix_digits(count: int) -> int:
    """Hex digits that give so many boundaries a prefix each."""
    digits = 1
    while 16**digits < count and digits < MOST_DIGITS:
        digits += 1
    return digits


def prefix(hex_id, digits: int):
    return F.conv(F.rpad(F.substring(hex_id, 1, digits), digits, "0"), 16, 10).cast("int")


def intervals(routes: DataFrame) -> DataFrame:
    """Adds stop (exclusive; null: to the end of the ring) and the wrapped interval of each group's last route, from ''."""
    by = Window.partitionBy("group_id").orderBy("ring_id")
    rows = routes.withColumns({"start": F.col("ring_id"), "stop": F.lead("ring_id").over(by), "_low": F.min("ring_id").over(Window.partitionBy("group_id"))})
    wrapped = rows.filter("stop IS NULL").withColumns({"start": F.lit(""), "stop": F.col("_low")})
    return rows.union(wrapped.select(*rows.columns)).drop("_low")


def lookup(keys: DataFrame, routes: DataFrame, digits: int | None = None, how: str = "inner") -> DataFrame:
    """Each key with its owner in every group of ``routes``; with a group_id in ``keys``, in that group only.

    ``digits`` of the prefix come from the boundaries' count unless given.  With
    how="left" keys of groups without routes stay, with nulls.
    """
    sizes = routes.groupBy("group_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("groups")).first()
    digits = digits or prefix_digits(sizes["most"] or 1)
    spans = intervals(routes)
    upto = F.coalesce(prefix(F.col("stop"), digits), F.lit(16**digits - 1))
    spans = spans.withColumn("_prefix", F.explode(F.sequence(prefix(F.col("start"), digits), upto))).withColumnRenamed("group_id", "_group")
    if (sizes["all"] or 0) + sizes["groups"] * 16**digits <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    own = keys.withColumn("_own_prefix", prefix(F.col("id"), digits))
    same = (F.col("_own_prefix") == F.col("_prefix")) & (F.col("id") >= F.col("start")) & (F.col("stop").isNull() | (F.col("id") < F.col("stop")))
    if "group_id" in keys.columns:
        return own.join(spans, same & (F.col("group_id") == F.col("_group")), how).drop("_prefix", "_own_prefix", "_group", "start", "stop")
    return own.join(spans, same, how).withColumnRenamed("_group", "group_id").drop("_prefix", "_own_prefix", "start", "stop")


def with_bounds(routes: DataFrame, digits: int = 64) -> DataFrame:
    """A route list closed by the smallest and the largest id, both owned by each group's last route."""
    last = routes.groupBy("group_id").agg(F.max_by(F.struct("address", "backend_id"), "ring_id").alias("o")).select("group_id", "o.*")
    ends = last.withColumn("ring_id", F.explode(F.array(F.lit("0" * digits), F.lit("f" * digits))))
    return routes.select("group_id", "ring_id", "address", "backend_id").unionByName(ends.select("group_id", "ring_id", "address", "backend_id"))


def unique(routes: DataFrame) -> DataFrame:
    """The first route of each (address, group, backend)."""
    return routes.groupBy("address", "group_id", "backend_id").agg(F.min("ring_id").alias("ring_id"))


def islands(routes: DataFrame, digits: int = 64) -> DataFrame:
    """Ranges of each group in which one (address, backend) owns everything: neighbours coalesce, the last ends at the largest id."""
    by = Window.partitionBy("group_id").orderBy("ring_id")
    owner = F.struct("address", "backend_id")
    rows = with_bounds(routes, digits).withColumn("stop", F.lead("ring_id").over(by)).filter("stop IS NOT NULL")
    rows = rows.withColumn("new", F.when(F.lag(owner).over(by).eqNullSafe(owner), F.lit(0)).otherwise(F.lit(1)))
    rows = rows.withColumn("island", F.sum("new").over(by))
    return rows.groupBy("group_id", "island", "address", "backend_id").agg(F.min("ring_id").alias("start"), F.max("stop").alias("stop")).drop("island")


def inverse(owned: DataFrame, keys: list[str], digits: int = 64) -> DataFrame:
    """The gaps between the (start, stop) ranges of each owner, within the smallest and the largest id."""
    by = Window.partitionBy(*keys).orderBy("start")
    gaps = owned.select(*keys, F.coalesce(F.lag("stop").over(by), F.lit("0" * digits)).alias("gap_start"), F.col("start").alias("gap_stop"))
    tail = owned.groupBy(*keys).agg(F.max("stop").alias("gap_start")).withColumn("gap_stop", F.lit("f" * digits))
    return gaps.unionByName(tail).filter("gap_start < gap_stop")


def common_ranges(routes: DataFrame, digits: int = 64) -> DataFrame:
    """Elementary ranges (id to stop, exclusive) between all groups' boundaries, each with its owner in every group.

    The first range begins at the smallest id, the last has no end (null).  The
    boundaries of a ring are ordered in one pass: a few for each backend.
    """
    starts = routes.select(F.col("ring_id").alias("id")).union(routes.sparkSession.createDataFrame([("0" * digits,)], "id string")).distinct()
    return lookup(starts.withColumn("until", F.lead("id").over(Window.partitionBy(F.lit(0)).orderBy("id"))), routes).withColumnRenamed("until", "stop")


def shares(routes: DataFrame, digits: int = 64) -> DataFrame:
    """(group_id, address, backend_id, width, percent, address_percent): how much of its group's ring each owner and each address has, by the leading 15 digits."""
    by = Window.partitionBy("group_id").orderBy("ring_id")
    rows = with_bounds(routes, digits).withColumn("stop", F.lead("ring_id").over(by)).filter("stop IS NOT NULL")
    width = leading(F.col("stop")) - leading(F.col("ring_id"))
    rows = rows.groupBy("group_id", "address", "backend_id").agg(F.sum(width).alias("width"))
    whole = F.sum("width").over(Window.partitionBy("group_id", "address"))
    return rows.withColumns({"percent": ring_percent(F.col("width")), "address_percent": ring_percent(whole)})


def upsert(routes: DataFrame, change: DataFrame) -> DataFrame:
    """Replace the boundaries of the (group, address, backend) in ``change``; a boundary that its group has already is not taken twice."""
    left = routes.join(change.select("group_id", "address", "backend_id").distinct(), ["group_id", "address", "backend_id"], "left_anti")
    fresh = change.join(left.select("group_id", "ring_id"), ["group_id", "ring_id"], "left_anti").select(*left.columns).dropDuplicates(["group_id", "ring_id"])
    return left.unionByName(fresh)


def upsert_status(routes: DataFrame, change: DataFrame) -> DataFrame:
    """(group_id, address, backend_id, status) of each backend in ``change``: an error if other backends have all of its boundaries already."""
    left = routes.join(change.select("group_id", "address", "backend_id").distinct(), ["group_id", "address", "backend_id"], "left_anti")
    rows = change.join(left.select("group_id", "ring_id", F.lit(True).alias("taken")), ["group_id", "ring_id"], "left")
    return rows.groupBy("group_id", "address", "backend_id").agg(F.when(F.every(F.col("taken").isNotNull()), F.lit(-EEXIST)).otherwise(F.lit(0)).alias("status"))


def of_address(routes: DataFrame, address: str) -> DataFrame:
    """An address's routes, of each backend the first by boundary."""
    rows = routes.filter(F.col("address") == address)
    return rows.groupBy("backend_id").agg(F.min_by(F.struct("group_id", "ring_id"), F.struct("ring_id", "group_id")).alias("r")).select("backend_id", "r.*")


def groups_of(routes: DataFrame, address: str) -> DataFrame:
    return routes.filter(F.col("address") == address).select("group_id").distinct()


def backends_of(routes: DataFrame, address: str) -> DataFrame:
    return routes.filter(F.col("address") == address).select("backend_id").distinct()


def of_backend(routes: DataFrame, address: str, backend_id: int) -> DataFrame:
    """All routes of a backend."""
    return routes.filter((F.col("address") == address) & (F.col("backend_id") == backend_id))


def first_of_backend(routes: DataFrame, address: str, backend_id: int) -> DataFrame:
    """(group_id, ring_id) of a backend's first route by boundary: its group, and an id that it owns."""
    return of_backend(routes, address, backend_id).agg(F.min(F.struct("ring_id", "group_id")).alias("r")).filter("r IS NOT NULL").select("r.group_id", "r.ring_id")
