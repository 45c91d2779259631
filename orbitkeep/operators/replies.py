"""Result algebra: which replies are shown, when a request succeeded, what failed."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ENXIO

#: Places of a request (groups, nodes, backends) in one broadcast row at most.
PLACES = 10_000

_ok = lambda: F.col("status") == 0
_ack = lambda: F.col("data_size") == 0
_final = lambda: F.col("is_final")

FILTERS = {
    "positive": lambda: _ok() & ~_ack(),
    "positive_with_ack": _ok,
    "positive_final": lambda: _final() & _ok(),
    "negative": lambda: ~_ok(),
    "negative_with_ack": lambda: ~_ok() | _ack(),
    "negative_final": lambda: _final() & ~_ok(),
    "all": lambda: ~_ok() | ~_ack(),
    "all_with_ack": lambda: F.lit(True),
    "all_final": _final,
}

#: On (successes, total) of a request's final replies.
CHECKERS = {
    "no_check": lambda s, n: F.lit(True),
    "at_least_one": lambda s, n: s > 0,
    "all": lambda s, n: s == n,
    "quorum": lambda s, n: s > F.floor(n / 2),
}


def shown(replies: DataFrame, accept: str | Column = "positive") -> DataFrame:
    """Replies that a filter accepts: one of FILTERS, or a condition of your own."""
    return replies.filter(FILTERS[accept]() if isinstance(accept, str) else accept)


def outcome(replies: DataFrame, checker="at_least_one", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, successes, total, ok, error) of each request, from its final replies only.

    ``checker`` is one of CHECKERS, or a function of the columns successes and
    total.  error is 0 where the check holds; else the first real error to
    arrive if nothing succeeded, else "no such device or address".  That error
    is not a real one if it is no reply (is_reply) but tells that nothing could
    be sent.
    """
    final = replies.filter("is_final").groupBy(*keys).agg(F.count_if(_ok()).alias("successes"), F.count("*").alias("total"), _first_error(replies).alias("first_error"))
    ok = _checked(checker)
    error = F.when(ok, F.lit(0)).when((F.col("successes") == 0) & F.col("first_error").isNotNull(), F.col("first_error")).otherwise(F.lit(-ENXIO))
    return final.select(*keys, "successes", "total", ok.alias("ok"), error.alias("error"))


def _checked(checker) -> Column:
    return (CHECKERS[checker] if isinstance(checker, str) else checker)(F.col("successes"), F.col("total"))


def _first_error(replies: DataFrame) -> Column:
    """The status of the first real error to arrive; of several at once the lowest.

    Whole numbers of arrival and the status make one number, so that Spark
    aggregates in place: it sorts the rows of a task for the least struct.
    """
    real = (F.col("status") != 0) & ~(~F.col("is_reply") & (F.col("status") == -ENXIO))
    if not isinstance(replies.schema["arrival"].dataType, T.IntegralType):
        return F.min_by("status", F.when(real, F.struct("arrival", "status")))
    span, half = F.lit(Decimal(2**32)), F.lit(Decimal(2**31))
    least = F.min(F.when(real, F.col("arrival").cast("decimal(20,0)") * span + F.col("status").cast("decimal(10,0)") + half))
    return (F.pmod(least, span) - half).cast(replies.schema["status"].dataType)


def remove_on_fail(replies: DataFrame, checker: str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Compensation: of requests whose check failed, the groups that had succeeded and are to be removed again."""
    good = F.collect_set(F.when(_ok(), F.col("group_id"))).alias("_good")
    final = replies.filter("is_final").repartition(*keys).groupBy(*keys).agg(F.count_if(_ok()).alias("successes"), F.count("*").alias("total"), good)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return final.filter(~_checked(checker) & known).select(*keys, F.explode("_good").alias("group_id"))


def aggregated(replies: DataFrame, requests: DataFrame, checker="at_least_one", key: str = "request", sub: str = "part") -> DataFrame:
    """(key, total, ok, error) of requests that were sent as several ones (sub).

    ok if any reply of any part is good; else error is that of the last part
    that failed, and "no such device or address" where there are no parts.
    ``requests`` has a row for each key.
    """
    parts = outcome(replies, checker, (key, sub)).groupBy(key).agg(F.sum("total").alias("total"), F.max_by("error", F.when(F.col("error") != 0, F.col(sub))).alias("last"))
    good = replies.groupBy(key).agg(F.max(_ok() & _final()).alias("good"))
    rows = requests.select(key).distinct().join(parts, key, "left").join(good, key, "left")
    error = F.when(F.col("total").isNull(), F.lit(-ENXIO)).when(F.col("good"), F.lit(0)).otherwise(F.coalesce("last", F.lit(0)))
    return rows.select(key, F.coalesce("total", F.lit(0)).alias("total"), (error == 0).alias("ok"), error.alias("error"))


def first_valid(replies: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The first reply with status 0 and a body, by group."""
    return replies.filter(FILTERS["positive"]()).groupBy(*keys).agg(F.min("group_id").alias("_least"), *[F.min_by(c, "group_id").alias(c) for c in ("data_size", "ts_sec")]).select(*keys, F.col("_least").alias("group_id"), "data_size", "ts_sec")


def with_each(requests: DataFrame, places: DataFrame) -> DataFrame:
    """Each request with each of the places.

    Counted places within the bound travel as one broadcast row; more of them as
    several rows, each met once by every request.
    """
    blocks = max(1, -(-places.count() // PLACES))
    at = F.struct(*places.columns)
    packed = places.select(F.pmod(F.xxhash64(at), F.lit(blocks)).cast("int").alias("_block"), at.alias("_at")).groupBy("_block").agg(F.collect_list("_at").alias("_places"))
    rows = requests.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.join(F.broadcast(packed) if blocks == 1 else packed, "_block")
    return rows.select(*requests.columns, F.explode("_places").alias("_at")).select(*requests.columns, "_at.*")


def fan_out(requests: DataFrame, routes: DataFrame, level: str = "group") -> DataFrame:
    """A request for each group, node or backend of a route table."""
    columns = {"group": ["group_id"], "node": ["address"], "backend": ["group_id", "address", "backend_id"]}[level]
    return with_each(requests, routes.select(*columns).distinct())
