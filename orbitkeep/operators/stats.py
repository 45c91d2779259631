"""Statistics of access logs: counters, hot keys in a decaying window, histograms, reports."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import EINVAL, Category, StoreError
from .folds import folded_rows

#: Upper bounds of latency (microseconds) and size (bytes) buckets; a value equal to a bound is within it.
LATENCY, SIZE = (500, 5000, 100000), (100, 500, 1000)


def _bucket(column: str, bounds: tuple[int, ...]):
    out = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        out = F.when(F.col(column) <= bounds[i], F.lit(i)).otherwise(out)
    return out


def counted_size():
    """A failed read has no size."""
    return F.when((F.col("cmd") == "READ") & (F.col("status") < 0), F.lit(0)).otherwise(F.col("size"))


def command_counters(access: DataFrame, by: tuple[str, ...] = ("cmd",)) -> DataFrame:
    """Successes, failures, size and time by command, cache or disk, outside or internal."""
    place = F.when(F.col("in_cache"), "cache").otherwise("disk")
    origin = F.when(F.col("trans") != 0, "outside").otherwise("internal")
    cmd = F.coalesce("cmd", F.lit("UNKNOWN"))
    return access.withColumn("cmd", cmd).groupBy(*by, place.alias("place"), origin.alias("origin")).agg(F.count_if(F.col("status") == 0).alias("successes"), F.count_if(F.col("status") != 0).alias("failures"), F.sum(counted_size()).cast("long").alias("size"), F.sum("time_us").alias("time_us"))


def client_counters(access: DataFrame) -> DataFrame:
    return access.groupBy("client", "cmd").agg(F.count_if(F.col("status") == 0).alias("successes"), F.count_if(F.col("status") != 0).alias("failures"))


def command_totals(access: DataFrame) -> DataFrame:
    """Counts per command, and over all of them (cmd null)."""
    return access.rollup("cmd").agg(F.count_if(F.col("status") == 0).alias("successes"), F.count_if(F.col("status") != 0).alias("failures"))


def decayed(reads: DataFrame, window: int, keys: tuple[str, ...] = ("group_id", "id")) -> DataFrame:
    """(keys, weight, frequency, last) of each key's reads played in order of (sec, event_id).

    With each read the sum so far is scaled by max(0, 1 - gap / window), cut to
    a whole number, and the read's size (for the frequency: 1.0) is added.
    """
    reads = reads.withColumn("at", F.col("sec"))

    def step(state: tuple, sec: int, size: int) -> tuple:
        weight, frequency, last = state
        keep = 0.0 if last is None else max(0.0, 1.0 - (sec - last) / float(window))
        return math.floor(weight * keep) + size, frequency * keep + 1.0, sec

    return folded_rows(reads, keys, ("sec", "event_id"), ("at", "size"), (0, 0.0, None), step, lambda s: s, "weight long, frequency double, last long")


def top_keys(access: DataFrame, k: int, window: int, now: int | None = None, capacity: int | None = None) -> DataFrame:
    """The k keys with the largest decayed size of reads.

    Keys that are idle at ``now`` for longer than the window are out.  With a
    ``capacity`` only so many keys of a group are remembered, those read last
    (of equal ones the lower id).
    """
    reads = access.filter("cmd = 'READ' AND status = 0 AND size > 0")
    if capacity is not None:
        # from the latest read of each key, so that what is forgotten is not folded
        latest = reads.groupBy("group_id", "id").agg(F.max(F.struct("sec", "event_id")).alias("latest"))
        place = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("latest"), "id"))
        reads = reads.join(latest.withColumn("place", place).filter(F.col("place") <= capacity).select("group_id", "id"), ["group_id", "id"], "left_semi")
    rows = decayed(reads, window)
    if now is not None:
        rows = rows.filter(F.lit(now) - F.col("last") <= window)
    return rows.orderBy(F.desc("weight"), "group_id", "id").limit(k)


def histogram(access: DataFrame, seconds: int = 1) -> DataFrame:
    """Counts per time slot, latency bucket and size bucket."""
    slot = F.col("sec") - F.pmod("sec", F.lit(seconds))
    return access.groupBy(slot.alias("slot"), _bucket("time_us", LATENCY).alias("x"), _bucket("size", SIZE).alias("y")).agg(F.count("*").alias("n"))


def report(access: DataFrame) -> DataFrame:
    """(group_id, backend_id, report): the counters of each backend's commands as one JSON document, without commands that were never used."""
    own = command_counters(access, ("group_id", "backend_id", "cmd"))
    entry = F.struct("cmd", "place", "origin", "successes", "failures", "size", "time_us")
    return own.groupBy("group_id", "backend_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("report"))


def storage_and_proxy(access: DataFrame) -> DataFrame:
    """Counts per command, apart for requests that came from clients (storage) and that went on to other nodes (proxy: internal ones)."""
    of = {"storage": F.col("trans") != 0, "proxy": F.col("trans") == 0}
    ended = {"successes": F.col("status") == 0, "failures": F.col("status") != 0}
    return access.groupBy("cmd").agg(*[F.count_if(a & b).alias(f"{place}_{name}") for place, a in of.items() for name, b in ended.items()])


def backend_totals(records: DataFrame, categories: int = -1) -> DataFrame:
    """Of each group, as far as the categories ask: objects and bytes (IO), removed and uncommitted records (BACKEND)."""
    flag = lambda bit: F.count_if(F.col("record_flags").bitwiseAND(bit) != 0)
    parts = {Category.IO: [F.count("*").alias("objects"), F.sum("size").alias("bytes")], Category.BACKEND: [flag(1).alias("removing"), flag(128).alias("uncommitted")]}
    asked = [c for bit, columns in parts.items() if categories & bit for c in columns]
    return records.groupBy("group_id").agg(*asked) if asked else records.select("group_id").distinct()


def page_sizes(records: DataFrame, shard, pages: int) -> DataFrame:
    """(shard, objects, size, removing, sizes): totals of each cache shard, and the bytes of each of its pages in order, pages by the last digits of ids."""
    page = F.pmod(F.conv(F.substring("id", -8, 8), 16, 10).cast("long"), F.lit(pages))
    rows = records.groupBy(shard.alias("shard"), page.alias("page")).agg(F.count("*").alias("objects"), F.sum("size").alias("size"), F.count_if(F.col("record_flags").bitwiseAND(1) != 0).alias("removing"))
    sizes = F.map_from_entries(F.collect_list(F.struct("page", "size")))
    rows = rows.groupBy("shard").agg(*[F.sum(c).alias(c) for c in ("objects", "size", "removing")], sizes.alias("sizes"))
    return rows.withColumn("sizes", F.transform(F.sequence(F.lit(0), F.lit(pages - 1)), lambda p: F.coalesce(F.try_element_at("sizes", p.cast("long")), F.lit(0))))


#: Parts of a report by category: functions of (access, records) that return (group_id, name, value).
PROVIDERS: dict[Category, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def provider(category: Category):
    """Register a part of reports; a part that is registered again is replaced."""

    def put(f):
        PROVIDERS[category] = f
        return f

    return put


@provider(Category.COMMANDS)
def _commands(access: DataFrame, records: DataFrame) -> DataFrame:
    rows = access.groupBy("group_id", F.coalesce("cmd", F.lit("UNKNOWN")).alias("cmd")).agg(F.count_if(F.col("status") == 0).alias("successes"), F.count_if(F.col("status") != 0).alias("failures"))
    each = F.explode(F.array(*[F.struct(F.concat("cmd", F.lit(f".{c}")).alias("name"), F.col(c).alias("value")) for c in ("successes", "failures")])).alias("x")
    return rows.select("group_id", each).select("group_id", "x.*")


def _totals(category: Category, columns: tuple[str, ...]):
    def run(access: DataFrame, records: DataFrame) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns])).alias("x")
        return backend_totals(records, category).select("group_id", each).select("group_id", "x.*")

    return run


provider(Category.IO)(_totals(Category.IO, ("objects", "bytes")))
provider(Category.BACKEND)(_totals(Category.BACKEND, ("removing", "uncommitted")))


def document(access: DataFrame, records: DataFrame, categories: int = -1, at: int = 0) -> DataFrame:
    """(group_id, report): one JSON document a group with the time ``at`` and an entry for each asked category that has a provider."""
    parts = [f(access, records).select("group_id", F.lit(c.name.lower()).alias("category"), "name", "value") for c, f in sorted(PROVIDERS.items()) if categories & c]
    if not parts:
        raise StoreError(EINVAL, f"no part of a report in the categories {categories:#x}")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    entry = F.array_sort(F.collect_list(F.struct("category", "name", "value")))
    return rows.groupBy("group_id").agg(F.to_json(F.struct(F.lit(at).alias("timestamp"), entry.alias("values"))).alias("report"))


def durations(milestones: DataFrame, by: str = "user_id", keys: tuple[str, ...] = ("sec", "event_id")) -> DataFrame:
    """Seconds between an entity's consecutive milestones; null at the first."""
    w = Window.partitionBy(by).orderBy(*keys)
    return milestones.withColumn("took", F.col("sec") - F.lag("sec").over(w))


def recovery_counters(outcomes: DataFrame) -> DataFrame:
    """(name, success, failure, total) of counted outcomes; negative counts are failures."""
    n = F.col("n")
    return outcomes.groupBy("name").agg(F.sum(F.when(n > 0, n).otherwise(0)).alias("success"), F.sum(F.when(n < 0, -n).otherwise(0)).alias("failure"), F.sum(F.abs(n)).alias("total"))
