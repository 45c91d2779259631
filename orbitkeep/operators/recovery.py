"""Recovery: which replicas differ or are misplaced, and which actions repair them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import EBADFD, EILSEQ, ENOENT, ENXIO, ETIMEDOUT, uncommitted

@dataclass(frozen=True)
class Options:
    """What a recovery run takes into account.

    prepare_before: uncommitted writes older than this may be removed.
    user_flags: only keys with a replica of one of these; empty: all keys.
    since: only replicas written at that time or later.
    no_meta: times and user flags of committed replicas are unknown, all are 0.
    address, backend_id: only keys that this node (this backend of it) owns in some group; null: all.
    dry_run: find out what to do, and do nothing.
    safe: do not remove anything.
    """

    groups: tuple[int, ...] = (1, 2, 3)
    prepare_before: int = 0
    user_flags: tuple[int, ...] = ()
    chunk_size: int = 1 << 20
    server_send: bool = True
    since: int = 0
    no_meta: bool = False
    address: str | None = None
    backend_id: int | None = None
    dry_run: bool = False
    safe: bool = False


def selected(records: DataFrame, options: Options, owners: DataFrame | None = None) -> DataFrame:
    """The replicas that a run looks at; ``owners`` (id, address, backend_id), which a run for one node needs, has a row for each group."""
    rows = records.filter(F.col("group_id").isin(list(options.groups)) & (F.col("ts_sec") >= options.since))
    if options.no_meta:
        rows = rows.withColumns({c: F.when(uncommitted(), F.col(c)).otherwise(F.lit(0).cast("long")) for c in ("ts_sec", "user_flags")})
    if options.address is not None:
        own = (F.col("address") == options.address) & (F.lit(options.backend_id is None) | (F.col("backend_id") == F.lit(options.backend_id)))
        rows = rows.join(owners.filter(own).select("id").distinct(), "id", "left_semi")
    return rows


def applied(plan: DataFrame, options: Options) -> DataFrame:
    """What of (id, action, ...) is done: with safe no removal, with dry_run nothing."""
    rows = plan.filter(F.col("action") != "skip")
    if options.dry_run:
        return rows.limit(0)
    return rows.filter(F.col("action") != "remove") if options.safe else rows


def custom(keys: DataFrame, recover: Callable[[DataFrame, Options], DataFrame], options: Options) -> DataFrame:
    """Recovery by a function of your own, which gets keys with infos and returns (id, action, src_group, dst_groups) of those that it recovers."""
    out = recover(keys, options)
    if missing := {"id", "action", "src_group", "dst_groups"} - set(out.columns):
        raise ValueError(f"a recovery function has to return {sorted(missing)} too")
    return out.select("id", "action", "src_group", "dst_groups")


def from_dump(records: DataFrame, dump: DataFrame) -> DataFrame:
    """(id, infos, status) of the keys in a dump, each once, whatever it holds more; a key that no group has is an error with empty infos."""
    wanted = dump.select("id").distinct()
    found = infos(records.join(wanted, "id", "left_semi"))
    rows = wanted.join(found, "id", "left")
    return rows.select("id", F.coalesce("infos", F.array().cast(found.schema["infos"].dataType)).alias("infos"), F.when(F.col("infos").isNull(), F.lit(-ENOENT)).otherwise(F.lit(0)).alias("status"))


def infos(records: DataFrame) -> DataFrame:
    """(id, infos): the replicas of each key, newest and largest first, then by group."""
    info = F.struct((-F.col("ts_sec")).alias("t"), (-F.col("size")).alias("z"), "group_id", "ts_sec", "size", "user_flags", "record_flags")
    own = F.transform(F.array_sort(F.collect_list(info)), lambda x: F.struct(x["group_id"].alias("group_id"), x["ts_sec"].alias("ts_sec"), x["size"].alias("size"), x["user_flags"].alias("user_flags"), x["record_flags"].alias("record_flags")))
    return records.groupBy("id").agg(own.alias("infos"))


def _open(x):
    return x["record_flags"].bitwiseAND(128) != 0


def _same(x, y):
    return (x["ts_sec"] == y["ts_sec"]) & (x["size"] == y["size"]) & (x["user_flags"] == y["user_flags"])


def skipped(options: Options):
    """True for keys that need nothing: no replica has the wanted user flags, or all groups hold the same committed version."""
    first = F.get("infos", F.lit(0))
    same = (F.size("infos") == len(options.groups)) & F.forall("infos", lambda x: ~_open(x) & _same(x, first))
    if not options.user_flags:
        return same
    return ~F.exists("infos", lambda x: x["user_flags"].isin(*options.user_flags)) | same


def with_groups(keys: DataFrame, options: Options) -> DataFrame:
    """Adds newest (replicas equal to the first), missed (groups without one) and different groups, each in order."""
    first = F.get("infos", F.lit(0))
    version = lambda x: (x["ts_sec"] == first["ts_sec"]) & (x["size"] == first["size"])
    groups = F.array(*[F.lit(g) for g in options.groups])
    ids = lambda xs: F.array_sort(F.transform(xs, lambda x: x["group_id"]))
    return keys.withColumns({
        "newest": F.filter("infos", version),
        "missed": F.array_except(groups, ids(F.col("infos"))),
        "different": ids(F.filter("infos", lambda x: ~version(x))),
    })


def actions(keys: DataFrame, options: Options) -> DataFrame:
    """(id, action, src_group, dst_groups) for every key with infos.

    skip: nothing to do, or an open write that may still be committed; remove:
    the newest replicas are all open and too old, the key goes everywhere; copy:
    from a committed newest replica to the groups that miss it or differ, open
    newest ones counted among those.
    """
    rows = with_groups(keys, options)
    all_open = F.forall("newest", _open)
    stale = F.get("newest", F.lit(0))["ts_sec"] < options.prepare_before
    some_open = F.array_sort(F.transform(F.filter("newest", _open), lambda x: x["group_id"]))
    source = F.get(F.filter("newest", lambda x: ~_open(x)), F.lit(0))["group_id"]
    to = F.array_sort(F.array_distinct(F.concat("missed", "different", some_open)))
    holders = F.array_sort(F.transform("infos", lambda x: x["group_id"]))
    action = F.when(skipped(options), "skip").when(all_open & stale, "remove").when(all_open, "skip").when(F.size(to) > 0, "copy").otherwise("skip")
    return rows.select("id", action.alias("action"), source.alias("source"), to.alias("to"), holders.alias("holders")).select(
        "id", "action", F.when(F.col("action") == "copy", F.col("source")).alias("src_group"),
        F.when(F.col("action") == "copy", F.col("to")).when(F.col("action") == "remove", F.col("holders")).otherwise(F.array().cast("array<int>")).alias("dst_groups"),
    )


def newest_counts(keys: DataFrame, options: Options) -> DataFrame:
    """(group_id, n): in how many keys a group holds a newest version."""
    return with_groups(keys, options).select(F.explode("newest").alias("x")).groupBy("x.group_id").agg(F.count("*").alias("n"))


def buckets(keys: DataFrame, options: Options) -> DataFrame:
    """(id, bucket): the group that a key is sent from: of those with a newest version the one with most of them; -1 where keys are sent one by one.

    Counts are one row a group.
    """
    counts = newest_counts(keys, options)
    rows = with_groups(keys, options)
    each = rows.select("id", F.explode("newest").alias("x")).select("id", "x.group_id", "x.size").join(F.broadcast(counts), "group_id")
    best = each.groupBy("id").agg(F.max_by("group_id", F.struct("n", -F.col("group_id"))).alias("group_id"), F.max("size").alias("size"))
    stale = F.forall("newest", _open) & (F.get("newest", F.lit(0))["ts_sec"] < options.prepare_before)
    rest = F.lit(not options.server_send) | (F.col("size") > options.chunk_size) | F.col("stale")
    return rows.select("id", stale.alias("stale")).join(best, "id").select("id", F.when(rest, F.lit(-1)).otherwise(F.col("group_id")).alias("bucket"))


def send_rounds(keys: DataFrame, failures: DataFrame, options: Options) -> DataFrame:
    """(id, round, src_group, status, outcome) of sending keys group by group.

    A key fails in a round if ``failures`` (id, group_id, status) has its source,
    and goes on to the next newest holder.  After a timeout, or where the source
    is out of reach, it goes on only if that one has the same user flags too: a
    worse replica does not stand in for one that is there.  A source that turns
    out corrupt is removed, unless the run is safe.  outcome: sent, next (tried again
    from the next holder), removed (the same, without the source) or failed (nobody is left).
    """
    holders = F.filter("newest", lambda x: ~_open(x))
    turns = with_groups(keys, options).filter(~skipped(options)).select("id", F.posexplode(holders).alias("round", "x")).select("id", "round", F.col("x.group_id").alias("src_group"), F.col("x.user_flags").alias("flags"))
    after = F.lead("flags").over(Window.partitionBy("id").orderBy("round"))
    tried = turns.withColumn("after", after).join(failures.select("id", F.col("group_id").alias("src_group"), "status").distinct(), ["id", "src_group"], "left").withColumn("status", F.coalesce("status", F.lit(0)))
    away = F.col("status").isin(-ETIMEDOUT, -ENXIO)
    ends = (F.col("status") == 0) | F.col("after").isNull() | (away & (F.col("after") != F.col("flags")))
    last = F.min(F.when(ends, F.col("round"))).over(Window.partitionBy("id"))
    outcome = F.when(F.col("status") == 0, "sent").when((F.col("status") == -EILSEQ) & ~F.lit(options.safe), "removed").when(ends, "failed").otherwise("next")
    return tried.withColumns({"last": last, "outcome": outcome}).filter("round <= last").select("id", "round", "src_group", "status", "outcome")


def merge_send(sent: DataFrame) -> DataFrame:
    """(id, group_id, holder_n, action) after moving keys from every backend that should not have them to their owner.

    ``sent`` has the status of each move.  moved: it went well; gone: the key
    was not there; removed: an older or a corrupt version, which goes; rest: any
    other error, so the key is left for recovery one by one.
    """
    status = F.col("status")
    action = F.when(status == 0, "moved").when(status == -ENOENT, "gone").when(status.isin(-EBADFD, -EILSEQ), "removed").otherwise("rest")
    return sent.select("id", "group_id", "holder_n", action.alias("action"))


def unrecovered(asked: DataFrame, sent: DataFrame) -> DataFrame:
    """Keys (id, group_id) that are not recovered by moves: nobody answered for them, or an answer is an error that leaves a valid version where it was."""
    done = merge_send(sent).groupBy("id", "group_id").agg(F.max(F.col("action") == "rest").alias("rest"))
    return asked.select("id", "group_id").distinct().join(done, ["id", "group_id"], "left").filter("coalesce(rest, true)").select("id", "group_id")


def merge_actions(held: DataFrame, options: Options) -> DataFrame:
    """(id, group_id, holder_n, owner_n, action) for records held elsewhere than at their owner.

    ``held`` has id, group_id, holder_n, owner_n, ts_sec, record_flags, and
    owner_ts (null: the owner has none).  remove: open, or the owner's is
    strictly newer; keep: already at the owner; else move.
    """
    action = F.when(F.col("holder_n") == F.col("owner_n"), "keep").when(F.col("record_flags").bitwiseAND(128) != 0, "remove").when(F.col("owner_ts") > F.col("ts_sec"), "remove").otherwise("move")
    return held.select("id", "group_id", "holder_n", "owner_n", action.alias("action"))


def newest_place(held: DataFrame) -> DataFrame:
    """(id, group_id, best_n, at_owner): of several holders in a group the newest, then largest, then the owner itself; others are to be removed."""
    best = F.max_by(F.struct("holder_n", "owner_n"), F.struct("ts_sec", "size", F.col("holder_n") == F.col("owner_n"), -F.col("holder_n")))
    return held.groupBy("id", "group_id").agg(best.alias("b")).select("id", "group_id", F.col("b.holder_n").alias("best_n"), (F.col("b.holder_n") == F.col("b.owner_n")).alias("at_owner"))


def since(text: str, now: int) -> int:
    """Seconds since the epoch of "2w 1d 3h 30m" before now."""
    units = {"w": 604800, "d": 86400, "h": 3600, "m": 60}
    return now - sum(int(part[:-1]) * units[part[-1]] for part in text.split())
