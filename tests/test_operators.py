"""Worked cases of single operators."""

import itertools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from orbitkeep.functions import keys
from orbitkeep.model import EINVAL, ENOTSUP, ENXIO, ERANGE, StoreError
from orbitkeep.operators import reads, recovery, replies, routes, scan, stats, transfer, writes
from orbitkeep.plans import registry
from orbitkeep.session import Session

RECORD = "id string, group_id int, ts_sec long, size long, user_flags long, record_flags long"


def test_latest_and_quorum(spark):
    rows = spark.createDataFrame([("a", 1, 10, 5, 0, 0), ("a", 2, 10, 5, 0, 0), ("a", 3, 15, 5, 0, 0), ("b", 1, 10, 5, 0, 0), ("b", 2, 15, 5, 0, 0)], RECORD)
    assert {(r.id, r.group_id) for r in reads.latest(rows).collect()} == {("a", 3), ("b", 2)}
    ids = rows.select("id").union(spark.createDataFrame([("none",)], "id string"))
    found = {(r.id, r.group_id, r.status) for r in reads.quorum(rows, ids, (1, 2, 3)).collect()}
    assert found == {("a", 1, 0), ("a", 2, 0), ("b", 2, 0), ("b", 3, -2), *(("none", g, -2) for g in (1, 2, 3))}


@pytest.fixture
def duck_of():
    def made(folder):
        con = duckdb.connect()
        for table in folder.glob("*.parquet"):
            con.sql(f"create view {table.stem} as select * from '{table}/*.parquet'")
        for sql in ("events AS SELECT 1 event_id, 1 user_id, TIMESTAMP '2020-01-01' ts, 'view' event_type, 1.0 AS value", "documents AS SELECT 1 doc_id, '' AS text"):
            con.sql(f"create view {sql}")
        return con

    return made


def _exchanges(df) -> int:
    """Shuffles in the plan of a query whose joins are planned as on large tables."""
    conf, key = df.sparkSession.conf, "spark.sql.autoBroadcastJoinThreshold"
    old = conf.get(key)
    conf.set(key, "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        conf.set(key, old)


def test_reads_meet_in_one_shuffle(spark, sf_dir):
    for name in ("read_attempts", "lookup_first", "read_repair_actions", "quorum_lookup"):
        assert _exchanges(registry.QUERIES[name](spark, sf_dir)) == 1, name


def test_writes_and_sends_meet_in_one_shuffle(spark, sf_dir):
    for name in ("write_cas_groups", "server_send_status", "server_send_checksum", "server_send_copy"):
        assert _exchanges(registry.QUERIES[name](spark, sf_dir)) == 1, name


def test_replies_meet_before_they_are_many(spark, sf_dir):
    """Keys and what replicas are made of meet by k; then one shuffle by id, and aggregates that need no sorting."""
    for name in ("check_all", "check_quorum", "first_valid", "prepare_latest_rank", "remove_on_fail"):
        rows = registry.QUERIES[name](spark, sf_dir)
        assert _exchanges(rows) == 3, name
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "hashpartitioning(k" in plan and "hashpartitioning(k#0L, group_id" not in plan
    assert not re.search(r"hashpartitioning\(id#\d+, group_id", registry.QUERIES["merge_actions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString())


def test_fixtures_with_a_key_twice_and_a_null_key(spark, duck_of, tmp_path):
    """Orders that share a key, or have none, give the rows that the SQL gives."""
    spark.sql("SELECT k o_orderkey, TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_dt_interval(CAST(i AS INT)) o_orderdate, IF(i % 2 = 0, '1-URGENT', '2-HIGH') o_orderpriority FROM (SELECT id i, IF(id % 10 = 0, NULL, id div 2) k FROM range(60))").write.parquet(str(tmp_path / "orders.parquet"))
    con = duck_of(tmp_path)
    for name in ("filter_all_with_ack", "merge_actions", "merge_newest", "check_all", "remove_on_fail", "first_valid"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        columns = sorted(got.columns)
        want = con.sql(registry.ORACLE_SQL[name]).select(*[f'"{c}"' for c in columns]).fetchall()
        if name == "first_valid":  # which of two equal first replies is told is open
            got, want = got.select("id", "group_id"), [(r[columns.index("id")], r[columns.index("group_id")]) for r in want]
            columns = ["id", "group_id"]
        assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want)), name


def test_errors_that_arrive_at_once(spark):
    rows = spark.createDataFrame([("a", g, s, True, 0, 0, True, t) for g, s, t in ((1, -84, -5), (2, -110, -5), (3, -2, 7))] + [("b", 1, 5, True, 0, 0, True, 2**62), ("b", 2, -6, True, 0, 0, False, -(2**62))], "id string, group_id int, status int, is_final boolean, data_size long, ts_sec long, is_reply boolean, arrival long")
    for r in (rows, rows.withColumn("arrival", F.timestamp_seconds(F.col("arrival") % 1000))):
        assert {x.id: x.error for x in replies.outcome(r, "all").collect()} == {"a": -110, "b": 5}


def test_sends_of_odd_rows(spark):
    """Keys without an id meet nothing; of several records with one id each is sent, and each target record counts."""
    source = spark.createDataFrame([("a", 1, 10, 5, 0, 0), ("a", 1, 12, 5, 0, 0), ("b", 1, 10, 5, 0, 128), (None, 1, 10, 5, 0, 0)], RECORD)
    target = spark.createDataFrame([("a", 2, 11, 7, 0, 0), ("b", 2, 1, 7, 0, 0), (None, 2, 99, 7, 0, 0), ("c", 2, 1, 7, 0, 0), ("a", 9, 1, 7, 0, 0)], RECORD)
    done = sorted((str(r.id), r.group_id, r.status) for r in transfer.outcomes(source, target, (2, 3)).collect())
    assert done == [("None", 2, 0), ("None", 3, 0), ("a", 2, -77), ("a", 2, 0), ("a", 3, 0), ("a", 3, 0), ("b", 2, -6), ("b", 3, -6)]
    after = sorted((str(r.id), r.group_id, r.ts_sec) for r in transfer.copied(target, source, (2, 3)).collect())
    assert after == [("None", 2, 99), *[("a", 2, t) for t in (10, 12)], *[("a", 3, t) for t in (10, 10, 12, 12)], ("a", 9, 1), ("b", 2, 1), ("c", 2, 1)]


def test_reads_of_odd_rows(spark):
    """Several replicas in a group are told apart, ids that are null have none, groups that nobody asks do not count."""
    rows = spark.createDataFrame([("a", 1, 10, 5, 0, 0), ("a", 1, 11, 6, 0, 0), ("a", 9, 10, 5, 0, 0), (None, 1, 10, 5, 0, 0), ("b", 2, 10, 5, 0, 0)], RECORD)
    ids = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "id string")
    bad = spark.createDataFrame([("a", 2, -84), ("b", 1, -84), (None, 1, -110)], "id string, group_id int, status int")
    told = sorted((str(r.id), r.prio, r.group_id, r.status, r.ts_sec or 0) for r in reads.lookup(rows, ids, (2, 1), bad).collect())
    assert told == [("None", 0, 2, -2, 0), ("None", 1, 1, -2, 0), ("a", 0, 2, -84, 0), ("a", 1, 1, 0, 10), ("a", 1, 1, 0, 11), ("b", 0, 2, 0, 10)]
    assert sorted(map(tuple, reads.repairs(rows, ids, (2, 1), bad).collect())) == [("a", 1, 2), ("a", 1, 2)]
    found = sorted((str(r.id), r.group_id, r.status, r.ts_sec or 0) for r in reads.quorum(rows, ids, (1, 2)).collect())
    assert found == [("None", 1, -2, 0), ("None", 2, -2, 0), ("a", 1, 0, 11), ("a", 2, -2, 0), ("b", 1, -2, 0), ("b", 2, 0, 10)]


def test_quorum_is_of_the_groups_asked(spark):
    rows = spark.createDataFrame([("a", 1, 10, 5, 0, 0), ("a", 2, 10, 5, 0, 0), ("a", 3, 15, 5, 0, 0)], RECORD)
    chosen = lambda groups: {r.group_id for r in reads.quorum(rows, rows, groups).filter("status = 0").collect()}
    assert chosen((1, 2, 3)) == {1, 2}
    assert chosen((1, 2, 3, 4, 5)) == {3}  # two of five are no quorum: the newest


def test_empty_requests_are_errors(spark):
    rows = spark.createDataFrame([("a", 1, 10, 5, 0, 0)], RECORD)
    with pytest.raises(StoreError) as e:
        reads.bulk_read(rows, rows.limit(0), (1,))
    assert e.value.errno == EINVAL
    with pytest.raises(StoreError) as e:
        writes.bulk(spark.range(2).withColumnRenamed("id", "n"), spark.range(1).selectExpr("id n", "'x' data"), (1,))
    assert e.value.errno == EINVAL
    with pytest.raises(StoreError) as e:
        transfer.copy_scan(rows, 1, ())
    assert e.value.errno == ENXIO
    with pytest.raises(StoreError):
        stats.document(rows, rows, 1 << 20)


def test_sessions(spark):
    first = Session(groups=(2, 1), namespace="ns")
    names = spark.createDataFrame([("x", 10, 3), ("y", 10, 4)], "name string, ts_sec long, size long")
    store = spark.createDataFrame([], RECORD)
    store = first.write(store, names.withColumns({"user_flags": F.lit(0).cast("long"), "record_flags": F.lit(0).cast("long")}))
    assert store.count() == 4 and {r.group_id for r in first.read(store, names).collect()} == {2}
    assert first.with_(namespace="other").read(store, names).count() == 0
    later = first.with_(groups=(1,), timestamp=20).write(store, names.filter("name = 'x'").selectExpr("name", "ts_sec", "9L size", "0L user_flags", "0L record_flags"))
    assert {(r.group_id, r.ts_sec, r["size"]) for r in first.read_latest(later, names).collect()} == {(1, 20, 9), (1, 10, 4)}
    assert {(r.group_id, r.status) for r in first.quorum_lookup(later, names.limit(1)).collect()} == {(1, 0)}
    left = first.with_(groups=(2,)).remove(later, names)
    assert {(r.prio, r.group_id, r.status) for r in first.lookup(left, names).collect()} == {(0, 2, -2), (1, 1, 0)}
    outcomes, after = first.with_(groups=(3,)).send(left, 1, flags=16)
    assert {r.status for r in outcomes.collect()} == {0} and {r.group_id for r in after.collect()} == {3}
    answers = spark.createDataFrame([("a", -2, True, 0, True, 1)], "id string, status int, is_final boolean, data_size long, is_reply boolean, arrival int")
    assert first.shown(answers).count() == 0 and first.with_(accept="all").shown(answers).count() == 1
    assert not first.outcome(answers).first().ok and first.with_(checker=lambda s, n: n == 1).outcome(answers).first().ok
    with pytest.raises(StoreError) as e:
        first.with_(raises=True).outcome(answers)
    assert e.value.errno == 2


def test_custom_recovery(spark):
    rows = recovery.infos(spark.createDataFrame([("a", 1, 10, 5, 0, 0), ("a", 2, 20, 5, 0, 0)], RECORD))
    own = lambda k, o: k.selectExpr("id", "'copy' action", "infos[0].group_id src_group", "array(9) dst_groups", "1 more")
    assert recovery.custom(rows, own, recovery.Options()).collect() == [("a", "copy", 2, [9])]
    with pytest.raises(ValueError, match="dst_groups"):
        recovery.custom(rows, lambda k, o: own(k, o).drop("dst_groups"), recovery.Options())
    plan = recovery.actions(rows, recovery.Options())
    assert recovery.applied(plan, recovery.Options()).count() == 1
    assert recovery.applied(plan, recovery.Options(dry_run=True)).count() == 0
    assert {r.ts_sec for r in recovery.selected(spark.createDataFrame([("a", 1, 10, 5, 0, 0), ("b", 1, 10, 5, 0, 128)], RECORD), recovery.Options(no_meta=True)).collect()} == {0, 10}


def test_many_places_and_long_rings(spark, monkeypatch):
    monkeypatch.setattr(replies, "PLACES", 7)
    places = spark.range(50).selectExpr("id place")
    assert replies.with_each(spark.range(9), places).distinct().count() == 450
    ring = [(g, f"{g * 7919 + i * 104729:08x}", f"a{i}", i % 3) for g in (1, 2) for i in range(300)]
    ids = [f"{i * 9999991 % (1 << 32):08x}" for i in range(400)]
    found = routes.lookup(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(ring, "group_id int, ring_id string, address string, backend_id int"))
    got = {(r.id, r.group_id): r.address for r in found.collect()}
    for i in ids:
        for g in (1, 2):
            own = sorted((b, a) for h, b, a, _ in ring if h == g)
            assert got[i, g] == max([x for x in own if x[0] <= i] or own)[1]
    assert len(got) == 800 and routes.prefix_digits(300) == 3


def test_places_in_a_partition_of_the_store(spark):
    rows = spark.range(500).selectExpr("CAST(id % 3 AS INT) group_id", "substring(sha2(CAST(CAST(id AS STRING) AS BINARY), 256), 1, 8) id")
    got = scan.placed(rows, digits=1).collect()
    for g in range(3):
        own = sorted(r for r in got if r.group_id == g)
        assert [r.place for r in sorted(own, key=lambda r: r.id)] == list(range(1, len(own) + 1)) and {r.total for r in own} == {len(own)}


def test_uncommitted_is_invisible(spark):
    rows = spark.createDataFrame([("a", 1, 20, 5, 0, 128), ("a", 2, 10, 5, 0, 0)], RECORD)
    assert [r.group_id for r in reads.latest(rows).collect()] == [2]


@pytest.mark.parametrize(("start", "num"), [(0, 255), (3, 14), (7, 3)])
def test_range_page(spark, start, num):
    ids = [("13" * 5 + f"{i:02x}" + "13" * 26, 1) for i in range(16)]
    rows = spark.createDataFrame(ids, "id string, group_id int")
    got = sorted(r.id for r in scan.page(rows, "0" * 64, "f" * 64, start, num).collect())
    assert got == sorted(x for x, _ in ids)[start : start + num]


def test_scan_errors():
    with pytest.raises(StoreError) as e:
        scan.in_ranges([("2", "1")])
    assert e.value.errno == ERANGE
    with pytest.raises(StoreError):
        scan.in_time(2, 1)
    with pytest.raises(StoreError) as e:
        scan.check_flags(1 << 20)
    assert e.value.errno == ENOTSUP


def test_inverted_and_zero_ranges(spark):
    rows = spark.createDataFrame([("00", 1, 0, 1, 0, 0), ("ff", 1, 5, 1, 0, 0)], RECORD)
    assert scan.scan(rows, ranges=[("0" * 4, "0" * 4)]).count() == 2
    assert scan.scan(rows, time=(1, 9)).count() == 1


def test_route_wraps(spark):
    ring = spark.createDataFrame([(1, "40", "x", 0), (1, "80", "y", 1)], "group_id int, ring_id string, address string, backend_id int")
    ids = spark.createDataFrame([("00",), ("40",), ("7f",), ("80",), ("ff",)], "id string")
    assert {r.id: r.address for r in routes.lookup(ids, ring).collect()} == {"00": "y", "40": "x", "7f": "x", "80": "y", "ff": "y"}
    assert routes.lookup(ids.withColumn("group_id", F.lit(7)), ring, how="left").filter("address IS NULL").count() == 5


def test_prepare_commit_matrix(spark):
    logs = {}
    for p, c in itertools.product(("", "p"), ("", "c")):
        logs[p + c + "!"] = [("prepare", p), ("plain", "0"), ("plain", "1"), ("plain", "2"), ("commit", c)]
    rows = [(k, i, op, data) for k, log in logs.items() for i, (op, data) in enumerate(log)]
    got = {r.id: (r.data, r.visible) for r in writes.folded(spark.createDataFrame(rows, "id string, seq int, op string, data string")).collect()}
    assert got == {k: (log[0][1] + "012" + log[-1][1], True) for k, log in logs.items()}


def test_overlaid_writes(spark):
    rows = spark.createDataFrame([([(0, "55555"), (1, "43210")],)], "parts array<struct<offset:int,data:string>>")
    whole = rows.select(writes.overlaid(F.col("parts")).alias("x"))
    assert whole.first().x == "543210"
    assert whole.select(reads.slice_of(F.col("x"), F.lit(3), F.lit(0)).alias("a"), reads.slice_of(F.col("x"), F.lit(2), F.lit(1)).alias("b")).first() == ("210", "3")


def test_keyed_digest(spark):
    import hmac

    rows = spark.createDataFrame([(b"abc",), (b"",), (None,)], "data binary")
    for secret in (b"k", b"", b"long" * 60):
        for bits in (256, 512):
            got = [r.d for r in rows.select(keys.keyed_digest(F.col("data"), secret, bits).alias("d")).collect()]
            assert got == [*(hmac.new(secret, x, f"sha{bits}").hexdigest() for x in (b"abc", b"")), None]


def test_checkers(spark):
    rows = spark.createDataFrame([("a", g, s, True, 1, 0, True, g) for g, s in ((1, 0), (2, -2), (3, 0))] + [("b", 1, -6, True, 0, 0, False, 1), ("b", 2, -2, True, 0, 0, True, 2), ("c", 1, -6, True, 0, 0, True, 2), ("c", 2, -2, True, 0, 0, True, 3)], "id string, group_id int, status int, is_final boolean, data_size long, ts_sec long, is_reply boolean, arrival int")
    ok = lambda c: {r.id: (r.ok, r.error) for r in replies.outcome(rows, c).collect()}
    assert ok("quorum") == {"a": (True, 0), "b": (False, -2), "c": (False, -6)}
    assert ok("all")["a"] == (False, -6)
    assert ok("no_check")["b"] == (True, 0)
    assert {(r.id, r.group_id) for r in replies.remove_on_fail(rows, "all").collect()} == {("a", 1), ("a", 3)}


# -- recovery: all combinations of absent, prepared and written, old, current and new
OLD, CUR, NEW = 100, 200, 300
VARIANTS = [None, *itertools.product((False, True), (OLD, CUR, NEW))]


def _expected(case, limit):
    have = {g: x for g, x in enumerate(case, 1) if x}
    newest = max(ts for _, ts in have.values())
    top = {g for g, (_, ts) in have.items() if ts == newest}
    committed = sorted(g for g in top if have[g][0])
    if not committed:
        return ("remove", None, sorted(have)) if newest < limit else ("skip", None, [])
    others = sorted(set(range(1, len(case) + 1)) - set(committed))
    return ("copy", committed[0], others) if others else ("skip", None, [])


@pytest.mark.parametrize("groups", [2, 3])
def test_recovery_matrix(spark, groups):
    cases = {f"{i:03d}": c for i, c in enumerate(itertools.product(VARIANTS, repeat=groups)) if any(c)}
    rows = [(k, g, x[1], 10, 0, 0 if x[0] else 128) for k, c in cases.items() for g, x in enumerate(c, 1) if x]
    options = recovery.Options(groups=tuple(range(1, groups + 1)), prepare_before=250)
    got = {r.id: (r.action, r.src_group, list(r.dst_groups)) for r in recovery.actions(recovery.infos(spark.createDataFrame(rows, RECORD)), options).collect()}
    assert got == {k: _expected(c, 250) for k, c in cases.items()}


def test_user_flags_choose_keys(spark):
    rows = [(k, g, 10 + (g == 2), 5, f, 0) for k, flags in (("a", (0, 1, 0)), ("b", (0, 2, 0)), ("c", (1, 1, 0))) for g, f in enumerate(flags, 1)]
    keys_ = recovery.infos(spark.createDataFrame(rows, RECORD))
    assert {r.id for r in keys_.filter(~recovery.skipped(recovery.Options(user_flags=(2,)))).collect()} == {"b"}


# -- hot keys
def _fold(events, window):
    weight, freq, last = 0, 0.0, None
    for sec, size in events:
        keep = 0.0 if last is None else max(0.0, 1 - (sec - last) / window)
        weight, freq, last = int(weight * keep) + size, freq * keep + 1, sec
    return weight, freq


@pytest.mark.parametrize("events", [[(0, 100)], [(0, 100), (0, 100)], [(0, 100), (150, 100), (300, 50)], [(0, 100), (299, 1)], [(0, 100), (301, 1)], [(i * 7, i) for i in range(1, 40)]])
def test_decayed(spark, events):
    rows = spark.createDataFrame([(1, "a", i, t, s) for i, (t, s) in enumerate(events)], "group_id int, id string, event_id int, sec long, size long")
    r = stats.decayed(rows, 300).first()
    assert (r.weight, pytest.approx(r.frequency)) == _fold(events, 300)


def test_top_keys_limit_and_idle(spark):
    rows = spark.createDataFrame([(1, f"k{i}", i, 1000 if i else 0, 10 + i, "READ", 0) for i in range(9)], "group_id int, id string, event_id int, sec long, size long, cmd string, status int")
    assert [r.id for r in stats.top_keys(rows, 3, 300, now=1100).collect()] == ["k8", "k7", "k6"]
    assert "k0" not in {r.id for r in stats.top_keys(rows, 50, 300, now=1100).collect()}


def test_fold_keeps_keys_whole_after_an_adaptive_join(spark):
    """The join with the remembered keys is planned as a shuffled one and turns out to be small, as on large logs."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 400000, 1, 8).selectExpr("CAST(id % 1 + 1 AS INT) group_id", "CAST(id % 20 AS STRING) id", "id event_id", "id sec", "1L size", "'READ' cmd", "0 status")
        got = stats.top_keys(rows, 50, 10**9, capacity=9).collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(r.id for r in got) == [str(i) for i in range(11, 20)] and all(abs(r.frequency - 20000) < 10 for r in got)


def test_histogram_bounds_are_inclusive(spark):
    rows = spark.createDataFrame([(0, 500, 100), (0, 501, 101), (0, 100001, 1001)], "sec long, time_us long, size long")
    assert {(r.x, r.y) for r in stats.histogram(rows).collect()} == {(0, 0), (1, 1), (3, 3)}


def test_since():
    assert recovery.since("1w 2d 3h 4m", 10**9) == 10**9 - (7 + 2) * 86400 - 3 * 3600 - 240
