"""Streams against their batch twins, and files against tables."""

import pytest
from pyspark.sql import functions as F

from orbitkeep.operators import stats, writes
from orbitkeep.sources import fixtures, records
from orbitkeep.streaming import expiry, hotkeys, notify


@pytest.fixture(scope="module")
def log_dir(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "access")
    fixtures.access(spark, sf_dir).orderBy("sec", "event_id").coalesce(1).write.parquet(path)
    return path


def _run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def _stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_notifications(spark, log_dir):
    log = spark.read.parquet(log_dir)
    watches = log.select("id").distinct().limit(4).withColumn("watcher", F.lit("w"))
    watches = spark.createDataFrame(watches.collect(), watches.schema)
    got = _run(spark, notify.notifications(_stream(spark, log_dir), watches), "told", "append")
    assert sorted(got.collect()) == sorted(notify.notifications(log, watches).collect())


def test_hot_keys_equal_batch(spark, log_dir):
    log = spark.read.parquet(log_dir)
    got = _run(spark, hotkeys.hot_keys(_stream(spark, log_dir), 864000), "hot", "update")
    want = stats.decayed(log.filter("cmd = 'READ' AND status = 0 AND size > 0"), 864000)
    key = lambda r: (r.group_id, r.id, r.weight, round(r.frequency, 6), r.last)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_expiry(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = spark.createDataFrame([("a", 1, 100, 10), ("b", 2, 100, 0)], "id string, event_id long, sec long, ttl long")
    rows.coalesce(1).write.parquet(path)
    spark.createDataFrame([("c", 3, 1000, 0)], rows.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r.id, r.event) for r in _run(spark, expiry.cache_events(stream), "gone", "update").collect()}
    assert {("a", "written"), ("b", "written"), ("c", "written")} <= got
    assert ("b", "expired") not in got


def test_expiry_keeps_the_newest_write(spark, tmp_path):
    """Batches out of order: an older write does not replace a newer one, and what outlived its time goes."""
    path = str(tmp_path / "w")
    schema = "id string, event_id long, sec long, ttl long"
    batches = [[("a", 2, 200, 1000), ("b", 1, 150, 20)], [("a", 1, 190, 5), ("b", 3, 160, 100)], [("c", 4, 400, 0)], [("c", 5, 410, 0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = [(r.id, r.event, r.until) for r in _run(spark, expiry.cache_events(stream, "100 seconds"), "newest", "update").collect()]
    assert [x for x in got if x[0] == "a"] == [("a", "written", 1200), ("a", "written", 1200)]
    assert ("b", "expired", 260) in got and ("c", "expired") not in {x[:2] for x in got}
    every = spark.read.schema(schema).parquet(path)
    assert {r.id for r in writes.unexpired(every, 410, F.col("ttl")).collect()} == {"a", "c"}


def test_stalls_equal_batch(spark, log_dir):
    late = F.when(F.col("event_id") % 3 == 0, 0).otherwise(-110)
    got = _run(spark, expiry.stalls(_stream(spark, log_dir).withColumn("status", late)), "stalled", "append")
    want = expiry.stalls_of(spark.read.parquet(log_dir).withColumn("status", late))
    assert sorted(got.collect()) == sorted(want.collect()) and want.count()


def test_windows_and_sessions(spark, log_dir):
    log = spark.read.parquet(log_dir)
    counts = _run(spark, expiry.windowed_counts(_stream(spark, log_dir), "1 hour", "1 hour"), "counted", "complete")
    assert counts.agg(F.sum("n")).first()[0] == log.count()
    assert expiry.sessions(log, "1 hour", "1 hour").agg(F.sum("n")).first()[0] == log.count()


def test_record_files(spark, sf_dir, tmp_path):
    rows = fixtures.replicas(spark, sf_dir).select("group_id", (F.col("k") % 2).cast("int").alias("backend_id"), "id", "ts_sec", "size", "record_flags", F.col("id").cast("binary").alias("data"))
    path = str(tmp_path / "records")
    records.write_records(rows, path, 4)
    back = records.read_records(spark, path)
    assert "data" not in back.columns and back.count() == rows.count()
    assert sorted(back.select("group_id", "id").collect()) == sorted(rows.select("group_id", "id").collect())
    assert "PushedFilters: [IsNotNull(id)" in back.filter("id > 'a' AND group_id = 1")._jdf.queryExecution().toString()
    records.compact(spark, path, str(tmp_path / "less"), 2)
    assert records.read_records(spark, str(tmp_path / "less")).count() == rows.count()


def test_key_dump_and_objects(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    records.dump_keys(ids, str(tmp_path / "keys"))
    assert sorted(r.id for r in records.read_keys(spark, str(tmp_path / "keys")).collect()) == ["a", "b"]
    (tmp_path / "object.bin").write_bytes(b"12345")
    objects = records.objects_from_files(spark, str(tmp_path / "object.bin"))
    assert objects.first()["size"] == 5
    records.objects_to_files(objects.unionByName(objects.selectExpr("name", "ts_sec - 1 ts_sec", "size", "CAST('old' AS BINARY) data")), str(tmp_path / "out"))
    assert [(p.name, p.read_bytes()) for p in (tmp_path / "out").iterdir()] == [("object.bin", b"12345")]
