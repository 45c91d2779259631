"""Name → query, and name → the same query in SQL.

Queries apply the operators to tables derived from the test data
(``sources.fixtures``) and return flat columns: integers as long, arrays joined
by commas.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as K
from ..operators import containers, control, reads, recovery, replies, routes, scan, stats, tags, transfer, weights, writes
from ..sources import fixtures as fx
from ..sources import records
from ..streaming import expiry, notify

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir), with the SQL that follows the fixture tables."""

    def put(f):
        own = name or f.__name__
        QUERIES[own] = lambda spark, sf_dir: flat(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[own] = fx.SQL + sql
        return f

    return put


# -- keys and routes ----------------------------------------------------------
@query("SELECT k, sha256(CAST(k AS VARCHAR)) AS id FROM keys")
def key_transform(s, d):
    return fx.keys(s, d).select("k", K.transform(F.col("k").cast("string"), bits=256).alias("id"))


@query("SELECT k, sha256('tenant' || chr(0) || CAST(k AS VARCHAR)) AS id FROM keys")
def key_transform_ns(s, d):
    return fx.keys(s, d).select("k", K.transform(F.col("k").cast("string"), "tenant", 256).alias("id"))


@query("SELECT k, rpad(to_hex(k), 64, '0') AS id, lpad(lower(to_hex(k)), 64, '0') AS bound FROM (SELECT k FROM keys) t".replace("rpad(to_hex(k)", "rpad(lower(to_hex(k))"))
def hex_id_pad(s, d):
    text = F.hex("k")
    return fx.keys(s, d).select("k", K.parse_id(text, 64).alias("id"), K.parse_bound(text, 64).alias("bound"))


_PAD = {mask: "".join(f"\\x{x ^ mask:02X}" for x in b"secret".ljust(64, b"\0")) for mask in (0x36, 0x5C)}


@query(f"SELECT k, sha256('{_PAD[0x5C]}'::BLOB || unhex(sha256('{_PAD[0x36]}'::BLOB || encode(CAST(k AS VARCHAR))))) AS digest FROM keys")
def keyed_digest(s, d):
    return fx.keys(s, d).select("k", K.keyed_digest(F.col("k").cast("string"), b"secret", 256).alias("digest"))


def _bytes_backwards(start: int) -> str:
    return "CAST('0x' || " + " || ".join(f"substr(id, {start + i}, 2)" for i in range(14, -1, -2)) + " AS UBIGINT)"


_SHARD = f"CAST(xor({_bytes_backwards(1)}, {_bytes_backwards(49)}) % {{n}} AS BIGINT)"


@query(f"SELECT k, {_SHARD.format(n=16)} AS shard, {_SHARD.format(n=7)} AS odd_shard FROM keys")
def cache_shard(s, d):
    return fx.keys(s, d).select("k", K.shard(F.col("id"), 16).alias("shard"), K.shard(F.col("id"), 7).alias("odd_shard"))


@query("SELECT a.sec AS a_sec, b.sec AS b_sec, a.event_id, (a.sec, a.event_id) < (b.sec, b.event_id) AS earlier FROM access a JOIN access b ON b.event_id = a.event_id + 1")
def time_compare(s, d):
    a = fx.access(s, d).select("event_id", F.col("sec").alias("a_sec"))
    b = fx.access(s, d).select((F.col("event_id") - 1).alias("event_id"), F.col("sec").alias("b_sec"))
    return a.join(b, "event_id").select("a_sec", "b_sec", "event_id", K.time_before(F.col("a_sec"), F.col("event_id"), F.col("b_sec"), F.col("event_id") + 1).alias("earlier"))


@query("SELECT k, group_id, ring_id, address, CAST(backend_id AS BIGINT) AS backend_id FROM owners")
def route_all_groups(s, d):
    return routes.lookup(fx.keys(s, d), fx.routes(s)).select("k", "group_id", "ring_id", "address", "backend_id")


@query("SELECT r.k, r.group_id, o.address, CAST(o.backend_id AS BIGINT) AS backend_id, CASE WHEN o.address IS NULL THEN -6 ELSE 0 END AS status FROM (SELECT k, id, CASE WHEN k % 10 = 0 THEN 9 ELSE group_id END AS group_id FROM replicas) r LEFT JOIN owners o ON r.k = o.k AND r.group_id = o.group_id")
def route_lookup(s, d):
    asked = fx.replicas(s, d).select("k", "id", F.when(F.col("k") % 10 == 0, F.lit(9)).otherwise(F.col("group_id")).alias("group_id"))
    return routes.lookup(asked, fx.routes(s), how="left").select("k", "group_id", "address", "backend_id", F.when(F.col("address").isNull(), -6).otherwise(0).alias("status"))


@query("SELECT CAST(group_id AS BIGINT) AS group_id, CASE WHEN wrap THEN '' ELSE ring_id END AS start, CASE WHEN wrap THEN low ELSE stop END AS stop, CAST(n AS BIGINT) AS n FROM spans, (SELECT unnest([false, true]) AS wrap) WHERE NOT wrap OR stop IS NULL")
def route_interval(s, d):
    return routes.intervals(fx.routes(s)).select("group_id", "start", "stop", "n")


_BOUNDS = """, lasts AS (SELECT group_id, address, backend_id FROM spans WHERE stop IS NULL),
closed AS (SELECT group_id, ring_id, address, backend_id FROM routes
  UNION ALL SELECT group_id, repeat('0', 64), address, backend_id FROM lasts UNION ALL SELECT group_id, repeat('f', 64), address, backend_id FROM lasts),
steps AS (SELECT *, lead(ring_id) OVER w AS stop, CASE WHEN lag(address || '/' || backend_id) OVER w = address || '/' || backend_id THEN 0 ELSE 1 END AS new FROM closed WINDOW w AS (PARTITION BY group_id ORDER BY ring_id)),
marked AS (SELECT *, sum(new) OVER (PARTITION BY group_id ORDER BY ring_id) AS island FROM steps WHERE stop IS NOT NULL),
islands AS (SELECT group_id, address, backend_id, min(ring_id) AS start, max(stop) AS stop FROM marked GROUP BY group_id, island, address, backend_id)
"""


@query(_BOUNDS + "SELECT CAST(group_id AS BIGINT) AS group_id, ring_id, address, CAST(backend_id AS BIGINT) AS backend_id FROM closed")
def route_closed(s, d):
    return routes.with_bounds(fx.routes(s))


@query(_BOUNDS + "SELECT CAST(group_id AS BIGINT) AS group_id, address, CAST(backend_id AS BIGINT) AS backend_id, CAST(sum(CAST('0x' || substr(stop, 1, 15) AS BIGINT) - CAST('0x' || substr(ring_id, 1, 15) AS BIGINT)) AS BIGINT) AS width FROM steps WHERE stop IS NOT NULL GROUP BY ALL")
def route_widths(s, d):
    return routes.shares(fx.routes(s)).select("group_id", "address", "backend_id", "width")


@query(_BOUNDS + """, owned AS (SELECT group_id, address, backend_id, sum(CAST('0x' || substr(stop, 1, 15) AS BIGINT) - CAST('0x' || substr(ring_id, 1, 15) AS BIGINT)) AS width FROM steps WHERE stop IS NOT NULL GROUP BY ALL)
SELECT CAST(group_id AS BIGINT) AS group_id, address, CAST(backend_id AS BIGINT) AS backend_id, round(CAST(width AS DOUBLE) * 100 / 1152921504606846975, 9) AS percent, round(CAST(sum(width) OVER (PARTITION BY group_id, address) AS DOUBLE) * 100 / 1152921504606846975, 9) AS address_percent FROM owned""")
def route_percentages(s, d):
    rows = routes.shares(fx.routes(s))
    return rows.select("group_id", "address", "backend_id", F.round("percent", 9).alias("percent"), F.round("address_percent", 9).alias("address_percent"))


@query(_BOUNDS + "SELECT CAST(group_id AS BIGINT) AS group_id, address, CAST(backend_id AS BIGINT) AS backend_id, start, stop FROM islands")
def route_islands(s, d):
    return routes.islands(fx.routes(s)).select("group_id", "address", "backend_id", "start", "stop")


@query(_BOUNDS + """, gaps AS (
  SELECT group_id, address, backend_id, coalesce(lag(stop) OVER (PARTITION BY group_id, address, backend_id ORDER BY start), repeat('0', 64)) AS gap_start, start AS gap_stop FROM islands
  UNION ALL SELECT group_id, address, backend_id, max(stop), repeat('f', 64) FROM islands GROUP BY ALL)
SELECT CAST(group_id AS BIGINT) AS group_id, address, CAST(backend_id AS BIGINT) AS backend_id, gap_start, gap_stop FROM gaps WHERE gap_start < gap_stop""")
def route_inverse(s, d):
    return routes.inverse(routes.islands(fx.routes(s)), ["group_id", "address", "backend_id"])


@query("SELECT b.ring_id AS id, b.until AS stop, CAST(s.group_id AS BIGINT) AS group_id, s.address, CAST(s.backend_id AS BIGINT) AS backend_id FROM (SELECT *, lead(ring_id) OVER (ORDER BY ring_id) AS until FROM (SELECT DISTINCT ring_id FROM routes UNION SELECT repeat('0', 64))) b JOIN spans s ON (s.ring_id <= b.ring_id AND (s.stop IS NULL OR b.ring_id < s.stop)) OR (s.stop IS NULL AND b.ring_id < s.low)")
def route_common_ranges(s, d):
    return routes.common_ranges(fx.routes(s)).select("id", "stop", "group_id", "address", "backend_id")


@query("SELECT address, CAST(group_id AS BIGINT) AS group_id, CAST(backend_id AS BIGINT) AS backend_id, min(ring_id) AS ring_id FROM routes GROUP BY ALL")
def route_unique(s, d):
    return routes.unique(fx.routes(s))


@query("SELECT DISTINCT address, CAST(backend_id AS BIGINT) AS backend_id FROM routes WHERE group_id IN (1, 2)")
def route_distinct(s, d):
    return fx.routes(s).filter("group_id IN (1, 2)").select("address", "backend_id").distinct()


@query("SELECT CAST(group_id AS BIGINT) AS group_id, ring_id, CAST(n AS BIGINT) AS n FROM routes WHERE address = 'host2:1025:2'")
def route_by_address(s, d):
    return fx.routes(s).filter("address = 'host2:1025:2'").select("group_id", "ring_id", "n")


@query("SELECT CAST(backend_id AS BIGINT) AS backend_id, CAST(arg_min(group_id, ring_id) AS BIGINT) AS group_id, min(ring_id) AS ring_id FROM routes WHERE address = 'host2:1025:2' GROUP BY backend_id")
def route_of_address(s, d):
    return routes.of_address(fx.routes(s), "host2:1025:2")


@query("SELECT CAST(group_id AS BIGINT) AS group_id, ring_id FROM routes WHERE address = 'host2:1025:2' AND backend_id = 1")
def route_of_backend(s, d):
    return routes.of_backend(fx.routes(s), "host2:1025:2", 1).select("group_id", "ring_id")


@query("SELECT CAST(arg_min(group_id, ring_id) AS BIGINT) AS group_id, min(ring_id) AS ring_id FROM routes WHERE address = 'host2:1025:2' AND backend_id = 1")
def route_first_of_backend(s, d):
    return routes.first_of_backend(fx.routes(s), "host2:1025:2", 1)


@query("SELECT DISTINCT CAST(group_id AS BIGINT) AS group_id FROM routes WHERE address = 'host2:1025:2'")
def route_groups_of(s, d):
    return routes.groups_of(fx.routes(s), "host2:1025:2")


@query("SELECT DISTINCT CAST(backend_id AS BIGINT) AS backend_id FROM routes WHERE address = 'host2:1025:2'")
def route_backends_of(s, d):
    return routes.backends_of(fx.routes(s), "host2:1025:2")


def _change(s):
    """New boundaries for two backends; all of the second's are taken by others."""
    fresh = s.range(3).selectExpr("CAST(1 AS INT) group_id", "sha2(CAST(concat('new-', id) AS BINARY), 256) ring_id", "'host1:1025:2' address", "CAST(0 AS INT) backend_id")
    return fresh.union(fx.routes(s).filter("group_id = 2 AND n IN (0, 3)").selectExpr("group_id", "ring_id", "'host9:1025:2'", "CAST(1 AS INT)"))


@query("SELECT CAST(1 AS BIGINT) AS group_id, 'host1:1025:2' AS address, CAST(0 AS BIGINT) AS backend_id, CAST(0 AS BIGINT) AS status UNION ALL SELECT 2, 'host9:1025:2', 1, -17")
def route_upsert_status(s, d):
    return routes.upsert_status(fx.routes(s), _change(s))


@query("SELECT CAST(group_id AS BIGINT) AS group_id, ring_id, address, CAST(backend_id AS BIGINT) AS backend_id FROM routes WHERE NOT (group_id = 1 AND address = 'host1:1025:2' AND backend_id = 0) UNION ALL SELECT 1, sha256('new-' || n), 'host1:1025:2', 0 FROM range(3) t(n)")
def route_upsert(s, d):
    change = s.range(3).selectExpr("CAST(1 AS INT) group_id", "sha2(CAST(concat('new-', id) AS BINARY), 256) ring_id", "'host1:1025:2' address", "CAST(0 AS INT) backend_id")
    return routes.upsert(fx.routes(s).select("group_id", "ring_id", "address", "backend_id"), change)


# -- reads ----------------------------------------------------------------------
_ORDER = "CASE group_id WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END"


@query(f"SELECT id, arg_min(CAST(group_id AS BIGINT), {_ORDER}) AS group_id, arg_min(ts_sec, {_ORDER}) AS ts_sec, arg_min(size, {_ORDER}) AS size, arg_min(user_flags, {_ORDER}) AS user_flags FROM live GROUP BY id")
def read_first_group(s, d):
    return reads.first_group(fx.replicas(s, d), (2, 3, 1))


@query(f"SELECT id, arg_min(CAST(group_id AS BIGINT), {_ORDER}) AS group_id, arg_min(ts_sec, {_ORDER}) AS ts_sec, arg_min(size, {_ORDER}) AS size, arg_min(user_flags, {_ORDER}) AS user_flags FROM live GROUP BY id")
def bulk_read_fallback(s, d):
    return reads.bulk_read(fx.replicas(s, d), fx.keys(s, d), (2, 3, 1))


@query("SELECT doc_id, doc_id % 50 AS off, CASE WHEN doc_id % 50 > 0 AND doc_id % 50 >= length(text) THEN -7 ELSE 0 END AS status, sha256(substr(text, CAST(doc_id % 50 + 1 AS BIGINT), 40)) AS digest FROM documents")
def read_slice(s, d):
    rows = fx.table(s, d, "documents").select("doc_id", (F.col("doc_id") % 50).cast("int").alias("off"), "text")
    return rows.select("doc_id", "off", reads.slice_status(F.length("text"), F.col("off")).alias("status"), F.sha2(reads.slice_of(F.col("text"), F.col("off"), F.lit(40)), 256).alias("digest"))


_TRIES = f""", tries AS (
  SELECT a.id, a.group_id, {_ORDER.replace('group_id', 'a.group_id')} AS prio, CASE WHEN l.id IS NULL THEN -2 ELSE 0 END AS status
  FROM asked a LEFT JOIN live l ON l.id = a.id AND l.group_id = a.group_id),
firsts AS (SELECT *, min(CASE WHEN status = 0 THEN prio END) OVER (PARTITION BY id) AS first FROM tries),
done AS (SELECT id, CAST(prio AS BIGINT) AS prio, CAST(group_id AS BIGINT) AS group_id, CAST(status AS BIGINT) AS status FROM firsts WHERE first IS NULL OR prio <= first)
"""


@query(_TRIES + "SELECT * FROM done")
def read_attempts(s, d):
    return reads.attempts(fx.replicas(s, d), fx.keys(s, d), (2, 3, 1))


_FAILED = "CASE WHEN (a.k + a.group_id) % 7 = 0 THEN -110 WHEN (a.k + a.group_id) % 5 = 0 THEN -84 WHEN l.id IS NULL THEN -2 ELSE 0 END"


def _failures(s, d):
    """Groups that answer with an error: out of reach, or a corrupt replica."""
    rows = fx.keys(s, d).select("k", "id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("group_id"))
    return rows.selectExpr("id", "group_id", "CASE WHEN (k + group_id) % 7 = 0 THEN -110 WHEN (k + group_id) % 5 = 0 THEN -84 END status").filter("status IS NOT NULL")


@query(_TRIES.replace("CASE WHEN l.id IS NULL THEN -2 ELSE 0 END", _FAILED) + "SELECT b.id, g.group_id AS from_group, b.group_id AS to_group FROM done b JOIN done g ON g.id = b.id AND g.status = 0 JOIN keys k ON k.id = b.id JOIN live l ON l.id = g.id AND l.group_id = g.group_id WHERE b.status IN (-2, -77, -84) AND k.k % 3 <> 1 AND (k.k % 4 <> 0 OR l.size <= 8)")
def read_repair_actions(s, d):
    wanted = fx.keys(s, d).selectExpr("id", "IF(k % 3 = 1, 1, 0) offset", "IF(k % 4 = 0, 8, 0) size")
    return reads.repairs(fx.replicas(s, d), wanted, (2, 3, 1), _failures(s, d))


@query(_TRIES.replace("CASE WHEN l.id IS NULL THEN -2 ELSE 0 END", _FAILED).replace("l.group_id = a.group_id)", "l.group_id = a.group_id AND l.size > 0)") + "SELECT d.id, d.prio, d.group_id, d.status, l.ts_sec, l.size FROM done d LEFT JOIN live l ON l.id = d.id AND l.group_id = d.group_id AND l.size > 0")
def lookup_first(s, d):
    return reads.lookup(fx.replicas(s, d), fx.keys(s, d), (2, 3, 1), _failures(s, d))


@query("SELECT id, CAST(group_id AS BIGINT) AS group_id, ts_sec, size, user_flags FROM live QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts_sec DESC, group_id) = 1")
def read_latest(s, d):
    return reads.latest(fx.replicas(s, d))


@query("SELECT id, CAST(group_id AS BIGINT) AS group_id, CAST(status AS BIGINT) AS status, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN status <> 0 THEN 2 WHEN data_size = 0 THEN 1 ELSE 0 END, CASE WHEN status = 0 AND data_size > 0 THEN -ts_sec END NULLS FIRST, group_id, is_final) AS place FROM replies")
def prepare_latest_rank(s, d):
    return reads.latest_order(fx.replies(s, d)).select("id", "group_id", "status", "place")


@query(""", seen AS (SELECT * FROM five_groups WHERE NOT open), agreed AS (SELECT id, ts_sec FROM seen GROUP BY id, ts_sec HAVING count(*) >= 3), newest AS (SELECT id, max(ts_sec) AS ts_sec FROM seen GROUP BY id),
chosen AS (SELECT n.id, coalesce(a.ts_sec, n.ts_sec) AS ts_sec FROM newest n LEFT JOIN agreed a USING (id))
SELECT id, CAST(group_id AS BIGINT) AS group_id, CAST(0 AS BIGINT) AS status, ts_sec, size FROM seen SEMI JOIN chosen USING (id, ts_sec)
UNION ALL SELECT k.id, g.group_id, -2, NULL, NULL FROM keys k, (SELECT unnest([1, 2, 3, 4, 5]) AS group_id) g ANTI JOIN seen s ON s.id = k.id AND s.group_id = g.group_id""")
def quorum_lookup(s, d):
    return reads.quorum(fx.five_groups(s, d), fx.keys(s, d), (1, 2, 3, 4, 5))


@query("SELECT id, CAST(group_id AS BIGINT) AS group_id, ts_sec, size FROM live WHERE size > 0")
def parallel_lookup(s, d):
    return reads.present(fx.replicas(s, d)).select("id", "group_id", "ts_sec", "size")


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN repeat('0', 64) ELSE sha256(text) END AS digest, sha256(text) = CASE WHEN doc_id % 11 = 0 THEN sha256('x') ELSE sha256(text) END AS valid FROM documents")
def checksum_verify(s, d):
    rows = fx.table(s, d, "documents").select("doc_id", reads.checksum(F.col("text"), 256).alias("digest"), F.sha2("text", 256).alias("own"))
    return rows.select("doc_id", "digest", (F.col("own") == F.when(F.col("doc_id") % 11 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("own"))).alias("valid"))


def holders(s, d):
    """Keys with owner and holder by group; every ninth is held by its neighbour."""
    return _holder(routes.lookup(fx.keys(s, d), fx.routes(s)))


def _holder(owned: DataFrame) -> DataFrame:
    return owned.withColumnRenamed("n", "owner_n").withColumn("holder_n", F.when((F.col("k") * 5 + F.col("group_id")) % 9 == 0, (F.col("owner_n") + 1) % 8).otherwise(F.col("owner_n")))


@query("SELECT k, CAST(group_id AS BIGINT) AS group_id, CAST(owner_n AS BIGINT) AS owner_n, CAST(holder_n AS BIGINT) AS holder_n FROM holders WHERE owner_n <> holder_n")
def misplaced_keys(s, d):
    return reads.misplaced(holders(s, d)).select("k", "group_id", "owner_n", "holder_n")


# -- scans ------------------------------------------------------------------------
_LOW, _HIGH = "3" * 64, "9" * 64
_SHOWN = "CAST(group_id AS BIGINT) AS group_id, id, ts_sec, size, user_flags"
_COLUMNS = ["group_id", "id", "ts_sec", "size", "user_flags"]


@query(f"SELECT {_SHOWN} FROM replicas")
def iter_default(s, d):
    return scan.scan(fx.replicas(s, d), columns=_COLUMNS)


@query(f"SELECT {_SHOWN} FROM replicas WHERE id BETWEEN '{_LOW}' AND '{_HIGH}' OR id BETWEEN '{'c' * 64}' AND '{'d' * 64}'")
def iter_ranges(s, d):
    return scan.scan(fx.replicas(s, d), ranges=[(_LOW, _HIGH), ("c" * 64, "d" * 64)], columns=_COLUMNS)


@query(f"SELECT {_SHOWN} FROM replicas WHERE ts_sec BETWEEN 800000000 AND 1000000000")
def iter_time(s, d):
    return scan.scan(fx.replicas(s, d), time=(800000000, 1000000000), columns=_COLUMNS)


@query("SELECT CAST(group_id AS BIGINT) AS group_id, id, CASE WHEN record_flags = 128 THEN ts_sec ELSE 0 END AS ts_sec, size, CASE WHEN record_flags = 128 THEN user_flags ELSE 0 END AS user_flags FROM replicas")
def iter_no_meta(s, d):
    return scan.scan(fx.replicas(s, d), no_meta=True, columns=_COLUMNS)


@query(f"SELECT * FROM (SELECT CAST(group_id AS BIGINT) AS group_id, id, row_number() OVER (PARTITION BY group_id ORDER BY id) AS iterated_keys, count(*) OVER (PARTITION BY group_id) AS total_keys FROM replicas) WHERE id BETWEEN '{_LOW}' AND '{_HIGH}'")
def iter_progress(s, d):
    return scan.progress(fx.replicas(s, d).select("group_id", "id"), scan.in_ranges([(_LOW, _HIGH)]))


@query(f"SELECT * FROM (SELECT CAST(group_id AS BIGINT) AS group_id, id, row_number() OVER (PARTITION BY group_id ORDER BY id) AS place FROM replicas WHERE id BETWEEN '{_LOW}' AND '{_HIGH}') WHERE place > 7 AND place <= 21")
def range_page(s, d):
    return scan.page(fx.replicas(s, d).select("group_id", "id"), _LOW, _HIGH, 7, 14)


@query(f"SELECT CAST(group_id AS BIGINT) AS group_id, greatest(count(*) - 3, 0) AS n FROM replicas WHERE id BETWEEN '{_LOW}' AND '{_HIGH}' GROUP BY group_id")
def range_count(s, d):
    return scan.count_range(fx.replicas(s, d), _LOW, _HIGH, 3)


@query(f"SELECT CAST(group_id AS BIGINT) AS group_id, count(*) AS n FROM replicas WHERE id NOT BETWEEN '{_LOW}' AND '{_HIGH}' GROUP BY group_id")
def range_delete(s, d):
    return scan.delete_range(fx.replicas(s, d), _LOW, _HIGH).groupBy("group_id").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(group_id AS BIGINT) AS group_id, count(*) FILTER (id BETWEEN '{_LOW}' AND '{_HIGH}') AS removed, 0 AS removed_again FROM replicas GROUP BY group_id".replace("0 AS removed_again", "CAST(0 AS BIGINT) AS removed_again"))
def range_delete_counts(s, d):
    rows = fx.replicas(s, d)
    again = scan.removed_range(scan.delete_range(rows, _LOW, _HIGH), _LOW, _HIGH).withColumnRenamed("removed", "removed_again")
    return scan.removed_range(rows, _LOW, _HIGH).join(again, "group_id")


@query("SELECT k, CAST(group_id AS BIGINT) AS group_id, CASE WHEN k % 3 = 0 AND size + k % 5 * 20 >= 48 THEN size + k % 5 * 20 - 48 ELSE size + k % 5 * 20 END AS size FROM replicas")
def size_normalised(s, d):
    rows = fx.replicas(s, d).selectExpr("k", "group_id", "size + k % 5 * 20 size", "IF(k % 3 = 0, record_flags | 64, record_flags) record_flags")
    return records.normalised(rows).select("k", "group_id", "size")


# -- result algebra -----------------------------------------------------------------
_FILTER_SQL = {
    "positive": "status = 0 AND data_size > 0", "positive_with_ack": "status = 0", "positive_final": "is_final AND status = 0", "negative": "status <> 0", "negative_with_ack": "status <> 0 OR data_size = 0",
    "negative_final": "is_final AND status <> 0", "all": "status <> 0 OR data_size > 0", "all_with_ack": "true", "all_final": "is_final",
}
for _name, _sql in _FILTER_SQL.items():
    query(f"SELECT k, CAST(group_id AS BIGINT) AS group_id, CAST(status AS BIGINT) AS status, data_size, is_final FROM replies WHERE {_sql}", f"filter_{_name}")(lambda s, d, f=_name: replies.shown(fx.replies(s, d), f).select("k", "group_id", "status", "data_size", "is_final"))

_CHECK_SQL = {"no_check": "true", "at_least_one": "s > 0", "all": "s = n", "quorum": "s > n // 2"}
_OUTCOME = """, final AS (SELECT id, count(*) FILTER (status = 0) AS s, count(*) AS n, arg_min(status, arrival) FILTER (status <> 0 AND (is_reply OR status <> -6)) AS e FROM replies WHERE is_final GROUP BY id),
outcome AS (SELECT id, s AS successes, n AS total, CAST({check} AS BOOLEAN) AS ok, CAST(CASE WHEN {check} THEN 0 WHEN s = 0 AND e IS NOT NULL THEN e ELSE -6 END AS BIGINT) AS error FROM final)
"""
for _name, _sql in _CHECK_SQL.items():
    query(_OUTCOME.format(check=_sql) + "SELECT * FROM outcome", f"check_{_name}")(lambda s, d, c=_name: replies.outcome(fx.replies(s, d), c))


@query(_OUTCOME.format(check="s = n") + "SELECT DISTINCT r.id, CAST(r.group_id AS BIGINT) AS group_id FROM replies r JOIN outcome o ON r.id = o.id AND NOT o.ok WHERE r.is_final AND r.status = 0")
def remove_on_fail(s, d):
    return replies.remove_on_fail(fx.replies(s, d), "all")


@query("SELECT id, CAST(min(group_id) AS BIGINT) AS group_id, arg_min(data_size, group_id) AS data_size, arg_min(ts_sec, group_id) AS ts_sec FROM replies WHERE status = 0 AND data_size > 0 GROUP BY id")
def first_valid(s, d):
    return replies.first_valid(fx.replies(s, d))


@query("SELECT k, address, CAST(r.backend_id AS BIGINT) AS backend_id, CAST(group_id AS BIGINT) AS group_id FROM keys, (SELECT DISTINCT group_id, address, backend_id FROM routes) r")
def fan_out_backends(s, d):
    return replies.fan_out(fx.keys(s, d).select("k"), fx.routes(s), "backend")


@query("SELECT k, address FROM keys, (SELECT DISTINCT address FROM routes) r")
def fan_out_nodes(s, d):
    return replies.fan_out(fx.keys(s, d).select("k"), fx.routes(s), "node")


@query("SELECT k, CAST(group_id AS BIGINT) AS group_id FROM keys, (SELECT DISTINCT group_id FROM routes) r")
def fan_out_groups(s, d):
    return replies.fan_out(fx.keys(s, d).select("k"), fx.routes(s), "group")


@query(""", ended AS (SELECT k // 50 AS request, k AS part, count(*) FILTER (status = 0) AS s, count(*) AS n, arg_min(status, arrival) FILTER (status <> 0 AND (is_reply OR status <> -6)) AS e, bool_or(status = 0) AS good FROM replies WHERE is_final GROUP BY ALL),
checked AS (SELECT *, CASE WHEN s = n THEN 0 WHEN s = 0 AND e IS NOT NULL THEN e ELSE -6 END AS error FROM ended WHERE part % 4 = 1),
whole AS (SELECT request, CAST(sum(n) AS BIGINT) AS total, bool_or(good) AS good, arg_max(error, part) FILTER (error <> 0) AS last FROM checked GROUP BY request)
SELECT r.request, coalesce(total, 0) AS total, CAST(CASE WHEN total IS NULL THEN -6 WHEN good THEN 0 ELSE coalesce(last, 0) END AS BIGINT) AS error, CASE WHEN total IS NULL THEN false ELSE good OR last IS NULL END AS ok
FROM (SELECT DISTINCT k // 50 AS request FROM keys UNION SELECT -1) r LEFT JOIN whole USING (request)""")
def aggregated_requests(s, d):
    rows = fx.replies(s, d).selectExpr("*", "k div 50 request", "k part").filter("k % 4 = 1")
    requests = fx.keys(s, d).selectExpr("k div 50 request").union(s.range(1).selectExpr("-1"))
    return replies.aggregated(rows, requests, "all")


# -- writes -----------------------------------------------------------------------
_NEW = "SELECT id, group_id, ts_sec + (k % 5 - 2) * 43200 AS ts_sec, size + 100 AS size, user_flags FROM replicas WHERE k % 3 = 0"


def _new_writes(s, d):
    return fx.replicas(s, d).filter("k % 3 = 0").selectExpr("id", "group_id", "ts_sec + (k % 5 - 2) * 43200 ts_sec", "size + 100 size", "user_flags")


@query(f"SELECT id, CAST(group_id AS BIGINT) AS group_id, size, ts_sec, user_flags FROM (SELECT id, group_id, ts_sec, size, user_flags, 0 AS new FROM replicas UNION ALL SELECT *, 1 FROM ({_NEW})) QUALIFY row_number() OVER (PARTITION BY id, group_id ORDER BY ts_sec DESC, new DESC) = 1")
def write_lww(s, d):
    return writes.last_writer(fx.replicas(s, d).select("id", "group_id", "ts_sec", "size", "user_flags"), _new_writes(s, d))


@query("SELECT k, CAST(group_id AS BIGINT) AS group_id FROM keys, g3")
def write_fan_out(s, d):
    return writes.to_groups(fx.keys(s, d), (1, 2, 3)).select("k", "group_id")


@query("SELECT doc_id AS id, CAST(group_id AS BIGINT) AS group_id, length(text) AS size, sha256(text) AS digest FROM documents, (SELECT unnest([1, 2]) AS group_id)")
def bulk_write(s, d):
    docs = fx.table(s, d, "documents")
    requests = docs.selectExpr("doc_id n", "doc_id id", "doc_id ts_sec")
    return writes.bulk(requests, docs.selectExpr("doc_id n", "text data"), (1, 2)).select("id", "group_id", "size", F.sha2("data", 256).alias("digest"))


@query(f"SELECT w.id, CAST(w.group_id AS BIGINT) AS group_id, CASE WHEN r.ts_sec IS NULL OR r.ts_sec <= w.ts_sec THEN 0 ELSE -77 END AS status FROM ({_NEW}) w LEFT JOIN replicas r ON r.id = w.id AND r.group_id = w.group_id")
def write_cas_time(s, d):
    have = fx.replicas(s, d).select("id", "group_id", F.col("ts_sec").alias("have"))
    return _new_writes(s, d).join(have, ["id", "group_id"], "left").select("id", "group_id", writes.cas_time_status(F.col("have"), F.col("ts_sec")).alias("status"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR sha256(text) = sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) THEN 0 ELSE -77 END AS status FROM documents")
def write_cas_csum(s, d):
    stored = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.sha2("text", 256))
    given = F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256)
    return fx.table(s, d, "documents").select("doc_id", writes.cas_status(stored, given).alias("status"))


@query("SELECT doc_id, sha256(replace(text, 'the', 'THE')) AS digest, text <> replace(text, 'the', 'THE') AS changed FROM documents")
def write_cas_converter(s, d):
    rows = writes.convert(fx.table(s, d, "documents").select("doc_id", "text"), lambda c: F.replace(c, F.lit("the"), F.lit("THE")), "text")
    return rows.select("doc_id", F.sha2("text", 256).alias("digest"), "changed")


@query(""", seen AS (SELECT * FROM object_values WHERE NOT open), olds AS (SELECT id, arg_max(data, ts_sec * 10 - group_id) AS old FROM seen GROUP BY id),
made AS (SELECT b.id, g.group_id, old, replace(old, 'the', 'THE') AS new, coalesce(v.meanwhile, 0) >= 10 AS lost FROM olds b, g3 g LEFT JOIN object_values v ON v.id = b.id AND v.group_id = g.group_id)
SELECT id, CAST(group_id AS BIGINT) AS group_id, CAST(CASE WHEN old <> new AND lost THEN -77 ELSE 0 END AS BIGINT) AS status, sha256(CASE WHEN lost THEN old ELSE new END) AS digest FROM made""")
def write_cas_groups(s, d):
    rows = writes.cas_convert(fx.values(s, d), lambda c: F.replace(c, F.lit("the"), F.lit("THE")), (1, 2, 3))
    return rows.select("id", "group_id", "status", F.sha2("data", 256).alias("digest"))


@query("SELECT id, string_agg(data, '' ORDER BY seq) AS data, count(*) AS parts FROM commits GROUP BY id")
def write_append(s, d):
    return writes.appended(fx.commits(s, d))


@query("""SELECT id, data, visible FROM (
  SELECT id, last_base, last_remove, string_agg(data, '' ORDER BY seq) AS data, bool_or(op IN ('commit', 'write')) AS visible
  FROM (SELECT *, max(CASE WHEN op IN ('prepare', 'write') THEN seq END) OVER (PARTITION BY id) AS last_base, max(CASE WHEN op = 'remove' THEN seq END) OVER (PARTITION BY id) AS last_remove FROM commits)
  WHERE seq >= coalesce(last_base, 0) AND seq > coalesce(last_remove, -1) GROUP BY id, last_base, last_remove)""")
def write_prepare_commit(s, d):
    return writes.folded(fx.commits(s, d))


@query()
def write_commit_truncated(s, d):
    return writes.folded(fx.commits(s, d).withColumn("csize", F.when(F.col("seq") % 3 == 0, 6)))


ORACLE_SQL["write_commit_truncated"] = fx.SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, steps AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS i FROM commits),
played AS (
  SELECT id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS data, false AS visible FROM (SELECT DISTINCT id FROM steps)
  UNION ALL
  SELECT s.id, s.i, CASE s.op WHEN 'remove' THEN NULL WHEN 'write' THEN s.data WHEN 'prepare' THEN s.data WHEN 'commit' THEN CASE WHEN s.seq % 3 = 0 THEN substr(coalesce(p.data, '') || s.data, 1, 6) ELSE coalesce(p.data, '') || s.data END ELSE coalesce(p.data, '') || s.data END,
         CASE s.op WHEN 'plain' THEN p.visible WHEN 'write' THEN true WHEN 'commit' THEN true ELSE false END
  FROM played p JOIN steps s ON s.id = p.id AND s.i = p.i + 1)
SELECT id, data, visible FROM played WHERE data IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1 AND i = (SELECT max(i) FROM steps t WHERE t.id = played.id)"""


@query(""", writes_ AS (SELECT doc_id % 20 AS id, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS i, CAST((doc_id // 20) % 4 * 2 AS BIGINT) AS off, 'd' || doc_id AS data FROM documents)
SELECT id, CAST(max(off + length(data)) AS BIGINT) AS size FROM writes_ GROUP BY id""")
def write_offsets(s, d):
    log = fx.table(s, d, "documents").selectExpr("doc_id % 20 id", "doc_id seq", "(doc_id div 20) % 4 * 2 offset", "concat('d', doc_id) data")
    return writes.offset_writes(log).select("id", F.length("data").alias("size"))


@query("SELECT doc_id, i * 1000 AS off, least(1000, length(text) - i * 1000) AS size, CASE WHEN length(text) <= 1000 THEN 'write' WHEN i = 0 THEN 'prepare' WHEN i = (length(text) + 999) // 1000 - 1 THEN 'commit' ELSE 'plain' END AS phase FROM documents, LATERAL (SELECT unnest(range(greatest((length(text) + 999) // 1000, 1))) AS i)")
def write_chunks(s, d):
    rows = fx.table(s, d, "documents").select("doc_id", F.explode(writes.chunks(F.length("text"), 1000)).alias("c"))
    return rows.select("doc_id", F.col("c.offset").alias("off"), "c.size", "c.phase")


@query("SELECT id, sec, ttl, event_id FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 100000 * (event_id % 4) END AS ttl FROM access WHERE cmd = 'WRITE' QUALIFY row_number() OVER (PARTITION BY id ORDER BY sec DESC, event_id DESC) = 1) WHERE ttl = 0 OR sec + ttl > (SELECT max(sec) FROM access) - 50000")
def write_ttl(s, d):
    log = fx.access(s, d)
    now = log.agg(F.max("sec") - 50000).scalar()
    ttl = F.when(F.col("event_id") % 4 == 0, F.lit(0)).otherwise(100000 * (F.col("event_id") % 4)).cast("long")
    return writes.unexpired(log.filter("cmd = 'WRITE'"), now, ttl)


@query("SELECT id, CAST(group_id AS BIGINT) AS group_id, size FROM replicas WHERE k % 4 <> 0")
def bulk_remove(s, d):
    return writes.without(fx.replicas(s, d), fx.keys(s, d).filter("k % 4 = 0")).select("id", "group_id", "size")


@query("SELECT event_id, CASE WHEN cmd = 'WRITE' AND group_id = 2 AND backend_id = 1 THEN -30 ELSE 0 END AS status FROM access")
def read_only_guard(s, d):
    places = s.range(6).selectExpr("CAST(id % 3 + 1 AS INT) group_id", "CAST(id div 3 AS INT) backend_id", "id = 4 read_only")
    return writes.read_only_status(fx.access(s, d), places).select("event_id", "status")


@query("SELECT id, seq, row_number() OVER (PARTITION BY id ORDER BY seq) AS turn FROM commits")
def write_order(s, d):
    return writes.in_order(fx.commits(s, d)).select("id", "seq", "turn")


# -- containers ---------------------------------------------------------------------
@query("SELECT id, CAST(group_id AS BIGINT) AS group_id, row_number() OVER (PARTITION BY id ORDER BY ts_sec DESC, size DESC, group_id) AS place FROM replicas")
def container_sort(s, d):
    return containers.ranked(fx.replicas(s, d)).select("id", "group_id", "place")


_FIRST = "(SELECT * FROM replicas WHERE group_id {g} QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts_sec DESC, size DESC, group_id) = 1)"


@query(f"SELECT r.id, CAST(r.group_id AS BIGINT) AS group_id, r.ts_sec, r.size FROM {_FIRST.format(g='IN (2, 3)')} r LEFT JOIN {_FIRST.format(g='= 1')} l ON l.id = r.id WHERE l.id IS NULL OR r.ts_sec > l.ts_sec OR (r.ts_sec = l.ts_sec AND r.size > l.size)")
def container_diff(s, d):
    rows = fx.replicas(s, d)
    return containers.difference(rows.filter("group_id = 1"), rows.filter("group_id IN (2, 3)")).select("id", "group_id", "ts_sec", "size")


@query("SELECT id, CAST(group_id AS BIGINT) AS group_id, ts_sec, size FROM replicas QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts_sec DESC, size, user_flags DESC, group_id) = 1")
def container_merge(s, d):
    return containers.merged(fx.replicas(s, d), "asc").select("id", "group_id", "ts_sec", "size")


@query("SELECT k, CASE WHEN id <= '4' || repeat('f', 63) THEN 0 WHEN id BETWEEN repeat('8', 64) AND repeat('b', 64) THEN 1 END AS range_id FROM keys")
def container_buckets(s, d):
    spans = s.createDataFrame([(0, "0" * 64, "4" + "f" * 63), (1, "8" * 64, "b" * 64)], "range_id long, start string, stop string")
    return containers.bucketed(fx.keys(s, d), spans).select("k", "range_id")


@query("SELECT range_id, string_agg(DISTINCT node, ',' ORDER BY node) AS nodes FROM (SELECT substr(id, 1, 1) AS range_id, address || '/' || backend_id AS node FROM owners) GROUP BY range_id")
def container_transpose(s, d):
    rows = routes.lookup(fx.keys(s, d), fx.routes(s))
    return containers.transposed(rows.select(F.substring("id", 1, 1).alias("range_id"), F.concat_ws("/", "address", F.col("backend_id").cast("string")).alias("node")))


# -- recovery -------------------------------------------------------------------------
_OPTIONS = recovery.Options(prepare_before=900000000)
_INFOS = """, f AS (SELECT *, first_value(ts_sec) OVER w AS ft, first_value(size) OVER w AS fz, first_value(user_flags) OVER w AS fu, count(*) OVER (PARTITION BY id) AS n FROM replicas
  WINDOW w AS (PARTITION BY id ORDER BY ts_sec DESC, size DESC, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
flags AS (SELECT *, ts_sec = ft AND size = fz AS newest, record_flags & 128 <> 0 AS open FROM f),
per AS (SELECT id, max(n) AS n, max(ft) AS ft, max(fz) AS fz, bool_and(NOT open AND newest AND user_flags = fu) AS same, bool_and(open) FILTER (newest) AS all_open,
  min(CASE WHEN newest AND NOT open THEN ord END) AS src_ord, list(group_id) FILTER (NOT newest OR open) AS bad, list(group_id) AS holders
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts_sec DESC, size DESC, group_id) AS ord FROM flags) GROUP BY id),
src AS (SELECT id, min(group_id) AS source FROM flags WHERE newest AND NOT open GROUP BY id),
gone AS (SELECT a.id, list(a.group_id) AS missed FROM (SELECT DISTINCT r.id, g3.group_id FROM replicas r, g3) a LEFT JOIN replicas r ON r.id = a.id AND r.group_id = a.group_id WHERE r.id IS NULL GROUP BY a.id),
todo AS (SELECT per.*, src.source, list_sort(list_distinct(list_concat(coalesce(missed, []), coalesce(bad, [])))) AS too FROM per LEFT JOIN src USING (id) LEFT JOIN gone USING (id)),
acts AS (SELECT *, CASE WHEN n = 3 AND same THEN 'skip' WHEN all_open AND ft < 900000000 THEN 'remove' WHEN all_open THEN 'skip' WHEN len(too) > 0 THEN 'copy' ELSE 'skip' END AS action FROM todo)
"""


@query("SELECT id, string_agg(group_id || ':' || ts_sec || ':' || size, ',' ORDER BY ts_sec DESC, size DESC, group_id) AS infos FROM replicas GROUP BY id")
def dc_infos(s, d):
    return recovery.infos(fx.replicas(s, d)).select("id", F.transform("infos", lambda x: F.concat_ws(":", x["group_id"].cast("string"), x["ts_sec"].cast("string"), x["size"].cast("string"))).alias("infos"))


@query(_INFOS + "SELECT id, n = 3 AND same AS skipped FROM per")
def dc_skip(s, d):
    return recovery.infos(fx.replicas(s, d)).select("id", recovery.skipped(_OPTIONS).alias("skipped"))


@query(_INFOS + "SELECT per.id, NOT bool_or(replicas.user_flags = 2) OR max(n = 3 AND same) AS skipped FROM per JOIN replicas USING (id) GROUP BY per.id")
def dc_user_flags(s, d):
    return recovery.infos(fx.replicas(s, d)).select("id", recovery.skipped(recovery.Options(user_flags=(2,))).alias("skipped"))


@query(_INFOS + "SELECT id, array_to_string(list_sort(list_distinct(list_concat(coalesce(missed, []), coalesce(different, [])))), ',') AS dst_groups FROM (SELECT id, list(group_id) FILTER (NOT newest) AS different FROM flags GROUP BY id) LEFT JOIN gone USING (id)")
def dc_dest_groups(s, d):
    rows = recovery.with_groups(recovery.infos(fx.replicas(s, d)), _OPTIONS)
    return rows.select("id", F.array_sort(F.array_union("missed", "different")).alias("dst_groups"))


@query(_INFOS + "SELECT id, action, CASE WHEN action = 'copy' THEN CAST(source AS BIGINT) END AS src_group, CASE action WHEN 'copy' THEN array_to_string(too, ',') WHEN 'remove' THEN array_to_string(list_sort(holders), ',') ELSE '' END AS dst_groups FROM acts")
def dc_actions(s, d):
    return recovery.actions(recovery.infos(fx.replicas(s, d)), _OPTIONS)


@query(_INFOS + "SELECT action, CAST(CASE WHEN action = 'copy' THEN source END AS BIGINT) AS src_group, count(*) AS n FROM acts GROUP BY ALL")
def dc_action_counts(s, d):
    rows = recovery.actions(recovery.infos(fx.replicas(s, d)), _OPTIONS)
    return rows.groupBy("action", "src_group").agg(F.count("*").alias("n"))


@query(_INFOS + "SELECT CAST(group_id AS BIGINT) AS group_id, count(*) AS n FROM flags WHERE newest GROUP BY group_id")
def dc_newest_counts(s, d):
    return recovery.newest_counts(recovery.infos(fx.replicas(s, d)), _OPTIONS)


@query(_INFOS + """, counts AS (SELECT group_id, count(*) AS c FROM flags WHERE newest GROUP BY group_id)
SELECT f.id, CASE WHEN max(p.fz) > 12 OR (max(p.all_open) AND max(p.ft) < 900000000) THEN -1 ELSE arg_max(f.group_id, c * 10 - f.group_id) END AS bucket FROM flags f JOIN counts USING (group_id) JOIN per p ON p.id = f.id WHERE f.newest GROUP BY f.id""")
def dc_buckets(s, d):
    return recovery.buckets(recovery.infos(fx.replicas(s, d)), recovery.Options(prepare_before=900000000, chunk_size=12))


@query(_INFOS + """, bad AS (SELECT id, group_id, CASE (k // 3) % 4 WHEN 0 THEN -110 WHEN 1 THEN -6 WHEN 2 THEN -84 ELSE -5 END AS status FROM replicas WHERE (k + group_id) % 3 = 0),
turns AS (SELECT f.id, row_number() OVER (PARTITION BY f.id ORDER BY f.group_id) - 1 AS round, f.group_id AS src_group, f.user_flags AS uf, lead(f.user_flags) OVER (PARTITION BY f.id ORDER BY f.group_id) AS after, coalesce(b.status, 0) AS status
  FROM flags f JOIN per p ON p.id = f.id LEFT JOIN bad b ON b.id = f.id AND b.group_id = f.group_id WHERE f.newest AND NOT f.open AND NOT (p.n = 3 AND p.same)),
ends AS (SELECT *, status = 0 OR after IS NULL OR (status IN (-110, -6) AND after <> uf) AS done FROM turns),
lasts AS (SELECT *, min(CASE WHEN done THEN round END) OVER (PARTITION BY id) AS last FROM ends)
SELECT id, round, CAST(src_group AS BIGINT) AS src_group, CAST(status AS BIGINT) AS status, CASE WHEN status = 0 THEN 'sent' WHEN status = -84 THEN 'removed' WHEN done THEN 'failed' ELSE 'next' END AS outcome FROM lasts WHERE round <= last""")
def dc_send_rounds(s, d):
    rows = fx.replicas(s, d)
    bad = rows.filter("(k + group_id) % 3 = 0").selectExpr("id", "group_id", "CASE (k div 3) % 4 WHEN 0 THEN -110 WHEN 1 THEN -6 WHEN 2 THEN -84 ELSE -5 END status")
    return recovery.send_rounds(recovery.infos(rows), bad, _OPTIONS)


@query(_INFOS + "SELECT id, action, CASE WHEN action = 'copy' THEN CAST(source AS BIGINT) END AS src_group FROM acts WHERE action = 'copy'")
def dc_actions_safe(s, d):
    options = recovery.Options(prepare_before=900000000, safe=True)
    return recovery.applied(recovery.actions(recovery.infos(fx.replicas(s, d)), options), options).select("id", "action", "src_group")


@query("SELECT r.id, CAST(r.group_id AS BIGINT) AS group_id, r.ts_sec FROM replicas r WHERE r.ts_sec >= 800000000 AND r.id IN (SELECT id FROM owners WHERE address = 'host2:1025:2' AND backend_id = 1)")
def dc_selected(s, d):
    options = recovery.Options(since=800000000, address="host2:1025:2", backend_id=1)
    return recovery.selected(fx.replicas(s, d), options, routes.lookup(fx.keys(s, d), fx.routes(s))).select("id", "group_id", "ts_sec")


@query("""SELECT k.id, CAST(CASE WHEN count(r.id) = 0 THEN -2 ELSE 0 END AS BIGINT) AS status, coalesce(string_agg(r.group_id, ',' ORDER BY r.ts_sec DESC, r.size DESC, r.group_id), '') AS holders
FROM (SELECT id FROM keys UNION ALL SELECT sha256('absent-' || n) FROM range(4) t(n)) k LEFT JOIN replicas r ON r.id = k.id GROUP BY k.id""")
def dc_dump_lookup(s, d):
    dump = fx.keys(s, d).select("id").union(s.range(4).selectExpr("sha2(CAST(concat('absent-', id) AS BINARY), 256)"))
    return recovery.from_dump(fx.replicas(s, d), dump).select("id", "status", F.transform("infos", lambda x: x["group_id"]).alias("holders"))


_HELD = """, held AS (SELECT h.*, r.ts_sec, r.size, r.record_flags, CASE WHEN h.k % 3 = 0 THEN r.ts_sec + (h.k % 2) * 10 END AS owner_ts FROM holders h JOIN replicas r ON r.id = h.id AND r.group_id = h.group_id)
"""


def held(s, d):
    return _holder(routes.lookup(fx.replicas_of_keys(s, d), fx.routes(s))).withColumn("owner_ts", F.when(F.col("k") % 3 == 0, F.col("ts_sec") + F.col("k") % 2 * 10))


@query(_HELD + "SELECT id, CAST(group_id AS BIGINT) AS group_id, CAST(holder_n AS BIGINT) AS holder_n, CAST(owner_n AS BIGINT) AS owner_n, CASE WHEN holder_n = owner_n THEN 'keep' WHEN record_flags = 128 THEN 'remove' WHEN owner_ts > ts_sec THEN 'remove' ELSE 'move' END AS action FROM held")
def merge_actions(s, d):
    return recovery.merge_actions(held(s, d), _OPTIONS)


@query(_HELD + """, places AS (SELECT id, group_id, holder_n, owner_n, ts_sec, size FROM held UNION ALL SELECT id, group_id, owner_n, owner_n, owner_ts, size FROM held WHERE owner_ts IS NOT NULL AND holder_n <> owner_n)
SELECT id, CAST(group_id AS BIGINT) AS group_id, CAST(holder_n AS BIGINT) AS best_n, holder_n = owner_n AS at_owner FROM places QUALIFY row_number() OVER (PARTITION BY id, group_id ORDER BY ts_sec DESC, size DESC, (holder_n = owner_n) DESC, holder_n) = 1""")
def merge_newest(s, d):
    rows = held(s, d).select("id", "group_id", "holder_n", "owner_n", "ts_sec", "size", "owner_ts")
    other = rows.filter("owner_ts IS NOT NULL AND holder_n <> owner_n").selectExpr("id", "group_id", "owner_n holder_n", "owner_n", "owner_ts ts_sec", "size")
    return recovery.newest_place(rows.drop("owner_ts").unionByName(other))


_MOVED = "CASE WHEN k % 11 = 0 THEN -2 WHEN k % 7 = 0 THEN -84 WHEN k % 5 = 0 THEN -110 WHEN owner_ts > ts_sec THEN -77 ELSE 0 END"


def _moves(s, d):
    return held(s, d).filter("holder_n <> owner_n").withColumn("status", F.expr(_MOVED))


@query(_HELD + f"SELECT id, CAST(group_id AS BIGINT) AS group_id, CAST(holder_n AS BIGINT) AS holder_n, CASE status WHEN 0 THEN 'moved' WHEN -2 THEN 'gone' WHEN -110 THEN 'rest' ELSE 'removed' END AS action FROM (SELECT *, {_MOVED} AS status FROM held WHERE holder_n <> owner_n)")
def merge_send(s, d):
    return recovery.merge_send(_moves(s, d))


@query(_HELD + f"SELECT id, CAST(group_id AS BIGINT) AS group_id FROM holders ANTI JOIN (SELECT id, group_id, {_MOVED} AS status FROM held WHERE holder_n <> owner_n) m ON m.id = holders.id AND m.group_id = holders.group_id AND m.status <> -110")
def merge_unrecovered(s, d):
    return recovery.unrecovered(holders(s, d), _moves(s, d))


_SENT = """, sent AS (SELECT s.id, g.group_id, s.ts_sec, s.size, CASE WHEN s.record_flags = 128 THEN -6 WHEN t.ts_sec > s.ts_sec THEN -77 ELSE 0 END AS status
  FROM replicas s, (SELECT unnest([2, 3]) AS group_id) g LEFT JOIN replicas t ON t.id = s.id AND t.group_id = g.group_id WHERE s.group_id = 1)
"""


def _sent(s, d):
    rows = fx.replicas(s, d)
    source, target = rows.filter("group_id = 1"), rows.filter("group_id IN (2, 3)")
    return source, target, transfer.outcomes(source, target, (2, 3))


@query(_SENT + "SELECT id, CAST(group_id AS BIGINT) AS group_id, CAST(status AS BIGINT) AS status FROM sent")
def server_send_status(s, d):
    return _sent(s, d)[2]


@query(_SENT + "SELECT t.id, CAST(t.group_id AS BIGINT) AS group_id, t.ts_sec, t.size FROM replicas t LEFT JOIN sent n ON n.id = t.id AND n.group_id = t.group_id AND n.status = 0 WHERE t.group_id IN (2, 3) AND n.id IS NULL UNION ALL SELECT id, group_id, ts_sec, size FROM sent WHERE status = 0")
def server_send_copy(s, d):
    source, target, _ = _sent(s, d)
    return transfer.copied(target, source, (2, 3)).select("id", "group_id", "ts_sec", "size")


@query("SELECT id, CAST(group_id AS BIGINT) AS group_id, CAST(CASE WHEN open THEN -6 WHEN k % 8 = 0 THEN -84 WHEN have > ts_sec THEN -77 ELSE 0 END AS BIGINT) AS status FROM (SELECT s.id, s.k, s.ts_sec, s.record_flags = 128 AS open, g.group_id, t.ts_sec AS have FROM replicas s, (SELECT unnest([2, 3]) AS group_id) g LEFT JOIN replicas t ON t.id = s.id AND t.group_id = g.group_id WHERE s.group_id = 1)")
def server_send_checksum(s, d):
    rows = fx.replicas(s, d)
    return transfer.outcomes(rows.filter("group_id = 1").withColumn("valid", F.col("k") % 8 != 0), rows.filter("group_id IN (2, 3)"), (2, 3))


@query("SELECT address, CAST(backend_id AS BIGINT) AS backend_id, count(*) AS keys FROM owners WHERE group_id = 2 GROUP BY ALL")
def server_send_requests(s, d):
    return transfer.requests(fx.keys(s, d), fx.routes(s), 2)


def _copy(s, d, flags):
    rows = fx.replicas(s, d).select("group_id", "id", "ts_sec", "size", "user_flags", "record_flags")
    return transfer.copy_scan(rows, 1, (2,), [(_LOW, _HIGH)], flags=flags)


_COPIED = f""", own AS (SELECT * FROM replicas WHERE group_id = 1), there AS (SELECT * FROM replicas WHERE group_id = 2),
tried AS (SELECT o.*, o.record_flags = 128 AS open, o.record_flags <> 128 AND {{taken}} AS ok FROM own o LEFT JOIN there t ON t.id = o.id WHERE o.id BETWEEN '{_LOW}' AND '{_HIGH}')
"""


@query(_COPIED.format(taken="NOT coalesce(t.ts_sec > o.ts_sec, false)") + "SELECT id, CAST(2 AS BIGINT) AS group_id, CAST(CASE WHEN ok THEN 0 WHEN open THEN -6 ELSE -77 END AS BIGINT) AS status FROM tried")
def copy_iterator_status(s, d):
    return _copy(s, d, 0)[0]


@query(_COPIED.format(taken="true") + """SELECT id, CAST(group_id AS BIGINT) AS group_id, ts_sec, size FROM replicas WHERE (group_id = 1 AND id NOT IN (SELECT id FROM tried WHERE ok)) OR (group_id = 2 AND id NOT IN (SELECT id FROM tried WHERE ok)) OR group_id = 3
UNION ALL SELECT id, 2, ts_sec, size FROM tried WHERE ok""")
def copy_iterator_move(s, d):
    return _copy(s, d, 16 + 32)[1].select("id", "group_id", "ts_sec", "size")


@query(_SENT + "SELECT id, ts_sec FROM replicas WHERE group_id = 1 AND id IN (SELECT id FROM sent WHERE status <> 0)")
def server_send_move(s, d):
    source, _, done = _sent(s, d)
    return transfer.left_after_move(source, done).select("id", "ts_sec")


# -- statistics --------------------------------------------------------------------------
_SIZE = "CASE WHEN cmd = 'READ' AND status < 0 THEN 0 ELSE size END"


@query(f"SELECT cmd, CASE WHEN in_cache THEN 'cache' ELSE 'disk' END AS place, CASE WHEN trans <> 0 THEN 'outside' ELSE 'internal' END AS origin, count(*) FILTER (status = 0) AS successes, count(*) FILTER (status <> 0) AS failures, CAST(sum({_SIZE}) AS BIGINT) AS size, CAST(sum(time_us) AS BIGINT) AS time_us FROM access GROUP BY ALL")
def command_stats(s, d):
    return stats.command_counters(fx.access(s, d))


@query("SELECT client, cmd, count(*) FILTER (status = 0) AS successes, count(*) FILTER (status <> 0) AS failures FROM access GROUP BY ALL")
def client_stats(s, d):
    return stats.client_counters(fx.access(s, d))


@query("SELECT cmd, count(*) FILTER (status = 0) AS successes, count(*) FILTER (status <> 0) AS failures FROM access GROUP BY ROLLUP (cmd)")
def command_totals(s, d):
    return stats.command_totals(fx.access(s, d))


@query("SELECT cmd, count(*) FILTER (status = 0 AND trans <> 0) AS storage_successes, count(*) FILTER (status <> 0 AND trans <> 0) AS storage_failures, count(*) FILTER (status = 0 AND trans = 0) AS proxy_successes, count(*) FILTER (status <> 0 AND trans = 0) AS proxy_failures FROM access GROUP BY cmd")
def storage_and_proxy(s, d):
    return stats.storage_and_proxy(fx.access(s, d))


@query(f"""SELECT CASE WHEN event_id % 50 = 0 THEN 'UNKNOWN' ELSE cmd END AS cmd, CASE WHEN in_cache THEN 'cache' ELSE 'disk' END AS place, CASE WHEN trans <> 0 THEN 'outside' ELSE 'internal' END AS origin, count(*) AS n, CAST(sum({_SIZE.replace("cmd = 'READ'", "cmd = 'READ' AND event_id % 50 <> 0")}) AS BIGINT) AS size FROM access GROUP BY ALL""")
def unknown_commands(s, d):
    rows = fx.access(s, d).withColumn("cmd", F.when(F.col("event_id") % 50 != 0, F.col("cmd")))
    return stats.command_counters(rows).select("cmd", "place", "origin", (F.col("successes") + F.col("failures")).alias("n"), "size")


@query(f"""SELECT CAST(group_id AS BIGINT) AS group_id, CAST(backend_id AS BIGINT) AS backend_id, '[' || string_agg('{{"cmd":"' || cmd || '","place":"' || place || '","origin":"' || origin || '","successes":' || s || ',"failures":' || f || ',"size":' || size || ',"time_us":' || t || '}}', ',' ORDER BY cmd, place, origin) || ']' AS report
FROM (SELECT group_id, backend_id, cmd, CASE WHEN in_cache THEN 'cache' ELSE 'disk' END AS place, CASE WHEN trans <> 0 THEN 'outside' ELSE 'internal' END AS origin, count(*) FILTER (status = 0) AS s, count(*) FILTER (status <> 0) AS f, CAST(sum({_SIZE}) AS BIGINT) AS size, CAST(sum(time_us) AS BIGINT) AS t FROM access GROUP BY ALL) GROUP BY group_id, backend_id""")
def commands_report(s, d):
    return stats.report(fx.access(s, d))


@query("""SELECT CAST(group_id AS BIGINT) AS group_id, '{"timestamp":1000,"values":[' || string_agg('{"category":"' || category || '","name":"' || name || '","value":' || value || '}', ',' ORDER BY category, name, value) || ']}' AS report FROM (
  SELECT group_id, 'commands' AS category, cmd || '.successes' AS name, count(*) FILTER (status = 0) AS value FROM access GROUP BY group_id, cmd UNION ALL SELECT group_id, 'commands', cmd || '.failures', count(*) FILTER (status <> 0) FROM access GROUP BY group_id, cmd
  UNION ALL SELECT group_id, 'io', 'objects', count(*) FROM replicas GROUP BY group_id UNION ALL SELECT group_id, 'io', 'bytes', CAST(sum(size) AS BIGINT) FROM replicas GROUP BY group_id) GROUP BY group_id""")
def statistics_document(s, d):
    return stats.document(fx.access(s, d), fx.replicas(s, d), 2 + 4, 1000)


@query(f"SELECT event_id, {_SIZE} AS size FROM access")
def read_error_size(s, d):
    return fx.access(s, d).select("event_id", stats.counted_size().cast("long").alias("size"))


_DECAY = """, RECURSIVE_ AS (SELECT 1), reads AS (SELECT *, row_number() OVER (PARTITION BY group_id, id ORDER BY sec, event_id) AS i FROM access WHERE cmd = 'READ' AND status = 0 AND size > 0),
fold AS (
  SELECT group_id, id, i, sec, CAST(size AS BIGINT) AS weight, CAST(1.0 AS DOUBLE) AS frequency FROM reads WHERE i = 1
  UNION ALL
  SELECT r.group_id, r.id, r.i, r.sec, CAST(floor(f.weight * greatest(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) - (r.sec - f.sec) / CAST({window} AS DOUBLE))) AS BIGINT) + r.size,
         f.frequency * greatest(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) - (r.sec - f.sec) / CAST({window} AS DOUBLE)) + CAST(1 AS DOUBLE)
  FROM fold f JOIN reads r ON r.group_id = f.group_id AND r.id = f.id AND r.i = f.i + 1),
ends AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY group_id, id ORDER BY i DESC) = 1)
""".replace("RECURSIVE_ AS (SELECT 1), ", "")
WINDOW = 864000


@query()
def top_keys_decay(s, d):
    return stats.top_keys(fx.access(s, d), 50, WINDOW).withColumn("frequency", F.round("frequency", 6))


ORACLE_SQL["top_keys_decay"] = fx.SQL.replace("WITH ", "WITH RECURSIVE ", 1) + _DECAY.format(window=WINDOW) + "SELECT CAST(group_id AS BIGINT) AS group_id, id, weight, round(frequency, 6) AS frequency, sec AS last FROM ends ORDER BY weight DESC, group_id, id LIMIT 50"


@query()
def top_keys_bounded(s, d):
    rows = fx.access(s, d)
    return stats.top_keys(rows, 50, WINDOW, now=rows.agg(F.max("sec") + 3000).scalar(), capacity=9).withColumn("frequency", F.round("frequency", 6))


ORACLE_SQL["top_keys_bounded"] = fx.SQL.replace("WITH ", "WITH RECURSIVE ", 1) + _DECAY.format(window=WINDOW) + """SELECT CAST(group_id AS BIGINT) AS group_id, id, weight, round(frequency, 6) AS frequency, sec AS last
FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sec DESC, event_id DESC, id) AS place FROM (SELECT e.*, r.event_id FROM ends e JOIN reads r ON r.group_id = e.group_id AND r.id = e.id AND r.i = e.i))
WHERE place <= 9 AND (SELECT max(sec) + 3000 FROM access) - sec <= 864000 ORDER BY weight DESC, group_id, id LIMIT 50"""


@query("SELECT sec - sec % 3600 AS slot, CASE WHEN time_us <= 500 THEN 0 WHEN time_us <= 5000 THEN 1 WHEN time_us <= 100000 THEN 2 ELSE 3 END AS x, CASE WHEN size <= 100 THEN 0 WHEN size <= 500 THEN 1 WHEN size <= 1000 THEN 2 ELSE 3 END AS y, count(*) AS n FROM access GROUP BY ALL")
def size_latency_histogram(s, d):
    return stats.histogram(fx.access(s, d), 3600)


@query("SELECT CAST(group_id AS BIGINT) AS group_id, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (record_flags & 1 <> 0) AS removing, count(*) FILTER (record_flags & 128 <> 0) AS uncommitted FROM replicas GROUP BY group_id")
def backend_report(s, d):
    return stats.backend_totals(fx.replicas(s, d))


@query("SELECT CAST(group_id AS BIGINT) AS group_id, count(*) FILTER (record_flags & 1 <> 0) AS removing, count(*) FILTER (record_flags & 128 <> 0) AS uncommitted FROM replicas GROUP BY group_id")
def backend_report_masked(s, d):
    return stats.backend_totals(fx.replicas(s, d), 16)


@query(f"""SELECT shard, CAST(sum(objects) AS BIGINT) AS objects, CAST(sum(bytes) AS BIGINT) AS size, CAST(0 AS BIGINT) AS removing, string_agg(bytes, ',' ORDER BY page) AS sizes FROM (
  SELECT s.shard, p.page, count(r.id) AS objects, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT {_SHARD.format(n=4)} AS shard FROM replicas) s, range(3) p(page)
  LEFT JOIN (SELECT id, size, {_SHARD.format(n=4)} AS shard, CAST('0x' || substr(id, 57, 8) AS BIGINT) % 3 AS page FROM replicas) r ON r.shard = s.shard AND r.page = p.page GROUP BY s.shard, p.page) GROUP BY shard""")
def cache_page_arrays(s, d):
    return stats.page_sizes(fx.replicas(s, d), K.shard(F.col("id"), 4), 3)


@query(f"SELECT CAST(group_id AS BIGINT) AS group_id, {_SHARD.format(n=16)} AS shard, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS objects FROM replicas GROUP BY ALL")
def cache_page_stats(s, d):
    return fx.replicas(s, d).groupBy("group_id", K.shard(F.col("id"), 16).alias("shard")).agg(F.sum("size").alias("bytes"), F.count("*").alias("objects"))


@query("SELECT event_id, id, sec - lag(sec) OVER (PARTITION BY id ORDER BY sec, event_id) AS took FROM access")
def stage_durations(s, d):
    return stats.durations(fx.access(s, d), "id").select("event_id", "id", "took")


@query("SELECT cmd AS name, count(*) FILTER (status = 0) AS success, count(*) FILTER (status <> 0) AS failure, count(*) AS total FROM access GROUP BY cmd")
def recovery_counters(s, d):
    rows = fx.access(s, d).select(F.col("cmd").alias("name"), F.when(F.col("status") == 0, 1).otherwise(-1).alias("n"))
    return stats.recovery_counters(rows)


_FOLD = """, log AS (SELECT *, row_number() OVER (PARTITION BY group_id, backend_id ORDER BY sec, event_id) AS i FROM access),
fold AS (
  SELECT DISTINCT group_id, backend_id, CAST(0 AS BIGINT) AS i, CAST(1.0 AS DOUBLE) AS weight FROM log
  UNION ALL
  SELECT l.group_id, l.backend_id, l.i, CASE WHEN cmd = 'READ' AND status = 0 AND size > 0 AND time_us > 0 THEN CAST(1 AS DOUBLE) / ((CAST(1 AS DOUBLE) / weight + CAST(time_us AS DOUBLE) / CAST(size AS DOUBLE)) / CAST(2 AS DOUBLE)) WHEN status = -110 AND weight >= 2.0 THEN weight / CAST(10 AS DOUBLE) ELSE weight END
  FROM fold f JOIN log l ON l.group_id = f.group_id AND l.backend_id = f.backend_id AND l.i = f.i + 1)
"""


@query()
def weights_fold(s, d):
    return weights.folded(fx.access(s, d)).withColumn("weight", F.round("weight", 6))


ORACLE_SQL["weights_fold"] = fx.SQL.replace("WITH ", "WITH RECURSIVE ", 1) + _FOLD + "SELECT CAST(group_id AS BIGINT) AS group_id, CAST(backend_id AS BIGINT) AS backend_id, round(weight, 6) AS weight FROM fold QUALIFY row_number() OVER (PARTITION BY group_id, backend_id ORDER BY i DESC) = 1"


@query("""SELECT k, CAST(group_id AS BIGINT) AS group_id, row_number() OVER (PARTITION BY k ORDER BY -ln((CAST('0x' || substr(md5(id || ':' || group_id || ':11'), 1, 8) AS BIGINT) + 1) / CAST(4294967297 AS DOUBLE)) / weight, group_id) AS prio
FROM keys, (VALUES (1, CAST(1 AS DOUBLE)), (2, CAST(2 AS DOUBLE)), (3, CAST(4 AS DOUBLE))) g(group_id, weight)""")
def mix_states(s, d):
    places = s.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0)], "group_id int, weight double")
    return weights.mixed(fx.keys(s, d), places, 11).select("k", "group_id", "prio")


# -- control and tags -----------------------------------------------------------------------
_CONTROL = ", control AS (SELECT group_id, backend_id, event_id AS seq, CASE cmd WHEN 'LOOKUP' THEN 'disabled' WHEN 'WRITE' THEN 'readonly' ELSE 'enabled' END AS state FROM access)"


def control_log(s, d):
    command = F.when(F.col("cmd") == "LOOKUP", "disable").when(F.col("cmd") == "WRITE", "readonly").when(F.col("cmd") == "READ", "enable").otherwise("writable")
    return fx.access(s, d).select("group_id", "backend_id", F.col("event_id").alias("seq"), command.alias("command"))


@query(_CONTROL + "SELECT seq, state, CASE WHEN lag(state) OVER (PARTITION BY group_id, backend_id ORDER BY seq) = state THEN -114 ELSE 0 END AS status FROM control")
def backend_control(s, d):
    return control.results(control_log(s, d)).select("seq", "state", "status")


@query(_CONTROL + "SELECT CAST(group_id AS BIGINT) AS group_id, CAST(backend_id AS BIGINT) AS backend_id, arg_max(state, seq) AS state, max(seq) AS seq FROM control GROUP BY ALL")
def backend_status_latest(s, d):
    return control.current(control_log(s, d))


@query(_CONTROL + "SELECT CAST(r.group_id AS BIGINT) AS group_id, r.ring_id FROM routes r LEFT JOIN (SELECT group_id, backend_id, arg_max(state, seq) AS state FROM control GROUP BY ALL) c ON c.group_id = r.group_id AND c.backend_id = r.backend_id WHERE c.state IS DISTINCT FROM 'disabled'")
def enabled_routes(s, d):
    return control.enabled_routes(fx.routes(s), control.current(control_log(s, d))).select("group_id", "ring_id")


@query("SELECT CAST(g AS BIGINT) AS group_id, CAST(b AS BIGINT) AS backend_id, CASE WHEN (g, b) IN ((1, 1), (2, 0)) THEN CAST(-16 AS BIGINT) ELSE 0 END AS status, CASE WHEN (g, b) IN ((1, 1), (2, 0)) OR (g, b) IN ((2, 1)) THEN 8 // 2 ELSE 1 END AS routes FROM range(1, 3) t(g), range(2) u(b)")
def set_backend_ids(s, d):
    states = s.createDataFrame([(1, 0, "enabled"), (1, 1, "activating"), (2, 0, "deactivating"), (2, 1, "disabled")], "group_id int, backend_id int, state string")
    own = fx.routes(s).filter("group_id < 3").withColumn("address", F.lit("host1:1025:2")).select("group_id", "ring_id", "address", "backend_id")
    change = s.range(4).selectExpr("CAST(id div 2 + 1 AS INT) group_id", "sha2(CAST(concat('set-', id) AS BINARY), 256) ring_id", "'host1:1025:2' address", "CAST(id % 2 AS INT) backend_id")
    status, after = control.set_ids(own, states, change)
    return status.join(after.groupBy("group_id", "backend_id").agg(F.count("*").alias("routes")), ["group_id", "backend_id"])


@query("SELECT client, event_id FROM (SELECT *, row_number() OVER (PARTITION BY client, run ORDER BY sec, event_id) AS n FROM (SELECT *, sum(CASE WHEN status = -110 THEN 0 ELSE 1 END) OVER (PARTITION BY client ORDER BY sec, event_id) AS run FROM late) WHERE status = -110) WHERE n % 3 = 0".replace("FROM late", "FROM (SELECT event_id, sec, client, CASE WHEN event_id % 3 = 0 THEN 0 ELSE -110 END AS status FROM access)"))
def stalled_clients(s, d):
    return expiry.stalls_of(fx.access(s, d).withColumn("status", F.when(F.col("event_id") % 3 == 0, 0).otherwise(-110)))


@query("SELECT 'w' || (k % 3) AS watcher, a.id, event_id, sec, size FROM access a JOIN (SELECT DISTINCT id, k FROM (SELECT id, CAST(event_id % 7 AS BIGINT) AS k FROM access WHERE event_id % 11 = 0)) w ON w.id = a.id WHERE cmd = 'WRITE' AND status = 0")
def notifications(s, d):
    log = fx.access(s, d)
    watches = log.filter("event_id % 11 = 0").selectExpr("id", "event_id % 7 k").distinct().selectExpr("id", "concat('w', k % 3) watcher")
    return notify.notifications(log, watches)


_TAGGED = ", tagged AS (SELECT doc_id AS id, lang AS tag FROM documents UNION ALL SELECT doc_id, source FROM documents)"


def tagged(s, d):
    docs = fx.table(s, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.explode(F.array("lang", "source")).alias("tag"))


@query("SELECT doc_id AS id FROM documents WHERE lang = 'en' AND source = 'src7'")
def tag_find_all(s, d):
    return tags.find_all(tagged(s, d), ["en", "src7"])


@query("SELECT DISTINCT doc_id AS id FROM documents WHERE lang = 'fr' OR source = 'src7'")
def tag_find_any(s, d):
    return tags.find_any(tagged(s, d), ["fr", "src7"])


@query(_TAGGED + "SELECT id, tag FROM tagged QUALIFY row_number() OVER (PARTITION BY tag ORDER BY id DESC) <= 5")
def tag_capped(s, d):
    return tags.capped(tagged(s, d), 5)
