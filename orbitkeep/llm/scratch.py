"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Held while an action runs: a finished one's shuffle files go at once, else only when the driver's garbage is collected; and
#: Arrow batches, which a task and its Python worker both hold beside the heap, end at so many bytes (64 MB else, or 10,000 whole texts).
_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": f"{1 << 22}b"}
_HELD = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | _BATCH
_lock = threading.Lock()
_users: dict[int, list] = {}


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, behind underscores if need be, as no column of ``taken`` is called in any case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of frames that run later are small, too; a limit that the session was given stays."""
    with _lock:
        later = _users[id(spark)][1] if id(spark) in _users else None  # what concurrent users restore
        for k, v in _BATCH.items():
            if later is not None:
                later[k] = later[k] or v
            elif spark.conf.get(k, None) is None:
                spark.conf.set(k, v)


class Scratch:
    """Parquet tables under ``spark.checkpoint.dir`` or, where that is unset, under the warehouse.

    A written table survives lost executors and is not computed again.  Tables
    go when ``drop`` is called or, at the latest, when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        self.base = f"{base}/tables-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        where, files = self._files(self.base)
        files.mkdirs(where)  # only what exists can be marked
        files.deleteOnExit(where)

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @contextmanager
    def leaving_no_shuffle_files(self):
        """Actions within need their shuffle files no longer when they end, and small batches; the settings are restored when the last of concurrent users is done."""
        conf, key = self.spark.conf, id(self.spark)
        with _lock:
            own = _users.setdefault(key, [0, {k: conf.get(k, None) for k in _HELD}])
            own[0] += 1
            for k, v in _HELD.items():
                conf.set(k, v)
        try:
            yield
        finally:
            with _lock:
                own[0] -= 1
                if not own[0]:
                    del _users[key]
                    for k, v in own[1].items():
                        conf.unset(k) if v is None else conf.set(k, v)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{uuid.uuid4().hex}"
        with self.leaving_no_shuffle_files():
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def count(self, df: DataFrame) -> int:
        with self.leaving_no_shuffle_files():
            return df.count()

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing will read again."""
        for table in tables:
            if table is not None and (path := self._paths.pop(id(table), None)):
                where, files = self._files(path)
                files.delete(where, True)
