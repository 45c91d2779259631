"""Record tables in files: metadata and payload, key dumps, files as objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import HEADER, RecordFlag

RECORDS = "group_id int, backend_id int, address string, id string, ts_sec long, user_flags long, size long, record_flags long, data binary"


def read_records(spark: SparkSession, path: str, with_data: bool = False) -> DataFrame:
    """Records written by ``write_records``; without data the payload column is never read."""
    rows = spark.read.parquet(path)
    return rows if with_data else rows.drop("data")


def write_records(records: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet by group and backend, in ranges of ids, so that scans of a group, a backend or a key range skip the rest."""
    order = ["group_id", "backend_id", "id"]
    rows = records.repartitionByRange(partitions, *order) if partitions else records.repartitionByRange(*order)
    rows.sortWithinPartitions(*order).write.partitionBy("group_id", "backend_id").parquet(path)


def compact(spark: SparkSession, source: str, target: str, files: int) -> None:
    """Rewrite a record table without removed records, in fewer files."""
    write_records(spark.read.parquet(source).filter("record_flags & 1 = 0"), target, files)


def dump_keys(keys: DataFrame, path: str) -> None:
    keys.select("id").write.text(path)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("id")).filter("id <> ''")


def normalised(records: DataFrame) -> DataFrame:
    """Sizes without the header that stands before a value: of records with EXTHDR that are large enough to have one."""
    has = (F.col("record_flags").bitwiseAND(int(RecordFlag.EXTHDR)) != 0) & (F.col("size") >= HEADER)
    return records.withColumn("size", F.when(has, F.col("size") - HEADER).otherwise(F.col("size")))


def objects_from_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as objects: the name is the path, the time that of the file."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.col("path").alias("name"), F.unix_timestamp("modificationTime").alias("ts_sec"), F.col("length").alias("size"), F.col("content").alias("data"))


def objects_to_files(objects: DataFrame, path: str) -> None:
    """Each object (name, data) as a file under ``path``, by the last part of its name; of equal names the last one by ts_sec.

    Tasks write through Hadoop's file systems (pyarrow), so the path can be in any shared store.
    """
    own = objects.withColumn("_file", F.element_at(F.split("name", "/"), -1)).groupBy("_file").agg(F.max_by("data", "ts_sec").alias("data"))

    def put(rows):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(path)
        where.create_dir(base, recursive=True)
        for r in rows:
            with where.open_output_stream(f"{base}/{r._file}") as out:
                out.write(bytes(r.data))

    own.foreachPartition(put)
