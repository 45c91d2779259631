"""Tags of objects: all of, any of, and capped collections (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def find_all(tagged: DataFrame, tags: list[str]) -> DataFrame:
    """Ids that carry every one of the tags; ``tagged`` is (id, tag)."""
    return tagged.filter(F.col("tag").isin(tags)).groupBy("id").agg(F.countDistinct("tag").alias("n")).filter(F.col("n") == len(set(tags))).select("id")


def find_any(tagged: DataFrame, tags: list[str]) -> DataFrame:
    return tagged.filter(F.col("tag").isin(tags)).select("id").distinct()


def capped(tagged: DataFrame, limit: int, order: str = "id") -> DataFrame:
    """Of each tag the last ``limit`` entries."""
    w = Window.partitionBy("tag").orderBy(F.col(order).desc())
    return tagged.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).drop("place")
