"""Mixing sources to target weights by nested hash thresholds.

Documents get a uniform hash.  Words are summed by source and hash bucket; the
bucket in which a source's budget runs out is refined by further hash digits
until one hash is left, and everything below that threshold is taken.  No
document is sorted or moved: a plan of one row per source is joined to the
documents, whose copies follow from comparing hashes.  A larger budget takes a
superset (thresholds are nested), and reruns agree.

All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textstats as ts
from .scratch import Scratch

#: Weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that is mixed, and how often a source may be repeated.
SHARE, MOST = 1.5, 2
#: Hex digits of each refinement: 4,096 buckets.
DIGITS = 3
#: Plan rows broadcast at most; beyond that the join is shuffled, and adaptive execution splits hot sources.
BROADCAST_ROWS = 200_000


def _hash(doc_id: Column, text: Column) -> Column:
    """32 hex digits; rows without an id are told apart by their text."""
    return F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary"))


def targets(sources: DataFrame) -> DataFrame:
    """Adds target to (source, source_size); one row per source.

    Sources share SHARE of all words by weight, none above MOST times its own
    size; what is cut off is shared again by weight.  That is target = weight *
    level, cut at MOST * size, for the level at which the targets add up.  Going
    through the sources by size / weight, the first whose share of what is left
    fits under its limit gives the level.
    """
    last = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("k", F.row_number().over(last))
    rows = rows.withColumn("weight", F.expr(f"element_at(array({', '.join(map(str, WEIGHTS))}), CAST((k - 1) % {len(WEIGHTS)} + 1 AS INT))").cast("long"))
    by = Window.orderBy(F.col("source_size") * 1.0 / F.col("weight"), "k").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumns({"cut": F.coalesce(F.sum(MOST * F.col("source_size")).over(by), F.lit(0)), "gone": F.coalesce(F.sum("weight").over(by), F.lit(0)), "all": F.sum("source_size").over(every), "weights": F.sum("weight").over(every)})
    rows = rows.withColumn("level", (SHARE * F.col("all") - F.col("cut")) / (F.col("weights") - F.col("gone")))
    fits = F.col("level") * F.col("weight") <= 1.0 * MOST * F.col("source_size")
    rows = rows.withColumn("level", F.min(F.when(fits, F.struct("gone", "level"))).over(every)["level"])
    return rows.select("source", "source_size", F.least(F.col("level") * F.col("weight"), 1.0 * MOST * F.col("source_size")).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(source, source_size, target, whole, cut): take all documents ``whole`` times, and those with a hash up to ``cut`` once more."""
    scratch = Scratch(docs.sparkSession)
    base = scratch.save(docs.select("source", ts.word_count(F.col("text")).alias("size"), _hash(F.col(id_col), F.col("text")).alias("h")))
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = scratch.save(targets(sources).withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    small = rows.count() <= BROADCAST_ROWS
    open_ = rows.filter("budget > 0").select(F.col("source").alias("s"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"), "budget")
    found = []
    for digits in range(DIGITS, 32 + DIGITS, DIGITS):
        part = base.join(F.broadcast(open_) if small else open_, F.col("source").eqNullSafe(F.col("s")) & F.col("h").startswith(F.col("prefix")))
        sums = part.groupBy("s", F.substring("h", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("before").alias("before"), F.first("budget").alias("budget"))
        upto = sums.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("s").orderBy("prefix")))
        edge = upto.filter("upto > budget AND upto - size <= budget AND size > 0")
        edge = scratch.save(edge.select("s", "prefix", (F.col("upto") - F.col("size")).alias("before"), "budget", "size", "lo", "hi"))
        found.append(edge.filter("lo = hi"))
        open_ = edge.filter("lo < hi").select("s", "prefix", "before", "budget")
        if not open_.limit(1).count():
            break
    ends = found[0]
    for x in found[1:]:
        ends = ends.union(x)
    # the document at the edge is taken if that comes nearer to the target
    cut = F.when(F.col("budget") - F.col("before") > F.col("before") + F.col("size") - F.col("budget"), F.concat("lo", F.lit("~"))).otherwise(F.col("lo"))
    ends = ends.select("s", cut.alias("cut"))
    return scratch.save(rows.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut")))


def with_copies(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, copies, source_size, target) for each row of ``docs``, which stands in the struct ``row`` whatever its columns are called."""
    small = plan.count() <= BROADCAST_ROWS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(F.broadcast(plan) if small else plan, F.col("row")[source_col].eqNullSafe(F.col("source")))
    copies = F.col("whole") + (_hash(F.col("row")[id_col], F.col("row")[text_col]) < F.col("cut")).cast("long")
    return rows.select("row", copies.alias("copies"), "source_size", "target")


def taken(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``.

    Null texts have size 0; a null source is a source, the last one; repeated
    rows share a hash and are taken alike; sources without words have target 0;
    an empty table gives no rows; other columns are ignored.
    """
    rows = with_copies(docs.select(F.col(id_col).alias("doc_id"), "source", "text"), plan(docs, id_col))
    size = ts.word_count(F.col("row.text"))
    return rows.select("row.doc_id", size.alias("size"), "source_size", "target", (size * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents of the mix, with the columns of ``docs``; a document taken twice is there twice.

    Null texts, null sources, repeated rows and empty tables as in ``taken``: a
    document without words is taken like others, as often as its hash says.
    Columns may have any names; they stay as they are.
    """
    rows = with_copies(docs, plan(docs, id_col)).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
w AS (SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][(k - 1) % {len(WEIGHTS)} + 1] AS BIGINT) AS weight FROM k),
c AS (
  SELECT *, CAST(coalesce(sum({MOST} * source_size) OVER before, 0) AS DOUBLE) AS cut, CAST(coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS gone,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total, CAST(sum(weight) OVER () AS DOUBLE) AS weights
  FROM w WINDOW before AS (ORDER BY source_size * 1.0 / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (CAST({SHARE} AS DOUBLE) * total - cut) / (weights - gone) AS level FROM c),
one AS (SELECT arg_min(level, gone) AS level FROM l WHERE level * weight <= {MOST} * CAST(source_size AS DOUBLE)),
t AS (SELECT source, source_size, least(one.level * weight, {MOST} * CAST(source_size AS DOUBLE)) AS target FROM l, one),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN upto <= budget OR (upto - own <= budget AND budget - (upto - own) > upto - budget) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
