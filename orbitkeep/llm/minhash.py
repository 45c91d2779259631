"""Near-duplicate documents: MinHash with tensored banding, verified on full sets.

Banding with L tables of K values each usually needs K * L minhashes.  Here two
collections of ``SIDE`` sub-keys are drawn, each sub-key from ``PER_KEY``
minhashes, and table (i, j) is keyed by the pair (left i, right j): SIDE ** 2
tables from 2 * SIDE * PER_KEY minhashes.  With 16 and 4, a pair at similarity
0.85 is missed by all 256 tables with probability 1.5e-5.

How hot groups are kept cheap, without losing a link:

* documents with equal shingle sets are one class from the start (a partial
  aggregate), so copies never meet in a table;
* right keys are expanded only for left keys that two classes share;
* in a bucket each class is first compared with one centre only; links found
  there are joined into components, and buckets within one component are done;
* what is left open is looked at by centre, the buckets of one together: a row for
  each class and centre, not for each table;
* for the rest, a class that shares c of its n shingles with other classes can
  only link to a class of at most c * (t + 1) / t - n shingles, where t is the
  threshold; this exact bound removes the many almost-similar members of a
  family; those that remain are compared with the centre that shares the most,
  and at last, across components only, with all that share one of the rarest
  shingles (prefix filtering, exact as well).

Pairs are confirmed by intersecting their full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .linking import bounded, labelled, link_members, one_each
from .scratch import Scratch, unused

SIDE, PER_KEY = 16, 4
FRAGMENTS = SIDE * PER_KEY * 2

_rng = np.random.default_rng(0x7E45)
_XOR = _rng.integers(0, 1 << 63, FRAGMENTS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, FRAGMENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COMBINE = _rng.integers(0, 1 << 63, PER_KEY, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def class_key(own: np.ndarray) -> int:
    """64-bit key of a sorted set of hashes; 0 for the empty set only."""
    if not len(own):
        return 0
    with np.errstate(over="ignore"):
        a = np.sum(tc.mix(own ^ np.uint64(0xA5A5A5A5DEADBEEF)), dtype=np.uint64) + np.uint64(len(own))
    return int(tc.mix(np.array([a]))[0].astype(np.int64)) or 1


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, FRAGMENTS) minima; rows of empty sets are zero."""
    out = np.zeros((FRAGMENTS, len(sets)), np.uint64)
    full = np.array([len(s) > 0 for s in sets])
    if full.any():
        joined = np.concatenate(sets)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1][full]
        low = np.empty_like(joined)
        for i in range(FRAGMENTS):
            np.bitwise_xor(joined, _XOR[i], out=low)
            np.multiply(low, _MUL[i], out=low)
            out[i, full] = np.minimum.reduceat(low, at)
    return np.ascontiguousarray(out.T)


def _groups(sets: list[np.ndarray], most: int = 1 << 17):
    """Slices of sets of about ``most`` hashes, so that they stay in the cache."""
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= most):
            n += len(sets[j])
            j += 1
        yield i, j
        i = j


def _signatures(batches):
    for batch in batches:
        ids, digests = batch.column(0), batch.column(1)
        for i, j, data, offsets in tc.chunks(batch.column(2)):
            sets = tc.shingle_sets(data, offsets)
            keys = np.concatenate([minhashes(sets[p:q]) for p, q in _groups(sets)])
            sub = tc.mix(np.sum(tc.mix(keys).reshape(len(sets), 2, SIDE, PER_KEY) * _COMBINE, axis=3, dtype=np.uint64)).astype(np.int64)
            at = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SIDE)
            sides = [pa.ListArray.from_arrays(at, pa.array(sub[:, s].ravel())) for s in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), digests.slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) for s in sets], pa.int64()), *sides],
                names=["id", "digest", "n", "cls", "left", "right"],
            )


def _marked(batches):
    """Minhash fragments and sizes of the texts that have the class they were asked for."""
    for batch in batches:
        for i, j, data, offsets in tc.chunks(batch.column(1)):
            asked, body = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
            sets = tc.shingle_sets(data, offsets)
            right = np.flatnonzero([class_key(s) == c for s, c in zip(sets, asked.to_pylist(), strict=True)])
            if len(right):
                own = [sets[k] for k in right]
                keys = np.concatenate([minhashes(own[p:q]) for p, q in _groups(own)])
                marks = (tc.mix(keys) & np.uint64(255)).astype(np.uint8)
                at = pa.array(right)
                yield pa.RecordBatch.from_arrays([asked.take(at), pa.array([len(s) for s in own], pa.int64()), body.take(at), pa.array([m.tobytes() for m in marks], pa.binary())], names=["cls", "n", "body", "marks"])


def _buckets(signed: DataFrame) -> DataFrame:
    """(key, cls, centre, size) of the buckets of all tables that hold two classes or more: the smallest is the centre, and each other one has a row."""
    full = signed.filter("n > 0")
    left = full.select("cls", F.posexplode("left").alias("i", "v"))
    shared = left.groupBy("i", "v").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi").select("i", "v")
    masks = left.join(shared, ["i", "v"]).groupBy("cls").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    rows = full.select("cls", "left", "right").join(masks, "cls").dropDuplicates(["cls"])
    rows = rows.select("cls", "right", F.explode(F.expr("filter(transform(left, (v, i) -> struct(i, v)), x -> shiftright(mask, x.i) & 1 = 1)")).alias("l"))
    rows = rows.select("cls", "l.i", "l.v", F.posexplode("right").alias("j", "w"))
    keyed = rows.select("cls", F.xxhash64("i", "v", "j", "w").alias("key"))
    multi = keyed.groupBy("key").agg(F.min("cls").alias("centre"), F.count("*").alias("size")).filter("size > 1")
    return keyed.join(multi, "key").filter("cls <> centre")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Documents are linked if den * |A and B| >= num * |A or B| for their sets of
    5-word shingles (fewer words: the whole sequence; no words: linked with
    nothing).  component_id is the smallest id reachable; kept marks the row of
    that id.  Null texts are empty.  Rows of equal ids and texts get equal
    results; rows of a null id are linked like others, never lend their id to a
    component and are kept only if their component has no id (component_id is
    null then).  Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    # ids may be null or there twice: a class's text is found by id and digest
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    signed = scratch.save(docs.mapInArrow(_signatures, "id long, digest long, n long, cls long, left array<long>, right array<long>"))
    members = scratch.save(_buckets(signed))
    places = signed.select("cls", F.struct("id", "digest").alias("place"))
    candidates = members.select("cls").union(members.select("centre")).distinct().join(places, "cls").groupBy("cls").agg(F.min("place").alias("place"))
    candidates = scratch.save(candidates.select("cls", F.col("place.id").alias("id"), F.col("place.digest").alias("digest")))
    same = docs["id"].eqNullSafe(candidates["id"]) & (docs["digest"] == candidates["digest"])
    text = docs.join(bounded(candidates, candidates.count()), same).select("cls", F.col("text").cast("binary").alias("body"))
    sets = one_each(text.mapInArrow(_marked, "cls long, n long, body binary, marks binary"), scratch)
    link = link_members(members, sets, tc.shingle_sets, scratch, num, den)
    scratch.drop(candidates, sets)

    # documents: the smallest id of each component
    grouped = labelled(signed.filter("n > 0").select("id", "n", "cls"), link, "cls", "comp")
    least = grouped.groupBy("comp").agg(F.min("id").alias("component_id"))
    linked = grouped.join(least, "comp").select("id", "n", "component_id")
    alone = signed.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose document is kept, as they are; of rows with one id, one stays.

    Rows of a null id cannot be told apart and stay.  Documents without words
    are linked with nothing and stay; an empty table gives no rows; other
    columns may have any names.
    """
    id_ = unused("id", docs.columns)
    found = near_duplicates(docs, id_col, text_col, num, den).filter(F.col("doc_id").isNotNull())
    gone = Scratch(docs.sparkSession).save(found.filter("NOT kept").select(F.col("doc_id").alias(id_)).distinct())
    left = docs.join(bounded(gone, gone.count()), F.col(id_col) == F.col(id_), "left_anti")
    twice = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(id_)).agg(F.count("*").alias("n")).filter("n > 1").select(id_)
    if not twice.limit(1).count():
        return left
    same = F.col(id_col) == F.col(id_)
    return left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates([id_col]))
