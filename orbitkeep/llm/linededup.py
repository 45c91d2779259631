"""Line dedup: near-equal lines by MinHash over character shingles.

A line is a run between line feeds; lines without a word are left alone.  Lines
are compared as trimmed and A-Z lower-cased: sets of 64-bit hashes of all
``SIZE``-character shingles (a character is a code point, whatever its bytes; a
shorter line is one shingle).  A line of 49 characters with one changed in its
middle is just within the similarity of 0.8.

Equal lines are one class from the start.  Signatures are one-permutation
minhashes with empty bins filled from others; classes that agree on one of
``BANDS`` bands of ``ROWS`` bins are candidates (a pair at similarity 0.8 is
missed with probability 7e-4, at 0.85 with 1.2e-5); exact Jaccard similarity of
the full sets confirms; distributed union-find joins what is linked, and of each
component the first line by (document id, digest of the text, line number) is
kept.

Only classes are compared and labelled: their occurrences are counted, and their
first place found, by a partial aggregate, so that a line that stands in a third
of all documents is a row like others until the last join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .linking import bounded, labelled, link_members, one_each
from .scratch import Scratch, unused

SIZE = 5
BANDS, ROWS = 24, 6
BINS = BANDS * ROWS
#: Lines are linked at this similarity.
NUM, DEN = 80, 100
#: Classes that a task remembers at most, so as not to band them again, and entries of bands that it gathers before it passes them on.
REMEMBERED, GATHER = 1 << 18, 1 << 18
#: Buckets of band keys a shuffle partition: a bucket is sorted in memory.
BUCKETS = 8
#: Bytes of a signature kept beside a line.
MARKS = 128
#: Groups that share a band are compared in full up to this size, larger ones by centres and rare shingles.
SMALL = 64

_rng = np.random.default_rng(0x11E5)
_STEP = _rng.integers(0, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BORROW = _rng.integers(0, BINS, (96, BINS))
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = np.uint64((1 << 64) - 1)
_ENTRY = np.dtype([("key", "<u4"), ("cls", "<i8")])


def _moved(data: np.ndarray, at: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
    """Each place moved by steps of 1 or -1 over white space, to ``stop`` at most; places and stops name the byte looked at."""
    at, left = at.copy(), np.arange(len(at))
    for _ in range(32):  # longer runs of white space are rare
        left = left[(at[left] != stop[left]) & tc.SPACE[data[at[left].clip(0, len(data) - 1)]]]
        if not len(left):
            return at
        at[left] += step
    inked = np.flatnonzero(~tc.SPACE[data])
    inked = np.concatenate([[-1], inked, [len(data)]])
    found = inked[np.searchsorted(inked, at[left])] if step > 0 else inked[np.searchsorted(inked, at[left], side="right") - 1]
    at[left] = np.minimum(found, stop[left]) if step > 0 else np.maximum(found, stop[left])
    return at


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, start, end) of the lines with a word, trimmed."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 4
    feeds = np.flatnonzero(data == 10)
    cuts = np.searchsorted(feeds, offsets)
    n = np.diff(cuts) + 1  # lines of each row
    row = np.repeat(np.arange(len(n)), n)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    number = np.arange(len(row)) - first[row]
    starts, ends = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    starts[first], ends[first + n - 1] = offsets[:-1], offsets[1:]
    inner = number > 0
    starts[inner] = feeds + 1
    ends[np.flatnonzero(inner) - 1] = feeds
    starts = _moved(data, starts, ends, 1)
    full = starts < ends
    row, number, starts, ends = row[full], number[full], starts[full], ends[full]
    return row, number, starts, _moved(data, ends - 1, starts, -1) + 1


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points, A-Z lower-cased, and the places of the bytes that do not start one."""
    low, inner = tc.LOWER[data], np.flatnonzero((data & 0xC0) == 0x80)
    if not len(inner):
        return low.astype(np.uint32), inner
    try:
        return np.frombuffer(low.tobytes().decode().encode("utf-32-le"), np.uint32), inner
    except UnicodeDecodeError:  # somewhere in the chunk: any byte but an inner one starts a character
        where = np.flatnonzero((data & 0xC0) != 0x80)
        four = np.concatenate([low, np.zeros(3, np.uint8)]).astype(np.uint32)
        a, b, c, d = (four[where + k] & (0xFF if not k else 0x3F) for k in range(4))
        size = np.minimum(np.diff(np.append(where, len(data))), 4)
        made = [a, (a & 31) << 6 | b, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d]
        return np.choose(size - 1, made).astype(np.uint32), inner


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles that start at each character, and for each line its first one and how many it has."""
    chars, inner = characters(data)
    first = starts - np.searchsorted(inner, starts)
    size = ends - np.searchsorted(inner, ends) - first
    chars = np.concatenate([chars, np.zeros(SIZE, np.uint32)])
    grams = np.empty(len(chars) - SIZE + 1, np.uint64)
    for i in range(0, len(grams), tc.BLOCK):
        part = chars[i : i + tc.BLOCK + SIZE - 1].astype(np.uint64)
        n = len(part) - SIZE + 1
        own = part[:n] * _STEP[0]
        for j in range(1, SIZE):
            own += part[j : n + j] * _STEP[j]
        grams[i : i + n] = tc.mix(own)
    short = np.flatnonzero(size < SIZE)
    if len(short):
        own = size[short].astype(np.uint64)
        for j in range(SIZE - 1):
            own += np.where(j < size[short], chars[first[short] + j].astype(np.uint64) * _STEP[j], np.uint64(0))
        grams[first[short]] = tc.mix(own)
    return grams, first, np.maximum(size - SIZE + 1, 1)


def line_shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the lines (repeats too) and their offsets."""
    grams, first, n = _grams(data, starts, ends)
    at = np.concatenate([[0], np.cumsum(n)])
    return grams[np.repeat(first - at[:-1], n) + np.arange(at[-1])], at


def signatures(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(lines, BINS): the smallest hash of each bin; empty bins take another bin's value, by fixed draws."""
    n = len(at) - 1
    own = np.full((n, BINS), _EMPTY)
    place = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    place += np.repeat(np.arange(n) * BINS, np.diff(at))
    np.minimum.at(own.reshape(-1), place, shingles)
    out = own.copy()
    place = np.flatnonzero(own.reshape(-1) == _EMPTY)
    line, bin_ = place // BINS, place % BINS
    for draw in _BORROW:
        if not len(line):
            return out
        value = own[line, draw[bin_]]
        left = value == _EMPTY
        out[line, bin_] = value
        line, bin_ = line[left], bin_[left]
    out[line, bin_] = own.min(axis=1)[line]
    return out


def _occurrences(batches):
    for batch in batches:
        ids, digests = batch.column(0), batch.column(1)
        for i, j, data, offsets in tc.chunks(batch.column(2)):
            row, number, starts, ends = lines(data, offsets)
            if len(row):
                cls, at = tc.span_hashes(data, starts, ends).view(np.int64), pa.array(row)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(at), digests.slice(i, j - i).take(at), pa.array(number.astype(np.int32)), pa.array(cls)], names=["id", "digest", "line", "cls"])


def _bands(n_buckets: int):
    """(bucket, data): the entries of a bucket, 12 bytes each: 32 bits of a band's key and the class.

    A class that the task has met is not banded again, as far as it remembers.
    """

    def packed(held: list) -> pa.RecordBatch:
        key, cls = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = ((key >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.uint16 if n_buckets <= 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        entries = np.empty(len(key), _ENTRY)
        entries["key"], entries["cls"] = key[order].astype(np.uint32), cls[order]
        bucket = bucket[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        cuts = pa.array(np.append(first, len(key)) * _ENTRY.itemsize, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), pa.Array.from_buffers(pa.binary(), len(first), [None, cuts.buffers()[1], pa.py_buffer(entries)])], names=["bucket", "data"])

    def run(batches):
        known, held, size = np.zeros(0, np.int64), [], 0
        for batch in batches:
            for _, _, data, offsets in tc.chunks(batch.column(0)):
                _, _, starts, ends = lines(data, offsets)
                cls, one = np.unique(tc.span_hashes(data, starts, ends).view(np.int64), return_index=True)
                new = ~np.isin(cls, known, assume_unique=True)
                cls, one = cls[new], one[new]
                if not len(cls):
                    continue
                known = np.concatenate([known, cls]) if len(known) < REMEMBERED else cls
                table = signatures(*line_shingles(data, starts[one], ends[one])).reshape(-1, BANDS, ROWS)
                key = tc.mix(np.sum(table * _BAND, axis=2, dtype=np.uint64))
                held.append((key.ravel(), np.repeat(cls, BANDS)))
                size += key.size
                if size > GATHER:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return run


def _shared(batches):
    """Of rows sorted by bucket, (key, cls, centre, size) of the keys with several classes: the smallest is the centre, and each other one has a row."""

    def cut(bucket: int, held: list) -> pa.RecordBatch:
        entries = np.frombuffer(b"".join(held), _ENTRY)
        order = np.lexsort((entries["cls"], entries["key"]))
        key, cls = entries["key"][order], entries["cls"][order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
        key, cls = key[new], cls[new]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        size, of, other = np.diff(np.append(np.flatnonzero(first), len(key))), np.cumsum(first) - 1, ~first
        columns = key.astype(np.int64) + (bucket << 32), cls, cls[first][of], size[of].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x[other]) for x in columns], names=["key", "cls", "centre", "size"])

    last, held = None, []
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != last and held:
                yield cut(last, held)
                held = []
            last = bucket
            held.append(data)
    if held:
        yield cut(last, held)


def gram_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of whole lines."""
    grams, cuts = line_shingles(data, offsets[:-1], offsets[1:])
    return [tc.distinct(grams[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _line_bodies(batches):
    """(cls, n, body, marks) of the lines (cls, line) wanted from each text."""
    for batch in batches:
        for i, j, data, offsets in tc.chunks(batch.column(0)):
            wanted = batch.column(1).slice(i, j - i)
            cls, line = (wanted.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            row, number, starts, ends = lines(data, offsets)
            at = np.searchsorted(row << 32 | number, np.repeat(np.arange(j - i), wanted.value_lengths().to_numpy()) << 32 | line)
            if not len(at):
                continue
            bodies = [data[a:b].tobytes() for a, b in zip(starts[at], ends[at], strict=True)]
            stops = np.cumsum([len(x) for x in bodies])
            grams, cuts = line_shingles(np.frombuffer(b"".join(bodies), np.uint8), np.concatenate([[0], stops[:-1]]), stops)
            marks = np.ascontiguousarray((tc.mix(signatures(grams, cuts)[:, :MARKS]) & np.uint64(255)).astype(np.uint8))
            n = [len(tc.distinct(grams[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(n, pa.int64()), pa.array(bodies, pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary())], names=["cls", "n", "body", "marks"])


def _on_document(docs: DataFrame, own: DataFrame) -> list:
    """Documents are told apart by id and digest of the text: the id may be null or there twice."""
    return [docs["id"].eqNullSafe(own["id"]), docs["digest"] == own["digest"]]


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, dropped): for each document with lines to drop, their numbers from 0; digest is xxhash64 of its text."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    found = scratch.save(docs.mapInArrow(_occurrences, f"id {kind}, digest long, line int, cls long"))
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select("text").mapInArrow(_bands(n_parts * BUCKETS), "bucket long, data binary").repartition(n_parts, "bucket").sortWithinPartitions("bucket")
    members = scratch.save(packed.mapInArrow(_shared, "key long, cls long, centre long, size long"))

    # the classes that are there several times or to be compared, each with its first place
    compared = members.select("cls").union(members.select(F.col("centre").alias("cls"))).groupBy("cls").agg(F.lit(True).alias("compared"))
    twice = found.groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1")
    asked = scratch.save(compared.join(twice, "cls", "full").select("cls", F.col("n").isNotNull().alias("twice"), F.col("compared").isNotNull().alias("compared")))
    classes = found.join(bounded(asked, asked.count()), "cls").groupBy("cls", "twice", "compared").agg(F.min(F.struct("id", "digest", "line")).alias("first"))
    classes, n_compared = scratch.save(classes), asked.filter("compared").count()

    # the lines to compare, each from the document of its first place
    wanted = classes.filter("compared").groupBy("first.id", "first.digest").agg(F.collect_list(F.struct("cls", "first.line")).alias("wanted"))
    wanted = scratch.save(wanted)
    text = docs.join(bounded(wanted, n_compared), _on_document(docs, wanted)).select("text", "wanted")
    sets = one_each(text.mapInArrow(_line_bodies, "cls long, n long, body binary, marks binary"), scratch)
    labels = link_members(members, sets, gram_sets, scratch, NUM, DEN, SMALL)
    scratch.drop(sets, wanted, asked)

    # the first place of each component, then of each of its classes, then of each occurrence
    own = labels.toDF("cls", "comp").join(classes, "cls", "right").filter("twice OR comp IS NOT NULL").withColumn("comp", F.coalesce("comp", "cls"))
    own = scratch.save(own.select("cls", "comp", "first"))
    firsts = scratch.save(own.groupBy("comp").agg(F.min("first").alias("kept")))
    kept = scratch.save(own.join(bounded(firsts, firsts.count()), "comp").select("cls", "kept"))
    gone = found.join(bounded(kept, kept.count()), "cls").filter(~F.struct("id", "digest", "line").eqNullSafe(F.col("kept")))
    gone = scratch.save(gone.groupBy("id", "digest").agg(F.sort_array(F.collect_set("line")).alias("dropped")))
    scratch.drop(found, classes, own, firsts, kept)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines of each text, and n_lines and dropped_lines added (columns of those names are replaced).

    A document of which no line with a word is left has an empty text.  Null
    texts stay null, texts without repeated lines stay as they are.  Rows that
    agree in id and text are one document, there several times, and have one
    result; rows of one id (or of the null id, which comes first) with different
    texts are different documents.  Repeats within one text are dropped like
    others.  An empty table gives no rows; other columns may have any names.
    """
    gone = repeated_lines(docs, id_col, text_col)
    kept = [c for c in docs.columns if c not in ("n_lines", "dropped_lines")]
    id_, digest, dropped, parts, rest = (unused(c, docs.columns) for c in ("id", "digest", "dropped", "parts", "rest"))
    gone = bounded(gone, gone.count()).toDF(id_, digest, dropped)
    rows = docs.select(*kept).join(gone, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text_col) == F.col(digest)), "left")
    rows = rows.withColumn(parts, F.when(F.col(dropped).isNotNull(), F.split(F.col(text_col), "\n")))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(dropped)), lambda i: F.get(parts, i))
    rows = rows.withColumn(rest, F.when(F.col(dropped).isNotNull(), F.array_join(left, "\n")))
    text = F.when(F.trim(rest, F.lit(" \t\n\x0b\f\r")) == "", F.lit("")).otherwise(F.coalesce(rest, text_col))
    shown = [text.alias(c) if c == text_col else F.col(c) for c in kept]
    n_lines = F.coalesce(F.octet_length(text_col) - F.octet_length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return rows.select(*shown, n_lines.alias("n_lines"), F.coalesce(dropped, F.array().cast("array<int>")).alias("dropped_lines"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines; documents of which nothing is left are gone, those that were empty or null before stay.

    Nulls, repeated rows, ties and empty tables as in ``dedup_lines``; the columns are those of ``docs``, whatever their names.
    """
    n_lines, dropped = (unused(c, docs.columns) for c in ("n_lines", "dropped_lines"))
    plain = docs.withColumnsRenamed({"n_lines": n_lines, "dropped_lines": dropped})
    rows = dedup_lines(plain, id_col, text_col).filter((F.size("dropped_lines") == 0) | (F.col(text_col) != ""))
    return rows.select(*plain.columns).withColumnsRenamed({n_lines: "n_lines", dropped: "dropped_lines"})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)
