"""Document fingerprints from closed syncmers.

A k-mer of bytes is kept if the smallest hash of its inner s-mers stands at its
first or last place.  Whether a k-mer is kept depends on nothing around it, so a
passage shared by two texts gives the same anchors in both, wherever it stands;
any k - s + 1 neighbouring k-mers hold at least one.  A fingerprint is the
anchors of the smallest hashes, ``KEEP`` at most, in the order of their
positions, after the number of distinct anchors; it has a bounded size for texts
of any length, and equal texts have equal ones.

The printed fingerprint is that compact form; the likeness of two texts is
computed from all anchors of both, 2 * matched / (anchors of both), repeats
included.  Anchors are matched in order of position: equal starts and ends, then
the longest run of anchors that occur once in both in the same order, then the
gaps between these in the same way, so a reordered text is unlike its original.
In a gap without such anchors, repeated ones are matched by their occurrence.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

K, S = 16, 6
#: Anchors of a printed fingerprint at most.
KEEP = 128
#: Ranges of ids a partition, and rows held as Python strings at once.
RANGES, ROWS = 4, 256

_CODES = np.random.default_rng(0x5C).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _rolling(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-mers."""
    h = np.zeros(len(data) - n + 1, np.uint64)
    codes = _CODES[data]
    for i in range(n):
        h *= _BASE
        h += codes[i : i + len(h)]
    return tc.mix(h)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minima of all windows of n values, by doubling."""
    size, out = 1, x
    while size * 2 <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each span of bytes the places and 32-bit hashes of its closed syncmers; a span without one (under K bytes, or up to 2 * K - S - 1 bytes by chance) is one anchor itself."""
    out = []
    if len(data) >= K:
        small = _rolling(data, S)
        window = K - S + 1
        low = _least(small, window)
        n = len(low)
        kept = np.flatnonzero((low == small[:n]) | (low == small[window - 1 : window - 1 + n]))
        # a k-mer's hash from those of three s-mers that cover it
        mid = (K - S) // 2
        h = (tc.mix(small[kept] ^ (small[kept + mid] * _BASE) ^ tc.mix(small[kept + K - S])) >> np.uint64(32)).astype(np.uint32)
    else:
        kept, h = np.zeros(0, np.int64), np.zeros(0, np.uint32)
    lo, hi = np.searchsorted(kept, starts), np.searchsorted(kept, ends - K, side="right")
    for a, b, i, j in zip(starts, ends, lo, hi, strict=True):
        if j > i:
            out.append((kept[i:j] - a, h[i:j]))
        elif b > a:
            own = hashlib.blake2b(data[a:b].tobytes(), digest_size=4).digest()
            out.append((np.zeros(1, np.int64), np.frombuffer(own, np.uint32)))
        else:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.uint32)))
    return out


def sketch(h: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of distinct anchors, the smallest KEEP of them in the order of their first places, and all anchors by place."""
    ordered, first = np.unique(h, return_index=True)
    return len(ordered), h[np.sort(first[:KEEP])], h


def text_of(own: tuple[int, np.ndarray, np.ndarray]) -> str:
    return f"{own[0]}:{own[1].astype('>u4').tobytes().hex()}"


def _rising(x: np.ndarray) -> np.ndarray:
    """Places of the longest rising subsequence of distinct values: patience piles with links back."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, v in enumerate(x.tolist()):
        pile = bisect_left(tops, v)
        back.append(ends[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [v]
        ends[pile : pile + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return np.array(out[::-1], np.int64)


def _occurrence(h: np.ndarray) -> np.ndarray:
    """How many equal values come before each."""
    order = np.argsort(h, kind="stable")
    one = h[order]
    first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return out


def _once(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur once, sorted, and their places."""
    one, first, n = np.unique(h, return_index=True, return_counts=True)
    return one[n == 1], first[n == 1]


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """How many anchors match in order of position."""
    total, stack = 0, [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        n = min(a1 - a0, b1 - b0)
        if n <= 0:
            continue
        unlike = np.flatnonzero(a[a0 : a0 + n] != b[b0 : b0 + n])
        same = int(unlike[0]) if len(unlike) else n
        a0, b0, n = a0 + same, b0 + same, n - same
        total += same
        if not n:
            continue
        unlike = np.flatnonzero(a[a1 - n : a1][::-1] != b[b1 - n : b1][::-1])
        same = int(unlike[0]) if len(unlike) else n
        a1, b1 = a1 - same, b1 - same
        total += same
        if a0 >= a1 or b0 >= b1:
            continue
        x, y = a[a0:a1], b[b0:b1]
        (u, p), (v, q) = _once(x), _once(y)
        _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        if len(i):
            p, q = p[i], q[j]
            order = np.argsort(p)
            p, q = p[order], q[order]
            run = _rising(q)
            p, q = p[run], q[run]
            total += len(run)
            stack += zip((np.concatenate([[-1], p]) + 1 + a0).tolist(), (np.append(p, len(x)) + a0).tolist(), (np.concatenate([[-1], q]) + 1 + b0).tolist(), (np.append(q, len(y)) + b0).tolist(), strict=True)
            continue
        # each anchor with its occurrence occurs once: these match in order of position
        both = np.intersect1d(x, y)
        if not len(both):
            continue
        keys = [dict(zip(zip(z.tolist(), _occurrence(z).tolist(), strict=True), range(len(z)), strict=True)) for z in (x, y)]
        total += len(_rising(np.array([keys[1][k] for k in keys[0] if k in keys[1]], np.int64)))
    return total


def likeness(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> float:
    """From all anchors in order of position; 1 for equal texts, two empty ones included; 0 for one empty one."""
    x, y = a[2], b[2]
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    return 2 * matched(x, y) / (len(x) + len(y))


def _fingerprints(texts: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Sketches and anchors of many texts; several are hashed together."""
    out, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= tc.CHUNK_BYTES // 4):
            size += len(texts[j])
            j += 1
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts[i:j]])])
        data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        out += [sketch(h) for _, h in anchors(data, at[:-1], at[1:])]
        i = j
    return out


def _with_prints(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).fill_null("")
        raw = [t.encode() for t in texts.to_pylist()]
        made = [text_of(s) for s in _fingerprints(raw)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each row; null texts are empty, and the empty text's fingerprint is "0:"."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_with_prints, "doc_id long, fingerprint string")


def edited(a: str, b: str) -> str:
    """``a`` with its last half replaced by as many first characters of ``b``, or all of them."""
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


def _cuts_up_to(x, cuts: list[int], equal: bool):
    """How many of the sorted cuts are under x (or equal to it), by a coarse list and then one of its parts."""
    if not cuts:
        return F.lit(0)
    step = int(len(cuts) ** 0.5) + 1
    counted = lambda values: F.size(F.filter(values, lambda e: (e <= x) if equal else (e < x)))
    longs = lambda own: F.array(*[F.lit(c).cast("long") for c in own])
    coarse = counted(longs(cuts[::step]))
    parts = F.array(*[longs(cuts[i : i + step]) for i in range(0, len(cuts), step)])
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + counted(F.get(parts, coarse - 1)))


def _range_of(x, digest, cuts: list[int], null_ranges: int):
    """The range of an id, in order of (id, digest), nulls last; an id that is several cuts, and the null id, have several ranges."""
    before = _cuts_up_to(x, cuts, False)
    place = digest / F.lit(float(1 << 64)) + 0.5
    of = lambda n: F.least(F.floor(place * n).cast("int"), n - 1)
    own = _cuts_up_to(x, cuts, True) - before
    return F.when(x.isNull(), len(cuts) + 1 + of(F.lit(null_ranges))).otherwise(before + F.when(own > 1, of(own)).otherwise(F.lit(0))).cast("int")


def _compare(batches):
    """Rows in order of (range, id): each is compared with the one after it."""
    last = None  # range, id, text, sketch
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            ranges, ids, own, texts = (c.to_pylist() for c in batch.slice(i, ROWS).columns)
            texts = [t or "" for t in texts]
            pairs = []
            for now in zip(ranges, ids, texts, _fingerprints([t.encode() for t in texts]), own, strict=True):
                if last is not None and last[0] == now[0]:
                    pairs.append((last, now))
                last = now if now[4] else None  # a row lent by the next range only follows
            if pairs:
                yield _compared(pairs)


def _compared(rows: list) -> pa.RecordBatch:
    made = [edited(a[2], b[2]).encode() for a, b in rows]
    prints = _fingerprints(made)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[1] for a, _ in rows], pa.int64()),
            pa.array([len(a[2]) for a, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in made], pa.string()),
            pa.array([text_of(a[3]) for a, _ in rows], pa.string()),
            pa.array([text_of(p) for p in prints], pa.string()),
            pa.array([likeness(a[3], p) for (a, _), p in zip(rows, prints, strict=True)], pa.float64()),
            pa.array([likeness(a[3], b[3]) for a, b in rows], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document by ascending id; after the last comes the first.

    Ids are cut into ranges of about equal size; a range is sorted in one task,
    and its successor's first rows are lent to it, so texts are shuffled once.
    Null texts are empty; rows of a null id come last, rows of one id are in
    the order of a digest of their texts, and are dealt over several ranges if they are many; a
    single row is its own next one.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    n_ranges = RANGES * n_parts
    cuts = base.filter("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n_ranges for i in range(1, n_ranges)], 0.2 / n_ranges)
    nulls = base.agg(F.coalesce(F.avg(F.col("doc_id").isNull().cast("int")), F.lit(0.0))).first()[0]
    ranged = base.withColumn("bucket", _range_of(F.col("doc_id"), F.col("digest"), sorted(int(c) for c in cuts), 1 + int(nulls * n_ranges)))
    # at the driver: the first id and digest of each range
    firsts = sorted(ranged.groupBy("bucket").agg(F.min(F.struct("doc_id", "digest")).alias("first")).collect(), key=lambda r: r["bucket"])
    lends = spark.createDataFrame([(*r["first"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)], "first long, first_digest long, before int")
    rows = ranged.join(F.broadcast(lends), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("first_digest")), "left")
    places = F.array(F.struct("bucket", F.lit(True).alias("own")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(False).alias("own"))))
    rows = rows.select("doc_id", "digest", "text", F.explode(F.array_compact(places)).alias("at")).select("at.bucket", "doc_id", "at.own", "text", "digest")
    placed = rows.repartition(n_parts, "bucket").sortWithinPartitions("bucket", F.col("own").desc(), F.col("doc_id").asc_nulls_last(), "digest", "text").drop("digest")
    return placed.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark, sf_dir: str) -> DataFrame:
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
