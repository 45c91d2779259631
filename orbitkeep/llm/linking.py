"""Components of classes that share a bucket, by exact similarity of their sets.

Works on members (key, cls) of buckets and sets (cls, n, body, marks): body is
the text that a set is made from, a fraction of the size of the set's hashes,
and marks are one-byte fragments of minhashes.  ``decode`` turns the bytes of
many bodies and their offsets into sorted arrays of distinct hashes.  A pair is
linked if den * |A and B| >= num * |A or B|.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .components import contracted, with_roots
from .scratch import Scratch

#: Rows broadcast at most (about 16 bytes each); beyond that, a shuffled join.
BROADCAST_ROWS = 500_000
#: How far under the threshold an estimate from marks may be, in its standard deviations at 0.8: a linked pair is further off with probability 1.4e-5.
DEVIATIONS = 4.2
#: Pairs or bodies whose sets a task holds at once.
PAIRS = 256
#: Bytes of packed shingles that a task gathers before it passes them on.
ENTRY_BYTES = 1 << 22
#: Shingles a bucket, and buckets a shuffle partition at most: a task makes a row for each bucket that it has shingles for.
BUCKET_ENTRIES, BUCKETS = 1 << 14, 8
#: Candidates that a task looks at, at once.
CANDIDATES = 1 << 14
#: Classes of a family on either side of a block of pairs, and pairs that groups of smaller blocks are filled with.
BLOCK, GROUP_PAIRS = 1 << 10, 1 << 12
#: Rounds of union-find between two comparisons of which the second only profits from labels.
ROUNDS = 2


def bounded(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def _least(num: int, den: int, width: int) -> float:
    """The estimate from ``width`` marks down to which a pair may reach the threshold."""
    return num / den - DEVIATIONS * 0.4 / width**0.5


def _estimate(num: int, den: int):
    def run(batches):
        for x in batches:
            if x.num_rows:
                p, q = (np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint8).reshape(x.num_rows, -1) for k in (2, 3))
                least = _least(num, den, p.shape[1])
                same = _likeness(p, q)
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(same)], names=["a", "b", "likeness"]).filter(pa.array(same >= least))

    return run


#: An open class's shingle; the same with how often it occurs, the smallest set with it, and whether its component has it most often.
_HASH = np.dtype([("h", "<i8"), ("cls", "<i8"), ("comp", "<i8"), ("n", "<i4")])
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])
_SEEN = np.dtype([*_HASH.descr, ("df", "<i4"), ("least", "<i4"), ("main", "?")])


def _marked(width: int) -> np.dtype:
    return np.dtype([("cls", "<i8"), ("marks", "u1", (width,))])


def _placed(width: int) -> np.dtype:
    """A shingle of a class's prefix, with its place."""
    return np.dtype([*_HASH.descr, ("at", "<i4"), ("main", "?"), ("marks", "u1", (width,))])


class _Dealt:
    """Entries gathered and dealt to buckets by a hash of one of their fields, as rows (bucket, kind, data)."""

    SCHEMA = "bucket int, kind int, data binary"

    def __init__(self, field: str, n_buckets: int, kind: int = 0):
        self.field, self.n_buckets, self.kind = field, n_buckets, kind
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, entries: np.ndarray):
        self.held.append(entries)
        self.size += entries.nbytes
        if self.size > ENTRY_BYTES:
            yield from self.rest()

    def rest(self):
        entries = np.concatenate(self.held) if self.held else np.zeros(0)
        self.held, self.size = [], 0
        if len(entries):
            bucket = (tc.mix(entries[self.field].view(np.uint64)) >> np.uint64(32)) * np.uint64(self.n_buckets) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            entries, bucket = entries[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            data = [entries[i:j].tobytes() for i, j in zip(first, np.append(first[1:], len(entries)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array([self.kind] * len(first), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "kind", "data"])


def _by_bucket(batches):
    """Of rows sorted by bucket, the data of each by kind."""
    last, held = None, {}
    for batch in batches:
        for bucket, kind, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if bucket != last and held:
                yield {k: b"".join(v) for k, v in held.items()}
                held = {}
            last = bucket
            held.setdefault(kind, []).append(data)
    if held:
        yield {k: b"".join(v) for k, v in held.items()}


def _spread(decode, n_buckets: int):
    """The shingles of classes (cls, comp, n, body), dealt by shingle."""

    def run(batches):
        out = _Dealt("h", n_buckets)
        for batch in batches:
            for i in range(0, batch.num_rows, PAIRS):
                x = batch.slice(i, PAIRS)
                sets = _sets_of(x.column(3), decode)
                sizes = [len(s) for s in sets]
                entries = np.empty(sum(sizes), _HASH)
                entries["h"] = np.concatenate(sets).view(np.int64)
                for k, name in enumerate(("cls", "comp", "n")):
                    entries[name] = np.repeat(x.column(k).to_numpy(zero_copy_only=False), sizes)
                yield from out.add(entries)
        yield from out.rest()

    return run


def _with_marks(n_buckets: int, width: int):
    """Classes (cls, marks), dealt by class."""

    def run(batches):
        out = _Dealt("cls", n_buckets, 1)
        for batch in batches:
            if batch.num_rows:
                entries = np.empty(batch.num_rows, _marked(width))
                entries["cls"] = batch.column(0).to_numpy(zero_copy_only=False)
                entries["marks"] = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, width)
                yield from out.add(entries)
        yield from out.rest()

    return run


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _counted(n_buckets: int):
    """Shingles that several components have, with their frequencies, dealt by class."""

    def run(batches):
        out = _Dealt("cls", n_buckets)
        for data in _by_bucket(batches):
            e = np.frombuffer(data[0], _HASH)
            e = e[np.lexsort((e["comp"], e["h"]))]
            new, own = _starts(e["h"]), np.flatnonzero(_starts(e["h"], e["comp"]))
            of = np.cumsum(new) - 1  # the shingle of each entry
            first, comp = np.flatnonzero(new), e["comp"][own]
            comps = np.bincount(of[own])
            largest = np.lexsort((comp, np.diff(np.append(own, len(e))), of[own]))[np.cumsum(comps) - 1]
            keep = comps[of] > 1
            seen = np.empty(int(keep.sum()), _SEEN)
            for name in _HASH.names:
                seen[name] = e[name][keep]
            for name, values in (("df", np.bincount(of)), ("least", np.minimum.reduceat(e["n"], first)), ("main", comp[largest])):
                seen[name] = values[of[keep]] if name != "main" else e["comp"][keep] == values[of[keep]]
            yield from out.add(seen)
        yield from out.rest()

    return run


def _prefixes(num: int, den: int, n_buckets: int, width: int):
    """The prefix of each class, its shingles of one component only first, then from the rarest, dealt by shingle."""

    def run(batches):
        out = _Dealt("h", n_buckets)
        for data in _by_bucket(batches):
            if 0 not in data:
                continue
            e, marks = np.frombuffer(data[0], _SEEN), np.frombuffer(data[1], _marked(width))
            e, marks = e[np.lexsort((e["h"], e["df"], e["cls"]))], marks[np.argsort(marks["cls"])]
            first = np.flatnonzero(_starts(e["cls"]))
            shared = np.diff(np.append(first, len(e)))
            n, least = e["n"].astype(np.int64), e["least"].astype(np.int64)
            at = n - np.repeat(shared, shared) + np.arange(len(e)) - np.repeat(first, shared)
            keep = (den * at <= (den - num) * n) & ((n - at) * (den + num) >= num * (n + least))
            placed = np.empty(int(keep.sum()), _placed(width))
            for name in (*_HASH.names, "main"):
                placed[name] = e[name][keep]
            placed["at"] = at[keep]
            placed["marks"] = marks["marks"][np.searchsorted(marks["cls"], placed["cls"])]
            yield from out.add(placed)
        yield from out.rest()

    return run


def _met(num: int, den: int, n_buckets: int, width: int):
    """The pairs of different components that share a shingle of their prefixes and can reach the threshold, dealt by their first class."""

    least = _least(num, den, width)

    def pairs(e: np.ndarray):
        cls, marks, held, size = e["cls"], e["marks"], [], 0
        for i, j in _possible_pairs(e, num, den):
            near = _likeness(marks[i], marks[j]) >= least
            p, q = cls[i[near]], cls[j[near]]
            held.append(np.empty(len(p), _PAIR))
            held[-1]["a"], held[-1]["b"] = np.minimum(p, q), np.maximum(p, q)
            size += len(p)
            if size > CANDIDATES:
                yield _once(np.concatenate(held))
                held, size = [], 0
        if held:
            yield _once(np.concatenate(held))

    def run(batches):
        out = _Dealt("a", n_buckets)
        for data in _by_bucket(batches):
            for found in pairs(np.frombuffer(data[0], _placed(width))):
                yield from out.add(found)
        yield from out.rest()

    return run


def _possible_pairs(e: np.ndarray, num: int, den: int):
    """(i, j), a part at a time: the entries of one shingle and different components that can reach the threshold by their sizes and places.

    Within a shingle's largest component no entry meets another: the others
    meet those of it, and each other, whose sizes are in their reach.
    """
    order = np.lexsort((e["n"], e["h"]))
    h, comp, n, at, main = (e[k][order] for k in ("h", "comp", "n", "at", "main"))
    n, at = n.astype(np.int64), at.astype(np.int64)
    reach = ((n - at) * (den + num) - num * n) // num  # the size of the largest set that an entry can be linked to
    step = int(n.max(initial=0)) * den // num + 2
    code = (np.cumsum(_starts(h)) - 1) * step  # sorted by shingle, then by size
    ours = np.flatnonzero(~main)
    for theirs in (np.flatnonzero(main), ours):
        first = np.searchsorted(code[theirs] + n[theirs], code[ours] - (-num * n[ours] // den))
        if theirs is ours:  # each pair once
            first = np.maximum(first, np.arange(len(ours)) + 1)
        stop = np.searchsorted(code[theirs] + n[theirs], code[ours] + np.clip(np.minimum(reach[ours], n[ours] * den // num), 0, step - 1), side="right")
        count = np.maximum(stop - first, 0)
        cuts = np.concatenate([[0], np.cumsum(count)])
        for k in range(0, int(cuts[-1]), CANDIDATES):
            place = np.arange(k, min(k + CANDIDATES, int(cuts[-1])))
            own = np.searchsorted(cuts, place, side="right") - 1
            i, j = ours[own], theirs[first[own] + place - cuts[own]]
            keep = (comp[i] != comp[j]) & (n[i] <= reach[j])
            yield order[i[keep]], order[j[keep]]


def _once(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    return pairs[_starts(pairs["a"], pairs["b"])] if len(pairs) else pairs


def _told(batches):
    """Dealt pairs, each once."""
    for data in _by_bucket(batches):
        found = _once(np.frombuffer(data[0], _PAIR))
        yield pa.RecordBatch.from_arrays([pa.array(found[k]) for k in ("a", "b")], names=["a", "b"])


def _likeness(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Estimated similarities from marks; unequal minima share a byte once in 256."""
    return (_equal(p, q) / p.shape[1] * 256 - 1) / 255


def _equal(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many bytes of each row agree: eight at a time, as no byte of a sum of up to 31 words overflows into the next."""
    n, width = p.shape
    if width % 8 or width > 248:
        return np.count_nonzero(p == q, axis=1)
    total = (p == q).view(np.uint64).reshape(n, width // 8).sum(axis=1, dtype=np.uint64)
    low = total & np.uint64(0x00FF00FF00FF00FF)
    low += (total >> np.uint64(8)) & np.uint64(0x00FF00FF00FF00FF)
    return ((low * np.uint64(0x0001000100010001)) >> np.uint64(48)).astype(np.int64)


def _sets_of(column: pa.Array, decode) -> list[np.ndarray]:
    """The sets of a column of bodies."""
    out: list[np.ndarray] = []
    for _, _, data, offsets in tc.chunks(column):
        out += decode(data, offsets)
    return out


def _confirm(num: int, den: int, decode):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, PAIRS):
                x = batch.slice(i, PAIRS)
                ok = np.zeros(x.num_rows, bool)
                for r, (p, q) in enumerate(zip(_sets_of(x.column(2), decode), _sets_of(x.column(3), decode), strict=True)):
                    both = np.sort(np.concatenate([p, q]))
                    same = int(np.count_nonzero(both[1:] == both[:-1]))
                    ok[r] = den * same >= num * (len(p) + len(q) - same)
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


def _confirm_groups(num: int, den: int, decode):
    """Of the pairs (g, o, p) of a group, those that reach the threshold; each of the bodies (group, cls, body) is decoded once."""

    def run(pairs: pa.Table, bodies: pa.Table) -> pa.Table:
        cls = bodies.column("cls").to_numpy()
        sets = _sets_of(bodies.column("body"), decode) if len(cls) else [np.zeros(0, np.uint64)]
        n = np.array([len(x) for x in sets])
        first = np.concatenate([[0], np.cumsum(n)])
        values, places = np.unique(np.concatenate(sets), return_inverse=True)
        o, p = (pairs.column(k).to_numpy() for k in ("o", "p"))
        order = np.argsort(o, kind="stable")
        o, p = o[order], p[order]
        by_cls = np.argsort(cls)
        at_o, at_p = (by_cls[np.searchsorted(cls, x, sorter=by_cls)] for x in (o, p))
        own, ok = np.zeros(len(values), bool), np.zeros(len(o), bool)
        runs = np.append(np.flatnonzero(_starts(o)), len(o)) if len(o) else np.zeros(1, np.int64)
        for i, stop in zip(runs[:-1], runs[1:], strict=True):
            x = at_o[i]
            own[places[first[x] : first[x + 1]]] = True
            for k in range(i, stop, PAIRS):
                y = at_p[k : min(k + PAIRS, stop)]
                cuts = np.cumsum(n[y])
                both = own[places[np.repeat(first[y] - cuts + n[y], n[y]) + np.arange(cuts[-1])]]
                same = np.add.reduceat(both, cuts - n[y], dtype=np.int64)
                ok[k : k + len(y)] = den * same >= num * (n[x] + n[y] - same)
            own[places[first[x] : first[x + 1]]] = False
        return pa.table({"a": o[ok], "b": p[ok]})

    return run


def _hash_rows(decode):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, PAIRS):
                x = batch.slice(i, PAIRS)
                sets = _sets_of(x.column(3), decode)
                place = pa.array(np.repeat(np.arange(x.num_rows), [len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([*(x.column(k).take(place) for k in range(3)), pa.array(np.concatenate(sets).view(np.int64))], names=["cls", "comp", "n", "h"])

    return run


def labelled(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """``df`` with the component of its node; nodes without links are their own."""
    return df.join(labels.toDF(node, name), node, "left").withColumn(name, F.coalesce(name, node))


class Linker:
    """Confirmed links between classes so far, contracted, and labels (node, component) by them."""

    def __init__(self, sets: DataFrame, decode, scratch: Scratch, num: int, den: int):
        self.sets, self.decode, self.scratch, self.num, self.den = sets, decode, scratch, num, den
        self.links = self.labels = None

    def near(self, pairs: DataFrame) -> DataFrame:
        """(a, b, likeness) of the pairs whose fragments leave the threshold possible."""
        marks = self.sets.select("cls", "marks")
        both = pairs.join(marks.toDF("a", "ma"), "a").join(marks.toDF("b", "mb"), "b").select("a", "b", "ma", "mb")
        return self.scratch.save(both.mapInArrow(_estimate(self.num, self.den), "a long, b long, likeness double"))

    def confirm(self, pairs: DataFrame, rounds: int | None = None) -> None:
        """Link the pairs, of a saved table, that reach the threshold.

        After ``rounds`` rounds of union-find, nodes with one label are in one
        component, but a component may have several; without a limit, one.
        """
        bodies, n = self.sets.select("cls", "body"), pairs.count()
        wanted = bodies.toDF("b", "pb").join(bounded(pairs.select("b").distinct(), n), "b", "left_semi")
        both = bodies.toDF("a", "pa").join(bounded(pairs.select("a", "b"), n), "a").join(wanted, "b").select("a", "b", "pa", "pb")
        self.link(both.mapInArrow(_confirm(self.num, self.den, self.decode), "a long, b long"), rounds)

    def confirm_families(self, pairs: DataFrame, own: DataFrame) -> None:
        """Link the pairs, of a saved table, that reach the threshold; ``own`` has the component and body of each class.

        For families, in which a class has many pairs: its body goes to the
        groups of its pairs, not to each pair.
        """
        if not (n_pairs := pairs.count()):
            return
        grouped = self.scratch.save(_in_groups(pairs, own, -(-n_pairs // GROUP_PAIRS)))
        wanted = grouped.select("g", F.col("o").alias("cls")).union(grouped.select("g", "p")).distinct()
        bodies = own.select("cls", "body").join(wanted, "cls").select(F.col("g").alias("group"), "cls", "body")
        self.link(grouped.groupBy("g").cogroup(bodies.groupBy("group")).applyInArrow(_confirm_groups(self.num, self.den, self.decode), "a long, b long"))
        self.scratch.drop(grouped)

    def link(self, links: DataFrame, rounds: int | None = None) -> None:
        """Add links that are confirmed to those so far."""
        if self.links is not None:
            links = links.union(self.links)
        old = self.links, self.labels
        self.links = contracted(links, self.scratch, rounds)
        self.labels = self.links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")) if rounds else self.links.toDF("node", "component")
        self.labels = self.scratch.save(self.labels) if rounds else self.labels
        self.scratch.drop(*old)

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are not in one component yet."""
        return labelled(labelled(pairs, self.labels, "a", "ca"), self.labels, "b", "cb").filter("ca <> cb").select(*pairs.columns)

    def hash_rows(self, own: DataFrame) -> DataFrame:
        """(cls, comp, n, h): the hashes of the classes (cls, comp) in ``own``."""
        sets = self.sets.select("cls", F.col("n").cast("int").alias("n"), "body")
        return own.select("cls", "comp").join(sets, "cls").mapInArrow(_hash_rows(self.decode), "cls long, comp long, n int, h long")

    def still_open(self, members: DataFrame) -> DataFrame:
        """Members (key, cls), with comp and the number of them (open), of the buckets that hold several components.

        The centre of a bucket is none of them: it has been compared with every
        other member, so it is done.
        """
        rows = labelled(members, self.labels, "cls", "comp")
        several = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("open")).filter("lo < hi").select("key", "open")
        return self.scratch.save(rows.join(several, "key"))


def _fits(num: int, den: int) -> str:
    """Whether classes a and b can be linked, by the shingles that they share with others at all."""
    return f"a.comp <> b.comp AND {den + num} * least(a.c, b.c) >= {num} * (a.n + b.n)"


def _possible(members: DataFrame, link: Linker) -> DataFrame:
    """Members (key, cls, comp, n, c) without those that no other member can be linked to."""
    num, den, scratch = link.num, link.den, link.scratch
    own = scratch.save(members.select("cls", "comp").distinct())
    hashes = link.hash_rows(own)
    shared = hashes.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("h")
    c = scratch.save(hashes.join(shared, "h", "left_semi").groupBy("cls").agg(F.count("*").alias("c")).join(link.sets.select("cls", "n"), "cls"))
    rows = members.join(c, "cls")
    rows = rows.withColumns({"most": F.expr(f"c * {num + den} / {num} - n"), "least": F.expr(f"n * {num} / {den}")}).filter("least <= c AND least <= most")
    # once: further rounds remove a tenth of what is left, and the prefixes do that too
    span = rows.groupBy("key").agg(F.min("n").alias("small"), F.max("n").alias("large"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    rows = scratch.save(rows.join(span, "key").filter("least <= large AND most >= small").select("key", "cls", "comp", "n", "c"))
    scratch.drop(own, c)
    return rows


def _n_buckets(n_shingles: int, n_parts: int) -> int:
    """As many buckets as the shingles fill: few shingles are few rows, whatever the number of tasks and partitions."""
    return max(1, min(n_parts * BUCKETS, -(-n_shingles // BUCKET_ENTRIES)))


def _in_groups(pairs: DataFrame, own: DataFrame, n_groups: int) -> DataFrame:
    """(g, o, p): the pairs (a, b), p in the larger component, in groups by family.

    The family of o is the largest component that it has a pair with: most
    pairs are of a family's stragglers with its many linked members, which so
    come together.  A family is cut into blocks by either side.
    """
    sizes = own.groupBy("comp").agg(F.count("*").alias("many"))
    within = own.join(sizes, "comp").select("cls", F.struct("many", "comp").alias("family"))
    both = pairs.join(within.toDF("a", "fa"), "a").join(within.toDF("b", "fb"), "b")
    both = both.select(*(F.when(F.expr(test), F.struct(F.col(o).alias("o"), F.col(p).alias("p"), F.col(f).alias("family"))) for test, o, p, f in (("fa < fb", "a", "b", "fb"), ("fa >= fb", "b", "a", "fa"))))
    both = both.select(F.coalesce(*both.columns).alias("x")).select("x.*")
    of = both.groupBy("o").agg(F.max("family").alias("family"))
    blocks = of.groupBy("family").agg(F.ceil(F.greatest(F.count("*"), F.col("family.many")) / BLOCK).alias("n"))
    of = of.join(blocks, "family").select("o", "family.comp", "n")
    side = lambda x: F.pmod(F.xxhash64(x), "n")
    return both.select("o", "p").join(of, "o").select(F.pmod(F.xxhash64("comp", side("o"), side("p")), F.lit(n_groups)).alias("g"), "o", "p")


def _prefix_pairs(own: DataFrame, link: Linker) -> DataFrame:
    """Pairs (a, b), of the saved classes (cls, comp, n, marks, body) in ``own``, of different components that can reach the threshold: prefix filtering with positions.

    With each set ordered from its rarest shingle, a linked pair shares one among
    the first n - t * n + 1 of both, and from the first shared one on, enough
    shingles are left in both.  A member too far from its first shared shingle
    for even the smallest set with that shingle is no partner: in a family of
    sets of like size, this leaves those that reach the threshold by their first
    shared shingle, not all pairs.  Pairs within the largest component of a
    shingle are never looked at.
    """
    spark, num, den = own.sparkSession, link.num, link.den
    dealt = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    width, n_shingles = own.agg(F.max(F.length("marks")), F.sum("n")).first()
    if width is None:
        return spark.createDataFrame([], "a long, b long")
    n = _n_buckets(n_shingles, int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = own.select("cls", "marks").mapInArrow(_with_marks(n, width), _Dealt.SCHEMA)
    seen = dealt(own.select("cls", "comp", "n", "body").mapInArrow(_spread(link.decode, n), _Dealt.SCHEMA)).mapInArrow(_counted(n), _Dealt.SCHEMA)
    first = dealt(seen.union(marks)).mapInArrow(_prefixes(num, den, n, width), _Dealt.SCHEMA)
    met = dealt(first).mapInArrow(_met(num, den, n, width), _Dealt.SCHEMA)
    return link.scratch.save(dealt(met).mapInArrow(_told, "a long, b long"))


def _small_pairs(rest: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in the buckets of ``rest``."""
    return rest.alias("a").join(rest.alias("b"), "key").filter("a.cls < b.cls AND a.comp <> b.comp").select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()


def link_members(members: DataFrame, sets: DataFrame, decode, scratch: Scratch, num: int, den: int, small: int = 0) -> DataFrame:
    """Labels (node, component) of the classes that are linked to others; deletes ``members``.

    Members (key, cls, centre, size) are the classes of a bucket but one, its
    centre, and the number of all.  Buckets in which up to ``small`` others are
    open after that are compared in full.
    """
    link = Linker(sets, decode, scratch, num, den)
    star = link.near(members.select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct())
    if small:
        link.confirm(star.select("a", "b"), ROUNDS)
    else:  # each class tries its likeliest centre before the others
        link.confirm(scratch.save(star.groupBy("b").agg(F.max_by("a", "likeness").alias("a"))))
        link.confirm(scratch.save(link.apart(star.select("a", "b"))))
    # without limits to a full comparison, buckets with one centre are one: a family has as many rows as it has classes and centres, not tables
    open_ = members.filter("size > 2").select("key" if small else F.col("centre").alias("key"), "cls")
    rest = link.still_open(open_ if small else open_.distinct())
    scratch.drop(members, star)
    if small:
        link.confirm(link.near(_small_pairs(rest.filter(F.col("open") <= small))))
        crowded = rest.filter(F.col("open") > small).select("key", "cls")
        old, rest = rest, link.still_open(crowded)
        scratch.drop(old)

    if rest.limit(1).count():
        if not small:  # what can still be linked, first by the centre that shares the most
            rest = _possible(rest.select("key", "cls", "comp"), link)
            centre = rest.groupBy("key").agg(F.max_by(F.struct("cls", "comp", "n", "c"), F.expr("struct(c / n, -cls)")).alias("x")).select("key", "x.*")
            star = centre.alias("a").join(rest.alias("b"), "key").filter(_fits(num, den)).select(F.expr("least(a.cls, b.cls) a"), F.expr("greatest(a.cls, b.cls) b")).distinct()
            link.confirm(link.near(star))
            rest = link.still_open(rest.join(centre.select("key", F.col("cls").alias("centre")), "key").filter("cls <> centre").select("key", "cls"))
        # and then exactly: all that share a rare enough shingle
        crowded = scratch.save(rest.select("cls", "comp").distinct())
        own = scratch.save(sets.select("cls", F.col("n").cast("int").alias("n"), "marks", "body").join(bounded(crowded, crowded.count()), "cls"))
        pairs = _prefix_pairs(own, link)
        link.confirm_families(pairs, own)
        scratch.drop(crowded, own, pairs)
    scratch.drop(rest)
    return with_roots(link.labels)


def one_each(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The saved table of sets, each class once (a class is there twice only where ids repeat)."""
    saved = scratch.save(sets)
    if scratch.count(saved.select("cls").distinct()) == saved.count():
        return saved
    out = scratch.save(saved.dropDuplicates(["cls"]))
    scratch.drop(saved)
    return out
