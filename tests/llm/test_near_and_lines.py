"""Near-duplicate documents and lines against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from orbitkeep.llm import components as union_find
from orbitkeep.llm import linededup, linking, minhash
from orbitkeep.llm.scratch import Scratch

SCHEMA = "doc_id long, text string"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fold(text):
    return (text or "").encode().translate(FOLD)


def components(sets, num, den):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(sets))]


def shingles(text):
    w = fold(text).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def families(seed, n=8):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice((3, 40, 120)))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_equal_brute_force(spark, seed):
    texts = [*families(seed), "", None, " \n", "One two", "one TWO", "É é"]
    docs = list(enumerate(texts, 100))
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()}
    sets = [shingles(t) for t in texts]
    for k, c in enumerate(components(sets, 85, 100)):
        assert (got[100 + k].component_id, got[100 + k].n_shingles, got[100 + k].kept) == (100 + c, len(sets[k]), k == c)


def test_a_large_family_and_its_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)] * 40
    for _ in range(120):
        own = list(base)
        for k in range(rng.randint(1, 5)):
            own[rng.randrange(150)] = f"x{rng.random()}"
        texts.append(" ".join(own))
    got = sorted(minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect())
    assert [r.component_id for r in got] == components([shingles(t) for t in texts], 85, 100)


def test_documents_odd_rows(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, None), (8, "q r s t u v")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n long, component_id string")
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (8, 0, 8, True), (8, 2, 8, True)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    # many rows without an id, alike and apart
    texts = [" ".join(f"w{i + j}" for j in range(12)) if i % 3 else "a b c d e f g" for i in range(0, 600, 20)]
    many = spark.createDataFrame([(None, t) for t in texts] + [(9, texts[1])], SCHEMA)
    found = [r.component_id for r in minhash.near_duplicates(many).collect()]
    assert found.count(9) == 1 + texts.count(texts[1]) and found.count(None) == len(texts) - texts.count(texts[1])
    left = minhash.one_of_each(docs.filter("doc_id = 7"))
    assert left.columns == docs.columns and left.count() == 1


def line_of(text):
    """A line as compared: trimmed, A-Z lower-cased."""
    return fold(text.strip(" \t\n\x0b\f\r")).decode()


def grams(line, size=5):
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def order(document):
    return document[0] is not None, document[0] or 0, document[1]


def brute_lines(docs, digest):
    """For each document (id, text), told apart by both, the numbers of its lines to drop."""
    seen, occurrences = {}, []
    for k, t in sorted({(k, t) for k, t in docs}, key=lambda x: order((x[0], digest[x[1]]))):
        for i, line in enumerate((t or "").split("\n")):
            if b := line_of(line):
                occurrences.append((k, t, i, b))
                seen.setdefault(b, len(seen))
    groups = components([grams(b) for b in seen], 80, 100)
    kept, gone = set(), defaultdict(list)
    for k, t, i, b in occurrences:
        if groups[seen[b]] in kept:
            gone[k, t].append(i)
        kept.add(groups[seen[b]])
    return gone


def digests(frame):
    return {r.text: r.d for r in frame.selectExpr("text", "xxhash64(text) d").collect()}


def check_lines(spark, docs):
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    gone = brute_lines(docs, digests(frame))

    def left(k, t):
        if not gone[k, t]:
            return t
        rest = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k, t])
        return rest if rest.strip() else ""

    got = sorted(((r.doc_id, r.text, r.dropped_lines, r.n_lines) for r in linededup.dedup_lines(frame).collect()), key=repr)
    assert got == sorted(((k, left(k, t), gone[k, t], 0 if t is None else len(t.split("\n"))) for k, t in docs), key=repr)
    kept = sorted(((r.doc_id, r.text) for r in linededup.without_repeats(frame).collect()), key=repr)
    assert kept == sorted(((k, left(k, t)) for k, t in docs if not gone[k, t] or left(k, t)), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [*families(seed + 10, 6), *(x.replace("w", "é漢") for x in families(seed + 20, 3))]
    check_lines(spark, [(k, "\n".join(rng.choice([*pool, "", " ", "ab", "AB "]) for _ in range(rng.randint(0, 6)))) for k in range(25)] + [(99, None)])


def test_lines_of_repeated_and_null_ids(spark):
    rng = random.Random(3)
    pool = families(31, 4)
    docs = [(rng.choice([None, 5, 6, 7]), "\n".join(rng.choice(pool) + rng.choice(["", f" own {rng.random()}"]) for _ in range(rng.randint(0, 5)))) for _ in range(40)]
    docs += [(None, "shared words here\nunique alpha beta gamma"), (None, "quite other things\nshared words here"), (5, "theta iota kappa"), (5, "theta iota kappa"), (5, "shared words here\nlambda my ny")]
    check_lines(spark, docs)


def test_lines_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x y z\nq"), (1, "x y z"), (1, "x y z"), (2, "")], SCHEMA).selectExpr("*", "1 n_lines", "'a' cls", "5 key", "6 _id", "7 _dropped", "8 _parts", "9 id", "10 DIGEST", "11 dropped", "12 parts", "13 dropped_lines")
    got = {(r.doc_id, r.text, tuple(r.dropped_lines)) for r in linededup.dedup_lines(docs).collect()}
    assert got == {(None, "x y z\nq", ()), (1, "", (0,)), (2, "", ())}
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    left = linededup.without_repeats(docs)
    assert left.columns == docs.columns
    assert sorted(tuple(r)[2:] for r in left.collect()) == [(1, "a", *range(5, 14))] * 2


def test_edits_of_one_character_are_found_from_49_characters_on():
    rng = np.random.default_rng(4)
    for letters in ("abcdefghij klmnop", "éèüßñ 漢字かな🙂"):
        for size, same in ((49, True), (48, False), (200, True)):
            line = "".join(rng.permutation(list(letters * 20))[:size])
            other = line[: size // 2] + "Ω" + line[size // 2 + 1 :]
            sets = [linededup.gram_sets(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))[0] for x in (line, other)]
            if len(grams(line)) == size - 4:
                assert [len(s) for s in sets] == [len(grams(x)) for x in (line, other)]
                both = len(np.intersect1d(*sets))
                assert both == len(grams(line) & grams(other)) and (100 * both >= 80 * (len(sets[0]) + len(sets[1]) - both)) == same


def test_recall_of_bands():
    """Pairs of lines at a similarity from 0.8 on share a band, whatever their length."""
    rng = random.Random(5)
    for low, high, n, most in ((20, 45, 3000, 0.004), (50, 120, 3000, 0.003), (200, 600, 800, 0.003)):
        pairs = []
        while len(pairs) < n:
            line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(low, high)))
            other = list(line)
            for _ in range(rng.randint(1, 1 + len(line) // 50)):
                at = rng.choice([rng.randrange(len(other)), 0, len(other) - 1])
                other[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
            a, b = grams(line), grams("".join(other))
            if 0.8 <= len(a & b) / len(a | b) < 0.9:
                pairs.append((line.encode(), "".join(other).encode()))
        data = np.frombuffer(b"".join(x for p in pairs for x in p), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(x) for p in pairs for x in p])])
        table = linededup.signatures(*linededup.line_shingles(data, at[:-1], at[1:])).reshape(-1, 2, linededup.BANDS, linededup.ROWS)
        met = (table[:, 0] == table[:, 1]).all(axis=2).any(axis=1)
        assert 1 - met.mean() <= most, (low, high, 1 - met.mean())


def hot_family(seed, n):
    """Lines that resemble each other at about the threshold, so that they share bands and few are linked."""
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300))
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(5, 9)):
            own[rng.randrange(300)] = rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
        out.append("".join(own))
    return out


def test_rows_of_the_exact_step_follow_the_shingles_not_the_partitions(spark):
    """Few shingles fill few buckets, however many partitions there are; the pairs stay those of all buckets."""
    sets = [linededup.gram_sets(np.frombuffer(x.lower().encode(), np.uint8), np.array([0, len(x)]))[0] for x in hot_family(9, 150)]
    total = sum(len(s) for s in sets)
    assert linking._n_buckets(total, 211) <= 4 and linking._n_buckets(10**9, 211) == 211 * 8 and linking._n_buckets(0, 1) == 1
    entries = np.concatenate([np.array([(h, k, k, len(s)) for h in s.view(np.int64)], linking._HASH) for k, s in enumerate(sets)])
    n = linking._n_buckets(total, 211)
    rows = 0
    for part in np.array_split(entries, 211):  # as many tasks as partitions
        out = linking._Dealt("h", n)
        rows += sum(b.num_rows for b in [*out.add(part), *out.rest()])
    assert rows <= 211 * n < len(entries) / 50
    rng = np.random.default_rng(3)
    p, q = (rng.integers(0, 4, (500, 128)).astype(np.uint8) for _ in range(2))
    assert (linking._equal(p, q) == (p == q).sum(axis=1)).all() and (linking._equal(p, p) == 128).all()
    assert (linking._equal(p[:, :60], q[:, :60]) == (p[:, :60] == q[:, :60]).sum(axis=1)).all()


def test_a_crowded_family_of_lines_equals_brute_force(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        check_lines(spark, [(k, line) for k, line in enumerate(hot_family(9, 150))])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_contracted_links_keep_their_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    frame, scratch = spark.createDataFrame(links, "a long, b long"), Scratch(spark)
    whole = {r.node: r.component for r in union_find.components(frame, scratch).collect()}
    assert all(whole[a] == whole[b] and whole[a] <= a for a, b in links if a != b)
    few = union_find.contracted(frame, scratch, 1)
    assert {r.node: r.component for r in union_find.components(few, scratch).collect()} == whole


def test_buckets_of_one_centre_are_looked_at_once(spark, monkeypatch):
    """A family meets in very many tables; what is still open has a row for each class and centre, not for each table."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for _ in range(150):
        own = list(base)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(200)] = f"x{rng.random()}"
        texts.append(" ".join(own))
    seen, still_open = [], linking.Linker.still_open
    monkeypatch.setattr(linking.Linker, "still_open", lambda self, members: seen.append((members.count(), members.distinct().count(), members.select("key").distinct().count())) or still_open(self, members))
    got = sorted(minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect())
    assert [r.component_id for r in got] == components([shingles(t) for t in texts], 85, 100)
    assert seen and all(n == once and keys <= 150 for n, once, keys in seen), seen


def test_batches_of_saved_tables_are_small(spark):
    """What a task and its Python worker hold beside the heap does not follow the length of texts; settings are restored."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    keys = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    before = [spark.conf.get(k, None) for k in keys]
    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat(cast(id as string), 2500) AS text")  # about 10 KB each
    seen = Scratch(spark).save(texts.mapInArrow(sizes, "n long, size long")).collect()
    assert sum(r.n for r in seen) == 3000 and sum(r.size for r in seen) > 20 << 20
    assert max(r.size for r in seen) < 5 << 20
    assert [spark.conf.get(k, None) for k in keys] == before


def test_bands_are_passed_on_in_small_parts():
    """What a task gathers of bands stays small however many lines it has, and is whole."""
    import pyarrow as pa

    rng = random.Random(4)
    texts = ["\n".join("".join(rng.choices("abcdefgh ", k=97)) + "end" for _ in range(1000)) for _ in range(48)]
    parts = list(linededup._bands(4)(pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]) for t in texts))
    assert max(p.nbytes for p in parts) < 5 << 20
    assert sum(len(x) for p in parts for x in p.column(1).to_pylist()) == 48_000 * linededup.BANDS * linededup._ENTRY.itemsize


def test_candidates_leave_out_what_the_largest_component_has_among_itself():
    """Pairs of a shingle that can reach the threshold are those of brute force, and a family of 30,000 linked classes takes no time of its square."""
    import time

    import pyarrow as pa

    def met(e):
        e["marks"] = 7
        rows = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([e.tobytes()], pa.binary())], names=["bucket", "kind", "data"])
        return {(int(a), int(b)) for x in linking._told(linking._met(80, 100, 1, 128)([rows])) for a, b in zip(*x.columns, strict=True)} if len(e) else set()

    def as_int(pairs):
        return {(int(a), int(b)) for a, b in pairs}

    rng = np.random.default_rng(5)
    for _ in range(20):
        e = np.zeros(150, linking._placed(128))
        e["cls"], e["h"], e["comp"] = rng.permutation(150), rng.integers(0, 4, 150), rng.integers(0, 30, 150)
        e["n"] = rng.integers(5, 60, 150)
        e["at"] = e["n"] * rng.random(150) * 0.3
        e["main"] = e["comp"] == e["h"]
        told = set()
        for i in range(150):
            for j in range(i):
                x, y = e[i], e[j]
                small, large, left = min(x["n"], y["n"]), max(x["n"], y["n"]), min(x["n"] - x["at"], y["n"] - y["at"])
                if x["h"] == y["h"] and x["comp"] != y["comp"] and 100 * int(small) >= 80 * int(large) and int(left) * 180 >= 80 * (int(small) + int(large)):
                    told.add((min(x["cls"], y["cls"]), max(x["cls"], y["cls"])))
        assert met(e) == as_int(told)

    e = np.zeros(30_000, linking._placed(128))
    e["cls"], e["n"], e["main"] = np.arange(30_000), 400, True
    e["main"][:3], e["comp"][:3] = False, (1, 2, 3)
    began = time.thread_time()
    assert len(met(e)) == 3 * 29_997 + 3
    assert time.thread_time() - began < 8


def test_bodies_of_a_family_go_to_its_groups_not_to_its_pairs(spark):
    """Links equal brute force, and the rows with bodies follow the classes, though each straggler has a pair with each member of its family."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
    bodies, comps = [], []
    for family in range(3):
        base = [rng.choice(words) for _ in range(60)]
        for k in range(130):
            own = list(base)
            for _ in range(rng.randint(0, 4) if k < 100 else rng.randint(3, 12)):
                own[rng.randrange(60)] = rng.choice(words)
            bodies.append(" ".join(own).encode())
            comps.append(family * 1000 if k < 100 else family * 1000 + k)
    sets = [set(linededup.gram_sets(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0].tolist()) for b in bodies]
    n = len(bodies)
    pairs = [(a, b) for b in range(n) for a in range(b) if comps[a] != comps[b] and a // 130 == b // 130]
    near = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    scratch = Scratch(spark)
    frame = spark.createDataFrame([(k, len(s), bytearray(b)) for k, (s, b) in enumerate(zip(sets, bodies, strict=True))], "cls long, n long, body binary")
    asked = scratch.save(spark.createDataFrame(pairs, "a long, b long"))
    own = scratch.save(frame.join(spark.createDataFrame(list(enumerate(comps)), "cls long, comp long"), "cls"))
    link = linking.Linker(frame, linededup.gram_sets, scratch, 80, 100)
    told = []
    link.link = lambda links, rounds=None: told.extend(links.collect())
    link.confirm_families(asked, own)
    assert {(min(r), max(r)) for r in told} == near and 50 < len(near) < len(pairs)

    groups = linking._in_groups(asked, own, 12).collect()
    assert {(min(r.o, r.p), max(r.o, r.p)) for r in groups} == set(pairs) and len(groups) == len(pairs) > 9000
    sent = {(r.g, x) for r in groups for x in (r.o, r.p)}
    assert len(sent) < 3 * n
    link.confirm_families(asked.limit(0), own)  # nothing to confirm
