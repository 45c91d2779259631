"""Tokens, likelihoods, fingerprints and licenses against independent computations."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from orbitkeep.llm import bpe, licenses, lm, syncmers

SCHEMA = "doc_id long, text string"
ODD = ["", None, " ", "a", "Hello, WORLD! it's 12 o'clock", "x<|endoftext|>y", "éÉ ΣΣ İ ﬁ 漢字🙂\x1c\x85", "aaaa" * 400, "a\tb\r\nc"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary()
    own, theirs = bpe.Bpe(open(path, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = "aAbBcCsStT'’ \n\t1２éÉéΣİẞ<|endoftext|>.,!?-ñ漢字🙂"
    for text in [*[t or "" for t in ODD], *["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(500)]]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_frames(spark):
    docs = frame(spark, ODD).selectExpr("*", "1 row", "'x' ids")
    out = {r.doc_id: r for r in bpe.tokenized(docs, bpe.vocabulary()).collect()}
    sums = {r.doc_id: r for r in bpe.digests(docs, bpe.vocabulary()).collect()}
    assert set(out) == set(range(len(ODD)))
    for k, r in out.items():
        assert sums[k].n_tokens == len(r.ids) and r["row"] == 1
        assert sums[k].ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert sums[k].decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.tokenized(docs.limit(0), bpe.vocabulary()).count() == 0


def test_bpe_remembers_words_in_little_memory():
    """A worker's cache has a few hundred bytes a word, and the arrays of merge rounds are gone."""
    import tracemalloc

    own = bpe.Bpe(open(bpe.vocabulary(), encoding="utf-8").read())
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(30_000)]
    text = " ".join(words)
    tracemalloc.start()
    ids = own.encode(text)
    n = len(ids)
    del ids, words
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert n > 60_000 and len(own.cache) >= 30_000 and held < 300 * len(own.cache)


@pytest.mark.parametrize("limit", [None, "1m"])
def test_bpe_gets_texts_once_in_small_batches(spark, monkeypatch, limit):
    """What a task and its Python worker hold beside the heap does not follow the length of texts; a session's own limit stays."""
    import pyarrow as pa

    def sizes(*_):
        return lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array([[b.nbytes]] * b.num_rows, pa.list_(pa.int32())), pa.array([""] * b.num_rows)], names=["row", "ids", "decoded"]) for b in batches)

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(bpe, "_runner", sizes)
    docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat(cast(id as string), 2500) AS text")  # about 10 KB each
    try:
        spark.conf.unset(key)
        if limit:
            spark.conf.set(key, limit)
        rows = bpe.tokenized(docs, bpe.vocabulary()).collect()
        seen = {r.ids[0] for r in rows}
        assert len(rows) == 2000 and max(seen) < (5 << 20 if limit is None else 5 << 18)
        assert spark.conf.get(key) == (limit or f"{1 << 22}b")
        # rows of a batch have its size: each counts for its share
        times = {n: sum(r.ids[0] == n for r in rows) for n in seen}
        widest = max(len(r.text) for r in rows)
        assert all(n <= 1.2 * widest * k for n, k in times.items())
    finally:
        spark.conf.unset(key)


def test_likelihoods(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("a B c d", "x y z", "x w")) for _ in range(rng.randint(0, 30))) for _ in range(150)] + [None, "", "unseen1 unseen2", "\n", "W" * 9000]
    got = {r.doc_id: r for r in lm.scored(frame(spark, texts).selectExpr("*", "1 score", "2 rare")).collect()}
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", fold(t)), None] for t in texts]
    held = [zlib.crc32(str(k).encode()) % 5 == 1 for k in range(len(texts))]
    counts = collections.Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    for k, ws in enumerate(tokens):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # order helps
    assert lm.scored(frame(spark, texts).limit(0)).count() == 0


def _small_model(monkeypatch, words=40):
    monkeypatch.setattr(lm, "LEAST_WORDS", words)
    rng = np.random.default_rng(2)
    ids, counts, endings = rng.permutation(10_000)[:300].astype(np.int64), rng.integers(1, 99, 300), rng.integers(0, lm.ENDINGS, 300)
    lookup = lm.Lookup(ids, counts, endings, lm.words_of(300))
    weights = rng.integers(0, 99, lookup.first[-1]).astype(float)
    return lookup, lm.Model(weights, lookup.first), rng


def test_model_is_normalised(monkeypatch):
    lookup, model, rng = _small_model(monkeypatch)
    n = len(model.bias)
    assert n == 40 + lm.ENDINGS and lm.words_of(300) == 40 and lm.words_of(1 << 22) == 1 << 14 and lm.words_of(1 << 40) == lm.MOST_WORDS
    state = model.state(1)
    for _ in range(20):
        model.train(rng.integers(0, n, (500, lm.CONTEXT)), rng.integers(0, n, 500), state)
    contexts = rng.integers(0, n, (30, lm.CONTEXT))
    p = np.stack([10.0 ** model.log10(contexts, np.full(30, j)) for j in range(n)])
    assert np.allclose(p.sum(axis=0), 1, atol=1e-3)
    # against the plain formula
    x = sum(model.context[contexts[:, k]].astype(float) * model.position[k] for k in range(lm.CONTEXT))
    soft = lambda s: np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
    ending = soft(x @ model.ending.T + model.ending_bias)
    for j in range(0, n, 7):
        e = model.ending_of[j]
        own = slice(model.first[e], model.first[e + 1])
        want = ending[:, e] * soft(x @ model.word[own].T + model.bias[own])[:, j - model.first[e]]
        assert np.allclose(p[j], want, rtol=1e-3)


def test_gradient_of_the_noise_contrastive_objective(monkeypatch):
    """One small step changes parameters along the gradient of the objective, computed by differences with the same noise."""
    lookup, model, rng = _small_model(monkeypatch)
    n = len(model.bias)
    before, after = rng.integers(0, n, (64, lm.CONTEXT)), rng.integers(0, n, 64)

    def objective(m, seed=3):
        r = np.random.default_rng(seed)
        x, e = m.predicted(before).astype(float), m.ending_of[after]
        state = m.state(seed)
        noise = np.searchsorted(state["endings"], r.random(lm.NOISE))
        logs = lambda t: -np.log1p(np.exp(-t))
        offset = np.log(lm.NOISE * m.of_ending)
        out = logs((x * m.ending[e]).sum(1) + m.ending_bias[e] - offset[e]).sum() + logs(-(x @ m.ending[noise].T + m.ending_bias[noise] - offset[noise])).sum()
        drawn = np.searchsorted(state["words"], state["start"][e][:, None] + r.random((64, lm.WORD_NOISE)), side="right")
        drawn = np.clip(drawn, m.first[e][:, None], m.first[e + 1][:, None] - 1)
        assert (m.ending_of[drawn] == e[:, None]).all()
        s = lambda w: np.einsum("id,ikd->ik", x, m.word[w].astype(float)) + m.bias[w] - np.log(lm.WORD_NOISE * m.within[w])
        return out + logs(s(after[:, None])).sum() + logs(-s(drawn)).sum()

    steps = {}
    monkeypatch.setattr(lm.Model, "_step", lambda self, name, state, g: steps.__setitem__(name, np.asarray(g).reshape(getattr(self, name).shape)))
    model.train(before, after, {**model.state(3), "rng": np.random.default_rng(3)})
    for name, at in (("context", (before[0, 0], 3)), ("word", (after[1], 5)), ("bias", (after[2],)), ("ending", (model.ending_of[after[0]], 1)), ("ending_bias", (model.ending_of[after[3]],))):
        own = getattr(model, name).astype(np.float64)
        setattr(model, name, own)
        ups = []
        for step in (1e-4, -1e-4):
            own[at] += step
            ups.append(objective(model))
            own[at] -= step
        assert steps[name][at] == pytest.approx((ups[0] - ups[1]) / 2e-4, rel=1e-3, abs=1e-4), name


def test_words_outside_the_head(spark, monkeypatch):
    """Counts of words that are joined, not broadcast, are as exact."""
    monkeypatch.setattr(lm, "HEAD", 8)
    monkeypatch.setattr(lm, "GATHER", 4)
    test_likelihoods(spark)


def test_tasks_do_not_shorten_training(spark, monkeypatch):
    """Units of tokens, not tasks, are what is averaged: as one task or as several, the model is about as good."""
    monkeypatch.setattr(lm, "UNIT", 1000)
    rng = random.Random(1)
    texts = [" ".join(rng.choice([("a b c d", "x y z w"), ("k l m n", "o p q r")][t % 2]) for _ in range(60)) for t in range(200)]
    docs, scores = frame(spark, texts), []
    for n in (1, 4):
        scores.append(sum(r.score for r in lm.scored(docs.repartition(n)).filter("held_out").collect()))
    assert abs(scores[0] - scores[1]) < 0.03 * abs(scores[0])


WORD = (1 << 64) - 1


def finished(x):
    """The 64-bit finaliser, on Python's integers."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ x >> 33) * factor) & WORD
    return x ^ x >> 33


def hash_of(data):
    """Hash of a short run of bytes by its definition: a polynomial in the bytes' codes, finished."""
    h = 0
    for c in data:
        h = (h * 0x9E3779B97F4A7C15 + int(syncmers._CODES[c])) & WORD
    return finished(h)


def brute_anchors(data):
    """Places of the closed syncmers; a text without one is an anchor itself, so only the empty text has none."""
    small = [hash_of(data[i : i + syncmers.S]) for i in range(len(data) - syncmers.S + 1)]
    span = syncmers.K - syncmers.S + 1
    out = {i for i in range(len(data) - syncmers.K + 1) if min(small[i : i + span]) in (small[i], small[i + span - 1])}
    return out or ({0} if data else set())


def brute_hashes(data):
    """Hashes of the anchors by place."""
    if len(data) < syncmers.K or all(min(x) not in (x[0], x[-1]) for x in ([hash_of(data[i + j : i + j + syncmers.S]) for j in range(syncmers.K - syncmers.S + 1)] for i in range(len(data) - syncmers.K + 1))):
        return [int.from_bytes(hashlib.blake2b(data, digest_size=4).digest(), "little")] if data else []
    out = []
    for i in sorted(brute_anchors(data)):
        a, b, c = (hash_of(data[i + j : i + j + syncmers.S]) for j in (0, (syncmers.K - syncmers.S) // 2, syncmers.K - syncmers.S))
        out.append(finished(a ^ (b * 0x9E3779B97F4A7C15 & WORD) ^ finished(c)) >> 32)
    return out


def brute_print(hashes):
    kept = set(sorted(set(hashes))[: syncmers.KEEP])
    return f"{len(set(hashes))}:" + "".join(f"{h:08x}" for h in dict.fromkeys(hashes) if h in kept)


def common_in_order(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]


def test_anchors_equal_brute_force_and_move_with_their_passage():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd ") for _ in range(n)).encode() for n in (0, 3, 15, 16, 17, 200)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = syncmers.anchors(np.frombuffer(b"".join(texts), np.uint8), at[:-1], at[1:])
    assert [set(p.tolist()) for p, _ in got] == [brute_anchors(t) for t in texts]
    passage = texts[-1]
    (p, h), (q, g) = (syncmers.anchors(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0] for x in (passage, b"zz" + passage))
    assert set(zip((p + 2).tolist(), h.tolist(), strict=True)) <= set(zip(q.tolist(), g.tolist(), strict=True))


def test_next_documents(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc déf\n") for _ in range(rng.randint(0, 90))) for _ in range(57)] + ["", None, "x" * 30000]
    ids = rng.sample(range(10**6), len(texts))
    rows = sorted(zip(ids, texts, strict=True))
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 bucket", "true own").repartition(5)
    got = {r.doc_id: r for r in syncmers.with_next(docs).collect()}
    assert len(got) == len(rows)
    compared = 0
    for (k, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, next_, new = (brute_hashes(x.encode()) if len(x) < 1000 else None for x in (t, u, edited))
        if own is None or next_ is None or new is None:
            continue
        assert (r.fingerprint, r.edited_fingerprint) == (brute_print(own), brute_print(new))
        for near, other in ((r.near_edited, new), (r.near_next, next_)):
            if not own or not other:
                assert near == float(own == other)
                continue
            most = 2 * common_in_order(own, other) / (len(own) + len(other))
            unique = len(set(own)) == len(own) and len(set(other)) == len(other)
            assert near == pytest.approx(most) if unique else near <= most + 1e-9
            compared += unique
    assert compared > 60


def test_next_documents_odd_rows(spark):
    one = spark.createDataFrame([(5, "abcdef")], SCHEMA)
    assert syncmers.with_next(one).first().near_next == 1.0
    some = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (None, None)], SCHEMA)
    assert sorted((r.doc_id or 0, r.n_chars) for r in syncmers.with_next(some).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert syncmers.with_next(one.limit(0)).count() == 0
    assert syncmers.fingerprints(some).count() == 4


def test_next_documents_of_a_hot_id(spark):
    """Rows of one id, and of the null id, are in order of a digest of their texts, wherever ranges are cut."""
    rng = random.Random(13)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 40))) for _ in range(160)]
    rows = [((None, 7, 7, k)[k % 4], t) for k, t in enumerate(texts)] + [(7, texts[1])] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    digest = {r.text: r.d for r in docs.selectExpr("text", "xxhash64(text) d").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, digest[r[1]]))
    want = sorted(((k, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()) for (k, t), (_, u) in zip(order, order[1:] + order[:1], strict=True)), key=str)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in syncmers.with_next(docs).collect()), key=str) == want


def test_alignment_against_subsequences():
    rng = random.Random(8)
    for _ in range(200):
        a = [bytes([rng.randrange(97, 110)]) for _ in range(rng.randint(0, 14))]
        b = [bytes([rng.randrange(97, 110)]) for _ in range(rng.randint(0, 14))]
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (x == y))
        assert len(got) <= best[-1][-1]
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(got) == best[-1][-1]


def test_licenses_in_texts(spark):
    rng = random.Random(9)
    noise = lambda n: " ".join(f"w{rng.randrange(50)} under the" for _ in range(n))
    texts, names = [], []
    for name, t in licenses.TEMPLATES.items():
        words = t.split()
        changed = [w if rng.random() > 0.08 else "changed" for w in words] if len(words) > 20 else words
        texts.append(f"{noise(200)}\n{' '.join(changed)}\n{noise(100)}")
        names.append(name)
    texts += [None, "", noise(300), "Released under the MIT License. " * 50]
    docs = frame(spark, texts).selectExpr("*", "1 license")
    got = [r for r in sorted(licenses.scan(docs).collect())]
    for r, name in zip(got, names, strict=False):
        assert name in r.licenses, (name, r)
    assert [r.license for r in got[-4:]] == [None, None, None, "MIT notice"]
    assert got[-4].coverage == 0.0 and got[-4].first_word is None
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licenses_wherever_their_words_stand():
    rng = random.Random(10)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    names = lambda text: [x[0] for x in scanner.carried(scanner.scan(text))]
    long = {k: t.split() for k, t in licenses.TEMPLATES.items() if len(t.split()) >= licenses.SPREAD}
    for name, words in long.items():
        seeds = {w for w, own in scanner.seeds.items() if name in [x[0] for x in own]}
        half = len(words) // 2
        assert names(" ".join(words)) == [name]
        assert names(" ".join([*words[:half], *(f"x{i}" for i in range(3 * len(words))), *words[half:]])) == [name]
        # a foreign word may stand for the one that another variant has there: that one is named after it
        met = scanner.carried(scanner.scan(" ".join(x for w in words for x in (w, f"y{rng.randrange(99)}"))))
        assert [x[0] for x in met if x[1] == 1.0] == [name]
        if name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"):
            left = [w for w in words if not set(licenses.words_of(w)) & seeds]
            assert len(left) < len(words) and names(" ".join(left)) == [name]
    mit = long["MIT"]
    assert names(" ".join(mit[: mit.index("THE")])) == []
    for _ in range(60):
        name = rng.choice(sorted(long))
        words = [w for w in long[name] for w in ([w] if rng.random() < 0.8 else [])]
        for _ in range(rng.randrange(80)):
            words.insert(rng.randrange(len(words)), rng.choice(["the", "of", "software", "z", "copyright"]))
        got = {x[0]: x[1] for x in scanner.scan(" ".join(words))}
        a, b = licenses.words_of(" ".join(words)), scanner.templates[name]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j + 1], new[j], row[j] + (x == y)))
            row = new
        if row[-1] / len(b) >= scanner.least:
            assert got[name] == row[-1] / len(b)
        else:
            assert got.get(name, 0.0) <= row[-1] / len(b)


def test_likeness_covers_all_anchors_in_order_of_position():
    rng = random.Random(11)
    text = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    like = lambda a, b: syncmers.likeness(*syncmers._fingerprints([a, b]))
    first, second = text(3000), text(3000)
    assert like(first + second, first + second) == 1.0
    assert 0.45 < like(first + second, second + first) < 0.55
    for _ in range(12):  # a hundredth of a long text
        shared = text(300)
        assert like(text(9000) + shared + text(20700), text(20000) + shared + text(9700)) > 0
    for _ in range(60):
        values = np.arange(30, dtype=np.uint32)
        a, b = (np.array(rng.sample(list(values), rng.randint(1, 30)), np.uint32) for _ in range(2))
        b = a.copy() if rng.random() < 0.1 else b
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j + 1], new[j], row[j] + int(x == y)))
            row = new
        assert syncmers.matched(a, b) == row[-1]
        repeated = np.concatenate([a, b, a]), np.concatenate([b, a, b])
        assert 0 < syncmers.matched(*repeated) <= min(map(len, repeated))
    same = np.zeros(500, np.uint32)
    assert syncmers.matched(same, same[:300]) == 300
