"""Quality rules against a brute-force count, and odd rows of rules and classifier."""

import random
import re

import numpy as np
import pytest

from orbitkeep.llm import mixing, qualityrules, rulefit, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, kept int, fence_symbols string"
TEXTS = [None, "", " \n", "a b c", "one two three four five six " * 3, "x#y & z\nx#y & z\n\nq w e r t y u i o p", " ".join(f"w{i}é" for i in range(40)), "a a a a a a a a a a a a"]


def counts(text):
    find = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    text = text or ""
    words = find(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if find(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_statistics_equal_brute_force(spark):
    rows = [(k, t, None if k % 2 else "en", "s" if k % 3 else None, 1, "x") for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([*rows, (None, "a b", None, None, 1, "x"), rows[4]], SCHEMA)
    got = qualityrules.judge(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        own = counts("a b" if r.doc_id is None else TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == own
        assert not (r.base_failed and r.kept)
    assert qualityrules.judge(docs.limit(0)).count() == 0


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, None, None, 1, "x") for k, t in enumerate(TEXTS)] + [(None, "a", None, None, 1, "x")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = rulefit.scored(docs, none).collect()
    assert len(got) == len(TEXTS) + 1 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in rulefit.scored(docs, odd).collect())
    assert rulefit.scored(docs.limit(0), odd).count() == 0
    assert rulefit.kept(docs, none).columns == docs.columns


def test_verdicts_equal_brute_force_in_groups_with_outliers(spark):
    rng = random.Random(3)

    def text(k, words=100, lines=10, size=5):
        made = [f"{k}x{i}".ljust(size, "z")[-size:] if size > 3 else rng.choice("abcdefghijklmnopqrstuvwxyz") for i in range(words)]
        step = words // lines
        return "\n".join(" ".join(made[i : i + step]) for i in range(0, words, step))

    rows = []
    for lang, size, n in (("en", 6, 260), ("de", 9, 240), ("fr", 6, 30)):
        for k in range(n):
            own = text(k, size=size)
            if k < 6:  # 9 of 20 lines are repeats
                own = ["\n".join(f"{x}\na b c" for x in own.split("\n")), " ".join(["w%d" % i for i in range(85)] + ["p q r s t"] * 2), own + " #" * 12, text(k, size=2), own + " # ", "\n".join(own.split("\n")[:9] + own.split("\n")[:2])][k]
            rows.append((1000 * len(rows) + k, own, lang, "s", 1, "x"))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in qualityrules.judge(docs).collect()}

    def ratios(t):
        n, chars, symbols, dup, repeats, _ = counts(t)
        lines = len([x for x in t.split("\n") if x.strip()])
        whole = {"symbols": 1000 * symbols // n, "word_length": 1000 * chars // n, "dup_lines": 1000 * dup // lines, "repeats": 1000 * repeats // n}
        return {k: v - v % 10 ** max(len(str(v)) - 3, 0) for k, v in whole.items()}

    def quantiles(group):
        out = {}
        for k, x in qualityrules.RATIOS.items():
            v = sorted(ratios(r[1])[k] for r in group)
            out[k] = {q: v[-(-len(v) * (n or x[3]) // 100) - 1] for q, n in qualityrules.QUANTILES.items()}
        return len(group), out

    every, prior, dropped = quantiles(rows), qualityrules.PRIOR, set()
    for lang in ("en", "de", "fr"):
        group = [r for r in rows if r[2] == lang]
        n, own = quantiles(group)
        fence = {}
        for k, x in qualityrules.RATIOS.items():
            drawn = lambda a, b: (n * a + prior * b) / (n + prior)  # noqa: E731, B023
            q = {c: drawn(own[k][c], drawn(own[k][c], every[1][k][c])) for c in own[k]}  # one source: the language is the group
            fence[k] = (min(q["q1"] - 3 * (q["q3"] - q["q1"]), q["low"] - x[2]), max(q["q3"] + 3 * (q["q3"] - q["q1"]), q["high"] + x[2]))
        for r in group:
            stats, lines = counts(r[1]), len([x for x in r[1].split("\n") if x.strip()])
            n_words, _, symbols, dup, repeats, failed = stats
            fits = True
            for k, count, of, grain in (("symbols", symbols, n_words, 1), ("dup_lines", dup, lines, 1), ("repeats", repeats, n_words, 10)):
                allowed = fence[k][1] * of / 1000
                fits &= count <= allowed + 2 * (grain * allowed) ** 0.5 + grain
            mean, room = ratios(r[1])["word_length"], 4000 / n_words**0.5
            fits &= fence["word_length"][0] - room <= mean <= fence["word_length"][1] + room
            assert got[r[0]].kept == (fits and not failed), (r, fence)
            assert abs(got[r[0]].fence_dup_lines - fence["dup_lines"][1]) < 1e-6
            if not got[r[0]].kept and not got[r[0]].base_failed:
                dropped.add((lang, r[0] % 1000))
    assert {(lang, k) for lang in ("en", "de") for k in (0, 2, 3)} <= dropped, dropped
    assert not any(k > 5 for _, k in dropped) and ("en", 4) not in dropped and ("en", 5) not in dropped
    assert len({(r.lang_, r.fence_word_length) for r in qualityrules.judge(docs).join(docs.selectExpr("doc_id", "lang lang_"), "doc_id").collect()}) == 3


# -- classifier ----------------------------------------------------------------------
def test_trees_lasso_and_column_against_numpy(spark, monkeypatch):
    """The rules are paths of the trees, the weights minimise the penalised likelihood, and the column gives the model's scores."""
    monkeypatch.setattr(rulefit, "STEPS", 20_000)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, len(rulefit.FEATURES)))
    y = ((x[:, 0] > 0.3) & (x[:, 1] <= 0.5) | (x[:, 2] > 1.2)).astype(float)
    y[rng.random(800) < 0.03] = 1
    bias, rules = rulefit.fit(x, y)
    held = np.stack([np.logical_and.reduce([(x[:, f] > t) == bool(side) for f, t, side in terms]) for _, terms in rules], axis=1).astype(float)
    weights = np.array([w for w, _ in rules])
    assert 0 < len(rules) < 200 and all(len(terms) <= rulefit.DEPTH for _, terms in rules)
    p = 1 / (1 + np.exp(-(bias + held @ weights)))
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.95
    # at the minimum a rule's gradient (of standardised columns) equals the penalty, against the sign of its weight
    spread = held.std(axis=0)
    gradient = ((held - held.mean(axis=0)) / spread).T @ (p - y) / len(y)
    assert np.abs(gradient + np.sign(weights) * rulefit.LASSO).mean() < rulefit.LASSO / 4 and np.abs(gradient).max() < 1.3 * rulefit.LASSO and abs((p - y).mean()) < 1e-4
    frame = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x[:200])], "id long, " + ", ".join(f"f_{k} double" for k in rulefit.FEATURES))
    got = [r.s for r in frame.select("id", rulefit.score((bias, rules)).alias("s")).orderBy("id").collect()]
    assert np.allclose(got, p[:200])


def test_held_out_accuracy(spark, sf_dir):
    """On the labels that are never learned from."""
    docs, labels = (spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = rulefit.scored(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.97
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_kept_documents_are_those_scored_so_and_features_are_computed_once(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    clashing = docs.selectExpr("*", "1 score", "2 at", "3 row", "4 n_lines", "5 _t")
    left = rulefit.kept(clashing, labels)
    assert left.columns == clashing.columns
    want = {r.doc_id for r in rulefit.scored(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in left.collect()} == want and 0 < len(want) < docs.count()
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in (left, rulefit.scored(docs, labels))]
    assert plans[0].count("regexp_count") <= plans[1].count("regexp_count") + 1 and plans[0].count("split(") <= plans[1].count("split(") + 1


# -- urls -------------------------------------------------------------------------------
def brute_verdict(url, rules, default="allow"):
    low = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = low(host)
    fits = [(len(low(h)) + len(p), len(h), low(h) + p, action) for h, p, action in rules if h and (host == low(h) or host.endswith("." + low(h))) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_urls_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", broadcast)
    rules = [("net", "/", "block"), ("example.NET", "/en/", "allow"), ("b.example.net", "/", "block"), ("b.example.net", "/", "allow"), ("com", "/de/abcd", "block"), ("a.b.com", "/de/", "allow"), ("org", "", "block"), ("", "/x", "block")]
    rng = random.Random(2)
    hosts = ["net", "example.net", "b.example.net", "x.B.Example.net", "notexample.net", "com", "a.b.com", "c.a.b.com", "org", "x..org", ".", "", "éxample.org", "b.com"]
    urls = [f"{rng.choice(['http://', 'ftp://', '://', '', 'http:/'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/x?y=/de/', '/de/abcdef#z', '/de/', '?q', '#f', '/EN/'])}" for _ in range(300)]
    urls += [None, "", "://", "a://b://c/d", "http://" + "a." * 300 + "net/", "http://net/" + "x" * 30000, urls[0], urls[0]]
    pages = spark.createDataFrame([(k, u, "own", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, digest int")
    out = urlfilter.judge(pages, spark.createDataFrame(rules, "host string, path string, action string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert out.columns == ["page_id", "url", "digest", "host", "path", "rule", "verdict"] and len(got) == len(urls)
    for k, u in enumerate(urls):
        assert got[k] == brute_verdict(u, rules), u
    assert urlfilter.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, action string")).count() == 0
    none = urlfilter.judge(pages, spark.createDataFrame([], "host string, path string, action string"), default="block")
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "block")}


# -- mixing -------------------------------------------------------------------------------
def brute_targets(sizes):
    """By water-filling: what is cut off at a limit is shared again by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= over
    return target


def test_mixing_of_odd_rows(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", None, "c", "é"])) for k in range(400)]
    rows += [(None, "x y", "a"), (None, None, "b"), (7, "x y z", "a"), (7, "x y z", "a"), (500, "w " * 20000, "c"), (501, "", "empty"), (502, None, "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'t' target", "1 source_size", "2 copies", "3 whole", "4 cut", "5 row", "6 _source", "7 taken")
    got = mixing.taken(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target, taken = brute_targets(sizes), {}
    assert len(got) == len(rows)
    back = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        back.setdefault(r.doc_id, []).append(r)
    for k, t, s in rows:
        one = next(r for r in back[k] if r["size"] == len((t or "").split()) and r.source_size == sizes[s])
        assert abs(one.target - target[s]) < 1e-6
        taken[s] = taken.get(s, 0) + one.taken
    for s, n in taken.items():  # to half of a document at the edge
        largest = max(len((t or "").split()) for _, t, own in rows if own == s)
        assert abs(n - target[s]) <= largest, (s, n, target[s])
    assert sorted(map(str, mixing.taken(docs).collect())) == sorted(map(str, got))  # reruns agree
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg({"copies": "min", "target": "max", "whole": "sum"}).first()["max(target)"] == "t"
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.taken(docs.limit(0)).count() == 0
