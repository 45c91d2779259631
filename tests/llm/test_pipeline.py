"""The pipeline's stages against brute force, each on its own input."""

import random
from collections import Counter

import pytest
from test_near_and_lines import brute_lines, components, digests, shingles
from test_rules import brute_targets

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from orbitkeep.llm import bpe, rulefit  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n=60):
    """Lines of words, each with a full stop."""
    words = [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice(["", "ea", "io"]) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean and bad documents, copies, near copies, shared lines, and odd rows; with labels of the clean and bad ones."""
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(120):
        rows.append((k, prose(rng), "en", f"s{k % 4}"))
        labels.append((k, 1))
    for k in range(200, 260):
        rows.append((k, " ".join(w.upper() + "#$%!!" for w in prose(rng, 30).split()), "en", "s1"))
        labels.append((k, 0))
    shared = "this line stands in many of the documents of this corpus and says little."
    rows += [(300 + k, f"{shared}\n{prose(rng)}", "de", "s2") for k in range(20)]
    base = prose(rng, 120)
    rows += [(400 + k, base.replace(" ", "  ", k), "en", "s0") for k in range(5)]
    near = prose(rng, 240).split(" ")
    rows += [(500 + k, " ".join([*near[: 20 * k], f"changed{k}", *near[20 * k + 1 :]]), None, None) for k in range(1, 5)]
    rows += [(600, None, None, "s1"), (601, "", "en", None), (602, "x", "en", "s1"), (None, prose(rng), "en", "s1"), (7, rows[7][1], "en", "s3"), (603, prose(rng, 4000), "fr", "s2")]
    docs = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return docs, str(path)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def read(spark, corpus):
    return spark.read.parquet(f"{corpus[1]}/documents.parquet")


def test_stages_are_those_asked_for():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "source_mixing", "bpe_tokens"]


def test_quality_classifier(spark, corpus):
    docs = read(spark, corpus)
    got = STAGES["quality_classifier"](spark, docs, corpus[1])
    assert got.columns == docs.columns
    accepted = {(r.doc_id, r.score >= rulefit.CUT) for r in rulefit.scored(docs, spark.read.parquet(f"{corpus[1]}/labels.parquet")).collect()}
    assert rows_of(got) == sorted((d for d in corpus[0] if (d[0], True) in accepted), key=repr)
    kept = {r.doc_id for r in got.collect()}
    assert set(range(120)) <= kept and not kept & set(range(200, 260))


def test_line_dedup(spark, corpus):
    docs = read(spark, corpus)
    gone = brute_lines([d[:2] for d in corpus[0]], digests(docs))
    want = []
    for k, text, lang, source, _ in corpus[0]:
        left = text if not gone[k, text] else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[k, text])
        if not gone[k, text] or left.strip():
            want.append((k, left, lang, source, None if left is None else len(left)))
    got = STAGES["line_dedup"](spark, docs, corpus[1])
    assert got.columns == docs.columns and rows_of(got) == sorted(want, key=repr)
    assert sum("stands in many" in (r.text or "") for r in got.collect()) == 1


def test_near_dedup(spark, corpus):
    docs = read(spark, corpus)
    got = STAGES["near_dedup"](spark, docs, corpus[1])
    texts = [t for _, t, *_ in corpus[0]]
    groups = components([shingles(t) for t in texts], 80, 100)
    first = {}
    for d, g in zip(corpus[0], groups, strict=True):
        if d[0] is not None:
            first[g] = min(first.get(g, d[0]), d[0])
    stay = Counter()
    for d, g in zip(corpus[0], groups, strict=True):
        if d[0] is None or not shingles(d[1]) or first[g] == d[0]:
            stay[d[0]] += 1
    have = Counter(r.doc_id for r in got.collect())
    assert got.columns == docs.columns
    assert {k: v for k, v in have.items() if k is not None} == dict.fromkeys((k for k in stay if k is not None), 1)
    assert have[None] == 1
    assert {400, 501} <= set(have) and not set(have) & {401, 402, 403, 404, 502, 503, 504}


def test_source_mixing(spark, corpus):
    docs = read(spark, corpus)
    got = STAGES["source_mixing"](spark, docs, corpus[1]).collect()
    size = lambda t: len((t or "").split())
    sizes = Counter()
    for _, t, _, s, _ in corpus[0]:
        sizes[s] += size(t)
    target, taken, largest = brute_targets(dict(sizes)), Counter(), Counter()
    for r in got:
        taken[r.source] += size(r.text)
    for _, t, _, s, _ in corpus[0]:
        largest[s] = max(largest[s], size(t))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    times = Counter(tuple(r) for r in got)
    assert set(times) <= set(corpus[0]) and max(times.values()) <= 2 * max(Counter(corpus[0]).values())


def test_bpe_tokens(spark, corpus):
    docs = read(spark, corpus)
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    for r in STAGES["bpe_tokens"](spark, docs, corpus[1]).collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == theirs.decode(ids, skip_special_tokens=False)


def test_run_is_the_stages_one_after_the_other(spark, corpus, tmp_path):
    docs = read(spark, corpus)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus[1]).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    got = corpus_pipeline.run(spark, corpus[1])
    assert got.columns == docs.columns and rows_of(got) == rows_of(docs) and docs.count() > 100
    assert [corpus_pipeline.STAGES[k][1](spark, read(spark, corpus).limit(0), corpus[1]).count() for k in range(5)] == [0] * 5
