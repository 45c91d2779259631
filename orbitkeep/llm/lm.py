"""Text likelihood by a log-bilinear model with noise-contrastive estimation.

Tokens are lower-cased words and an end after each text.  The ``CONTEXT`` tokens
before a token have vectors; their sum, each weighted by the vector of its
position, predicts the token by products with output vectors and biases.  The
prediction is factored so that it is normalised at little cost: first the
ending (a class of words by their last two bytes), then the word within it.
Frequent words have vectors of their own, ``words_of`` the vocabulary's size; all
others of an ending share one, and are told apart by their smoothed relative
frequency.  So probabilities add up to one over all words, unknown ones
included.  For scoring, batched matrix products of contexts with all outputs (of
endings, and of one ending's words) give the normalised log-probabilities.

Training covers all training documents, in ``ROUNDS`` over disjoint shares of
them.  In a round, every ``UNIT`` tokens start from the same values and are gone
through in minibatches, with noise drawn from the frequencies of endings and of
words within an ending; then values are averaged by a grouped sum, and the next
round starts from there.  A unit is as long however many there are, so neither
the number of tasks nor that of documents shortens the training of a model.

Counts of all tokens of the corpus are exact.  Those of the ``HEAD`` most
frequent tokens at most are broadcast; the rare rest is joined.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .scratch import Scratch

ENDINGS, DIM, CONTEXT = 128, 16, 3
#: Examples of a minibatch, noise endings for all of them, noise words for each, and the learning rate.
BATCH, NOISE, WORD_NOISE, RATE = 2048, 24, 1, 0.05
#: Words with vectors: at least, at most, and how many words of the vocabulary there are for one.
LEAST_WORDS, MOST_WORDS, WORDS_FOR_ONE = 1024, 1 << 16, 256
#: Shares of the training documents, in 16ths, that the rounds go through.
ROUNDS = (2, 4, 10)
#: Scores that are worked on at once.
CELLS = 1 << 18
#: Tokens after which a model in training starts anew.
UNIT = 1 << 22
#: Tokens broadcast at most, 20 bytes each.
HEAD = 300_000
#: Counted tokens that a task gathers before it passes them on.
GATHER = 1 << 20
#: The end token's id; its ending class is 0.
END = np.int64(-0x7E57E57E57E57E57)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and ending classes of the tokens of each row, with offsets; each row closes with END."""
    starts, ends, rows = tc.word_spans(data, offsets)
    n = len(offsets) - 1
    ids = np.full(len(starts) + n, END)
    classes = np.zeros(len(ids), np.int64)
    place = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(rows))
    ids[place] = tc.span_hashes(data, starts, ends).view(np.int64)
    if len(starts):
        last = tc.LOWER[data[ends - 1]].astype(np.int64)
        before = np.where(ends - starts > 1, tc.LOWER[data[np.maximum(ends - 2, 0)]], 0).astype(np.int64)
        classes[place] = ((last * 131 + before) * 40503 >> 4) % ENDINGS
    return ids, classes, rows + np.arange(n + 1)


def _counts(batches):
    """(token, ending, n), added up within the task as far as memory is bounded."""
    held, size = [], 0

    def added():
        ids, ending, n = (np.concatenate(x) for x in zip(*held, strict=True))
        one, first, back = np.unique(ids, return_index=True, return_inverse=True)
        return one, ending[first], np.bincount(back, n, len(one)).astype(np.int64)

    for batch in batches:
        for _, _, data, offsets in tc.chunks(batch.column(0)):
            ids, ending, _ = tokens(data, offsets)
            one, first, n = np.unique(ids, return_index=True, return_counts=True)
            held.append((one, ending[first], n))
            size += len(one)
            if size > GATHER:
                held = [added()]
                size = len(held[0][0])
                if size > GATHER // 2:
                    yield _count_rows(held.pop())
                    size = 0
    if held:
        yield _count_rows(added())


def _count_rows(x) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1].astype(np.int32)), pa.array(x[2])], names=["token", "ending", "n"])


def words_of(distinct: int) -> int:
    """How many words have vectors of their own: a power of two that grows with the vocabulary."""
    return min(max(1 << max(distinct // WORDS_FOR_ONE, 1).bit_length() - 1, LEAST_WORDS), MOST_WORDS)


class Lookup:
    """The most frequent tokens: sorted ids, counts, and model classes.

    Classes are in order of their endings; an ending's last class is the rest of its words.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, endings: np.ndarray, words: int):
        order = np.argsort(ids)
        self.ids, self.counts = ids[order], counts[order]
        endings = endings[order].astype(np.int64)
        best = np.lexsort((self.ids, -self.counts))[:words]
        best = best[np.lexsort((self.ids[best], endings[best]))]
        own = np.bincount(endings[best], minlength=ENDINGS)
        self.first = np.concatenate([[0], np.cumsum(own + 1)])  # of each ending, and of none
        self.cls = np.full(len(ids), -1, np.int64)
        self.cls[best] = np.arange(len(best)) + endings[best]
        self.ending_of = np.repeat(np.arange(ENDINGS), own + 1)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether found)."""
        if not len(self.ids):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return at, self.ids[at] == ids

    def classes(self, at: np.ndarray, found: np.ndarray, ending: np.ndarray) -> np.ndarray:
        own = np.where(found, self.cls[at], -1) if len(self.ids) else np.full(len(at), -1)
        return np.where(own >= 0, own, self.first[ending + 1] - 1)


def _sigma(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Model:
    NAMES = ("context", "word", "bias", "ending", "ending_bias", "position")

    def __init__(self, weights: np.ndarray, first: np.ndarray):
        """weights: how often each class occurs; first: the first class of each ending, and their number."""
        rng = np.random.default_rng(7)
        self.first, n = first, len(weights)
        self.ending_of = np.repeat(np.arange(ENDINGS), np.diff(first))
        share = (weights + 0.5) / (weights + 0.5).sum()
        self.of_ending = np.add.reduceat(share, first[:-1])
        self.within = share / self.of_ending[self.ending_of]
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.context, self.word, self.ending = small(n, DIM), small(n, DIM), small(ENDINGS, DIM)
        self.bias, self.ending_bias = np.log(self.within).astype(np.float32), np.log(self.of_ending).astype(np.float32)
        self.position = np.ones((CONTEXT, DIM), np.float32)

    def values(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).reshape(-1) for k in self.NAMES])

    def put(self, values: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            own = getattr(self, k)
            setattr(self, k, values[at : at + own.size].reshape(own.shape).astype(np.float32))
            at += own.size

    def state(self, seed: int) -> dict:
        within = np.cumsum(self.within)
        start = np.concatenate([[0], within[self.first[1:-1] - 1]])
        return {"rng": np.random.default_rng(seed), "endings": np.cumsum(self.of_ending)[:-1], "words": within, "start": start, **{k: np.full_like(getattr(self, k), 1e-2) for k in self.NAMES}}

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """What (rows, CONTEXT) classes predict."""
        out = self.context[before[:, 0]] * self.position[0]
        for k in range(1, CONTEXT):
            out += self.context[before[:, k]] * self.position[k]
        return out

    def train(self, before: np.ndarray, after: np.ndarray, state: dict) -> None:
        """One minibatch: endings against noise endings, words against noise words of their ending."""
        rng, n = state["rng"], len(after)
        x, e = self.predicted(before), self.ending_of[after]
        # endings: noise is the same for the whole batch
        noise = np.searchsorted(state["endings"], rng.random(NOISE))
        offset = np.log(NOISE * self.of_ending).astype(np.float32)
        own, other = self.ending[e], self.ending[noise]
        real = 1 - _sigma(np.einsum("ij,ij->i", x, own) + self.ending_bias[e] - offset[e])
        fake = -_sigma(x @ other.T + self.ending_bias[noise] - offset[noise])
        toward = real[:, None] * own + fake @ other
        self._step("ending", state, _summed(np.concatenate([e, noise]), np.concatenate([real[:, None] * x, fake.T @ x]), ENDINGS))
        self._step("ending_bias", state, np.bincount(np.concatenate([e, noise]), np.concatenate([real, fake.sum(axis=0)]), ENDINGS))
        # words: noise of each example's own ending
        drawn = np.searchsorted(state["words"], state["start"][e][:, None] + rng.random((n, WORD_NOISE)), side="right")
        words = np.concatenate([after[:, None], np.clip(drawn, self.first[e][:, None], self.first[e + 1][:, None] - 1)], axis=1)
        vectors = self.word[words]
        logit = np.einsum("id,ikd->ik", x, vectors) + self.bias[words] - np.log(WORD_NOISE * self.within[words]).astype(np.float32)
        pull = -_sigma(logit)
        pull[:, 0] += 1
        toward += np.einsum("ik,ikd->id", pull, vectors)
        self._step("word", state, _summed(words.reshape(-1), (pull[:, :, None] * x[:, None, :]).reshape(-1, DIM), len(self.word)))
        self._step("bias", state, np.bincount(words.reshape(-1), pull.reshape(-1), len(self.bias)))
        position = np.stack([(self.context[before[:, k]] * toward).sum(axis=0) for k in range(CONTEXT)])
        parts = np.concatenate([toward * self.position[k] for k in range(CONTEXT)])
        self._step("context", state, _summed(before.T.reshape(-1), parts, len(self.context)))
        self._step("position", state, position / n)

    def _step(self, name: str, state: dict, g: np.ndarray) -> None:
        own, seen = getattr(self, name), state[name]
        g = g.astype(np.float32).reshape(own.shape)
        seen += g * g
        own += RATE * g / np.sqrt(seen)

    def log10(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of classes after their contexts."""
        out = np.empty(len(after), np.float32)
        endings, words = np.ascontiguousarray(self.ending.T), np.ascontiguousarray(self.word.T)
        ones = {n: np.ones(n, np.float32) for n in {ENDINGS, *np.diff(self.first).tolist()}}

        def chosen(x: np.ndarray, outputs: np.ndarray, bias: np.ndarray, own: np.ndarray) -> np.ndarray:
            """Log-probabilities of the outputs ``own``; blocks of scores stay in the cache."""
            got, step = np.empty(len(own), np.float32), max(CELLS // len(bias), 1)
            for i in range(0, len(own), step):
                score = x[i : i + step] @ outputs
                score += bias
                part = score[np.arange(len(score)), own[i : i + step]]
                np.exp(score, out=score)
                got[i : i + step] = part - np.log(score @ ones[len(bias)])
            return got

        for i in range(0, len(after), 1 << 17):
            x, own = self.predicted(before[i : i + (1 << 17)]), after[i : i + (1 << 17)]
            e = self.ending_of[own]
            order = np.argsort(e.astype(np.uint16), kind="stable")
            x, own, e = x[order], own[order], e[order]
            part = chosen(x, endings, self.ending_bias, e)
            cuts = np.searchsorted(e, np.arange(ENDINGS + 1))
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
                rows, of = slice(cuts[k], cuts[k + 1]), slice(self.first[k], self.first[k + 1])
                part[rows] += chosen(x[rows], words[:, of], self.bias[of], own[rows] - self.first[k])
            out[i + order] = part
        return out.astype(np.float64) / np.log(10)


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Values of equal rows added up."""
    at = rows[:, None] * values.shape[1] + np.arange(values.shape[1])
    return np.bincount(at.reshape(-1), values.reshape(-1), n * values.shape[1])


def _examples(lookup: Lookup, data: np.ndarray, offsets: np.ndarray):
    """Classes of the tokens and of the CONTEXT before each, the nearest first (END before each row's first), and where and whether tokens are found."""
    ids, ending, at = tokens(data, offsets)
    place, found = lookup.find(ids)
    after = lookup.classes(place, found, ending)
    end = lookup.classes(*lookup.find(np.array([END])), np.array([0]))[0]
    number = np.arange(len(ids)) - np.repeat(at[:-1], np.diff(at))
    before = np.full((len(ids), CONTEXT), end)
    for k in range(CONTEXT):
        there = np.flatnonzero(number > k)
        before[there, k] = after[there - k - 1]
    return ids, after, before, at, place, found


def _train(shared):
    def run(batches):
        lookup, start = shared.value
        total, n = np.zeros(len(start.values())), 0
        model, state, seen, held, size = copy.deepcopy(start), start.state(11), 0, [], 0

        def train():
            nonlocal size
            before, after = (np.concatenate(x) for x in zip(*held, strict=True))
            order = state["rng"].permutation(len(after))
            for i in range(0, len(order), BATCH):
                model.train(before[order[i : i + BATCH]], after[order[i : i + BATCH]], state)
            held.clear()
            size = 0

        for batch in batches:
            for _, _, data, offsets in tc.chunks(batch.column(0)):
                _, after, before, _, _, _ = _examples(lookup, data, offsets)
                at = 0
                while at < len(after):
                    upto = min(at + UNIT - seen, len(after))
                    held.append((before[at:upto], after[at:upto]))
                    size, seen, at = size + upto - at, seen + upto - at, upto
                    if size >= 4 * BATCH or seen == UNIT:
                        train()
                    if seen == UNIT:
                        total, n = total + model.values().astype(np.float64) * seen, n + seen
                        model, state, seen = copy.deepcopy(start), start.state(11), 0
        if held:
            train()
        if seen:
            total, n = total + model.values().astype(np.float64) * seen, n + seen
        if n:
            cuts = range(0, len(total), ROW)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([n] * len(cuts), pa.int64()), pa.array([total[i : i + ROW].tobytes() for i in cuts], pa.binary())], names=["part", "n", "sums"])

    return run


#: Parameters in a row of their sums, and rows added up at once.
ROW = 4096


def _added(batches):
    """Rows of one part, sorted by it, added up; a part ends where the next begins."""
    part, n, total = None, 0, None
    for batch in batches:
        for p, k, sums in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own = np.frombuffer(sums, np.float64)
            if p != part:
                if part is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "n", "sums"])
                part, n, total = p, 0, np.zeros(len(own))
            n, total = n + k, total + own
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "n", "sums"])


def _averaged(docs: DataFrame, lookup: Lookup, model: Model) -> Model:
    shared = docs.sparkSession.sparkContext.broadcast((lookup, model))
    schema = "part int, n long, sums binary"
    # all parameters once at the driver, whatever the corpus
    rows = docs.mapInArrow(_train(shared), schema).repartition("part").sortWithinPartitions("part", "n", "sums").mapInArrow(_added, schema)
    rows = sorted(rows.collect())
    if rows:
        model.put(np.concatenate([np.frombuffer(r["sums"], np.float64) / r["n"] for r in rows]))
    shared.destroy()
    return model


def _scores(shared):
    def run(batches):
        lookup, model, spread, total = shared.value
        rest = np.zeros(len(model.bias), bool)
        rest[lookup.first[1:] - 1] = True
        for batch in batches:
            for i, j, data, offsets in tc.chunks(batch.column(1)):
                ids, after, before, at, place, found = _examples(lookup, data, offsets)
                c = np.where(found, lookup.counts[place], 0) if len(lookup.ids) else np.zeros(len(ids), np.int64)
                known = np.log10(np.where(found, c, 0.5) + 0.5)  # 0 for tokens not found: the join adds their part
                score = model.log10(before, after)
                score += np.where(rest[after], known - spread[model.ending_of[after]], 0.0)
                add = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  each row has an END
                n = np.diff(at)
                rare = np.flatnonzero(~found)
                cuts = np.searchsorted(rare, at).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(add((found & (c > 0)).astype(np.int64))), pa.array(add(known) - n * total), pa.array(add(score)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids[rare]))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"],
                )

    return run


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Null texts are empty: one token, the end.  Rows of a null id are learned
    from.  Repeated rows count and are scored each; other columns are ignored;
    without training documents counts are 0 and the model is uniform; an empty
    table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    learned = docs.filter(~held_out(F.col("doc_id")))
    counted = learned.select("text").mapInArrow(_counts, "token long, ending int, n long")
    vocabulary = scratch.save(counted.groupBy("token").agg(F.max("ending").alias("ending"), F.sum("n").alias("c")))
    # the largest head within the bound: by counts rounded down to three digits, a few thousand values
    unit = F.pow(F.lit(10.0), F.greatest(F.length(F.col("c").cast("string")) - 3, F.lit(0))).cast("long")
    steps = vocabulary.groupBy((F.col("c") - F.col("c") % unit).alias("c")).agg(F.count("*").alias("n"), F.sum("c").alias("total")).orderBy(F.desc("c")).collect()
    total, distinct = sum(r["total"] for r in steps), sum(r["n"] for r in steps)
    least, size = 1 << 62, 0
    for r in steps:
        size += r["n"]
        if size > HEAD:
            break
        least = r["c"]
    head = vocabulary.filter(F.col("c") >= least).toArrow().to_pandas()
    lookup = Lookup(head["token"].to_numpy(np.int64), head["c"].to_numpy(np.int64), head["ending"].to_numpy(np.int64), words_of(distinct))
    # occurrences and distinct words of each ending, without the words of the model
    own = lookup.cls >= 0
    n, v = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in vocabulary.groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n[r["ending"]], v[r["ending"]] = r["n"], r["v"]
    n -= np.bincount(lookup.ending_of[lookup.cls[own]], lookup.counts[own], ENDINGS)
    v -= np.bincount(lookup.ending_of[lookup.cls[own]], minlength=ENDINGS)
    weights = np.zeros(lookup.first[-1])
    weights[lookup.cls[own]] = lookup.counts[own]
    weights[lookup.first[1:] - 1] = n
    model = Model(weights, lookup.first)
    share, upto = F.pmod(F.xxhash64("doc_id", "text"), F.lit(sum(ROUNDS))), 0
    for size in ROUNDS:
        model = _averaged(learned.filter((share >= upto) & (share < upto + size)).select("text"), lookup, model)
        upto += size

    shared = spark.sparkContext.broadcast((lookup, model, np.log10(n + 0.5 * (v + 1)), float(np.log10(total + 0.5 * (distinct + 1)))))
    rows = docs.mapInArrow(_scores(shared), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<long>")
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count("*").alias("k"))
    rare = rare.join(vocabulary.select("token", "c"), "token", "left").groupBy("row")
    # tokens that the head lacks: log10(c + 0.5), and whether they are known at all
    rare = rare.agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(F.lit(0))).alias("known"))
    out = rows.drop("rare").join(rare, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
