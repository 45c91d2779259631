"""Document quality by a sparse ensemble of rules.

Shallow boosted trees are grown on text statistics of a bounded sample of
labelled rows; every path from a root is a conjunction of thresholds, that is a
rule; a lasso-penalised logistic regression keeps few of the rules; and those
are compiled into one Spark column expression, by which all documents are
scored without Python.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textstats as ts

#: Labelled rows that the model is fitted on at most (those of the smallest hashes); about 100 bytes each at the driver.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, SHRINK, LEAST_ROWS = 40, 3, 64, 0.3, 10
#: Penalty of a rule's weight, in log-likelihood a row.
LASSO, STEPS = 2e-4, 600
#: Scores from here on count as good.
CUT = 0.3

FEATURES = ("n_words", "word_length", "symbols", "shouts", "bars", "capitals", "digits", "dup_lines", "distinct", "lines")


def features(docs: DataFrame, keep: list) -> DataFrame:
    """``keep`` and one double per feature; null texts are empty, and ratios of nothing are 0."""
    rows = ts.with_line_counts(docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t")), "_t")
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("double")
    rows = rows.withColumns({"_w": ts.words(F.col("_t")), "_symbols": count("[#*$%&<>]"), "_shouts": count("!"), "_bars": count("\\|"), "_capitals": count("[A-ZÀ-ÖØ-Þ]"), "_digits": count("[0-9]"), "_chars": F.length("_t").cast("double")}).drop("_t")
    n = F.size("_w").cast("double")
    of = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    chars = F.col("_chars")
    made = {
        "n_words": n, "word_length": of(F.length(F.array_join("_w", "")).cast("double"), n), "symbols": of(F.col("_symbols"), n), "shouts": of(F.col("_shouts"), n), "bars": of(F.col("_bars"), n),
        "capitals": of(F.col("_capitals"), chars), "digits": of(F.col("_digits"), chars), "dup_lines": of(F.col("n_dup_lines").cast("double"), F.col("n_lines").cast("double")),
        "distinct": of(F.size(F.array_distinct("_w")).cast("double"), n), "lines": of(F.col("n_lines").cast("double"), n),
    }
    return rows.select(*[c for c in rows.columns if not c.startswith("_") and c not in ("n_lines", "n_dup_lines")], *[v.alias(f"f_{k}") for k, v in made.items()])


# -- fitting, on the bounded sample ------------------------------------------
def _tree(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, paths: list, rows: np.ndarray, path: tuple, out: np.ndarray) -> None:
    """Grow a node; append the path of each node but the root; add the leaves' steps to out."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best, at = 1e-6, None
    if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
        for f in range(binned.shape[1]):
            own = binned[rows, f]
            n, gs, hs = np.bincount(own, minlength=BINS).cumsum()[:-1], np.bincount(own, grad[rows], BINS).cumsum()[:-1], np.bincount(own, hess[rows], BINS).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = 0
            if gain.max() > best:
                best, at = gain.max(), (f, int(gain.argmax()))
    if at is None:
        out[rows] += SHRINK * g / (h + 1)
        return
    low = binned[rows, at[0]] <= at[1]
    for side, own in ((0, rows[low]), (1, rows[~low])):
        paths.append((*path, (*at, side)))
        _tree(binned, grad, hess, paths, own, (*path, (*at, side)), out)


def _holds(binned: np.ndarray, path: tuple) -> np.ndarray:
    return reduce(np.logical_and, [(binned[:, f] > b) == bool(side) for f, b, side in path])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, list[tuple[int, float, int]]]]]:
    """(intercept, rules): a rule is a weight and its terms (feature, threshold, 1 if above, 0 if not)."""
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start = float(np.log(rate / (1 - rate)))
    if len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return start, []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # > b means above edges[b]
    margin, paths = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _tree(binned, y - p, p * (1 - p), paths, np.arange(len(y)), (), step)
        margin += step
    rules, seen = [], set()
    for path in dict.fromkeys(paths):
        own = _holds(binned, path)
        if 0 < own.sum() < len(y) and (key := own.tobytes()) not in seen:
            seen.update((key, (~own).tobytes()))
            rules.append(path)
    holds = np.stack([_holds(binned, p) for p in rules], axis=1).astype(np.float64)
    # lasso logistic regression by accelerated proximal steps
    mean, spread = holds.mean(axis=0), holds.std(axis=0)
    z = (holds - mean) / spread
    rate_of = 4 * len(y) / np.linalg.norm(z, 2) ** 2
    w = v = np.zeros(z.shape[1] + 1)
    t = 1.0
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(z @ v[1:] + v[0]))) - y
        new = v - rate_of * np.concatenate([[r.mean()], z.T @ r / len(y)])
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate_of * LASSO, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, v = new, new + (old - 1) / t * (new - w)
    used = np.flatnonzero(np.abs(w[1:]) > 1e-9)
    bias = float(w[0] - np.sum(w[1:][used] * mean[used] / spread[used]))
    return bias, [(float(w[1:][k] / spread[k]), [(f, float(edges[f][b]), side) for f, b, side in rules[k]]) for k in used]


def score(model: tuple, names=FEATURES) -> Column:
    """The model as a column expression over the feature columns."""
    bias, rules = model
    total = F.lit(bias)
    for weight, terms in rules:
        held = reduce(lambda a, b: a & b, [F.col(f"f_{names[f]}") > t if side else F.col(f"f_{names[f]}") <= t for f, t, side in terms])
        total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> tuple:
    """A model from the rows of ``labels`` (doc_id, quality) that may be learned from."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y"))
    known = known.filter(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id", "_y").limit(FIT_ROWS)
    rows = docs.join(F.broadcast(known), F.col(id_col) == F.col("_id"))
    sample = features(rows, [F.col("_id").alias("id"), F.col("_y").alias("y")]).orderBy(F.xxhash64("id"), "id", "y", *[f"f_{k}" for k in FEATURES]).limit(FIT_ROWS).toPandas()
    return fit(sample[[f"f_{k}" for k in FEATURES]].to_numpy(np.float64), (sample["y"].to_numpy() > 0).astype(np.float64))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Scores depend on the text alone; null texts are empty ones.  Labels join on
    the id only to learn: rows without an id are scored like others.  Without
    labels of both kinds the score is their smoothed share (one half of none).
    Repeated rows are scored each; other columns are ignored; an empty table
    gives no rows.
    """
    model = learn(docs, labels, id_col)
    rows = features(docs, [F.col(id_col).alias("doc_id")])
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, as they are.

    Null texts are scored as empty ones; repeated rows are judged each, rows
    without an id like others; an empty table gives no rows; other columns may
    have any names.
    """
    model = learn(docs, labels, id_col)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # A filter moves below the columns that it reads and computes each feature again for every rule that names it.
    # It stays above a column that the optimiser may not evaluate twice, so the features are computed once.
    rows = features(docs, [whole]).select("row", score(model).alias("score"), F.spark_partition_id().alias("at"))
    return rows.filter((F.col("score") >= CUT) & (F.col("at") >= 0)).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
