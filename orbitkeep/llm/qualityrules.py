"""Quality rules with thresholds that adapt to each language and source.

Fixed cut-offs misjudge languages and sources that differ; here each ratio gets
an upper fence from the quantiles of its own language and source, and the word
length a lower one too.  A fence stands ``WIDTH`` quartile distances outside the
quartiles, and outside a high quantile (for the lower fence: a low one) by the
ratio's least width at least, which absorbs rounding.

Quantiles come from mergeable sketches: counts of values rounded to three
significant digits (relative error below one hundredth), so that sketches add up
exactly in any order, source sketches merge into language sketches, and reruns
agree.  Quantiles of a source are drawn towards those of its language, and these
towards those of all documents, as if ``PRIOR`` more documents were like them: a
group speaks for itself by its size, without a size at which it begins to.

Short texts scatter: a count may exceed its share of the fence by ``SCATTER``
standard deviations and one occurrence (of a repeat: twice five words), a mean
word length by so much as n words vary.

Everything is DataFrame operations: statistics are column expressions, sketches
are partial aggregates, and documents are joined with the table of fences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textstats as ts
from .scratch import Scratch

#: Ratios in thousandths: (numerator, denominator, least width of the fence outside the high quantile, that quantile in hundredths, units that one occurrence counts).
RATIOS = {
    "symbols": ("n_symbols", "n_words", 20, 90, 1),
    "word_length": ("word_chars", "n_words", 300, 90, 0),
    "dup_lines": ("n_dup_lines", "n_lines", 50, 95, 1),
    "repeats": ("n_repeat_words", "n_words", 20, 90, 10),
}
#: Quantiles in hundredths: quartiles, the low one and (its place) the high one of the ratio.
QUANTILES = {"q1": 25, "q3": 75, "low": 10, "high": None}
#: Quartile distances from the quartiles to the fences.
WIDTH = 3
#: Documents that a group's wider group counts for.
PRIOR = 200
#: Standard deviations by which a count may exceed its fence, and the scatter of a word's length in thousandths of a character.
SCATTER, LENGTH_SCATTER = 2.0, 4000.0
#: Fences broadcast at most; beyond that, a salted join.
BROADCAST_ROWS = 200_000
SALTS = 16


def base_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = ts.with_line_counts(docs.select(*keep, text.alias("text")), "text")
    rows = rows.withColumns({"n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"), "_words": ts.words(F.col("text"))}).drop("text")
    rows = rows.withColumns({"n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long")})
    return ts.with_repeat_words(rows, "_words").drop("_words")


def _rounded(num: str, den: str):
    """Thousandths, rounded down to three significant digits."""
    v = F.expr(f"CASE WHEN {den} > 0 THEN 1000 * {num} div {den} ELSE 0 END")
    unit = F.pow(F.lit(10.0), F.greatest(F.length(v.cast("string")) - 3, F.lit(0))).cast("long")
    return v - v % unit


def _of_ratio(values: dict):
    """The value of the row's ratio."""
    return F.try_element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), F.col("ratio"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ratio, total and QUANTILES of sketches summed over keys."""
    merged = sketch.groupBy(*keys, "ratio", "value").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "ratio")
    ranked = merged.withColumns({"upto": F.sum("n").over(by.orderBy("value")), "total": F.sum("n").over(by)})
    at = {k: F.lit(q) if q else _of_ratio({r: x[3] for r, x in RATIOS.items()}) for k, q in QUANTILES.items()}
    return ranked.groupBy(*keys, "ratio").agg(F.max("total").alias("total"), *[F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("value"))).alias(k) for k, q in at.items()])


def fences(stats: DataFrame) -> DataFrame:
    """(lang, source, one fence column per ratio, low_word_length), for every pair that occurs; nulls are a value of their own."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), _rounded(x[0], x[1]).alias("value")) for k, x in RATIOS.items()]))
    sketch = stats.filter("n_words > 0").select("lang", "source", values.alias("x")).groupBy("lang", "source", "x.ratio", "x.value").agg(F.count("*").alias("n"))
    every = sketch.select("lang", "source", "ratio").distinct()
    at = [_quantiles(sketch, keys).select(*[F.col(k).alias(f"{k}_{i}") for k in [*keys, "ratio", "total", *QUANTILES]]) for i, keys in enumerate((["lang", "source"], ["lang"], []))]
    on = [F.col(f"lang_{i}").eqNullSafe(F.col("lang")) for i in (0, 1)]
    rows = every.join(at[0], on[0] & F.col("source_0").eqNullSafe(F.col("source")) & (F.col("ratio_0") == F.col("ratio")), "left")
    rows = rows.join(at[1], on[1] & (F.col("ratio_1") == F.col("ratio")), "left").join(F.broadcast(at[2]), F.col("ratio_2") == F.col("ratio"), "left")
    drawn = lambda i, own, wider: (F.col(f"total_{i}") * own + PRIOR * wider) / (F.col(f"total_{i}") + PRIOR)
    rows = rows.select("lang", "source", "ratio", *[drawn(0, F.col(f"{q}_0"), drawn(1, F.col(f"{q}_1"), F.col(f"{q}_2"))).alias(q) for q in QUANTILES])
    least, far = _of_ratio({r: x[2] for r, x in RATIOS.items()}), WIDTH * (F.col("q3") - F.col("q1"))
    rows = rows.withColumns({"fence": F.greatest(F.col("q3") + far, F.col("high") + least), "lower": F.least(F.col("q1") - far, F.col("low") - least)})
    of = lambda k, c: F.max(F.when(F.col("ratio") == k, F.col(c)))
    return rows.groupBy("lang", "source").agg(*[of(k, "fence").alias(f"fence_{k}") for k in RATIOS], of("word_length", "lower").alias("low_word_length"))


def judge(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The statistics of each document, base_failed, and kept by the fences.

    ``docs`` needs id_col, text, lang and source.  A document fails the base
    rule with fewer than 10 words, or more than a fifth of them in repeated
    windows.  Null texts are empty and fail; null languages and sources are
    groups of their own; repeated rows are judged each; other columns are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    stats = scratch.save(base_stats(docs, [F.col(id_col).alias("doc_id"), "lang", "source"]))
    limit = scratch.save(fences(stats))
    if limit.count() <= BROADCAST_ROWS:
        one, other = stats, F.broadcast(limit)
        salted = F.lit(True)
    else:
        one = stats.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        other = limit.withColumn("_own_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = F.col("_salt") == F.col("_own_salt")
    other = other.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    rows = one.join(other, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")) & salted, "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fits = F.lit(True)
    for k, (num, den, _, _, grain) in RATIOS.items():
        if grain:
            allowed = F.col(f"fence_{k}") * F.col(den) / 1000.0
            fits = fits & F.coalesce(F.col(num) <= allowed + SCATTER * F.sqrt(grain * allowed) + grain, F.lit(True))
        else:
            own, room = _rounded(num, den), LENGTH_SCATTER / F.sqrt(F.greatest("n_words", F.lit(1)))
            fits = fits & F.coalesce((own <= F.col(f"fence_{k}") + room) & (own >= F.col(f"low_{k}") - room), F.lit(True))
    return rows.withColumns({"base_failed": failed, "kept": ~failed & fits}).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[f"fence_{k}" for k in RATIOS], "low_word_length")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    at = lambda q, r: f"min(value) FILTER (upto * 100 >= total * {q if q else RATIOS[r][3]})"
    unit = "CAST(pow(10, greatest(length(CAST(v AS VARCHAR)) - 3, 0)) AS BIGINT)"
    sketches = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS ratio, CASE WHEN {x[1]} > 0 THEN 1000 * {x[0]} // {x[1]} ELSE 0 END AS v FROM stats WHERE n_words > 0" for r, x in RATIOS.items())
    levels = []
    for i, keys in enumerate((["lang", "source"], ["lang"], [])):
        by = ", ".join([*keys, "ratio"])
        quantiles = ", ".join("CASE ratio " + " ".join(f"WHEN '{r}' THEN {at(q, r)}" for r in RATIOS) + f" END AS {k}" for k, q in QUANTILES.items())
        levels.append(f"""m{i} AS (SELECT {by}, value, count(*) AS n FROM rounded GROUP BY ALL),
w{i} AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY value) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM m{i}),
q{i} AS (SELECT {by}, CAST(max(total) AS DOUBLE) AS total, {quantiles} FROM w{i} GROUP BY {by})""")
    drawn = ", ".join(f"(q0.total * q0.{k} + {PRIOR} * ((q1.total * q1.{k} + {PRIOR} * q2.{k}) / (q1.total + {PRIOR}))) / (q0.total + {PRIOR}) AS {k}" for k in QUANTILES)
    least = "CASE ratio " + " ".join(f"WHEN '{r}' THEN {x[2]}" for r, x in RATIOS.items()) + " END"
    checks = []
    for r, (num, den, _, _, grain) in RATIOS.items():
        if grain:
            m = f"(fence_{r} * {den} / CAST(1000 AS DOUBLE))"
            checks.append(f"coalesce({num} <= {m} + CAST({SCATTER} AS DOUBLE) * sqrt({grain} * {m}) + {grain}, true)")
        else:
            own, room = f"(SELECT v - v % {unit} FROM (SELECT CASE WHEN {den} > 0 THEN 1000 * {num} // {den} ELSE 0 END AS v))", f"CAST({LENGTH_SCATTER} AS DOUBLE) / sqrt(greatest(n_words, 1))"
            checks.append(f"coalesce({own} <= fence_{r} + {room} AND {own} >= low_{r} - {room}, true)")
    shown = ", ".join(f"max(CASE WHEN ratio = '{r}' THEN fence END) AS fence_{r}" for r in RATIOS)
    return rf"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
cut AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM base),
windows AS (SELECT r, i, ws[i : i + 4] AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM cut)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(5) t(j) GROUP BY r),
stats AS (SELECT doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM cut LEFT JOIN covered c USING (r)),
rounded AS (SELECT lang, source, ratio, v - v % {unit} AS value FROM ({sketches})),
{", ".join(levels)},
drawn AS (SELECT q0.lang, q0.source, q0.ratio, {drawn} FROM q0 JOIN q1 ON q1.lang IS NOT DISTINCT FROM q0.lang AND q1.ratio = q0.ratio JOIN q2 ON q2.ratio = q0.ratio),
limits AS (SELECT lang, source, ratio, greatest(q3 + {WIDTH} * (q3 - q1), high + {least}) AS fence, least(q1 - {WIDTH} * (q3 - q1), low - {least}) AS lower_ FROM drawn),
fences AS (SELECT lang, source, {shown}, max(CASE WHEN ratio = 'word_length' THEN lower_ END) AS low_word_length FROM limits GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND {" AND ".join(checks)} AS kept, {", ".join(f"fence_{r}" for r in RATIOS)}, low_word_length
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed FROM stats) s LEFT JOIN fences f ON f.lang IS NOT DISTINCT FROM s.lang AND f.source IS NOT DISTINCT FROM s.source
"""


ORACLE = _oracle()
