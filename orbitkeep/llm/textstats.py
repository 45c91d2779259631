"""Text statistics as Spark column expressions, without Python at run time.

Null texts count as empty.  Words are runs of characters other than space and
the controls 9 to 13.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The delimiters of words: space and the controls 9 to 13.
GAPS = "[ \\t-\\r]+"
_BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAPS))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")


def with_line_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds n_lines (lines with a word) and n_dup_lines (those equal to an earlier one)."""
    rows = df.withColumn("_lines", F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x, F.lit(_BLANKS)) != ""))
    return rows.withColumns({"n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")}).drop("_lines")


def with_repeat_words(df: DataFrame, list_col: str, size: int = 5) -> DataFrame:
    """Adds n_repeat_words: words in windows of ``size`` words that occur twice or more in the row.

    Windows are compared by 64-bit hashes.  Positions of repeated windows are
    found by sorting the hashes of one row; rows without repeats, nearly all,
    stop at the count of distinct hashes.
    """
    n = F.size(list_col)
    window = F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(F.col(list_col), i + j) for j in range(size)]))).otherwise(F.array().cast("array<bigint>"))
    rows = df.withColumn("_h", window)
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    rows = rows.withColumn("_p", F.when(twice, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda i, k: F.coalesce(F.get("_p", i + k)["h"] == F.get("_p", i)["h"], F.lit(False))
    at = F.transform(F.filter("_p", lambda x, i: same(i, 1) | F.when(i > 0, same(i, -1)).otherwise(F.lit(False))), lambda x: x["i"])
    rows = rows.withColumn("_q", F.array_sort(at))
    covered = F.aggregate(F.transform("_q", lambda p, k: F.coalesce(F.least(F.lit(size), F.get("_q", k + 1) - p), F.lit(size))), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_p", "_q")
