r"""URL filters: rules for hosts and path prefixes.

A url is expanded into the host suffixes and path prefixes that any rule can
have; the expressions are equi-joined with the rules on 32 bits of their
digest, whole digests confirm, and of the rules that fit the longest wins.  Work
is done once per distinct (host, path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Rules broadcast at most; beyond that both sides are shuffled, the rules once for each salt, since an expression such as "com/" may hold a third of all rows.
BROADCAST_ROWS = 200_000
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """Adds host and path."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return df.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def _digests(df: DataFrame) -> DataFrame:
    full = F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256)
    return df.withColumns({"digest": full, "short": F.substring(full, 1, 8)})


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to ``pages``; columns of those names are replaced.

    ``rules`` has host, path and action (allow or block; of equal rules with
    both, block holds).  A rule fits its host and all subdomains if the url's
    path starts with the rule's; the longest rule wins, of equally long ones
    that with the longer host.  Without a rule the verdict is ``default`` and
    rule is null.  A null url, or one without "://", has empty host and path and
    fits no rule.  Repeated rows are judged each.
    """
    rules = rules.groupBy(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("suffix"), F.coalesce("path", F.lit("")).alias("prefix")).agg(F.max("action").alias("action")).filter("suffix <> ''")
    rules = _digests(rules).withColumns({"labels": F.size(F.split("suffix", "\\.")), "length": F.length("prefix")}).withColumnsRenamed({"suffix": "r_suffix", "prefix": "r_prefix", "digest": "r_digest"})
    # (labels, length) pairs that rules have: at most 127 x 2,048 for valid urls, a handful in practice
    shapes = [(r[0], r[1]) for r in rules.select("labels", "length").distinct().collect()]
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = with_parts(pages.select(*kept, F.col(url).alias("_url")), "_url").drop("_url")
    names = parts.select("host", "path").distinct().filter("host <> ''")
    shape = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in shapes]).cast("array<struct<k:int,n:int>>"))
    own = names.withColumn("_labels", F.size(F.split("host", "\\."))).select("host", "path", "_labels", shape.alias("s")).filter("s.k <= _labels AND s.n <= length(path)")
    own = _digests(own.select("host", "path", F.expr("substring_index(host, '.', -s.k)").alias("suffix"), F.expr("left(path, s.n)").alias("prefix")))
    rules = rules.select("r_suffix", "r_prefix", "r_digest", "short", "action")
    on = ["short"]
    if rules.count() <= BROADCAST_ROWS:
        rules = F.broadcast(rules)
    else:
        own = own.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = ["short", "salt"]
    hits = own.join(rules, on).filter("digest = r_digest")
    best = hits.groupBy("host", "path").agg(F.max(F.struct((F.length("r_suffix") + F.length("r_prefix")).alias("n"), F.length("r_suffix").alias("h"), F.concat("r_suffix", "r_prefix").alias("rule"), "action")).alias("b"))
    best = best.select("host", "path", "b.rule", F.col("b.action").alias("verdict"))
    out = parts.join(best, ["host", "path"], "left")
    return out.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules).drop("url")


ORACLE = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
cut AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
parts AS (
  SELECT row_number() OVER () AS r, page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
rules(h, p, action) AS (VALUES {", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)}),
hits AS (
  SELECT r, h || p AS rule, action, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (r)
"""
