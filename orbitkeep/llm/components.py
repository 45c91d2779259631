"""Distributed union-find: connected components of a table of links.

Alternating star contraction: every node is hooked to the smallest label seen
among its neighbours until each component is a star around its smallest node.
Per-node minima are partial aggregates and hooks are equi-joins, so a node with
very many links is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _are_stars(links: DataFrame, scratch: Scratch) -> bool:
    """Whether every node has one smaller neighbour, which has none, or none: then a further round would leave all as it is."""
    both = links.select(F.col("a").alias("node"), "b").union(links.select(F.col("b").alias("node"), "b"))
    return not scratch.count(both.groupBy("node").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).filter("lo < hi"))


def contracted(links: DataFrame, scratch: Scratch, rounds: int | None = None) -> DataFrame:
    """A saved table of links (a, b), b < a, with the same components as ``links``, after so many rounds.

    Without a number of rounds, until all are stars: then a is there once, and b
    is the smallest node reachable, which has no row of its own.
    """
    a, b = F.col("a"), F.col("b")
    now = scratch.save(links.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")))
    done = 0
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = scratch.save(both.filter(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        after = scratch.save(small)
        scratch.drop(now, large)
        now, done = after, done + 1
        if done == rounds or rounds is None and _are_stars(now, scratch):
            return now


def with_roots(labels: DataFrame) -> DataFrame:
    """Labels (node, component) with the rows of the smallest nodes, which are their own component."""
    return labels.union(labels.select(F.col("component").alias("node"), "component").distinct())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node that has a link to another one.

    ``links`` has two long columns, a and b; order, repeats and self-links do
    not matter.  ``component`` is the smallest node reachable.  An empty table
    gives an empty result; links with a null are ignored.
    """
    return with_roots(contracted(links, scratch).toDF("node", "component"))
