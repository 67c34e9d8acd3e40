"""Connected components of link tables by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.shared import discard, written


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or a smaller one and a larger one; then each is next to its component's smallest."""
    roles = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return roles.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable. edges: a, b (long, not null) in any direction; a node without a link
    to another one is not in the result. Each round links every node's larger neighbours to its smallest one, then
    its smaller ones, until all are stars; minima are pre-aggregated, and those over all neighbours joined as a written table, which Spark
    broadcasts if it is small and otherwise joins with large partitions split."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc")
    while not _stars(now):
        both = now.union(now.select("b", "a"))
        of_all = written(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m")), "cc-min")
        large = both.join(of_all, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = written(large.distinct(), "cc-large")
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        before, now = now, written(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "cc")
        discard(before, of_all, large)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a[i]-b[i] between n nodes, as few as keep all components: each node with its component's first."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:  # shorten paths
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]
