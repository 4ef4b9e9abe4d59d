"""Connected components by large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermograph.llm.common import spill


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Least reachable number of each of ``n`` vertices, over links between the rows ``left`` and ``right``."""
    root = np.arange(n)
    rows, cols = left[linked.any(1)], right[linked.any(0)]
    inner = linked[np.ix_(linked.any(1), linked.any(0))]
    while len(rows):
        before = root.copy()
        np.minimum.at(root, rows, np.where(inner, root[cols][None, :], n).min(1))
        np.minimum.at(root, cols, np.where(inner, root[rows][:, None], n).min(0))
        root = root[root]
        if (root == before).all():
            break
    return root


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of (a, b) that is not its component's least, root being the least.

    Each round links neighbours to the least vertex around; the number of rounds
    follows the logarithm of the longest chain. Minima are written before they
    are joined, so that a vertex with many neighbours is split over tasks. Loops
    are ignored; an empty table gives an empty result.
    """
    now = spill(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = spill(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = spill(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = spill(both.join(least, "a").filter("b > a AND b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = spill(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = spill(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("v"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of a set of edges."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
