"""Connected components of edge tables, on the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import common


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """edges (a long, b long) -> (node, root): root is the smallest node reachable.

    Alternating star contraction: a large star hangs the larger neighbours of a node on its
    smallest one, a small star does so with the smaller ones; both keep the components and
    end, after a number of rounds like the logarithm of the longest path, in one star for
    each. Every round is written to the shared folder, so the lineage stays short.
    """
    now = common.materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    sums = None
    while True:
        # A node may have any number of edges. Minima are written before they are joined: both
        # sides of a join are then plain scans, and adaptive execution can split a hot node.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = common.materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), tag)
        large = common.materialize(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), tag)
        low = common.materialize(large.groupBy("a").agg(F.min("b").alias("m")), tag)
        hung = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(low, "a").select(F.explode(hung).alias("e")).select("e.*").where("a != b").distinct()
        now = common.materialize(small, tag)
        r = now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == tuple(r):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sums = tuple(r)


class Forest:
    """Union-find over 0..n-1 on arrays; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while len(a):
            x, y = p[a], p[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))
            while True:
                q = p[p]
                if (q == p).all():
                    break
                p[:] = q
