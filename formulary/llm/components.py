"""Connected components of a graph held as a table of edges, and a union-find for one task's share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulary.llm.common import dropped, stored


class Forest:
    """Union-find over 0..n-1 that keeps the smallest member as root."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of the edges (a, b, integers), the smallest node it reaches.

    Alternates the two star contractions until no edge changes: each round links every node's
    neighbours to the smallest among them, first the larger ones, then the smaller ones. Rounds grow
    with the logarithm of a component's size. A node with very many neighbours is only ever
    aggregated by min (combined map-side) and joined back, never collected. Edges with a null end
    are dropped; a loop leaves its node alone in its component; no edges give no rows.
    """
    both = edges.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long"))
    # each component is a star when every node's smallest neighbour is its component's smallest node
    now = stored(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        each = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = each.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = each.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = low.where("m < a").select("a", F.col("m").alias("b"))
        hung = stored(large.unionByName(own).where("a > b").distinct(), "edges")
        low = hung.groupBy("a").agg(F.min("b").alias("m"))
        small = hung.join(low, "a")
        after = stored(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a > b").distinct(), "edges")
        # a forest of depth one is left exactly when no root of an edge is itself the child of another
        loose = after.join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        several = after.groupBy("a").count().where("count > 1").limit(1).count()
        dropped(hung)
        old, now = now, after
        if old is not now and not loose and not several:
            dropped(old)
            break
        dropped(old)
    else:
        raise RuntimeError("the components did not settle")
    self_loops = both.where("a = b").select(F.col("a").alias("node")).distinct()
    tree = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    lone = self_loops.join(tree.select("node").unionByName(roots.select("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    return tree.unionByName(roots).unionByName(lone)
