"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import apart, drop_table, write_table


def components(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) to (node, component): each node that has an edge, with the smallest node it reaches.

    Large-star and small-star steps (Kiveris et al., 2014) turn the graph into one star per component in
    about log(n) rounds. The smallest neighbour of a node is a groupBy that combines before the shuffle,
    and it returns to the edges by a join whose large side Spark may split, so a node with very many
    edges does not gather in one task. Each round is a written table; two numbers come to the driver.
    Null ends and loops are ignored.
    """
    now = write_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(apart(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(least, "u"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = write_table(small.union(least).distinct(), "edges")
        drop_table(now)
        now = after


class Forest:
    """Unions of array positions inside one task; parents are smaller than their children."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            p = self.parent
            while not np.array_equal(p, q := p[p]):
                p = q
            self.parent = p
            a, b = p[i], p[j]
            apart = a != b
            i, j = i[apart], j[apart]
            if len(i):
                np.minimum.at(self.parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each position that is not a root, and its parent."""
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return child, self.parent[child]
