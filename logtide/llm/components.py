"""Connected components of a graph given by its links, without a driver copy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(u, v)`` with u != v.

    ``component`` is the smallest node reachable. Alternates large-star and
    small-star rounds (Kiveris et al., 2014): every link moves to the smallest
    neighbour until only stars are left, in a logarithmic number of rounds.
    Each round is written to the shared folder, so that the plan stays short
    and a lost executor costs one round at most. No links: no rows.
    """
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))
        small = large.join(low, "u").select(F.explode(star).alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
        last, edges = edges, materialize(small.where("u <> v").distinct(), "links")
        discard(last)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def _root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i] for every i; pairs within one tree cost a lookup only."""
        ra, rb = self.roots(a), self.roots(b)
        open_ = ra != rb
        if not open_.any():
            return
        pairs = np.unique(np.stack([np.minimum(ra, rb)[open_], np.maximum(ra, rb)[open_]], 1), axis=0)
        for x, y in pairs.tolist():
            x, y = self._root(x), self._root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def roots(self, nodes: np.ndarray | None = None) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if np.array_equal(nxt, up):
                break
            up = self.up = nxt
        return up if nodes is None else up[nodes]
