"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, drop, join_small, materialize, materialize_with


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long). Returns node, component (the smallest node reachable) for every node but the smallest of
    its component; a written table.

    Edges stay distributed; each round is written to the shared folder, with the count and the sum of hashes that tell
    when nothing changes any more. Rounds grow with the logarithm of the longest path. A node may hold any share of the
    edges: its least neighbour is aggregated before the shuffle and joined back, by broadcast while the counted edges
    are few, else from a written table whose hot keys Spark splits. Self-loops, repeated edges and nulls do not matter.
    """
    totals = {"n": F.count(F.lit(1)), "code": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, now = materialize_with(start, "edges", **totals)
    while now["n"]:
        many = 2 * now["n"]
        held: list[DataFrame] = []

        def once(df: DataFrame, name: str) -> DataFrame:
            """Read twice: written beyond the size up to which its reader is broadcast."""
            if many <= BROADCAST_ROWS:  # noqa: B023
                return df
            held.append(materialize(df, name))  # noqa: B023
            return held[-1]

        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = once(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        met = join_small(both, least, "a", "inner", many).where("b > a")
        large = once(met.select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        least = once(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = join_small(large, least, "a", "inner", many).where("b <> m").select(
            F.col("b").alias("a"), F.col("m").alias("b")
        )
        then, old = now, e
        e, now = materialize_with(
            small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges", **totals
        )
        for df in (old, *held):
            drop(df)
        if now == then:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable, by links (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
