"""Connected components: in Spark over edges, and inside a task over local pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table


def union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the sets of `i` and `j` in place; `parent` holds for each node the least node of its set."""
    while len(i):
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
    return parent


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of `edges` (a, b), longs.

    Alternates large-star and small-star steps. Minima are aggregated before
    the shuffle and joined back, so a hub is a skewed join that Spark can split,
    never one group. Each round is a written table, of files by its number of links; the loop ends when a round
    changes nothing. Self-links and repeated links don't matter; rows with a
    null end are no links. No links: an empty result.
    """
    now = table(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = table(large.where("a <> b").distinct(), seen[0])
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        done, now = now, table(small.distinct(), 2 * seen[0])
        drop(done, large)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
