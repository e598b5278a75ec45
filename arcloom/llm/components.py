"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.session import scratch_path


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (each row's lowest known companion) after rows ``i`` and ``j`` were linked."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        i, j = i[open_], j[open_]
        high, low = np.maximum(a, b)[open_], np.minimum(a, b)[open_]
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``: the lowest node it is joined to.

    Large and small stars in turn: each round hangs neighbours below the lowest node
    that their centre sees. Minima are combined before they are shuffled and joined
    back to plain links, so that a hub can be split. Ends when a round changes nothing.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(
        links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links"
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), a).alias("m")), "lowest")
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        large = stored(large.where(a != b).distinct(), "large-star")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = (
            large.join(low, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
        )
        edges = stored(small.where(a != b).distinct(), "small-star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(b.alias("node"), b.alias("root")).distinct()
    return edges.select(a.alias("node"), b.alias("root")).unionByName(roots)
