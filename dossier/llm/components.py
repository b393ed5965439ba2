"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.tables import stored


def _hashed(edges: DataFrame) -> tuple[int, int]:
    """Number and order-free fingerprint of the edges."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of the edges (a, b) with the smallest node of its component.

    Large stars tie the larger neighbours of a node to its smallest neighbour, small stars the smaller ones; both only
    shorten paths, so the edges end as one star per component after a few rounds. Minima are aggregated before they
    are joined back, so a node with very many edges is a skewed join, which the adaptive planner splits.
    """
    now = stored(edges.filter("a <> b").select("a", "b").distinct(), "component-edges")
    before = _hashed(now)
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a <> b").distinct()
        # Every edge now points from the larger node to a smaller one.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select("a", "b", "low")
        small = small.select("a", F.col("low").alias("b")).union(
            small.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        now = stored(small.distinct(), "component-edges")
        after = _hashed(now)
        if after == before:
            break
        before = after
    centres = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        centres.select("node", F.col("node").alias("component"))
    )
