"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_tables, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of edges (a, b). No edges: no rows.

    Every round takes the smallest label among neighbours and then the label of that label, so that chains shorten by
    half or more; labels are written between rounds. Repeated edges and loops change nothing.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        around = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = materialize(labels.join(around, "node", "left").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")))
        jump = lower.select(F.col("node").alias("hop"), F.col("label").alias("far"))
        moved = materialize(lower.join(jump, lower.label == jump.hop, "left").select("node", F.least("label", "far").alias("label"), "was"))
        changed = moved.where("label <> was").limit(1).count()
        drop_tables(lower, labels)
        labels = moved.select("node", "label")
        labels.written_at = moved.written_at
        if not changed:
            drop_tables(both)
            return labels


def extended_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of the graph whose components are `labels` after edges (a, b) are added: components are joined, not their nodes."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    known = labels.select("node", "label").union(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    of_a, of_b = (known.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}")) for x in ("a", "b"))
    across = edges.select("a", "b").join(of_a, "a").join(of_b, "b").where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    joined = connected_components(across)
    out = materialize(known.join(joined.select(F.col("node").alias("label"), F.col("label").alias("lower")), "label", "left").select("node", F.coalesce("lower", "label").alias("label")))
    drop_tables(joined)
    return out
