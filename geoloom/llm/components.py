"""Connected components by rounds of contraction, all in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _stars(hooks: DataFrame) -> DataFrame:
    """Follow ``parent`` to its end: halves each path's length a round. Deletes the tables it leaves behind."""
    parents = hooks
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        jumped = parents.join(up, "parent").select("node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved"))
        jumped = staged(jumped, "parents")
        discard(parents)
        parents = jumped
        if jumped.where("moved").isEmpty():
            return jumped


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges(a, b)``; a component's name is its least node.

    In each round every node hooks to its least neighbour, the trees are
    flattened by pointer jumping, and the edges are carried over to the roots;
    edges within a root vanish. Nothing but flags reaches the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    labels, last, parents = None, None, None
    while True:
        edges = staged(edges, "edges")
        for done in (last, parents):
            if done is not None:
                discard(done)
        last, parents = edges, None
        if edges.isEmpty():
            break
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"))
        hooks = ends.groupBy("e.node").agg(F.min("e.other").alias("parent")).select("node", F.least("node", "parent").alias("parent"))
        parents = _stars(staged(hooks, "hooks"))
        if labels is None:
            labels = staged(parents.select("node", F.col("parent").alias("component")), "labels")
        else:
            up = parents.select(F.col("node").alias("component"), "parent")
            carried = staged(labels.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
            discard(labels)
            labels = carried
        a = parents.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        b = parents.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        edges = edges.join(a, "a").join(b, "b").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).where("a != b").distinct()
    if labels is None:
        kind = edges.schema["a"].dataType
        return edges.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("component"))
    return labels
