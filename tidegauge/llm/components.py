"""Connected components of an edge table, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.rows import staged


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours are linked to its smallest neighbour (or itself) instead.

    ``large`` moves the neighbours above the node, else those not above it. A node
    with very many neighbours is split by AQE: the minimum comes from an aggregate
    with map-side combine and is joined back.
    """
    there = both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = there.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    out = there.join(least, "a")
    if large:
        out = out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        # The node itself and its smaller neighbours all hang on the smallest.
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that has an edge; the label is the smallest node of its component.

    Edges are columns ``a`` and ``b``, in any direction, repeated or not. Each round is
    written to the shared folder. The rounds, logarithmic in the size of the largest
    component, end when a round changes no edge.
    """
    now = staged(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        before = state
        now = staged(star(star(now, True), False), "star")
