"""Connected components of an edge table by contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import delete, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, for the nodes of edges (a, b).

    In each round every node points to its least neighbour if that is less, pointers are doubled until they end in
    roots, and edges are rewritten between roots. Every round at least halves the roots of what is not done. Tables are written
    between steps; only counts reach the driver."""
    spark = edges.sparkSession
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "parents")
        while True:
            up = parents.select(F.col("node").alias("label"), F.col("label").alias("up"))
            jumped = written(parents.join(up, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved")), "parents")
            moved = jumped.where("moved").limit(1).count()
            delete(spark, parents)
            parents = jumped.drop("moved")
            if not moved:
                break
        if labels is None:
            labels = parents
        else:
            up = parents.select(F.col("node").alias("label"), F.col("label").alias("up"))
            labels = written(labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        a, b = (parents.select(F.col("node").alias(x), F.col("label").alias(f"{x}_root")) for x in "ab")
        roots = edges.join(a, "a").join(b, "b").where("a_root <> b_root")
        fewer = written(roots.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
        delete(spark, edges)
        edges = fewer
        if not edges.limit(1).count():
            return labels
