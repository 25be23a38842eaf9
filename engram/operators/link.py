"""Links between notes and the merging of neighbours' attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.functions.rules import evolved_description, relation_label

MOST = 2


def relations(neighbours: DataFrame) -> DataFrame:
    """neighbours (src, dst, rank, src_tags, dst_tags) -> (source, target, relation): of each source its first MOST
    neighbours other than itself, nearest first."""
    others = neighbours.where((F.col("dst") != F.col("src")) & F.col("dst").isNotNull())
    k = F.row_number().over(W.partitionBy("src").orderBy("rank"))
    return others.withColumn("_k", k).where(F.col("_k") <= MOST).select(
        F.col("src").alias("source"), F.col("dst").alias("target"), relation_label(F.col("src_tags"), F.col("dst_tags")).alias("relation")
    )


def accepted(found: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(a, b): relations between a new note (src) and one of its neighbours (dst), in either direction."""
    near = neighbours.select("src", "dst").distinct()
    forward = found.join(near, (found["source"] == near["src"]) & (found["target"] == near["dst"])).select("source", "target")
    back = found.join(near, (found["target"] == near["src"]) & (found["source"] == near["dst"])).select("source", "target")
    return forward.union(back).select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()


def link_edges(pairs: DataFrame) -> DataFrame:
    """(src, dst): each pair in both directions, once."""
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a")).distinct()


def add_links(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """notes with the edges' ends added to their links, old ones first."""
    new = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("_new"))
    empty = F.array().cast("array<string>")
    joined = notes.join(new, "id", "left")
    return joined.withColumn("links", F.array_union(F.coalesce("links", empty), F.coalesce("_new", empty))).drop("_new").select(*notes.columns)


def evolve(pairs: DataFrame) -> DataFrame:
    """pairs of an existing note and a new one (old_keywords, old_tags, old_description, new_...): the existing note's
    merged keywords, tags and description, all other columns kept."""
    return (
        pairs.withColumn("keywords", F.array_union("old_keywords", "new_keywords"))
        .withColumn("tags", F.array_union("old_tags", "new_tags"))
        .withColumn("description", evolved_description(F.col("old_description"), F.col("new_description")))
    )


def hops(edges: DataFrame, start: DataFrame, n: int) -> DataFrame:
    """(start, id, hop): notes reachable in at most n links, with the least number of links."""
    reached = start.select(F.col("id").alias("start"), "id", F.lit(0).alias("hop"))
    front = reached
    for k in range(1, n + 1):
        step = front.join(edges, front["id"] == edges["src"]).select("start", F.col("dst").alias("id")).distinct()
        front = step.join(reached, ["start", "id"], "left_anti").withColumn("hop", F.lit(k))
        reached = reached.unionByName(front)
    return reached
