"""Level-synchronous breadth-first search, pushing or pulling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.scratch import cut

#: Pull when the frontier's edges exceed this share of the unvisited vertices' edges; push again below this share of vertices.
SWITCH = 20


class Search:
    """Distances (v, dist; -1 if unreachable) and one record per level."""

    def __init__(self, distances: DataFrame, levels: DataFrame):
        self.distances = distances
        self.levels = levels


def bfs(edges: DataFrame, root: int, direction: str = "auto") -> Search:
    """Search from ``root``; ``direction`` is auto, push or pull. Direction changes cost, not distances.

    Each level is one job: edges, which stay dealt by their source, are met by the
    frontier where they lie; what they reach goes through an anti join with the vertices
    seen (push), or the vertices not yet seen look for themselves in it (pull). So an edge
    leaves its place once at most, in the level of its source. What a level adds is
    checkpointed, so lineage stays short.
    """
    spark = edges.sparkSession
    e = edges.select("src", "dst").repartition("src").persist()
    degrees = cut(e.groupBy("src").agg(F.count("*").alias("degree")))
    vertices = cut(degrees.select(F.col("src").alias("v")).union(e.select(F.col("dst").alias("v")).distinct()).distinct())
    n_vertices = vertices.count()
    unseen_degrees = degrees.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
    frontier = cut(spark.createDataFrame([(root,)], "v long"))
    seen = frontier.select("v", F.lit(0).alias("dist"))
    level, size, pulling, records = 0, 1, False, []
    while size:
        mf = frontier.join(degrees, frontier["v"] == degrees["src"]).agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
        unseen_degrees -= mf
        if direction == "auto":
            pulling = size >= n_vertices // SWITCH if pulling else mf > unseen_degrees // SWITCH
        else:
            pulling = direction == "pull"
        records.append((level, size, mf, unseen_degrees, "rev" if pulling else "fwd"))
        f = frontier.select(F.col("v").alias("src"))
        reached = e.join(f, "src", "left_semi").select(F.col("dst").alias("v")).distinct()
        if pulling:
            frontier = cut(vertices.join(seen, "v", "left_anti").join(reached, "v", "left_semi"))
        else:
            frontier = cut(reached.join(seen, "v", "left_anti"))
        level += 1
        size = frontier.count()
        seen = cut(seen.union(frontier.select("v", F.lit(level).alias("dist")))) if level % 8 == 0 else seen.union(frontier.select("v", F.lit(level).alias("dist")))
    every = vertices.join(seen, "v", "left").select("v", F.coalesce("dist", F.lit(-1)).alias("dist"))
    e.unpersist()
    levels = spark.createDataFrame(records, "level int, frontier long, mf long, mu long, direction string")
    return Search(every, levels)


def summary(distances: DataFrame) -> DataFrame:
    """(reached, max_dist, sum_dist) over reachable vertices."""
    seen = distances.where("dist >= 0")
    return seen.agg(F.count("*").alias("reached"), F.max("dist").cast("long").alias("max_dist"), F.sum("dist").cast("long").alias("sum_dist"))
