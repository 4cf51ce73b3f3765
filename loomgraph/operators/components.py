"""Connected components by alternating star contractions on an edge DataFrame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.scratch import stored


#: Edges of which ``forest`` keeps a spanning forest at once.
FOREST_EDGES = 1 << 22


def _piece_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of 0 to n - 1 that each is connected with by edges ``a`` to ``b``."""
    parent = np.arange(n)
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != (up := parent[parent])).any():
            parent = up
    return parent


def forest(edges: DataFrame) -> DataFrame:
    """(u, v) with the components of ``edges`` (src, dst): of each few million edges, one from each vertex to the smallest it is connected with by them.

    Where a task has many edges for each vertex that is much less than all; loops and edges with a null end go.
    """

    def run(batches):
        held, n = [], 0

        def spanned():
            ends = np.concatenate(held, 1)
            ids, at = np.unique(ends, return_inverse=True)
            at = at.reshape(ends.shape)
            roots = _piece_roots(at[0], at[1], len(ids))
            moved = np.flatnonzero(roots != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[roots[moved]])], names=["u", "v"])

        for b in batches:
            held.append(np.stack([b.column(c).to_numpy() for c in (0, 1)]))
            n += b.num_rows
            if n >= FOREST_EDGES:
                yield spanned()
                held, n = [], 0
        if n:
            yield spanned()

    kept = edges.where("src <> dst").select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))
    return kept.mapInArrow(run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, both["u"] == low["w"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge to another; ``root`` is the smallest node of its component.

    ``edges`` has two columns of one orderable type. Each round halves distances
    to the root; rounds are written to the shared folder, so lineage stays short.
    """
    u, v = edges.columns[:2]
    now = stored(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        now = stored(_small_star(_large_star(now)), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
