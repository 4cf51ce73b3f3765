"""Transforms of edge DataFrames (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.scratch import stored

#: Rows that one task sorts or tells apart, about.
TASK_ROWS = 1 << 19


def tasks(spark: SparkSession, rows: int) -> int:
    """Into how many partitions to deal ``rows``, so that a task's memory does not grow with them."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def csr(edges: DataFrame) -> DataFrame:
    """(src, adj): each vertex's neighbours in order."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("adj"))


def csr_offsets(edges: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(src, degree, offset) of the vertices with edges, in id order.

    Offsets are running sums in blocks of ids, then over the blocks, so no task
    orders all vertices.
    """
    deg = degree(edges).withColumn("block", F.floor(F.col("src") / block))
    sums = deg.groupBy("block").agg(F.sum("degree").alias("total"))
    bases = sums.select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("base"))
    inside = F.sum("degree").over(Window.partitionBy("block").orderBy("src")) - F.col("degree")
    return deg.withColumn("inside", inside).join(bases, "block").select("src", "degree", (F.col("base") + F.col("inside")).alias("offset"))


def undirected(edges: DataFrame, max_id: int | None = None) -> DataFrame:
    """Both directions of every edge; self-loops and ids outside 0..max_id go, parallel edges stay."""
    kept = edges.select("src", "dst").where("src <> dst and src >= 0 and dst >= 0")
    if max_id is not None:
        kept = kept.where((F.col("src") <= max_id) & (F.col("dst") <= max_id))
    return kept.union(transpose(kept))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrize_both(edges: DataFrame, keep_loops: bool = False, parts: int | None = None) -> DataFrame:
    """Every edge and its reverse, once; edges are told apart before they are turned round, so each is exchanged once."""
    once = symmetrize_simple(edges.select("src", "dst"), keep_loops, parts)
    to = F.when(F.col("src") == F.col("dst"), F.array(F.struct("src", "dst"))).otherwise(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return once.select(F.explode(to).alias("e")).select("e.src", "e.dst")


def symmetrize_simple(edges: DataFrame, keep_loops: bool = False, parts: int | None = None) -> DataFrame:
    """Every undirected edge once, smaller id first; told apart in ``parts`` tasks, or as many as the session has."""
    kept = edges if keep_loops else drop_loops(edges)
    turned = kept.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return (turned.repartition(parts, "src", "dst") if parts else turned).distinct()


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def max_node(edges: DataFrame) -> DataFrame:
    """(max_node), 0 for no edges."""
    return edges.agg(F.coalesce(F.max(F.greatest("src", "dst")), F.lit(0).cast("long")).alias("max_node"))


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def degree_order(edges: DataFrame, block: int = 1 << 14) -> DataFrame:
    """(src, degree, new_id): ids from 0 by falling degree, ties by falling id.

    Ranks are counted in degree classes first (one row per degree), then inside
    a class in blocks of ids, so that no task orders all vertices. Degrees are
    written, for they are read twice. There are at most about as many classes as
    the root of twice the edges, so these are broadcast.
    """
    deg = stored(degree(edges), "degrees").withColumn("block", F.floor(F.col("src") / block))
    sizes = deg.groupBy("degree", "block").agg(F.count("*").alias("n"))
    classes = sizes.groupBy("degree").agg(F.sum("n").alias("n"))
    above = classes.select("degree", (F.sum("n").over(Window.orderBy(F.col("degree").desc())) - F.col("n")).alias("above"))
    inside = sizes.select("degree", "block", (F.sum("n").over(Window.partitionBy("degree").orderBy(F.col("block").desc())) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("degree", "block").orderBy(F.col("src").desc())) - 1
    return deg.withColumn("place", place).join(inside, ["degree", "block"]).join(F.broadcast(above), "degree").select("src", "degree", (F.col("above") + F.col("before") + F.col("place")).alias("new_id"))


def relabel_by_degree(edges: DataFrame, order: DataFrame | None = None, simple: bool = False) -> DataFrame:
    """Edges with ids replaced by their degree order; pass ``order`` to force or reuse one.

    Edges are written, for they are read twice, and counted, so that a task joins about
    ``TASK_ROWS`` of them however many there are; those of one vertex meet its new id in one
    task. ``simple`` says that each undirected edge comes once and that none is a loop.
    """
    edges = stored(edges.select("src", "dst"), "edges")
    parts = tasks(edges.sparkSession, edges.count())
    if order is None:
        order = degree_order(edges.union(transpose(edges)) if simple else symmetrize_both(edges, parts=parts))
    ids = order.select("src", "new_id").repartition(parts, "src")
    a, b = ids.select(F.col("src").alias("a"), F.col("new_id").alias("na")), ids.select(F.col("src").alias("b"), F.col("new_id").alias("nb"))
    half = edges.repartition(parts, "src").join(a, F.col("src") == F.col("a")).select("na", "dst").repartition(parts, "dst")
    return half.join(b, F.col("dst") == F.col("b")).select(F.col("na").alias("src"), F.col("nb").alias("dst"))


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Directed edges of a grid between neighbours up, down, left and right; id = row * cols + col."""
    cells = spark.range(rows * cols).select("id", F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    to = cells.select("id", "r", "c", F.explode(steps).alias("s")).select("id", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"))
    return to.where((F.col("r") >= 0) & (F.col("r") < rows) & (F.col("c") >= 0) & (F.col("c") < cols)).select(F.col("id").alias("src"), (F.col("r") * cols + F.col("c")).alias("dst"))


def local_partition(ids: DataFrame, size: int, parts: int, part: int) -> DataFrame:
    """Whether an id lies in the first share of ``size`` ids that ``part`` of ``parts`` owns."""
    share = size // parts
    return ids.withColumn("is_local", (F.col("id") >= part * share) & (F.col("id") < (part + 1) * share))
