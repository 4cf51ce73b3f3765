"""Ego-graph sampling with a fan-out per level, and a direct-mapped cache over a request sequence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.intmath import mix32
from loomgraph.operators.spread import join_one
from loomgraph.plans.scratch import stored

# Edges taken of each vertex, level by level.
FAN_OUT = (5, 3, 2, 1, 0)


def _grow(edges: DataFrame, roots: DataFrame, fan_out: tuple[int, ...], pick) -> DataFrame:
    """(root, level, src, dst): edges drawn at each level; a vertex of a root's sample is expanded once.

    Each level's edges are written once; what the last level reaches is not looked up, for nothing is drawn from it.
    """
    used = list(fan_out[: fan_out.index(0)] if 0 in fan_out else fan_out)
    seen = roots.select(F.col("v").alias("root"), F.col("v"))
    frontier, taken = seen, []
    for level, k in enumerate(used):
        last = level == len(used) - 1
        drawn = pick(frontier, k, level).select("root", F.lit(level).alias("level"), "src", "dst")
        taken.append(drawn if last else stored(drawn, "drawn"))
        if not last:
            reached = taken[-1].select("root", F.col("dst").alias("v"), F.lit(True).alias("new"))
            met = seen.select("root", "v", F.lit(False).alias("new")).union(reached)
            frontier = stored(met.groupBy("root", "v").agg(F.min("new").alias("new")).where("new").select("root", "v"), "frontier")
            seen = seen.union(frontier)
    return reduce(DataFrame.union, taken)


def first_k(edges: DataFrame, roots: DataFrame, fan_out: tuple[int, ...] = FAN_OUT) -> DataFrame:
    """Deterministic samples: each vertex gives its first k edges by ``pos`` (or dst, if edges have none).

    The limit on places is applied in each task before the exchange, so a hub's edges are not ordered by one task.
    """
    by = "pos" if "pos" in edges.columns else "dst"
    most = max(fan_out)
    some = edges.select("src", "dst", F.col(by).alias("at"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("at", "dst"))
    some = some.withColumn("place", place).where(F.col("place") <= most)
    heads = stored(some.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("place", "dst"))).alias("heads")), "heads")

    def pick(frontier: DataFrame, k: int, level: int) -> DataFrame:
        met = frontier.join(heads, frontier["v"] == heads["src"])
        return met.select("root", "src", F.explode(F.slice(F.col("heads.dst"), 1, k)).alias("dst"))

    return _grow(edges, roots, fan_out, pick)


#: Edges of a vertex that one window orders.
PLACES = 4096


def numbered_edges(edges: DataFrame, per_block: int = PLACES) -> DataFrame:
    """(src, dst, pos): each vertex's edges numbered from 0, in blocks.

    The edges of a vertex are dealt by hash into as many blocks as hold about
    ``per_block`` each; running counts over a vertex's blocks and places inside a
    block give the numbers. So the order is by block, then by dst, and no window holds
    a hub's whole list. Edges of a hub meet its degree in several tasks.
    """
    edges = edges.select("src", "dst")
    degrees = edges.groupBy("src").agg(F.count("*").alias("degree"))
    block = F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / per_block)).alias("block")
    blocked = stored(join_one(edges, stored(degrees, "degrees"), "src").select("src", "dst", block), "blocked-edges")
    sizes = blocked.groupBy("src", "block").agg(F.count("*").alias("n"))
    bases = sizes.select("src", "block", (F.sum("n").over(Window.partitionBy("src").orderBy("block")) - F.col("n")).alias("base"))
    inside = blocked.withColumn("place", F.row_number().over(Window.partitionBy("src", "block").orderBy("dst")) - 1)
    return inside.join(bases, ["src", "block"]).select("src", "dst", (F.col("base") + F.col("place")).cast("int").alias("pos"))


def random_k(edges: DataFrame, roots: DataFrame, fan_out: tuple[int, ...] = FAN_OUT, seed: int = 1) -> DataFrame:
    """Samples with replacement: draw i of a vertex takes edge number hash(seed, root, vertex, level, i) mod degree; see ``numbered_edges``."""
    degrees = edges.groupBy("src").agg(F.count("*").alias("degree"))
    numbered = stored(numbered_edges(edges), "numbered-edges")

    def pick(frontier: DataFrame, k: int, level: int) -> DataFrame:
        draws = frontier.join(degrees, frontier["v"] == degrees["src"]).select("root", "v", "degree", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
        h = mix32(F.col("root") * 31 + F.col("v") * 17 + F.col("i") * 7 + level * 3 + seed)
        asked = draws.select("root", F.col("v").alias("src"), (h % F.col("degree")).cast("int").alias("pos"))
        return asked.join(numbered, ["src", "pos"]).select("root", "src", "dst")

    return _grow(edges, roots, fan_out, pick)


def ego_graph(sample: DataFrame) -> DataFrame:
    """(root, u, v): a sample's edges in both directions and a self-loop at each vertex, once."""
    ends = sample.select("root", F.explode(F.array("src", "dst")).alias("u"))
    both = sample.select("root", "src", "dst").union(sample.select("root", "dst", "src")).toDF("root", "u", "v")
    return both.union(ends.select("root", "u", F.col("u").alias("v"))).distinct()


def cache_hits(requests: DataFrame, size: int) -> DataFrame:
    """(slot, requests, hits) of a direct-mapped cache that fills on each miss: a request hits if the slot's last id was the same."""
    slot = F.col("id") % size
    last = F.lag("id").over(Window.partitionBy("slot").orderBy("t", "id"))
    marked = requests.select("id", "t", slot.alias("slot")).withColumn("hit", F.coalesce(last == F.col("id"), F.lit(False)).cast("long"))
    return marked.groupBy("slot").agg(F.count("*").alias("requests"), F.sum("hit").alias("hits"))


def hit_rate(per_slot: DataFrame) -> DataFrame:
    return per_slot.agg(F.sum("hits").alias("hits"), F.sum("requests").alias("requests"), (F.sum("hits") * 100 / F.sum("requests")).alias("percent"))


def sample_report(sample: DataFrame) -> DataFrame:
    """(roots, edges, vertices, avg_edges, avg_vertices) of a set of samples."""
    edges = sample.groupBy("root").agg(F.count("*").alias("e"))
    vertices = sample.select("root", F.explode(F.array("src", "dst")).alias("v")).distinct().groupBy("root").agg(F.count("*").alias("n"))
    each = edges.join(vertices, "root")
    return each.agg(F.count("*").alias("roots"), F.sum("e").alias("edges"), F.sum("n").alias("vertices"), F.avg("e").alias("avg_edges"), F.avg("n").alias("avg_vertices"))
