"""Graphs, matrices, lists and telemetry derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.intmath import mix32
from loomgraph.operators.graph import symmetrize_both, symmetrize_simple, tasks
from loomgraph.operators.telemetry import SUFFIX, opcode_classes

MINUTES = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> int:
    return tasks(spark, table(spark, sf_dir, "lineitem").count())


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one order as directed edges from the earlier line to the later one, repeats and loops included."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").repartition(_parts(spark, sf_dir), "l_orderkey")
    a = items.select("l_orderkey", F.col("l_partkey").alias("src"), F.col("l_linenumber").alias("i"))
    b = items.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("j"))
    return a.join(b, "l_orderkey").where("i < j").select("src", "dst")


def co_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges between parts that share an order, once each; there are about two for each line."""
    return symmetrize_simple(pairs(spark, sf_dir), parts=2 * _parts(spark, sf_dir))


def co_part_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symmetrize_both(pairs(spark, sf_dir), parts=2 * _parts(spark, sf_dir))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite edges from parts to suppliers, whose ids are moved beyond all parts."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000).alias("dst")).distinct()


def event_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a linked list (id, next, val)."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    following = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("event_id").alias("id"), F.coalesce(following, F.lit(-1).cast("long")).alias("next"), mix32(F.col("event_id")).alias("val"))


def quantised(spark: SparkSession, sf_dir: str, scale: int = 127) -> DataFrame:
    """Embeddings in long form (i, k, v) as small integers."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("k", "x"))
    return e.select("i", F.col("k").cast("long").alias("k"), F.floor(F.col("x").cast("double") * scale).alias("v"))


def opcode_names() -> list[str]:
    """All classified opcodes in order, and the one that has no class."""
    return [*opcode_classes(), "LRW_RL"]


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as instruction counters: the part picks the opcode, quantity is the count."""
    names = opcode_names()
    items = table(spark, sf_dir, "lineitem")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("l_partkey") % len(names) + 1).cast("int"))
    name = F.when(F.col("l_linestatus") == "O", F.concat(name, F.lit(SUFFIX))).otherwise(F.concat(name, F.lit("_cycles")))
    return items.select(name.alias("StatisticName"), F.col("l_quantity").cast("long").alias("sum_u64"), F.col("l_orderkey").alias("SimTime"))


def minute(ts: str = "ts"):
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (MINUTES * 1_000_000))
