"""Scatter updates, pointer chasing, strided reads and atomics as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.intmath import mix32, xorshift_step
from loomgraph.plans.scratch import cut


def gups(table: DataFrame, updates: DataFrame, keys: tuple[str, ...] = ("idx",)) -> DataFrame:
    """``table`` (keys, val) with val ^= every update's value: the race-free result of scatter-XOR."""
    folded = updates.groupBy(*keys).agg(F.bit_xor("value").alias("_x"))
    return table.join(folded, list(keys), "left").select(*keys, F.col("val").bitwiseXOR(F.coalesce("_x", F.lit(0).cast("long"))).alias("val"))


def gups_updates(spark: SparkSession, threads: int, per_thread: int, table_size: int, base: int = 0, width: int = 8) -> DataFrame:
    """(thread, u, idx, value): each thread's generator from its own seed, as unsigned index and address."""
    states = F.aggregate(
        F.sequence(F.lit(1), F.lit(per_thread)),
        F.struct(F.col("id").alias("x"), F.array().cast("array<bigint>").alias("all")),
        lambda s, _: F.struct(xorshift_step(s["x"]).alias("x"), F.concat(s["all"], F.array(xorshift_step(s["x"]))).alias("all")),
        lambda s: s["all"],
    )
    draws = spark.range(threads).select(F.col("id").alias("thread"), F.posexplode(states).alias("u", "x"))
    x = F.col("x")
    # Unsigned remainder of a 64-bit pattern.
    half = F.shiftrightunsigned(x, 1)
    idx = ((half % table_size) * 2 + x.bitwiseAND(F.lit(1))) % table_size
    return draws.select("thread", "u", idx.alias("idx")).withColumn("value", F.col("idx") * width + base)


def list_rank(nodes: DataFrame, end: int = -1) -> DataFrame:
    """(id, last, steps, sum_val, xor_ids) from each node to its list's end, by pointer doubling.

    ``nodes`` is (id, next, val). Every round joins the table with itself once
    and doubles the reach; the number of rounds is the logarithm of the longest
    list. A cycle is an error.
    """
    now = cut(nodes.select("id", F.col("next").alias("to"), F.col("id").alias("last"), F.lit(1).cast("long").alias("steps"), F.col("val").cast("long").alias("sum_val"), F.col("id").alias("xor_ids")))
    total = now.count()
    reach = 1
    while now.where(F.col("to") != end).limit(1).count():
        if reach > 2 * max(total, 1):
            raise ValueError("the list has a cycle")
        ahead = now.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("to", "last", "steps", "sum_val", "xor_ids")])
        there = F.col("a").isNotNull()
        joined = now.join(ahead, now["to"] == ahead["a"], "left")
        now = cut(
            joined.select(
                "id",
                F.when(there, F.col("a_to")).otherwise(F.lit(end).cast("long")).alias("to"),
                F.when(there, F.col("a_last")).otherwise(F.col("last")).alias("last"),
                (F.col("steps") + F.coalesce("a_steps", F.lit(0))).alias("steps"),
                (F.col("sum_val") + F.coalesce("a_sum_val", F.lit(0))).alias("sum_val"),
                F.col("xor_ids").bitwiseXOR(F.coalesce("a_xor_ids", F.lit(0).cast("long"))).alias("xor_ids"),
            )
        )
        reach *= 2
    return now.select("id", "last", "steps", "sum_val", "xor_ids")


def ptr_chase(spark: SparkSession, n: int, stride: int, start: int, steps: int) -> DataFrame:
    """(final_index, sum_idx, sum_val) of a chase round a ring, in closed form for each step."""
    at = (F.lit(start).cast("long") + F.col("id") % n * stride) % n
    visited = spark.range(steps).select(at.alias("idx"))
    final = (start + steps % n * stride) % n
    return visited.agg(F.lit(final).cast("long").alias("final_index"), F.coalesce(F.sum("idx"), F.lit(0)).cast("long").alias("sum_idx"), F.coalesce(F.sum(mix32(F.col("idx"))), F.lit(0)).cast("long").alias("sum_val"))


def strided(df: DataFrame, stride: int, column: str = "id") -> DataFrame:
    return df.where(F.col(column) % stride == 0)


def block_owner(df: DataFrame, threads: int, block: int = 8, column: str = "id") -> DataFrame:
    """The thread that reads each element when blocks are dealt in turn."""
    return df.withColumn("owner", F.floor(F.col(column) / block) % threads)


def atomics(ops: DataFrame) -> DataFrame:
    """Final effect of atomics per address: ``ops`` is (addr, op, val, t); add and or fold, the first swap by (t, val) keeps its value."""
    pick = lambda op, col: F.when(F.col("op") == op, col)
    return ops.groupBy("addr").agg(
        F.sum(pick("add", F.col("val"))).alias("added"),
        F.bit_or(pick("or", F.col("val"))).alias("ored"),
        F.min(pick("swap", F.struct("t", "val")))["val"].alias("first_swap"),
        F.max(pick("max", F.col("val"))).alias("maximum"),
        F.count("*").alias("ops"),
    )


def compare_and_swap(ops: DataFrame, empty: int = -1) -> DataFrame:
    """(addr, winner): of attempts to swap ``empty`` for a value, the earliest by (t, val) wins."""
    return ops.groupBy("addr").agg(F.min(F.struct("t", "val"))["val"].alias("winner"))


def fib(spark: SparkSession, n: int) -> DataFrame:
    return spark.sql(f"""
      WITH RECURSIVE f(i, a, b) AS (SELECT 0, 0L, 1L UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < {int(n)})
      SELECT a AS fib FROM f WHERE i = {int(n)}""")


def hashed(column: str | Column) -> Column:
    return mix32(F.col(column) if isinstance(column, str) else column)
