"""Joins of many rows to the one row of their key, where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is dealt over several tasks; so there are at most so many such keys.
SHARES = 2000
#: Keys of fewer rows are never dealt.
FEW = 100


def join_one(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Rows of ``many`` with the row of ``one`` that has the same ``key``; ``one`` has each key once; ``how`` is inner or left.

    Keys that hold more than ``1 / SHARES`` of all rows of ``many``, at most ``SHARES``
    of them, are broadcast with the number of tasks that share them; their rows are
    dealt by hash of row and place, and their row of ``one`` is repeated as often.
    """
    limit = max(FEW, many.count() // SHARES)
    counted = many.groupBy(key).count().where((F.col("count") > limit) & F.col(key).isNotNull())
    hot = F.broadcast(counted.select(F.col(key).alias("_hot"), F.ceil(F.col("count") / limit).alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = many.join(hot, many[key] == hot["_hot"], "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), parts))
    spread = one.join(hot, one[key] == hot["_hot"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.drop("_hot", "_parts").join(spread.drop("_hot", "_parts"), [key, "_part"], how).drop("_part")
