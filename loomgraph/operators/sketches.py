"""Distinct counts and quantiles from sketches that are kept for each day and merged for any span of days.

A stored day is one row of fixed size whatever its rows: a HyperLogLog sketch of
``2**HLL_BITS`` registers, whose estimates are within 1.04 / sqrt(2**HLL_BITS) of
the count in one standard deviation, and a KLL sketch of ``KLL_K``, whose ranks are
within ``RANK_ERROR`` of the true ones with probability 0.99.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HLL_BITS = 12
KLL_K = 400
#: Four standard deviations of a distinct count.
COUNT_ERROR = 4 * 1.04 / 2 ** (HLL_BITS / 2)
RANK_ERROR = 0.015


def daily(events: DataFrame, day: Column, item: str, value: str) -> DataFrame:
    """(day, n, items, ranks): rows and both sketches of each day; null items and values are in neither sketch."""
    made = events.select(day.alias("day"), F.col(item).alias("i"), F.col(value).cast("double").alias("v"))
    return made.groupBy("day").agg(F.count("*").alias("n"), F.hll_sketch_agg("i", HLL_BITS).alias("items"), F.kll_sketch_agg_double("v", KLL_K).alias("ranks"))


def over(days: DataFrame, span: Column) -> DataFrame:
    """(span, n, items, ranks): the days of each span merged."""
    return days.groupBy(span.alias("span")).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("ranks").alias("ranks"))


def estimates(merged: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(span, n, distinct_items, q) of merged sketches; q has the quantiles of ``shares``."""
    q = F.array(*[F.kll_sketch_get_quantile_double("ranks", F.lit(s)) for s in shares])
    return merged.select("span", "n", F.hll_sketch_estimate("items").alias("distinct_items"), q.alias("q"))
