"""Sums over all rows below a value, for joins on an inequality of which only counts and sums are wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of keys, each ordered by one window.
RANGES = 256


def sums_below(points: DataFrame, asked: DataFrame, key: str, sums: list[str], by: str | None = None, ranges: int = RANGES) -> DataFrame:
    """Each row of ``asked`` with the ``sums`` of all rows of ``points`` whose ``key`` is smaller than its own, of the same ``by`` if given.

    ``asked`` has ``key`` (and ``by``), without nulls, and other columns than ``points``; points with a
    null key count nowhere. Points are added up by key first, keys are cut into
    ``ranges`` by their quantiles, and running sums go over the ranges and then inside
    each. So rows are exchanged a fixed number of times, however many pairs there are.
    """
    groups = [by] if by else []
    rest = [c for c in asked.columns if c not in (key, *groups)]
    point = points.where(F.col(key).isNotNull()).groupBy(*groups, key).agg(*[F.sum(c).alias(c) for c in sums])
    bounds = asked.select(key).union(points.select(key)).agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    bounds = sorted(set(bounds or []))
    place = F.array_size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(key))) if bounds else F.lit(0)
    row = F.struct(*rest) if rest else F.struct(F.lit(0).alias("_"))
    # At one key the asked rows come first: what is smaller is before them.
    every = asked.select(*groups, key, F.lit(0).alias("_side"), row.alias("_row"), *[F.lit(None).alias(c) for c in sums]).unionByName(
        point.select(*groups, key, F.lit(1).alias("_side"), F.lit(None).alias("_row"), *sums)
    )
    every = every.withColumn("_range", place)
    totals = every.where("_side = 1").groupBy(*groups, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    upto = Window.partitionBy(*groups).orderBy("_range").rangeBetween(Window.unboundedPreceding, -1)
    wanted = every.select(*groups, "_range").distinct()
    bases = wanted.join(totals, [*groups, "_range"], "left").select(*groups, "_range", *[F.coalesce(F.sum(f"_{c}").over(upto), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy(*groups, "_range").orderBy(key, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = every.select(*groups, key, "_range", "_side", "_row", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in sums])
    found = counted.where("_side = 0").join(bases, [*groups, "_range"])
    return found.select(*groups, key, *[F.col("_row")[c].alias(c) for c in rest], *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums])
