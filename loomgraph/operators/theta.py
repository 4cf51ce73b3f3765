"""Joins on any condition, by tiles of the matrix of pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import prefix

ROW, COLUMN = "_tile_row", "_tile_column"


def tile_counts(a: int, b: int, tiles: int) -> tuple[int, int]:
    """Rows and columns of a grid of about ``tiles`` tiles in which the copies of ``a`` and ``b`` rows are fewest.

    Each row of the first side goes to as many tiles as the grid has columns and
    the other way round, so the sides of a tile should hold like numbers of rows.
    """
    rows = min(tiles, max(1, round(math.sqrt(tiles * max(a, 1) / max(b, 1)))))
    return rows, max(1, math.ceil(tiles / rows))


def tiled(a: DataFrame, b: DataFrame, rows: int, columns: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with their tile: a row of ``a`` in one row of the grid and all its columns, a row of ``b`` in one column and all rows.

    The row or column is drawn by hash from a row's values and its place, so equal
    rows spread too, and a task that runs again draws the same.
    """

    def strip(df: DataFrame, n: int) -> Column:
        return F.pmod(F.xxhash64(*df.columns, F.monotonically_increasing_id()), F.lit(n)).cast("int")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return (
        a.withColumn(ROW, strip(a, rows)).withColumn(COLUMN, every(columns)),
        b.withColumn(COLUMN, strip(b, columns)).withColumn(ROW, every(rows)),
    )


def theta_join(a: DataFrame, b: DataFrame, condition: Column, tiles: int | None = None) -> DataFrame:
    """Pairs of rows of ``a`` and ``b``, whose columns have different names, that meet ``condition``; each pair once.

    For conditions without an equality. No side is broadcast for it and no key
    decides where rows go: with ``tiles`` tiles (by default one for each shuffle
    partition), a tile holds about ``1 / sqrt(tiles)`` of each side, and no tile
    depends on the values. Nulls meet no condition, as in SQL.
    """
    clash = {c.lower() for c in a.columns} & {c.lower() for c in b.columns}
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    tiles = tiles or int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = tiled(a, b, *tile_counts(a.count(), b.count(), tiles))
    return left.join(right, [ROW, COLUMN]).where(condition).drop(ROW, COLUMN)


def sums_above(a: DataFrame, b: DataFrame, values: tuple[str, str], groups: tuple[str, str], sums: list[str]) -> DataFrame:
    """Rows of ``a`` with the ``sums`` of all rows of ``b`` of a smaller value and another group, without making the pairs.

    Sums over all groups less those of the own group, by ``prefix.sums_below``. Rows
    without a value or group meet none, as in SQL; ``sums`` must be exact (integers, decimals).
    """
    mine, theirs = (df.where(F.col(v).isNotNull() & F.col(g).isNotNull()).withColumn("_value", F.col(v)).withColumn("_group", F.col(g)) for df, v, g in zip((a, b), values, groups, strict=True))
    # One row for each value and group is asked for, whatever repeats.
    asked, points = mine.select("_value", "_group").distinct(), theirs.select("_value", "_group", *sums)
    every = prefix.sums_below(points.drop("_group"), asked, "_value", sums)
    own = prefix.sums_below(points, asked, "_value", sums, by="_group")
    own = own.select("_value", "_group", *[F.col(c).alias(f"_own_{c}") for c in sums])
    other = every.join(own, ["_value", "_group"]).select("_value", "_group", *[(F.col(c) - F.col(f"_own_{c}")).alias(c) for c in sums])
    return mine.join(other, ["_value", "_group"]).select(*a.columns, *sums)
