"""Sparse and dense products, fixed-point attention, and vector kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.intmath import ONE, exp_q16, i32, inv_sqrt_q16
from loomgraph.operators.spread import join_one
from loomgraph.plans.scratch import stored


def spmm(matrix: DataFrame, features: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(row, out): each row's sum of val * feat over its entries; ``rows`` (row) adds zero rows.

    Features are arrays; a product is one join, and each task sums its rows
    element by element before the shuffle.
    """
    wide = matrix.join(features, matrix["col"] == features["node"]).select("row", "val", F.posexplode("feat").alias("k", "x"))
    sums = wide.groupBy("row", "k").agg(F.sum(F.col("val").cast("double") * F.col("x").cast("double")).alias("s"))
    packed = sums.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda p: p["s"]).alias("out"))
    if rows is None:
        return packed
    width = features.agg(F.max(F.size("feat"))).first()[0] or 0
    return rows.select("row").distinct().join(packed, "row", "left").select("row", F.coalesce("out", F.array_repeat(F.lit(0.0), width)).alias("out"))


def entry_parts(matrix: DataFrame, per_part: int, block: int = 1 << 16) -> DataFrame:
    """``matrix`` with the ``part`` of each entry: parts hold about ``per_part`` entries of consecutive rows.

    Rows get the running count of entries before them, in blocks of row ids, then over
    the blocks. The entries of a row lie from there on, each at a place drawn by hash,
    so a row of many entries spans as many parts as it fills and is never ordered.
    """
    counts = stored(matrix.groupBy("row").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("row") / block)), "row-counts")
    sums = counts.groupBy("block").agg(F.sum("n").alias("total"))
    bases = sums.select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("row")) - F.col("n")
    firsts = stored(counts.withColumn("inside", inside).join(bases, "block").select("row", "n", (F.col("base") + F.col("inside")).alias("first")), "row-starts")
    placed = join_one(matrix, firsts, "row")
    place = F.col("first") + F.pmod(F.xxhash64("row", "col"), F.col("n"))
    return placed.select(*matrix.columns, F.floor(place / per_part).cast("long").alias("part"))


def spmm_balanced(matrix: DataFrame, features: DataFrame, per_part: int = 1 << 16) -> DataFrame:
    """(row, out) as ``spmm``, with entries, not rows, dealt evenly: each part sums its rows, and rows that lie in several parts are put together.

    For matrices in which a few rows hold most entries. Each task sums the rows of
    its parts in order and writes one partial sum for each row and part.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        now, held = None, None
        for batch in batches:
            part, row, val, feat = batch.columns
            keys = np.stack([part.to_numpy(), row.to_numpy()])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
            width = len(feat[0])
            sums = np.add.reduceat(val.to_numpy()[:, None] * feat.flatten().to_numpy().reshape(-1, width), starts)
            if now is not None and now == (keys[0, 0], keys[1, 0]):
                sums[0] += held
            elif now is not None:
                yield _partial([now[1]], held[None])
            if len(starts) > 1:
                yield _partial(keys[1, starts[:-1]], sums[:-1])
            now, held = (keys[0, -1], keys[1, -1]), sums[-1]
        if now is not None:
            yield _partial([now[1]], held[None])

    def _partial(rows, sums) -> pa.RecordBatch:
        lists = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(sums).ravel()), sums.shape[1]).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(rows, np.int64)), lists], names=["row", "s"])

    feats = features.select(F.col("node").alias("col"), F.transform("feat", lambda x: x.cast("double")).alias("feat"))
    met = entry_parts(matrix, per_part).join(feats, "col").select("part", F.col("row").cast("long").alias("row"), F.col("val").cast("double").alias("val"), "feat")
    partial = met.repartition("part").sortWithinPartitions("part", "row").mapInArrow(run, "row long, s array<double>")
    sums = partial.select("row", F.posexplode("s").alias("k", "x")).groupBy("row", "k").agg(F.sum("x").alias("s"))
    return sums.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda p: p["s"]).alias("out"))


def gemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v): product of sparse or dense (i, k, v) and (k, j, v) in 64-bit integers. Zero results are present wherever entries meet."""
    left = a.select("i", "k", F.col("v").alias("x"))
    right = b.select("k", "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def gemm_tiled(a: DataFrame, b: DataFrame, tile: int = 256) -> DataFrame:
    """The same product by tiles: tiles meet on the inner index, numpy multiplies them, partial tiles are summed."""
    ta = a.select(F.floor(F.col("i") / tile).alias("ti"), F.floor(F.col("k") / tile).alias("tk"), F.struct("i", "k", "v").alias("e"))
    tb = b.select(F.floor(F.col("j") / tile).alias("tj"), F.floor(F.col("k") / tile).alias("tk"), F.struct("k", "j", "v").alias("e"))
    ta = ta.groupBy("ti", "tk").agg(F.collect_list("e").alias("ea"))
    tb = tb.groupBy("tj", "tk").agg(F.collect_list("e").alias("eb"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def matrix(entries) -> tuple:
            """Rows, columns, the matrix of one tile's entries, and where there are any."""
            x, y, v = (entries.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            rows, r = np.unique(x, return_inverse=True)
            columns, c = np.unique(y, return_inverse=True)
            m, seen = (np.zeros((len(rows), len(columns)), np.int64) for _ in range(2))
            np.add.at(m, (r, c), v)
            seen[r, c] = 1
            return rows, columns, m, seen

        for batch in batches:
            for ea, eb in zip(batch.column(0), batch.column(1), strict=True):
                (i, ka, left, has_left), (kb, j, right, has_right) = matrix(ea), matrix(eb)
                _, a, b = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                out = left[:, a] @ right[b]
                r, c = np.nonzero(has_left[:, a] @ has_right[b])
                yield pa.RecordBatch.from_arrays([pa.array(i[r]), pa.array(j[c]), pa.array(out[r, c])], names=["i", "j", "p"])

    parts = ta.join(tb, "tk").select("ea", "eb").mapInArrow(run, "i long, j long, p long")
    return parts.groupBy("i", "j").agg(F.sum("p").alias("v"))


def checksum(product: DataFrame) -> DataFrame:
    return product.agg(F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("checksum"))


def scores_q16(q: DataFrame, k: DataFrame, dim: int, wrap: bool = True) -> DataFrame:
    """(i, j, s): integer dot products of q (i, k, v) and k (k, j, v), times 1/sqrt(dim), in Q16.16."""
    s = F.col("v") * inv_sqrt_q16(dim)
    return gemm(q, k).select("i", "j", (i32(s) if wrap else s).alias("s"))


def softmax_q16(scores: DataFrame, wrap: bool = True, mode: str = "reference") -> DataFrame:
    """(i, j, p): row-wise softmax in Q16.16. ``reference`` uses the four-term series, ``exact`` true exponentials."""
    row = Window.partitionBy("i")
    x = F.col("s") - F.max("s").over(row)
    if mode == "exact":
        e = F.round(F.exp(x / ONE) * ONE).cast("long")
    else:
        e = exp_q16(i32(x) if wrap else x)
    with_e = scores.withColumn("e", e)
    total = F.sum("e").over(row)
    n = F.count("*").over(row)
    share = F.expr("shiftleft(e, 16) div total")
    even = F.expr(f"cast({ONE} as bigint) div n")
    return with_e.withColumn("total", total).withColumn("n", n).select("i", "j", F.when(F.col("total") <= 0, even).otherwise(share).alias("p"))


def apply_probs_q16(probs: DataFrame, values: DataFrame, tile: int = 64) -> DataFrame:
    """(i, d, o): sums of p * v over j, shifted down once for each tile of j; values are (j, d, v)."""
    parts = probs.join(values, "j").groupBy("i", "d", F.floor(F.col("j") / tile).alias("t")).agg(F.sum(F.col("p") * F.col("v")).alias("acc"))
    return parts.groupBy("i", "d").agg(F.sum(F.shiftright("acc", 16)).alias("o"))


def fma(df: DataFrame, a: str = "a", b: str = "b", c: str = "c") -> DataFrame:
    return df.withColumn(c, F.col(c) + F.col(a) * F.col(b))


def stream(df: DataFrame, kernel: str, scalar: float | Column = 3.0) -> DataFrame:
    """The bandwidth kernels over columns a, b, c: copy c=a, scale b=s*c, add c=a+b, triad a=b+s*c."""
    s = scalar if isinstance(scalar, Column) else F.lit(scalar)
    made = {"copy": ("c", F.col("a")), "scale": ("b", s * F.col("c")), "add": ("c", F.col("a") + F.col("b")), "triad": ("a", F.col("b") + s * F.col("c"))}
    name, value = made[kernel]
    return df.withColumn(name, value)
