"""Triangles: the lists of oriented edges meet the edges that close them, in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import symmetrize_simple, transpose
from loomgraph.operators.pieces import long, short
from loomgraph.plans.scratch import Rounds, stored, tidy

#: Closing edges that one task is given, about.
BLOCK_EDGES = 1 << 24
#: Pairs of ends that one task looks up, about.
BLOCK_WEDGES = 1 << 31
#: Ranges of ids at most.
MOST_RANGES = 1 << 9
#: Bytes of one Arrow batch of pieces.
BATCH_BYTES = 8 << 20
#: Blocks of fewer edges are not made to keep more tasks busy.
FEWEST_EDGES = 1 << 20
#: Pairs of a closing edge's possible ends that a task looks up at once.
PAIRS = 1 << 21


def _oriented(simple: DataFrame, last: Rounds) -> DataFrame:
    """Undirected edges, each once, from the end of lower (degree, id) to the other, so that no vertex has a large fan-out.

    Edges are written to ``last`` before each exchange and what was written before goes, so that the disk holds one exchange at a time.
    """
    simple = last.keep(simple)
    ends = simple.select("src", "dst")
    degrees = stored(ends.union(transpose(ends)).groupBy("src").agg(F.count("*").alias("d")), "degrees")
    a = degrees.select(F.col("src").alias("a"), F.col("d").alias("da"))
    b = degrees.select(F.col("src").alias("b"), F.col("d").alias("db"))
    half = last.keep(simple.join(a, simple["src"] == a["a"]).drop("a"))
    wide = half.join(b, half["dst"] == b["b"])
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("src") < F.col("dst")))
    rest = [c for c in simple.columns if c not in ("src", "dst")]
    return last.keep(wide.select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("dst"), *rest))


class _Closing:
    """The closing edges of a block: (y, z) with a weight, or 64 neighbouring z of a y as bits, found by a table of bits and then exactly."""

    def __init__(self, src, dst, weight, words: bool):
        place = dst >> 6 if words else dst
        self.y, yi = np.unique(src, return_inverse=True)
        self.z, zi = np.unique(place, return_inverse=True)
        keys = yi * len(self.z) + zi  # below the product of two counts of edges, so within 64 bits
        order = np.argsort(keys)
        self.keys, held = keys[order], weight[order]
        if words:
            bits = (np.uint64(1) << (dst & 63).astype(np.uint64))[order]
            starts = np.flatnonzero(np.diff(self.keys, prepend=-1))
            self.keys, held = self.keys[starts], np.bitwise_or.reduceat(bits, starts) if len(starts) else bits
        self.held = held
        self.shift = np.uint64(64 - max(10, int(4 * len(keys)).bit_length()))
        self.table = np.zeros(1 << int(64 - self.shift), bool)
        self.table[self._slot(self.keys)] = True

    def _slot(self, keys):
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    @staticmethod
    def index(values, of):
        """Places of ``values`` in the ordered ``of``, -1 where they are not."""
        if not len(of):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(of, values), len(of) - 1)
        return np.where(of[at] == values, at, -1)

    def held_at(self, keys):
        """(places in ``keys``, places in ``held``) of the keys that are here."""
        maybe = np.flatnonzero(self.table[self._slot(keys)])
        at = np.searchsorted(self.keys, keys[maybe])
        at[at == len(self.keys)] = 0
        right = self.keys[at] == keys[maybe]
        return maybe[right], at[right]


def _words(values, rows):
    """(place of a 64-bit word, bits, row): the values of each row as words."""
    order = np.lexsort((values, rows))
    place, row, bits = values[order] >> 6, rows[order], np.uint64(1) << (values[order] & 63).astype(np.uint64)
    starts = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    return place[starts], np.bitwise_or.reduceat(bits, starts) if len(starts) else bits, row[starts]


def _met(closing: _Closing, x, counts, flat, weight, words: bool):
    """(x, y, z, product of weights, or number of z) of what ``closing`` closes in lists, some million pairs at a time."""
    rows = np.repeat(np.arange(len(x)), counts)
    y_at = closing.index(flat, closing.y)
    firsts = np.flatnonzero(y_at >= 0)
    place, given, z_row = _words(flat, rows) if words else (flat, weight, rows)
    z_at = closing.index(place, closing.z)
    kept = z_at >= 0
    z_at, given, z_row, place = z_at[kept], given[kept], z_row[kept], place[kept]
    begin = np.searchsorted(z_row, np.arange(len(x) + 1))
    begin, many = begin[rows[firsts]], np.diff(begin)[rows[firsts]]
    ends = np.cumsum(many)
    low = 0
    while low < len(firsts):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        n = many[low:high]
        one = np.repeat(np.arange(low, high), n)
        other = np.repeat(begin[low:high] - (ends[low:high] - n - done), n) + np.arange(len(one))
        hit, at = closing.held_at(y_at[firsts[one]] * len(closing.z) + z_at[other])
        first, other = firsts[one[hit]], other[hit]
        if words:
            both = closing.held[at] & given[other]
            yield x[rows[first]], flat[first], place[other], np.bitwise_count(both).astype(np.int64)
        else:
            yield x[rows[first]], flat[first], place[other], closing.held[at] * given[other] * weight[first]
        low = high


def _cells(matrix: np.ndarray, wedges: np.ndarray, block_edges: int, block_wedges: int) -> list[tuple[int, int, int, int, int]]:
    """(i0, i1, j0, j1, tasks): squares of pairs of ranges, i before j or both the same, that hold every closing edge.

    ``matrix`` and ``wedges`` count the closing edges of a pair of ranges and the pairs of ends of a list there. Squares are
    quartered while they hold more than is given; one that cannot be is shared by several tasks.
    """
    found, left = [], [(0, len(matrix), 0, len(matrix))]
    while left:
        i0, i1, j0, j1 = left.pop()
        closing, pairs = (int(x[i0:i1, j0:j1].sum()) for x in (matrix, wedges))
        if not closing or not pairs:
            continue
        if i1 - i0 > 1 and (closing > block_edges or pairs > block_wedges):
            i, j = (i0 + i1) // 2, (j0 + j1) // 2
            left += [(i0, i, j0, j), (i0, i, j, j1), (i, i1, j, j1)] + ([] if i0 == j0 else [(i, i1, j0, j)])
        else:
            found.append((i0, i1, j0, j1, -(-pairs // block_wedges)))
    return found


def _lists_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(x, number of ends, ends, weights or None) of a batch of lists."""
    adj = batch.column("adj")
    weight = batch.column("k").flatten().to_numpy() if "k" in batch.schema.names else None
    return batch.column("src").to_numpy(), np.diff(adj.offsets.to_numpy()), adj.flatten().to_numpy(), weight


def _counted(bounds: np.ndarray):
    """The matrices of ``_cells`` over the lists of a task."""
    n = len(bounds) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing, pairs = np.zeros((n, n), np.int64), np.zeros((n, n))
        for batch in batches:
            x, counts, flat, _ = _lists_of(batch)
            if not len(flat):
                continue
            rows, of = np.repeat(np.arange(len(x)), counts), np.searchsorted(bounds, flat)
            np.add.at(closing, (np.searchsorted(bounds, x)[rows], of), 1)
            each = np.bincount(rows * n + of, minlength=len(x) * n).reshape(-1, n).astype(np.float64)
            pairs += each.T @ each
            pairs[np.arange(n), np.arange(n)] -= each.sum(0)
        yield pa.record_batch([pa.array([m.astype(np.int64).tobytes()], pa.binary()) for m in (closing, pairs)], names=["closing", "pairs"])

    return run


PIECE = "part int, kind int, n long, x_low long, x binary, counts binary, flat_low long, flat binary, weight binary"


def _dealt(bounds: np.ndarray, cells: list[tuple[int, int, int, int, int]]):
    """Lists as pieces for the tasks of cells: closing edges from the first range of a cell to the second (kind 0) or back (kind 1), and what lists have in both (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, counts, flat, weight = _lists_of(batch)
            if not len(flat):
                continue
            rows, of, own = np.repeat(np.arange(len(x)), counts), np.searchsorted(bounds, flat), np.searchsorted(bounds, x)[:, None]
            own = own[rows, 0]
            ends = np.cumsum(np.bincount(rows * (len(bounds) + 1) + of, minlength=len(x) * (len(bounds) + 1)).reshape(len(x), -1), 1)
            ends = np.concatenate([np.zeros((len(x), 1), np.int64), ends], 1)
            share = (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            made, part = [], 0

            def piece(kind: int, places: np.ndarray, parts) -> None:
                if not len(places):
                    return
                firsts = np.flatnonzero(np.diff(rows[places], prepend=-1))
                size = np.diff(firsts, append=len(places)).astype("<i4").tobytes()
                data = (kind, len(firsts), *short(x[rows[places[firsts]]]), size, *short(flat[places]), None if weight is None else weight[places].tobytes())  # noqa: B023
                made.extend((p, *data) for p in parts)  # noqa: B023

            for i0, i1, j0, j1, tasks in cells:
                a, b = ends[:, i1] - ends[:, i0], ends[:, j1] - ends[:, j0]
                good = a > 1 if i0 == j0 else (a > 0) & (b > 0)
                first, second = (of >= i0) & (of < i1), (of >= j0) & (of < j1)
                piece(0, np.flatnonzero((own >= i0) & (own < i1) & second), range(part, part + tasks))
                if i0 != j0:
                    piece(1, np.flatnonzero((own >= j0) & (own < j1) & first), range(part, part + tasks))
                places = np.flatnonzero(good[rows] & (first | second))
                if tasks == 1:
                    piece(2, places, [part])
                else:
                    to = share[rows[places]] % np.uint64(tasks)
                    for t in range(tasks):
                        piece(2, places[to == t], [part + t])
                part += tasks
            if made:
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=[c.split()[0] for c in PIECE.split(", ")])

    return run


def _joined(listed: bool, words: bool):
    """The task of ``_triangles``: for each cell its closing edges, then the lists that may be closed there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, closings = None, ([], []), None
        for batch in batches:
            for i in range(batch.num_rows):
                part, kind, n, x_low, x, counts, flat_low, flat, weight = (c[i].as_py() for c in batch.columns)
                if part != now:
                    now, held, closings = part, ([], []), None
                counts = np.frombuffer(counts, "<i4")
                x, flat = long(x_low, x, n), long(flat_low, flat, int(counts.sum()))
                weight = np.ones(len(flat), np.int64) if weight is None else np.frombuffer(weight, "<i8")
                if kind < 2:
                    held[kind].append((np.repeat(x, counts), flat, weight))
                    continue
                if closings is None:
                    closings = [_Closing(*(np.concatenate(c) for c in zip(*h, strict=True)), words) for h in held if h]
                    held = [], []
                total = 0
                for closing in closings:
                    for a, b, c, m in _met(closing, x, counts, flat, weight, words):
                        if listed and len(a):
                            yield pa.record_batch([pa.array(v.astype(np.int64)) for v in (a, b, c)], names=["x", "y", "z"])
                        total += int(m.sum())
                if not listed and total:
                    yield pa.record_batch([pa.array([total], pa.int64())], names=["n"])

    return run


def _triangles(simple: DataFrame, listed: bool = False, words: bool = False, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(x, y, z) of each triangle, or numbers (n) whose sum is the count, weighted by the product of ``k`` if edges have one.

    ``simple`` has each undirected edge once. A triangle is an oriented edge from y to z
    that closes the list of an x. Ids are cut into ranges, and pairs of ranges make cells of about
    ``block_edges`` closing edges at most; a list goes to each cell that holds two of its ends, and of it what
    lies in the two ranges. So on a random graph an end is sent about as often as the root of twice the number of cells,
    and where ids near each other are neighbours a few times. A cell to which too many pairs of ends go is shared by several
    tasks, each with its closing edges. Wedges are made in a task and never shuffled. Each step
    writes its rows, and those before it go with their shuffle files.
    """
    spark = simple.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    weighted = "k" in simple.columns
    pair = F.struct("dst", "k") if weighted else F.struct("dst")
    with tidy(spark):
        last = Rounds(spark, "oriented")
        made = _oriented(simple, last).groupBy("src").agg(F.collect_list(pair).alias("l")).select("src", F.col("l.dst").alias("adj"), *([F.col("l.k").alias("k")] if weighted else []))
        lists = stored(made.select(F.col("src").cast("long").alias("src"), F.col("adj").cast("array<long>").alias("adj"), *(["k"] if weighted else [])), "lists")
        last.drop()
        m = lists.agg(F.coalesce(F.sum(F.size("adj")), F.lit(0))).first()[0]
        blocks = max(math.ceil(m / block_edges), min(math.ceil(m / FEWEST_EDGES), 2 * spark.sparkContext.defaultParallelism), 1)
        ranges = min(1 << max(0, math.ceil(math.log2(2 * blocks))), MOST_RANGES) if blocks > 1 else 1
        bounds = np.zeros(0, np.int64)
        if ranges > 1:
            ends = lists.select(F.explode(F.concat("adj", F.array_repeat("src", F.size("adj")))).alias("v"))
            bounds = np.unique(np.asarray(ends.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10_000)).first()[0], np.int64))
        closing, pairs = np.zeros((2, len(bounds) + 1, len(bounds) + 1), np.int64)
        for row in lists.mapInArrow(_counted(bounds), "closing binary, pairs binary").toLocalIterator():
            closing += np.frombuffer(row["closing"], "<i8").reshape(closing.shape)
            pairs += np.frombuffer(row["pairs"], "<i8").reshape(pairs.shape)
    closing = np.triu(closing) + np.tril(closing, -1).T
    pairs = np.triu(pairs) * 2 - np.diag(np.diag(pairs))
    cells = _cells(closing, pairs, min(block_edges, math.ceil(m / blocks)), BLOCK_WEDGES)
    dealt = lists.mapInArrow(_dealt(bounds, cells), PIECE).repartitionById(max(sum(c[-1] for c in cells), 1), "part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(_joined(listed, words), "x long, y long, z long" if listed else "n long")


def _sum(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("triangles"))


def list_triangles(edges: DataFrame) -> DataFrame:
    """(u, v, w) with u < v < w, each triangle once."""
    t = F.sort_array(F.array("x", "y", "z"))
    return _triangles(symmetrize_simple(edges), listed=True).select(t[0].alias("u"), t[1].alias("v"), t[2].alias("w"))


def count_triangles(edges: DataFrame) -> DataFrame:
    return _sum(_triangles(symmetrize_simple(edges)))


def count_by_intersection(edges: DataFrame) -> DataFrame:
    """Triangles by intersecting the adjacency of both ends of each oriented edge."""
    return _sum(_triangles(symmetrize_simple(edges)))


def adjacency_bitmaps(oriented: DataFrame) -> DataFrame:
    """(src, block, bits): the ends of each vertex's edges as bits, in blocks of 64 ends; blocks without an end have no row."""
    bit = F.expr("shiftleft(1L, cast(dst & 63 AS INT))")
    return oriented.groupBy("src", F.shiftright("dst", 6).alias("block")).agg(F.bit_or(bit).alias("bits"))


def count_by_bitmaps(edges: DataFrame) -> DataFrame:
    """Triangles by AND and bit_count of the bitmaps of both ends of each oriented edge, 64 neighbouring ids at a time."""
    return _sum(_triangles(symmetrize_simple(edges), words=True))


def count_ordered_multi(edges: DataFrame) -> DataFrame:
    """Ordered count n > v > vv over directed adjacency as given: parallel edges count for each way they close a triangle.

    Three vertices have one such order, so the product of the numbers of parallel
    edges is counted once for each triangle, whatever way its edges are oriented.
    """
    e = edges.where("src > dst").groupBy("src", "dst").agg(F.count("*").alias("k"))
    return _sum(_triangles(e))
