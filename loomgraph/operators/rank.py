"""PageRank by a fixed number of pull rounds over blocks of vertices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.pieces import PIECE, edges_of, long, pieces, short
from loomgraph.plans.scratch import Rounds, stored, tidy

#: Edges of one block, about; a vertex's edges lie in one block.
BLOCK_EDGES = 1 << 22
#: Graphs of more edges write each round, smaller ones every fifth.
OFTEN_EDGES = 1 << 24

STATE = "block long, part long, x binary, l1 double, total double"


def _raw(table: pa.Table, column: str, i: int, kind: str = "<i8") -> np.ndarray:
    value = table.column(column)[i]
    return np.frombuffer(value.as_buffer(), kind) if value.is_valid else np.zeros(0, kind)


def _blocks(e: DataFrame, per_block: int, count: int | None = None) -> DataFrame:
    """(block, v, degree, to, idx, own, starts, at): one row for each range of ids.

    ``v`` are its vertices in order and ``degree`` their edges out; ``own`` are those with edges in, of which those of the i-th
    begin at ``starts[i]``; edge j comes from the place ``at[j]`` of all that the block reads, in order of ids.
    ``idx[i]`` are the places in ``v`` of the vertices that block ``to[i]`` reads, in order.
    """
    partitions = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(partitions, -(-(e.count() if count is None else count) // per_block))
    bounds = np.unique(np.asarray(e.agg(F.percentile_approx("dst", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or [], np.int64))

    def packed(table: pa.Table) -> pa.Table:
        src, dst = edges_of(table)
        near, at = np.unique(src, return_inverse=True)
        order = np.argsort(dst, kind="stable")
        own, starts = np.unique(dst[order], return_index=True)
        made = [own, starts.astype(np.int32), at.astype(np.int32)[order], near]
        return pa.table([pa.array([table.column("block")[0].as_py()]), *(pa.array([x.tobytes()], pa.binary()) for x in made)], names=["block", "own", "starts", "at", "near"])

    def asked(batches):
        """What each block reads of another: ids and how many edges leave them; part -1 holds its own vertices and edges."""
        for b in batches:
            for i in range(b.num_rows):
                block, near = b.column("block")[i].as_py(), _raw(b, "near", i)
                many = np.bincount(_raw(b, "at", i, "<i4"), minlength=len(near)).astype(np.int32)
                of = np.searchsorted(bounds, near)
                blocks, starts = np.unique(of, return_index=True)
                ids, counts = np.split(near, starts[1:]), np.split(many, starts[1:])
                own = [b.column(c)[i].as_py() for c in ("own", "starts", "at")]
                rows = [(block, -1, 0, None, None, *own), *((int(x), block, *short(y), z.tobytes(), None, None, None) for x, y, z in zip(blocks, ids, counts, strict=True))]
                types = [pa.int64()] * 3 + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["block", "to", "low", "ids", "many", "own", "starts", "at"])

    def answered(table: pa.Table) -> pa.Table:
        parts = table.column("to").to_pylist()
        mine = next((i for i, part in enumerate(parts) if part < 0), None)
        own = np.zeros(0, np.int64) if mine is None else _raw(table, "own", mine)
        many = [_raw(table, "many", i, "<i4") for i in range(len(parts))]
        ids = [own if i == mine else long(table.column("low")[i].as_py(), table.column("ids")[i].as_py(), len(many[i])) for i in range(len(parts))]
        v = np.unique(np.concatenate(ids))
        degree, to, idx = np.zeros(len(v), np.int64), [], []
        for i, part in enumerate(parts):
            if part >= 0:
                at = np.searchsorted(v, ids[i])
                degree[at] += many[i]
                to.append(part)
                idx.append(at.astype(np.int32).tobytes())
        rest = [b"" if mine is None else table.column(c)[mine].as_py() for c in ("own", "starts", "at")]
        columns = [pa.array([table.column("block")[0].as_py()]), pa.array([v.tobytes()], pa.binary()), pa.array([degree.tobytes()], pa.binary()), pa.array([to], pa.list_(pa.int64())), pa.array([idx], pa.list_(pa.binary()))]
        return pa.table([*columns, *(pa.array([x], pa.binary()) for x in rest)], names=["block", "v", "degree", "to", "idx", "own", "starts", "at"])

    inward = e.mapInArrow(pieces(bounds), PIECE).groupBy("block").applyInArrow(packed, "block long, own binary, starts binary, at binary, near binary")
    sent = inward.mapInArrow(asked, "block long, to long, low long, ids binary, many binary, own binary, starts binary, at binary")
    made = sent.groupBy("block").applyInArrow(answered, "block long, v binary, degree binary, to array<long>, idx array<binary>, own binary, starts binary, at binary")
    return stored(made, "blocks").repartition(partitions, "block").persist()


def _sent(graph: pa.Table, ranks: np.ndarray, l1: float) -> pa.Table:
    """The ranks of a block, and what each block that reads them adds up."""
    block, to = graph.column("block")[0].as_py(), graph.column("to")[0].as_py()
    share = ranks / np.maximum(_raw(graph, "degree", 0), 1)
    data = [share[np.frombuffer(x, "<i4")].tobytes() for x in graph.column("idx")[0].as_py()]
    none = [None] * len(to)
    columns = [pa.array([block, *to]), pa.array([-1] + [block] * len(to)), pa.array([ranks.tobytes(), *data], pa.binary()), pa.array([l1, *none], pa.float64()), pa.array([float(ranks.sum()), *none], pa.float64())]
    return pa.table(columns, names=["block", "part", "x", "l1", "total"])


def _round(n: int, damping: float):
    def run(graph: pa.Table, state: pa.Table) -> pa.Table:
        state = state.sort_by("part")
        before = _raw(state, "x", 0, "<f8")
        read = np.concatenate([np.zeros(0), *(_raw(state, "x", i, "<f8") for i in range(1, state.num_rows))])
        v, own = _raw(graph, "v", 0), _raw(graph, "own", 0)
        got = np.zeros(len(v))
        if len(own):
            got[np.searchsorted(v, own)] = np.add.reduceat(read[_raw(graph, "at", 0, "<i4")], _raw(graph, "starts", 0, "<i4"))
        ranks = (1 - damping) / n + damping * got
        return _sent(graph, ranks, float(np.abs(ranks - before).sum()))

    return run


def _started(n: int):
    def run(graph: pa.Table, start: pa.Table) -> pa.Table:
        v = _raw(graph, "v", 0)
        ranks = np.full(len(v), 1.0 / n)
        if start.num_rows:
            ranks[np.searchsorted(v, start.column("v").to_numpy())] = start.column("rank").to_numpy()
        return _sent(graph, ranks, 0.0)

    return run


def _unpacked(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(_raw(b, "v", i)), pa.array(_raw(b, "x", i, "<f8"))], names=["v", "rank"])


def pagerank(edges: DataFrame, iterations: int = 50, damping: float = 0.85, start: DataFrame | None = None) -> DataFrame:
    """(v, rank) after ``iterations`` rounds of (1 - d)/N + d * sum(rank[u] / degree[u]), from equal ranks or from ``start`` (v, rank).

    Sinks pass nothing on; there is no early stop. Edges with a null end take no part.
    """
    return _ranks(edges, iterations, damping, start, False)[0]


def pagerank_rounds(edges: DataFrame, iterations: int = 50, damping: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(v, rank) after all rounds, and (round, l1, total): how much each round moved ranks, and their sum after it."""
    found, changes = _ranks(edges, iterations, damping, None, True)
    return found, edges.sparkSession.createDataFrame(changes, "round int, l1 double, total double")


def _ranks(edges: DataFrame, iterations: int, damping: float, start: DataFrame | None, trace: bool, per_block: int = BLOCK_EDGES) -> tuple[DataFrame, list[tuple]]:
    """The ranks after all rounds, and the change and sum of each, if ``trace``.

    Edges stay in their blocks. A round exchanges, for each pair of blocks, the shares of
    the vertices that one reads of the other, once however many edges they have; where
    ids near each other are neighbours, that is a few times the vertices. The files of a
    round go as soon as the next one is written.
    """
    kind, spark = dict(edges.dtypes)["src"], edges.sparkSession
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")
    with tidy(spark):
        count = e.count()
        graph = _blocks(e, per_block, count)
        n = graph.agg(F.coalesce(F.sum(F.octet_length("v") / 8), F.lit(0)).cast("long")).first()[0]
        if start is None:
            first = spark.createDataFrame([], "block long, v long, rank double")
        else:
            ids = graph.select("block", "v").mapInArrow(_ids, "block long, v long")
            first = ids.join(start.select(F.col("v").cast("long").alias("v"), "rank"), "v").select("block", "v", "rank")
        by_block = lambda state: graph.groupBy("block").cogroup(state.groupBy("block"))
        state, changes, last = by_block(first).applyInArrow(_started(max(n, 1)), STATE), [], Rounds(spark, "ranks")
        for i in range(iterations if n else 0):
            state = by_block(state).applyInArrow(_round(n, damping), STATE)
            if trace or count > OFTEN_EDGES or i % 5 == 4:
                state = last.keep(state)
            if trace:
                changes.append((i + 1, *state.agg(F.sum("l1"), F.sum("total")).first()))
        whole = stored(graph.select("block", "v").join(state.where("part = -1").select("block", "x"), "block").mapInArrow(_unpacked, "v long, rank double"), "ranks")
        graph.unpersist()
        last.drop()
    return whole.select(F.col("v").cast(kind).alias("v"), "rank"), changes


def _ids(batches):
    for b in batches:
        for i in range(b.num_rows):
            v = _raw(b, "v", i)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), b.column("block")[i].as_py())), pa.array(v)], names=["block", "v"])


def l1_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(l1, total): sum of absolute changes and of the new ranks."""
    b = after.select(F.col("v").alias("w"), F.col("rank").alias("now"))
    return before.join(b, before["v"] == b["w"]).agg(F.sum(F.abs(F.col("now") - F.col("rank"))).alias("l1"), F.sum("now").alias("total"))
