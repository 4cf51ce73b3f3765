"""Communities: integer-gain local moving, refinement into connected pieces, partition listing."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components, forest
from loomgraph.operators.graph import symmetrize_both
from loomgraph.operators.pieces import PIECE, edges_of, long, pieces, short
from loomgraph.operators.rank import _blocks as vertex_blocks
from loomgraph.plans.scratch import Rounds, stored, tidy


class _Graph:
    """Neighbours by place: those of ``ids[i]`` are ``near[starts[i] : starts[i + 1]]``, in order; four bytes for each end of an edge."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, near: np.ndarray):
        self.ids, self.near, self.starts = ids, near, starts.tolist()

    @classmethod
    def of_pairs(cls, pairs) -> _Graph:
        given = np.asarray(pairs, np.int64).reshape(-1, 2)
        ends = np.concatenate([given, given[:, ::-1]])
        ids, at = np.unique(ends, return_inverse=True)
        at = at.reshape(ends.shape)
        at = at[np.lexsort((at[:, 1], at[:, 0]))]
        return cls(ids, np.searchsorted(at[:, 0], np.arange(len(ids) + 1)), at[:, 1].astype(np.int32))

    @classmethod
    def of_blocks(cls, blocks: list[tuple]) -> _Graph:
        """From (v, number of neighbours, neighbours as ``short`` packs them) of ranges of ids in order; ``blocks`` is emptied."""
        ids = np.concatenate([b[0] for b in blocks])
        starts = np.concatenate([[0], np.cumsum(np.concatenate([b[1] for b in blocks]), dtype=np.int64)])
        near, at = np.empty(starts[-1], np.int32), 0
        blocks.reverse()
        while blocks:
            _, k, low, data = blocks.pop()
            n = int(k.sum())
            for first in range(0, n, 1 << 20):
                m, width = min(1 << 20, n - first), len(data) // n
                near[at : at + m] = np.searchsorted(ids, long(low, data[first * width : (first + m) * width], m))
                at += m
        return cls(ids, starts, near)

    def neighbours(self, i: int) -> list[int]:
        return self.near[self.starts[i] : self.starts[i + 1]].tolist()

    def places(self, vertices) -> list[int]:
        """The places of those of ``vertices`` that are here, in their order."""
        given = np.asarray(vertices, np.int64)
        at = np.searchsorted(self.ids, given)
        at[at == len(self.ids)] = 0
        return at[self.ids[at] == given].tolist() if len(self.ids) else []


def _moves(graph: _Graph, max_passes: int, gain: str, order: list[int], groups: list[list[int]] | None, m2: int) -> np.ndarray:
    """The community of each place after serial moves in ``order``; those of one of ``groups`` move in turn by what held when the group began."""
    own = np.arange(len(graph.ids), dtype=np.int32)
    total = array("q", np.diff(graph.starts).tolist())  # arrays, not lists, for what a vertex looks up lies all over them
    near, starts = graph.near, graph.starts
    standard = gain == "standard"

    def turns(places: list[int], own_then: np.ndarray, total_then: array) -> bool:
        """Move ``places`` in turn by the communities and totals that they see."""
        moved = False
        for u in places:
            low, high = starts[u], starts[u + 1]
            k, here = high - low, own_then.item(u)
            links = Counter(own_then[near[low:high]].tolist())  # in order of the first neighbour
            # A gain is inside * m2 - k * total + k * (total here - k), less what leaving costs; the last terms are the same for all.
            stay = links.pop(here, 0)
            most, best = (stay * m2 if standard else 0) - k * (total_then[here] - k), here
            for there, inside in links.items():
                won = inside * m2 - k * total_then[there]
                if won > most:
                    most, best = won, there
            if best != here:
                total[here] -= k
                total[best] += k
                own[u] = best
                moved = True
        return moved

    for _ in range(max_passes):
        if groups is None:
            moved = turns(order, own, total)
        else:
            moved = any([turns(group, own.copy(), total[:]) for group in groups])
        if not moved:
            break
    return graph.ids[own]


def _move(pairs, max_passes: int, gain: str, order: list[int] | None, groups: list[list[int]] | None = None, m2: int | None = None) -> dict[int, int]:
    """Communities of edges ``pairs`` after serial moves of vertices in ``order``, or by ``groups``; ``m2`` is twice the edges of the whole graph, if they are a part of it."""
    graph = _Graph.of_pairs(pairs)
    found = _moves(graph, max_passes, gain, *_turns(graph, order, groups), len(graph.near) if m2 is None else m2)
    return dict(zip(graph.ids.tolist(), found.tolist(), strict=True))


def _turns(graph: _Graph, order: list[int] | None, groups: list[list[int]] | None):
    """Vertices as places."""
    return list(range(len(graph.ids))) if order is None else graph.places(order), None if groups is None else [graph.places(g) for g in groups]


def _by_component(simple: DataFrame, vertices: DataFrame, move, per_block: int | None = None) -> DataFrame:
    """(v, comm) by ``move(graph, tags)``, places to communities, of each component in a task of its own; ``vertices`` are (node, root, tag).

    Edges come to their task in blocks of ids that other tasks have packed and put in order, so it holds
    four bytes for each end of an edge and some for each vertex, and sorts none.
    """
    _small_batches(simple)
    e = simple.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    bounds = _bounds(e, max(1, -(-2 * e.count() // (per_block or BLOCK_EDGES))))

    def dealt(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, b.column("node").to_numpy())), *b.columns], names=["block", *b.schema.names])

    def packed(edges: pa.Table, told: pa.Table) -> pa.Table:
        near, v = edges_of(edges)
        told = told.sort_by("node")
        nodes, roots, tags = (told.column(c).to_numpy() for c in ("node", "root", "tag"))
        at = np.searchsorted(nodes, v)
        order = np.lexsort((near, at, roots[at]))
        near, at = near[order], at[order]
        firsts = np.flatnonzero(np.diff(at, prepend=-1))
        own, k = at[firsts], np.diff(firsts, append=len(at)).astype(np.int32)
        rows = []
        starts = np.flatnonzero(np.diff(roots[own]) != 0) + 1
        for low, high in zip([0, *starts], [*starts, len(own)], strict=True):
            some = own[low:high]
            data = short(near[firsts[low] : firsts[high] if high < len(own) else len(at)])
            rows.append((int(roots[some[0]]), edges.column("block")[0].as_py(), nodes[some].tobytes(), tags[some].tobytes(), k[low:high].tobytes(), *data))
        return pa.table([pa.array(x) for x in zip(*rows, strict=True)], names=["root", "block", "v", "tags", "k", "low", "near"])

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((r for b in batches for r in zip(*[b[c] for c in ("block", "v", "tags", "k", "low", "near")], strict=True)), key=lambda r: r[0])
        blocks = [(np.frombuffer(v, "<i8"), np.frombuffer(k, "<i4"), low, near) for _, v, _, k, low, near in rows]
        tags = np.concatenate([np.frombuffer(r[2], "<i8") for r in rows])
        del rows
        graph = _Graph.of_blocks(blocks)
        yield pd.DataFrame({"v": graph.ids, "comm": move(graph, tags)}, columns=["v", "comm"]).astype("int64")

    told = vertices.select("node", "root", F.col("tag").cast("long").alias("tag")).mapInArrow(dealt, "block long, node long, root long, tag long")
    blocks = e.mapInArrow(pieces(bounds, both=True), PIECE).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(packed, "root long, block long, v binary, tags binary, k binary, low long, near binary")
    return stored(blocks, "blocks").groupBy("root").applyInPandas(moved, "v long, comm long")


def _small_batches(df: DataFrame) -> None:
    """A batch of blocks goes to Python by bytes, not by 10,000 rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _bounds(e: DataFrame, n: int) -> np.ndarray:
    """The ids that cut the ends of edges into about ``n`` ranges of as many each."""
    found = e.select(F.explode(F.array("src", "dst")).alias("v")).agg(F.percentile_approx("v", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] if n > 1 else None
    return np.unique(np.asarray(found or [], np.int64))


def local_moving(edges: DataFrame, max_passes: int = 10, gain: str = "reference", order: list[int] | None = None) -> DataFrame:
    """(v, comm): each vertex joins, in turn, the neighbouring community of largest integer gain.

    ``gain`` is "reference" (links into the own community are not subtracted, so
    it may oscillate until ``max_passes``) or "standard". Vertices move in
    ``order``, ascending by default. Moves depend on each other across a connected
    component and on nothing outside it but the number of all edges, and passes over a
    component at rest change nothing; so each component is moved by a
    task of its own, with the same result. A component is held by one task, in eight
    bytes an edge; see ``parallel_moving`` for one that is too large for that.
    """
    with tidy(edges.sparkSession):
        simple = stored(edges.where("src <> dst").select("src", "dst"), "graph")
        m2 = 2 * simple.count()
        vertices = stored(connected_components(forest(simple)).withColumn("tag", F.lit(0)), "roots")

        def move(graph, _):
            return _moves(graph, max_passes, gain, *_turns(graph, order, None), m2)

        return _by_component(simple, vertices, move)


#: Bytes of one Arrow batch of blocks.
BATCH_BYTES = 8 << 20
#: Ends of edges that one task packs for the tasks of components, about.
BLOCK_EDGES = 1 << 22
#: Directed edges of a block of ``parallel_moving``, about; a vertex's edges lie in one block.
ROUND_EDGES = 1 << 21


def _raw(table, column: str, i: int, kind: str = "<i8"):
    return np.frombuffer(table.column(column)[i].as_buffer(), kind)


TOLD = "block long, part long, n long, comm_low long, comm binary, total_low long, total binary, turn binary"


def _told(graph: pa.Table, now: pa.Table) -> pa.Table:
    """What a block's vertices are in, for itself (part -1) and, in packed form, for each block that reads some of them."""
    now = now.sort_by("v")
    comm, total, turn = (now.column(c).to_numpy() for c in ("comm", "total", "turn"))
    block, to = graph.column("block")[0].as_py(), graph.column("to")[0].as_py()
    rows = [(block, -1, len(comm), *short(comm), *short(total), turn.astype(np.uint8).tobytes())]
    for reader, data in zip(to, graph.column("idx")[0].as_py(), strict=True):
        at = np.frombuffer(data, "<i4")
        rows.append((reader, block, len(at), *short(comm[at]), *short(total[at]), b""))
    return pa.table([pa.array(x) for x in zip(*rows, strict=True)], names=[c.split()[0] for c in TOLD.split(", ")])


def _block_moves(m2: int):
    """A round of one block, from what it is told of its vertices and of those it reads: (block, v, k, comm) afterwards."""

    def run(graph, told):
        told = told.sort_by("part")
        rows = [tuple(c[i].as_py() for c in told.columns) for i in range(told.num_rows)]
        del told
        here, total_here = long(*rows[0][3:5], rows[0][2]), long(*rows[0][5:7], rows[0][2])
        turn = np.frombuffer(rows[0][7], np.uint8).astype(bool)
        comm, total = (np.concatenate([long(r[c], r[c + 1], r[2]) for r in rows[1:]]) for c in (3, 5))
        del rows
        v, starts, at = _raw(graph, "own", 0), _raw(graph, "starts", 0, "<i4"), _raw(graph, "at", 0, "<i4")
        k = np.diff(starts, append=len(at))
        rest = total_here - k
        # Communities by place in their order: smaller to sort, and a total for each.
        names, place = np.unique(comm, return_inverse=True)
        totals = np.zeros(len(names), np.int64)
        totals[place] = total
        keys = np.repeat(np.arange(len(v)), k) * len(names) + place[at]
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        inside = np.diff(first, append=len(keys))
        u, there = np.divmod(keys[first], len(names))
        del keys, comm, total, place
        stay = np.zeros(len(v), np.int64)
        same = names[there] == here[u]
        stay[u[same]] = inside[same]
        won = (inside - stay[u]) * m2 - k[u] * totals[there] + k[u] * rest[u]
        good = np.flatnonzero(~same & (won > 0) & turn[u])
        good = good[np.lexsort((there[good], -won[good], u[good]))]
        best = good[np.diff(u[good], prepend=-1) != 0]
        now = here.copy()
        now[u[best]] = names[there[best]]
        return pa.table([pa.array(np.full(len(v), graph.column("block")[0].as_py())), pa.array(v), pa.array(k), pa.array(now)], names=["block", "v", "k", "comm"])

    return run


def parallel_moving(edges: DataFrame, rounds: int = 5, block_edges: int = ROUND_EDGES) -> DataFrame:
    """(v, comm) by synchronous moves to the neighbouring community of largest standard gain: an extension for large graphs.

    In each round only vertices of one parity of a hash move, which keeps
    neighbours from swapping for ever. Edges stay in blocks of ids; a round exchanges
    vertices, and tells each block the communities of the vertices that its edges touch, once
    however many edges they have, in a packed row for each pair of blocks. The files of a round go
    with the next.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    _small_batches(edges)

    def begun(batches):
        for b in batches:
            for i in range(b.num_rows):
                own = _raw(b, "own", i)
                k = np.diff(_raw(b, "starts", i, "<i4"), append=len(b.column("at")[i].as_buffer()) // 4)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b.column("block")[i].as_py())), pa.array(own), pa.array(k), pa.array(own)], names=["block", "v", "k", "comm"])

    with tidy(spark):
        e = stored(edges.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), "graph")
        count = e.count()
        m2 = 2 * count or 1
        graph = vertex_blocks(e.union(e.select("dst", "src")), block_edges, 2 * count)
        last = Rounds(spark, "communities")
        now = last.keep(graph.select("block", "own", "starts", "at").mapInArrow(begun, "block long, v long, k long, comm long"))
        for i in range(rounds):
            totals = now.groupBy("comm").agg(F.sum("k").alias("total"))
            turn = F.pmod(F.xxhash64(F.col("v").cast(kind), F.lit(i // 2)), F.lit(2)) == i % 2
            told = now.join(totals, "comm").select("block", "v", "comm", "total", turn.alias("turn"))
            sent = graph.select("block", "to", "idx").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_told, TOLD)
            moved = graph.select("block", "own", "starts", "at").groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_block_moves(m2), "block long, v long, k long, comm long")
            now = last.keep(moved)
        graph.unpersist()
    return now.select(F.col("v").cast(kind).alias("v"), F.col("comm").cast(kind).alias("comm"))


def colours(edges: DataFrame) -> DataFrame:
    """(v, colour): colours from 0 such that no edge joins two vertices of one colour.

    In each round the vertices whose hash is larger than that of all neighbours
    without a colour take the smallest colour that no neighbour has. The result
    depends on the graph alone; rounds grow about with the logarithm of its size,
    and no vertex has a colour above its degree.
    """
    e = stored(symmetrize_both(edges), "graph")
    left = stored(e.select(F.col("src").alias("v")).distinct().withColumn("p", F.xxhash64("v")), "uncoloured")
    done = None
    while left.limit(1).count():
        near = e.join(left.select(F.col("v").alias("dst"), "p"), "dst").groupBy("src").agg(F.max(F.struct("p", "dst")).alias("top"))
        free = left.join(near, left["v"] == near["src"], "left").where(F.col("top").isNull() | (F.struct("p", F.col("v").alias("dst")) > F.col("top"))).select("v")
        used = e.join(free.select(F.col("v").alias("src")), "src")
        if done is None:
            chosen = free.withColumn("colour", F.lit(0))
        else:
            taken = used.join(done.select(F.col("v").alias("dst"), "colour"), "dst").groupBy("src").agg(F.collect_set("colour").alias("c"))
            lowest = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("c")), "c"))
            chosen = free.join(taken, free["v"] == taken["src"], "left").select("v", F.coalesce(lowest, F.lit(0)).alias("colour"))
        chosen = stored(chosen, "coloured")
        done = chosen if done is None else stored(done.union(chosen), "coloured")
        left = stored(left.join(chosen, "v", "left_anti"), "uncoloured")
    return edges.sparkSession.createDataFrame([], "v long, colour int") if done is None else done


def _lowest_colours(graph: _Graph, priority: np.ndarray) -> np.ndarray:
    """The colours of ``colours`` by place: vertices by falling hash, then id, take the smallest colour that no neighbour has."""
    found = [-1] * len(graph.ids)
    for i in np.lexsort((graph.ids, priority))[::-1].tolist():
        taken, c = {found[v] for v in graph.neighbours(i)}, 0
        while c in taken:
            c += 1
        found[i] = c
    return np.asarray(found, np.int64)


#: Edges of a component that one task moves by itself, in eight bytes each.
TASK_EDGES = 1 << 28


def moving_by_colours(edges: DataFrame, max_passes: int = 10, gain: str = "reference", coloured: DataFrame | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(v, comm): the moves of ``local_moving`` for large graphs, colour by colour.

    The vertices of a colour move together. None is a neighbour of another, so
    each sees its neighbours as in any serial order of them; totals of communities
    are those at the start of the colour. So a serial run that takes vertices in order
    of colour and totals once a colour gives the same communities, and a run can be
    replayed. Moves and colours depend on nothing outside a connected component but the number
    of all edges, so a component of at most ``task_edges`` edges is coloured and moved by one
    task; in larger ones each colour of each pass is one job, and passes end when none moves.
    """
    with tidy(edges.sparkSession):
        simple = stored(edges.where("src <> dst").select("src", "dst"), "graph")
        count = simple.count()
        m2 = 2 * count or 1
        roots = stored(connected_components(forest(simple)), "roots")
        if coloured is None:
            vertices = roots.withColumn("tag", F.xxhash64(F.col("node").cast(dict(simple.dtypes)["src"])))
        else:
            vertices = roots.join(coloured.select(F.col("v").alias("node"), F.col("colour").alias("tag")), "node")
        given = coloured is not None

        def move(graph, tags):
            of = tags if given else _lowest_colours(graph, tags)
            order = np.argsort(of, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
            return _moves(graph, max_passes, gain, [], [g.tolist() for g in groups], m2)

        small, wide = simple, None
        if count > task_edges:
            each = simple.join(roots.withColumnRenamed("node", "src"), "src")
            large = stored(each.groupBy("root").count().where(F.col("count") > task_edges).select("root"), "large")
            small, wide = (each.join(large, "root", how).select("src", "dst") for how in ("left_anti", "left_semi"))
            small, vertices = stored(small, "small"), vertices.join(large, "root", "left_anti")
        found = _by_component(small, stored(vertices, "vertices"), move)
    return found if wide is None or not wide.limit(1).count() else found.union(_moving_jobs(wide, max_passes, gain, coloured, m2))


def _moving_jobs(edges: DataFrame, max_passes: int, gain: str, coloured: DataFrame | None, m2: int) -> DataFrame:
    """(v, comm) by a job for each colour of each pass."""
    edges = stored(edges, "graph")
    e = stored(edges.union(edges.select("dst", "src")), "graph")
    coloured = stored(colours(edges) if coloured is None else coloured, "colours")
    degrees = e.groupBy("src").agg(F.count("*").alias("k"))
    now = stored(degrees.select(F.col("src").alias("v"), "k", F.col("src").alias("comm")).join(coloured, "v"), "communities")
    numbers = sorted(r["colour"] for r in now.select("colour").distinct().collect())  # no more than the largest degree and one
    for _ in range(max_passes):
        moved = 0
        for colour in numbers:
            totals = now.groupBy("comm").agg(F.sum("k").alias("total"))
            mine = now.where(F.col("colour") == colour).select(F.col("v").alias("src"), "k", F.col("comm").alias("here"))
            there = now.select(F.col("v").alias("dst"), F.col("comm").alias("there"))
            links = e.join(mine, "src").join(there, "dst").groupBy("src", "k", "here", "there").agg(F.count("*").alias("inside"), F.min("dst").alias("first"))
            stay = links.where("there = here").select(F.col("src").alias("s"), F.col("inside").alias("stay"))
            rest = totals.select(F.col("comm").alias("here"), F.col("total").alias("total_here"))
            offers = links.where("there <> here").join(totals.withColumnRenamed("comm", "there"), "there").join(rest, "here").join(stay, F.col("src") == F.col("s"), "left")
            won = F.col("inside") * m2 - F.col("k") * F.col("total") + F.col("k") * (F.col("total_here") - F.col("k"))
            if gain == "standard":
                won = won - F.coalesce("stay", F.lit(0)) * m2
            best = offers.withColumn("won", won).where("won > 0").groupBy("src").agg(F.max_by("there", F.struct("won", -F.col("first"))).alias("to"))
            best = stored(best, "moves")
            n = best.count()
            if n:
                moved += n
                now = stored(now.join(best, now["v"] == best["src"], "left").select("v", "k", F.coalesce("to", "comm").alias("comm"), "colour"), "communities")
        if not moved:
            break
    return now.select("v", "comm")


def refine(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(v, comm): each community split into connected pieces, numbered from 0 by smallest member."""
    a = parts.select(F.col("v").alias("src"), F.col("comm").alias("ca"))
    b = parts.select(F.col("v").alias("dst"), F.col("comm").alias("cb"))
    inside = edges.select("src", "dst").join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst")
    found = connected_components(inside)
    rooted = parts.join(found, parts["v"] == found["node"], "left").select("v", F.coalesce("root", "v").alias("root"))
    numbers = dense_numbers(rooted.select("root").distinct(), "root")
    return rooted.join(numbers, "root").select("v", F.col("number").alias("comm"))


def dense_numbers(ids: DataFrame, column: str, block: int = 1 << 16) -> DataFrame:
    """(column, number): ids numbered from 0 in order, counted in blocks."""
    blocked = ids.withColumn("_block", F.floor(F.col(column) / block))
    sums = blocked.groupBy("_block").agg(F.count("*").alias("_n"))
    bases = sums.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(column)) - 1
    return blocked.withColumn("_place", place).join(bases, "_block").select(column, (F.col("_base") + F.col("_place")).alias("number"))


def members(parts: DataFrame) -> DataFrame:
    """(comm, members): the vertices of each community in order."""
    return parts.groupBy("comm").agg(F.sort_array(F.collect_list("v")).alias("members"))
