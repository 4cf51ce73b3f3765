"""Exact top-k search by integer inner product, with a KD-tree for each shard.

Rows are dealt evenly to shards of bounded size. Each shard is one KD-tree:
median splits along the widest side, with the tight bounding box and the
smallest id of every node. Queries go in blocks of bounded size, each first to
one shard, then with the k-th scores found there to all others. Some blocks
of queries meet a shard's tree in one task, which opens it once. In a shard,
nodes are taken best first by the largest inner product that their box allows;
a node is left out for every query whose k-th score its bound cannot reach.

Memory of a task: one shard and one set of blocks, both bounded by rows and by
bytes at eight bytes a component, and their results.

Defined results: vectors that are null, or hold a null or non-finite component,
and rows without vec_id take no part; vectors of unequal lengths are padded with
zeros; repeated rows are separate candidates and separate queries, and only the
query's own row is left out; scores beyond 64 bits are cut off there; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.scratch import stored

SHARD_ROWS = 1 << 16
BLOCK_ROWS = 512
LEAF_ROWS = 256
#: Bytes of a shard's vectors, and of the queries that meet it in one task.
SHARD_BYTES = 64 << 20
SET_BYTES = 32 << 20
SCALE = 256


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Integer lists as a matrix of the smallest fitting type, padded with zeros."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    values = lists.flatten().to_numpy()
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        m = values.reshape(len(sizes), width)
    else:
        m = np.zeros((len(sizes), width), np.int64)
        m[np.arange(width)[None] < sizes[:, None]] = values
    most = max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    return m.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def build_tree(ids: np.ndarray, rows: np.ndarray, v: np.ndarray, leaf: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """A KD-tree: rows in leaf order and, for each node, its range, children, box and smallest id."""
    order = np.arange(len(v))
    begin, end, split, low, high, least = [], [], [], [], [], []
    todo = [(0, len(v))]
    while todo:
        a, b = todo.pop()
        own = order[a:b]
        lo, hi = v[own].min(0), v[own].max(0)
        begin.append(a)
        end.append(b)
        low.append(lo)
        high.append(hi)
        least.append(ids[own].min())
        split.append(b - a > leaf and v.shape[1] > 0)
        if split[-1]:
            m = (b - a) // 2
            side = int(np.argmax(hi.astype(np.float64) - lo))
            if hi[side] > lo[side]:
                order[a:b] = own[np.argpartition(v[own, side], m, kind="introselect")]
            else:  # equal rows: by id, so that small ids stand together
                order[a:b] = own[np.argsort(ids[own], kind="stable")]
            todo += [(a + m, b), (a, a + m)]  # the first half comes next: nodes are in pre-order
    at = {(a, b): i for i, (a, b) in enumerate(zip(begin, end, strict=True))}
    first = np.array([i + 1 if s else -1 for i, s in enumerate(split)])
    second = np.array([at[(end[i + 1], end[i])] if s else -1 for i, s in enumerate(split)])
    boxes = {"begin": begin, "end": end, "low": low, "high": high, "least": least}
    return {k: np.array(x) for k, x in boxes.items()} | {"first": first, "second": second, "ids": ids[order], "rows": rows[order], "v": v[order]}


def _products(q: np.ndarray, v: np.ndarray):
    """A function for exact inner products of these value ranges: in doubles where they are exact, else in integers."""
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    bound = most(q) * most(v) * max(1, q.shape[1])
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
    return kind, lambda a, b: a.astype(kind) @ b.astype(kind).T


def search(tree: dict[str, np.ndarray], q: np.ndarray, q_rows: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray):
    """The best k of a shard for each query, as far as they may beat the k-th (score, id) known so far: query, score, id."""
    v = tree["v"]
    width = max(v.shape[1], q.shape[1])
    pad = lambda x: x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
    v, q, low, high = pad(v), pad(q), pad(tree["low"]), pad(tree["high"])
    kind, dot = _products(q, v)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    if kind is object:
        kth = np.array([int(x) for x in kth], object)
    else:  # no score of this kind is as low as -2**62
        kth = np.maximum(kth, -(2.0**62)).astype(kind)
    kth_id = kth_id.copy()
    least = tree["least"]
    best_q, best_s, best_i = np.empty(0, np.int64), np.empty(0, kind), np.empty(0, np.int64)

    def open_queries(node: int) -> tuple[np.ndarray, object]:
        bound = dot(plus, high[node : node + 1])[:, 0] + dot(minus, low[node : node + 1])[:, 0]
        may = (bound > kth) | ((bound == kth) & (least[node] < kth_id))
        return np.flatnonzero(may), bound[may].max() if may.any() else None

    heap = []

    def push(node: int) -> None:
        _, top = open_queries(node)
        if top is not None:
            heapq.heappush(heap, (-top, int(least[node]), node))

    push(0)
    while heap:
        _, _, node = heapq.heappop(heap)
        if tree["first"][node] >= 0:
            push(int(tree["first"][node]))
            push(int(tree["second"][node]))
            continue
        active, _ = open_queries(node)  # k-th scores may have risen since
        if not len(active):
            continue
        a, b = int(tree["begin"][node]), int(tree["end"][node])
        s = dot(q[active], v[a:b])
        ids = tree["ids"][a:b]
        take = (s > kth[active][:, None]) | ((s == kth[active][:, None]) & (ids[None] < kth_id[active][:, None]))
        take &= tree["rows"][a:b][None] != q_rows[active][:, None]
        at_q, at_v = np.nonzero(take)
        if not len(at_q):
            continue
        changed = np.unique(active[at_q])
        old = np.isin(best_q, changed)
        cq = np.concatenate([best_q[old], active[at_q]])
        cs = np.concatenate([best_s[old], s[at_q, at_v]])
        ci = np.concatenate([best_i[old], ids[at_v]])
        order = np.lexsort((ci, -cs, cq)) if kind is not object else np.array(sorted(range(len(cq)), key=lambda j: (cq[j], -cs[j], ci[j])))
        cq, cs, ci = cq[order], cs[order], ci[order]
        starts = np.flatnonzero(np.concatenate([[True], cq[1:] != cq[:-1]]))
        place = np.arange(len(cq)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(cq)]])))
        keep = place < k
        full = place == k - 1
        kth[cq[full]], kth_id[cq[full]] = cs[full], ci[full]
        best_q, best_s, best_i = (np.concatenate([x[~old], y[keep]]) for x, y in ((best_q, cq), (best_s, cs), (best_i, ci)))
    return best_q, best_s, best_i, kth, kth_id


def _build(table: pa.Table) -> pa.Table:
    tree = build_tree(table.column("vec_id").to_numpy(), table.column("row").to_numpy(), _matrix(table.column("v")))
    return pa.table({"shard": table.column("shard").slice(0, 1), "tree": pa.array([_pack(**tree)], pa.binary())})


def _block(table: pa.Table) -> pa.Table:
    made = _pack(ids=table.column("vec_id").to_numpy(), rows=table.column("row").to_numpy(), q=_matrix(table.column("v")))
    return pa.table({"block": table.column("block").slice(0, 1), "queries": pa.array([made], pa.binary())})


RESULT = "query_row long, query_id long, vec_id long, score long, block long, shard long, kth binary"
_SCHEMA = pa.schema([(c, pa.int64()) for c in ("query_row", "query_id", "vec_id", "score", "block", "shard")] + [("kth", pa.binary())])
_EMPTY = _SCHEMA.empty_table()
_NONE = -(2.0**200)


def _run(k: int):
    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        """Blocks (block, shard, queries, kth or null) and their shard's tree: result rows, and for each block one row with the k-th scores reached."""
        if not shard.num_rows or not asked.num_rows:
            return _EMPTY
        tree, big, out = _unpack(shard.column("tree")[0].as_py()), np.iinfo(np.int64), []
        for row in range(asked.num_rows):
            block, number, queries, known = (asked.column(c)[row].as_py() for c in ("block", "shard", "queries", "kth"))
            q = _unpack(queries)
            m = len(q["ids"])
            kth, kth_id = np.full(m, _NONE), np.full(m, big.max)
            if known is not None:
                before = _unpack(known)
                kth, kth_id = before["kth"], before["kth_id"]
            qs, s, ids, kth, kth_id = search(tree, q["q"], q["rows"], k, kth, kth_id)
            s = np.array([min(max(int(x), big.min), big.max) for x in s], np.int64)
            state = _pack(kth=kth.astype(np.float64), kth_id=kth_id) if kth.dtype == np.float64 else None  # exact as doubles
            n = len(qs)
            put = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(1, kind)])
            found = [put(x, pa.int64()) for x in (q["rows"][qs], q["ids"][qs], ids, s)]
            out.append(pa.Table.from_arrays([*found, pa.array([block] * (n + 1), pa.int64()), pa.array([number] * (n + 1), pa.int64()), pa.array([None] * n + [state], pa.binary())], schema=_SCHEMA))
        return pa.concat_tables(out).combine_chunks()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows for each row that ``is_query`` marks.

    ``vectors`` has vec_id and embedding; each component x counts as floor(256 x).
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select("vec_id", is_query.alias("asks"), whole.alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "vectors")
    count = F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0))
    size = rows.agg(F.count("*").alias("n"), count.alias("asks"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    wide = 8 * max(1, size["width"])
    shard_rows, block_rows = max(1, min(SHARD_ROWS, SHARD_BYTES // wide)), max(1, min(BLOCK_ROWS, SET_BYTES // wide))
    n_shards, n_blocks = -(-size["n"] // shard_rows) or 1, -(-size["asks"] // block_rows) or 1
    in_set = max(1, SET_BYTES // (wide * block_rows))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    shards = rows.withColumn("shard", deal(n_shards)).groupBy("shard").applyInArrow(_build, "shard long, tree binary")
    shards = stored(shards, "shards")
    blocks = stored(rows.where("asks").withColumn("block", deal(n_blocks)).groupBy("block").applyInArrow(_block, "block long, queries binary"), "query-blocks")

    def ask(asked: DataFrame) -> DataFrame:
        asked = asked.select("block", "shard", "queries", "kth", F.floor(F.col("block") / in_set).alias("set"))
        keys = asked.select(F.col("shard").alias("met"), F.col("set").alias("by")).distinct()
        met = shards.join(keys, F.col("shard") == F.col("met")).select("met", "by", "tree")
        return asked.groupBy("shard", "set").cogroup(met.groupBy("met", "by")).applyInArrow(_run(k), RESULT)

    home = F.pmod("block", F.lit(n_shards))
    first = stored(ask(blocks.select("block", "queries", home.alias("shard"), F.lit(None).cast("binary").alias("kth"))), "first-shards")
    known = first.where("query_row is null").select(F.col("block").alias("own"), "kth")
    told = blocks.join(known, F.col("block") == F.col("own")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    rest = ask(told.where(F.col("shard") != home).select("block", "queries", "shard", "kth"))
    found = first.union(rest).where("query_row is not null")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
