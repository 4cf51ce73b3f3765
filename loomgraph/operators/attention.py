"""Attention by tiles of queries and keys, with a running maximum and sum.

Inputs are in long form: q (i, d, v), k (j, d, v) and v (j, d, v), with d from 0 to
``dim - 1``; columns named in ``by``, such as a sequence and a head, are computed
apart. Rows are packed into blocks of ``block`` ids, as matrices. Blocks of queries
meet blocks of keys in a grid of tasks (see ``theta``), so the shuffle carries
blocks and no row stands for a pair of positions. A task holds one tile and, for
the block of queries at hand, its running maximum, sum and output; these partial
states of a query, one for each task that saw its block, are merged by a rule that
does not depend on their order.

Missing coordinates are 0; a query without keys (``causal`` keeps keys j <= i) has no
output row; an empty table gives an empty result; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.intmath import exp_q16_array, i32_array, inv_sqrt_q16
from loomgraph.operators.theta import COLUMN, ROW, tile_counts, tiled
from loomgraph.plans.scratch import stored

BLOCK = 1024
#: Blocks of queries whose gradients a task holds, half a megabyte each at 64 dimensions; with more it writes them between two blocks of keys.
QUERY_BLOCKS = 256
#: Bytes of one Arrow batch of tiles.
BATCH_BYTES = 8 << 20


def _pack(dim: int, by: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = batch.column(len(by) + 1)
            size = entries.value_lengths().to_numpy()
            flat = entries.flatten()
            ids, ds, vs = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            ends = np.cumsum(size)
            id_lists, matrices = [], []
            for a, b in zip(ends - size, ends, strict=True):
                own, row = np.unique(ids[a:b], return_inverse=True)
                m = np.zeros((len(own), dim), vs.dtype)
                m[row, ds[a:b]] = vs[a:b]
                id_lists.append(own)
                matrices.append(m.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by) + 1], pa.array(id_lists, pa.list_(pa.int64())), pa.array(matrices, pa.binary())], names=[*batch.schema.names[: len(by) + 1], "ids", "m"])

    return run


def blocks(rows: DataFrame, id_column: str, dim: int, block: int = BLOCK, by: tuple[str, ...] = (), kind: str = "double") -> DataFrame:
    """(by, block, ids, m) of long-form rows (by, id, d, v): the matrix of each block of ids as bytes; ``kind`` is double or long."""
    _small_batches(rows)
    of = F.floor(F.col(id_column) / block).cast("long")
    entry = F.struct(F.col(id_column).cast("long"), F.col("d").cast("long"), F.col("v").cast(kind))
    grouped = rows.where(F.col(id_column).isNotNull()).groupBy(*by, of.alias("block")).agg(F.collect_list(entry).alias("entries"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.select(*by).dtypes), "block long, ids array<long>, m binary"])
    return grouped.mapInArrow(_pack(dim, by), schema)


def _small_batches(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _prefixed(df: DataFrame, prefix: str, by: tuple[str, ...]) -> DataFrame:
    return df.select(*by, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in by])


def tiles(outer: DataFrame, inner: DataFrame, condition: Column | None, by: tuple[str, ...]) -> DataFrame:
    """All tiles of outer and inner blocks that meet ``condition``, dealt over a grid of tasks; one block of ``outer`` after another in each."""
    n = int(outer.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = tiled(outer, inner, *tile_counts(outer.count(), inner.count(), n))
    met = left.join(right, [*by, ROW, COLUMN])
    return (met if condition is None else met.where(condition)).drop(ROW, COLUMN)


def _by_block(kernel: Callable, out: Callable, matrices: dict[str, str], dim: int, by: tuple[str, ...]):
    """Run ``kernel(state, tile)`` over the tiles of a partition; a state ends with its outer block and is written by ``out(key, state)``.

    A tile holds the columns of a row, matrices among them of the given types.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                tile = {n: batch.column(c)[i] for c, n in enumerate(names)}
                for n, x in tile.items():
                    if n in matrices:
                        tile[n] = np.frombuffer(x.as_buffer(), matrices[n]).reshape(-1, dim)
                    elif pa.types.is_list(x.type):
                        tile[n] = x.values.to_numpy(zero_copy_only=False)
                    else:
                        tile[n] = x.as_py()
                now = (*(tile[c] for c in by), tile["o_block"])
                if now != key:
                    if state is not None:
                        yield out(key, state)
                    key, state = now, None
                state = kernel(state, tile)
        if state is not None:
            yield out(key, state)

    return run


def _write(schema: str, by: tuple[str, ...]):
    """How a state's rows, (ids, column, column, ...), are written."""
    names = [x.split()[0].strip("`") for x in schema.split(", ")]

    def out(key, ids: np.ndarray, *columns) -> pa.RecordBatch:
        made = [pa.array([k] * len(ids)) for k in key[: len(by)]] + [pa.array(ids, pa.int64())]
        for c in columns:
            made.append(pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), c.shape[1]).cast(pa.list_(pa.from_numpy_dtype(c.dtype))) if c.ndim == 2 else pa.array(c))
        return pa.RecordBatch.from_arrays(made, names=names)

    return out


def _schema(df: DataFrame, by: tuple[str, ...], rest: str) -> str:
    return ", ".join([*(f"`{n}` {t}" for n, t in df.select(*by).dtypes), rest])


#: Arrays of a tile's size that a task uses again for each tile, by name; fresh ones cost more than what is done with them.
_HELD: dict[str, np.ndarray] = {}


def _room(name: str, shape: tuple[int, ...], kind: type) -> np.ndarray:
    found = _HELD.get(name)
    if found is None or found.shape != shape or found.dtype != kind:
        found = _HELD[name] = np.empty(shape, kind)
    return found


def _products(a: np.ndarray, b: np.ndarray, name: str = "products") -> tuple[np.ndarray, int | None]:
    """``a @ b.T``, and a bound of its values if all are whole numbers that 32-bit floats hold exactly; good until the next one of that name."""
    if (a == np.rint(a)).all() and (b == np.rint(b)).all():
        bound = _bound(a, b)
        if bound < 1 << 24:
            return np.matmul(a.astype(np.float32), b.astype(np.float32).T, out=_room(f"{name}32", (len(a), len(b)), np.float32)), bound
    return np.matmul(a, b.T, out=_room(name, (len(a), len(b)), np.float64)), None


#: Whole products up to so many get their exponentials from a table.
TABLE = 1 << 15


def _exponentials(q: np.ndarray, k: np.ndarray, ids_q: np.ndarray, ids_k: np.ndarray, causal: bool) -> tuple[np.ndarray, np.ndarray]:
    """The largest score of each query in a tile (-inf without a key), and exp(score - largest), good until the next call."""
    s, bound = _products(q, k)
    root = q.shape[1] ** 0.5
    masked = causal and ids_k[-1] > ids_q[0]
    if bound is not None and bound <= TABLE and not masked:
        top = s.max(1)
        places = _room("places", s.shape, np.intp)
        np.copyto(places, np.subtract(top[:, None], s, out=s), casting="unsafe")
        return top.astype(np.float64) / root, np.exp(np.arange(2 * bound + 1) / -root).take(places, out=_room("exponentials", s.shape, np.float64), mode="clip")
    s = s.astype(np.float64) / root
    if masked:
        s = np.where(ids_k[None, :] <= ids_q[:, None], s, -np.inf)
    top = s.max(1)
    return top, np.exp(s - np.where(np.isfinite(top), top, 0.0)[:, None])


def _forward(dim: int, causal: bool):
    def kernel(state, tile):
        q, k, v = tile["o_m"], tile["i_m"], tile["i_v"]
        here, e = _exponentials(q, k, tile["o_ids"], tile["i_ids"], causal)
        if state is None:
            state = (tile["o_ids"], np.full(len(q), -np.inf), np.zeros(len(q)), np.zeros((len(q), dim)))
        ids, m, total, o = state
        top = np.maximum(m, here)
        safe = np.where(np.isfinite(top), top, 0.0)
        new, old = np.exp(here - safe), np.exp(m - safe)
        return ids, top, total * old + e.sum(1) * new, o * old[:, None] + e @ v * new[:, None]

    return kernel


def forward(q: DataFrame, k: DataFrame, v: DataFrame, dim: int, causal: bool = True, block: int = BLOCK, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, o, lse): the output of each query as an array, and the logarithm of its sum of exponentials."""
    outer = _prefixed(blocks(q, "i", dim, block, by), "o_", by)
    keys, values = (_prefixed(blocks(x, "j", dim, block, by), "i_", by) for x in (k, v))
    inner = keys.join(values.select(*by, "i_block", F.col("i_ids").alias("v_ids"), F.col("i_m").alias("i_v")), [*by, "i_block"]).where("i_ids = v_ids").drop("v_ids")
    met = tiles(stored(outer, "queries"), stored(inner, "keys"), F.col("i_block") <= F.col("o_block") if causal else None, by)
    write = _write(_schema(q, by, "i long, m double, l double, o array<double>"), by)
    run = _by_block(_forward(dim, causal), lambda key, s: write(key, *s), {"o_m": "<f8", "i_m": "<f8", "i_v": "<f8"}, dim, by)
    parts = met.mapInArrow(run, _schema(q, by, "i long, m double, l double, o array<double>")).where("l > 0")
    return merged(parts, [*by, "i"])


def merged(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, o, lse) of partial states (key, m, l, o), in whatever order they come."""
    grouped = parts.groupBy(*key).agg(F.max("m").alias("top"), F.collect_list(F.struct("m", "l", "o")).alias("p"))
    weighed = F.transform("p", lambda x: F.struct((x["l"] * F.exp(x["m"] - F.col("top"))).alias("l"), F.transform(x["o"], lambda y: y * F.exp(x["m"] - F.col("top"))).alias("o")))
    none = F.struct(F.lit(0.0).alias("l"), F.array_repeat(F.lit(0.0), F.size(F.col("p")[0]["o"])).alias("o"))
    add = lambda a, x: F.struct((a["l"] + x["l"]).alias("l"), F.zip_with(a["o"], x["o"], lambda y, z: y + z).alias("o"))
    whole = grouped.select(*key, "top", F.reduce(weighed, none, add).alias("w"))
    return whole.select(*key, F.transform("w.o", lambda y: y / F.col("w.l")).alias("o"), (F.col("top") + F.ln("w.l")).alias("lse"))


def outputs(found: DataFrame, id_column: str = "i", by: tuple[str, ...] = (), column: str = "o") -> DataFrame:
    """Arrays as rows (by, id, d, value)."""
    return found.select(*by, id_column, F.posexplode(column).alias("d", column)).withColumn("d", F.col("d").cast("long"))


def _tile_gradients(tile: dict, q: str, k: str, v: str, g: str, ids_q: str, ids_k: str, stats: str, dim: int, causal: bool):
    """Probabilities and gradients of the scores of one tile, from the sums that the forward pass left."""
    lse, inner = tile[stats][:, 0], tile[stats][:, 1]
    top, p = _exponentials(tile[q], tile[k], tile[ids_q], tile[ids_k], causal)
    p *= np.exp(top - lse)[:, None]
    product = _products(tile[g], tile[v], "gradients")[0]
    ds = np.subtract(product, inner[:, None], out=_room("ds", product.shape, np.float64))
    ds *= p
    ds /= dim**0.5
    return p, ds


def gradients(q: DataFrame, k: DataFrame, v: DataFrame, grad: DataFrame, dim: int, causal: bool = True, block: int = BLOCK, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gradients (by, id, d, g) of q, k and v for an output gradient (by, i, d, g).

    Probabilities are made again tile by tile, once: a pass over the tiles of each block of keys
    sums the gradients of keys and values, and those of queries for up to ``QUERY_BLOCKS`` of
    the blocks it meets, so each gradient is summed in its task first.
    """
    found = stored(forward(q, k, v, dim, causal, block, by), "attention")
    inner = outputs(found, by=by).join(grad, [*by, "i", "d"]).groupBy(*by, "i").agg(F.sum(F.col("o") * F.col("g")).alias("inner"))
    stats = found.select(*by, "i", "lse").join(inner, [*by, "i"], "left")
    stats = stats.select(*by, "i", F.posexplode(F.array("lse", F.coalesce("inner", F.lit(0.0)))).alias("d", "v"))
    # Queries without an output take no part: their block's matrices hold the ids of ``found`` only.
    own = found.select(*by, "i")
    packed = lambda x, name: blocks(x, name, dim, block, by)
    grads = own.join(grad.withColumnRenamed("g", "v"), [*by, "i"], "left").select(*by, "i", F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("v", F.lit(0.0)).alias("v"))
    qs = packed(q.join(own, [*by, "i"]), "i").select(*by, "block", "ids", F.col("m").alias("q"))
    gs = packed(grads, "i").select(*by, "block", F.col("m").alias("g"))
    st = blocks(stats, "i", 2, block, by).select(*by, "block", F.col("m").alias("stats"))
    queries = stored(qs.join(gs, [*by, "block"]).join(st, [*by, "block"]), "queries")
    ks, vs = packed(k, "j").withColumnRenamed("m", "k"), packed(v, "j").select(*by, "block", F.col("m").alias("v"))
    keys = stored(ks.join(vs, [*by, "block"]), "keys")
    schema = _schema(q, by, "id long, of int, x array<double>, y array<double>")
    write = _write(schema, by)
    kinds, most = {"o_k": "<f8", "o_v": "<f8", "i_q": "<f8", "i_g": "<f8"}, QUERY_BLOCKS

    def of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries_of = {}  # by block of queries: ids and the sum of their gradients

        def kernel(state, tile):
            tile["i_stats"] = np.frombuffer(tile["i_stats"], "<f8").reshape(-1, 2)
            p, ds = _tile_gradients(tile, "i_q", "o_k", "o_v", "i_g", "i_ids", "o_ids", "i_stats", dim, causal)
            key = (*(tile[c] for c in by), tile["i_block"])
            dq, dk, dv = ds @ tile["o_k"], ds.T @ tile["i_q"], p.T @ tile["i_g"]
            if key in queries_of:
                np.add(queries_of[key][1], dq, out=queries_of[key][1])
            else:
                queries_of[key] = tile["i_ids"], dq
            if state is None:
                return tile["o_ids"], dk, dv
            return state[0], np.add(state[1], dk, out=state[1]), np.add(state[2], dv, out=state[2])

        def of_queries():
            for key, (ids, dq) in queries_of.items():
                yield write(key, ids, np.zeros(len(ids), np.int32), dq, np.zeros((len(ids), 1)))
            queries_of.clear()

        for made in _by_block(kernel, lambda key, s: write(key, s[0], np.ones(len(s[0]), np.int32), s[1], s[2]), kinds, dim, by)(batches):
            yield made
            if len(queries_of) > most:
                yield from of_queries()
        yield from of_queries()

    def summed(of: int, column: str) -> DataFrame:
        each = parts.where(F.col("of") == of).select(*by, "id", F.posexplode(column).alias("d", "x")).groupBy(*by, "id", "d").agg(F.sum("x").alias("g"))
        return each.withColumn("d", F.col("d").cast("long"))

    met = tiles(_prefixed(keys, "o_", by), _prefixed(queries, "i_", by), F.col("o_block") <= F.col("i_block") if causal else None, by)
    parts = stored(met.mapInArrow(of_tiles, schema), "gradients")
    return summed(0, "x"), summed(1, "x"), summed(1, "y")


#: Ids of a block of the fixed-point form, about; a block is a whole number of tiles.
WIDE = 1024


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min()))


def _bound(a: np.ndarray, b: np.ndarray) -> int:
    """No partial sum of a product in ``a @ b.T`` is larger: the lengths of the longest rows."""
    square = np.prod([np.einsum("ij,ij->i", x, x).max() for x in (a.astype(np.float64), b.astype(np.float64))])
    return int(square**0.5 * (1 + 1e-9)) + 1 if square < 2.0**120 else 1 << 62


def _whole_products(a: np.ndarray, b: np.ndarray, least: int = 0) -> tuple[np.ndarray, int]:
    """``a @ b`` of whole numbers and a bound of its values; by floats that hold every partial sum and ``least`` exactly, else by 64-bit words."""
    bound = _bound(a, b.T)
    most = max(bound, least)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return a.astype(kind) @ b.astype(kind), bound


def _q16_kernels(dim: int, tile: int, wrap: bool, mode: str):
    """The three passes of ``attention_q16`` over a tile of blocks: largest scores, sums of exponentials and keys, outputs."""
    scale = inv_sqrt_q16(dim)
    # Where no score wraps, exponentials follow from how far a product lies below the largest one; from ``far`` on they are the same.
    far = -(-(8 if mode == "reference" else 13) * 65536 // max(scale, 1))
    steps = -np.arange(far + 1, dtype=np.int64) * scale
    series = lambda x: np.round(np.exp(x / 65536.0) * 65536).astype(np.int64) if mode == "exact" else exp_q16_array(x)
    table = series(steps)

    def scores(dots: np.ndarray, bound: int) -> np.ndarray:
        s = dots.astype(np.int64) * scale
        return i32_array(s) if wrap and bound * scale >= 1 << 31 else s

    def largest(state, t):
        dots, bound = _whole_products(t["o_m"], t["i_m"].T)
        s = scores(dots.max(1), bound) if bound * scale < 1 << 31 else scores(dots, bound).max(1)
        return t["o_ids"], s if state is None else np.maximum(state[1], s)

    def near(t):
        """(below, rows, columns): products and the keys that are near the largest product of a query; exponentials instead, if these are many or scores may wrap."""
        top = np.frombuffer(t["o_top"], "<i8")
        whole = scale > 0 and _largest(top) < 1 << 30 and not (top % scale).any()
        highest = top // scale if whole else None
        dots, bound = _whole_products(t["o_m"], t["i_m"].T, _largest(highest) + far if whole else 0)
        if not whole or bound * scale >= 1 << 30:
            x = scores(dots, bound) - top[:, None]
            return series(i32_array(x) if wrap and mode == "reference" else x), None, None
        close = dots > (highest - far).astype(dots.dtype)[:, None]
        if np.count_nonzero(close) * 32 > close.size:
            return table[np.minimum(highest[:, None] - dots.astype(np.int64), far)], None, None
        rows, columns = np.divmod(np.flatnonzero(close), close.shape[1])
        return table[highest[rows] - dots[rows, columns].astype(np.int64)], rows, columns

    def totals(state, t):
        e, rows, _ = near(t)
        size = len(t["o_ids"]), len(t["i_ids"])
        if rows is None:
            total = e.sum(1)
        else:
            total = np.full(size[0], table[far] * size[1])
            np.add.at(total, rows, e - table[far])
        n = np.full(size[0], size[1], np.int64)
        return (t["o_ids"], total, n) if state is None else (t["o_ids"], state[1] + total, state[2] + n)

    def applied(state, t):
        total, n = np.frombuffer(t["o_sums"], "<i8").reshape(-1, 2).T
        share = lambda e, total, n: np.where(total <= 0, 65536 // n, (e << 16) // np.maximum(total, 1))
        v, of = t["i_v"], t["i_ids"] // tile
        starts = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
        e, rows, columns = near(t)
        if rows is None:
            p = share(e, total[:, None], n[:, None])
            o = sum(_whole_products(p[:, a:b], v[a:b])[0].astype(np.int64) >> 16 for a, b in zip(starts, [*starts[1:], len(of)], strict=True))
        else:
            # Keys far below weigh the same for a query, so a tile of them gives one multiple of its sum; then come tiles with nearer keys.
            sums = np.add.reduceat(v, starts)
            rest = share(np.full(len(total), table[far]), total, n)
            kinds, which = np.unique(rest, return_inverse=True)
            o = np.stack([((k * sums) >> 16).sum(0) for k in kinds])[which]
            if len(rows):
                at = np.searchsorted(starts, columns, "right") - 1
                first = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
                more = np.add.reduceat((share(e, total[rows], n[rows]) - rest[rows])[:, None] * v[columns], first)
                base = rest[rows[first]][:, None] * sums[at[first]]
                np.add.at(o, rows[first], ((base + more) >> 16) - (base >> 16))
        return t["o_ids"], o if state is None else state[1] + o

    return largest, totals, applied


def attention_q16(q: DataFrame, k: DataFrame, v: DataFrame, dim: int, tile: int = 64, wrap: bool = True, mode: str = "reference") -> DataFrame:
    """(i, d, o): fixed-point attention of integer q (i, d, v), k (j, d, v), v (j, d, v), all in Q16.16 arithmetic.

    Integer divisions do not merge, so three passes run over the same tiles: the
    largest score of each query, the sum of its exponentials and its keys, and the
    outputs, shifted down once for each ``tile`` of keys. Blocks hold several tiles.
    Every pair of rows is multiplied; products are taken in floats where these are
    exact, and keys so far below a query's largest score that their exponentials are
    the same are added up together.
    """
    block = tile * max(1, WIDE // tile)
    outer = stored(_prefixed(blocks(q, "i", dim, block, (), "long"), "o_", ()), "queries")
    keys, values = (blocks(x, "j", dim, block, (), "long") for x in (k, v))
    inner = stored(_prefixed(keys.join(values.select("block", F.col("m").alias("v")), "block"), "i_", ()), "keys")
    largest, totals, applied = _q16_kernels(dim, tile, wrap, mode)

    def passed(side: DataFrame, kernel, schema: str, values: bool = False) -> DataFrame:
        write = _write(schema, ())
        run = _by_block(kernel, lambda key, s: write(key, *s), {"o_m": "<i8", "i_m": "<i8", "i_v": "<i8"}, dim, ())
        return tiles(side, inner if values else inner.drop("i_v"), None, ()).mapInArrow(run, schema)

    def with_rows(side: DataFrame, rows: DataFrame, columns: list[str], name: str) -> DataFrame:
        long = rows.select("i", F.posexplode(F.array(*columns)).alias("d", "v"))
        return stored(side.join(blocks(long, "i", len(columns), block, (), "long").select(F.col("block").alias("o_block"), F.col("m").alias(name)), "o_block"), "queries")

    top = passed(outer, largest, "i long, top long").groupBy("i").agg(F.max("top").alias("top"))
    outer = with_rows(outer, top, ["top"], "o_top")
    sums = passed(outer, totals, "i long, total long, n long").groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    outer = with_rows(outer, sums, ["total", "n"], "o_sums")
    found = passed(outer, applied, "i long, o array<long>", values=True)
    return found.select("i", F.posexplode("o").alias("d", "o")).groupBy("i", F.col("d").cast("long").alias("d")).agg(F.sum("o").alias("o"))


def split_heads(packed: DataFrame, heads: int, dim: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """q (b, h, i, d, v), k and v (b, h, j, d, v) of packed rows (b, n, c, v), where c runs over query, key and value, then heads, then d."""
    c = F.col("c")
    split = packed.select("b", F.floor(c / dim).cast("long").alias("hd"), "n", F.pmod(c, F.lit(dim)).alias("d"), "v")
    split = split.select("b", F.pmod("hd", F.lit(heads)).alias("h"), F.floor(F.col("hd") / heads).cast("long").alias("part"), "n", "d", "v")
    return tuple(split.where(F.col("part") == i).select("b", "h", F.col("n").alias("i" if i == 0 else "j"), "d", "v") for i in range(3))


def pack_gradients(dq: DataFrame, dk: DataFrame, dv: DataFrame, heads: int, dim: int) -> DataFrame:
    """(b, n, c, g) of gradients (b, h, id, d, g): the way back of ``split_heads``."""
    parts = [x.select("b", F.col("id").alias("n"), (F.lit(i * heads * dim) + F.col("h") * dim + F.col("d")).alias("c"), "g") for i, x in enumerate((dq, dk, dv))]
    return parts[0].union(parts[1]).union(parts[2])


def join_heads(out: DataFrame, dim: int) -> DataFrame:
    """(b, n, c, o) of outputs (b, h, i, d, o): heads side by side."""
    return out.select("b", F.col("i").alias("n"), (F.col("h") * dim + F.col("d")).alias("c"), "o")
