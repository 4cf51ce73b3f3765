"""Edges on their way to blocks of ids: packed pieces of some thousand edges instead of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Edges that are put into pieces for their blocks at once.
PIECE_EDGES = 1 << 19


def short(ids: np.ndarray) -> tuple[int, bytes]:
    """Ids as the least of them and how far each lies above it, in 32 bits if these hold it."""
    low = int(ids.min())
    return low, (ids - low).astype("<u4" if int(ids.max()) - low < 1 << 32 else "<i8").tobytes()


def long(low: int, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u4" if len(data) == 4 * n else "<i8").astype(np.int64) + low


def pieces(bounds: np.ndarray, both: bool = False):
    """Edges, or both directions of each, as pieces (block, n, src, dst) by the range of their end, so that no row stands for an edge on its way to its block."""

    def piled(batches):
        held, n = [], 0
        for b in batches:
            ends = b.column("src").to_numpy(), b.column("dst").to_numpy()
            for way in (ends, ends[::-1]) if both else (ends,):
                held.append(way)
                n += b.num_rows
            if n >= PIECE_EDGES:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    def run(batches):
        for src, dst in piled(batches):
            of = np.searchsorted(bounds, dst)
            order = np.argsort(of, kind="stable")
            blocks, starts = np.unique(of[order], return_index=True)
            rows = [(int(block), len(a), *short(a), *short(b)) for block, a, b in zip(blocks, np.split(src[order], starts[1:]), np.split(dst[order], starts[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["block", "n", "src_low", "src", "dst_low", "dst"])

    return run


PIECE = "block long, n long, src_low long, src binary, dst_low long, dst binary"


def edges_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sources and ends of a block's pieces."""
    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    return tuple(np.concatenate([long(low, data, n) for low, data, n in zip(columns[f"{c}_low"], columns[c], columns["n"], strict=True)]) for c in ("src", "dst"))
