"""Vectorised views of a batch of texts: bytes, words, lines and their hashes.

All helpers work on one concatenated ``uint8`` buffer plus document offsets, so
a batch costs a fixed number of numpy passes however many documents it holds.
Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Space and the ASCII control characters 9 to 13 separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_KEY = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_STEP = U64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (wrapping arithmetic)."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; ``offsets`` has one more entry than rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    buf = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return buf, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 4 << 20):
    """Row ranges whose texts hold about ``limit`` bytes (a longer single text stands alone)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per document the index of its first word (n + 1 entries)."""
    if not len(buf):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    w = is_word[buf]
    edge = np.empty(len(buf) + 1, dtype=bool)
    edge[0], edge[-1] = w[0], w[-1]
    np.not_equal(w[1:], w[:-1], out=edge[1:-1])
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(buf))])
    split = inner[w[inner] & w[inner - 1]]  # two words that meet where one document ends
    flips = np.flatnonzero(edge)
    if len(split):
        flips = np.sort(np.concatenate([flips, split, split]))
    starts, ends = flips[0::2], flips[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are disjoint and in order."""
    if not len(starts):
        return np.empty(0, U64)
    size = ends - starts
    longest = int(size.max())
    powers = np.cumprod(np.full(longest, _STEP, U64), dtype=U64)
    first = np.cumsum(size) - size
    inside = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    if int(size.sum()) == len(buf):
        data = buf
    else:
        data = buf[inside + np.repeat(starts, size)]
    if lower:
        data = _LOWER[data]
    values = _BYTE_KEY[data] * powers[inside]
    sums = np.add.reduceat(values, first) if size.min() > 0 else _reduce_with_empty(values, first, size)
    return mix64(sums + size.astype(U64))


def _reduce_with_empty(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(size), U64)
    some = size > 0
    if some.any():
        out[some] = np.add.reduceat(values, first[some])
    return out


def shingles(words: np.ndarray, bounds: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and the first index per document; shorter documents give one hash of all their words."""
    n_words = np.diff(bounds)
    n_out = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(n_words.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(n_out)])
    if not len(words):
        return np.empty(0, U64), out_bounds
    long = n_words >= k
    acc = np.zeros(len(words), U64)
    for j in range(k):
        acc[: len(words) - j] = mix64(acc[: len(words) - j] * U64(0xD1342543DE82EF95) + words[j:])
    keep = np.ones(len(words), bool)
    ends = bounds[1:]
    for j in range(1, k):
        tail = ends - j
        keep[tail[(tail >= bounds[:-1]) & (n_words > 0)]] = False
    short = np.flatnonzero((n_words > 0) & ~long)
    keep[bounds[:-1][short]] = True
    for d in short:
        h = U64(0)
        with np.errstate(over="ignore"):
            for x in words[bounds[d] : bounds[d + 1]]:
                h = mix64(np.array([h * U64(0xD1342543DE82EF95) + x], U64))[0]
            acc[bounds[d]] = mix64(np.array([h ^ U64(n_words[d])], U64))[0]
    return acc[keep], out_bounds


def distinct_per_doc(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, and their bounds."""
    out, counts = [], np.zeros(len(bounds) - 1, np.int64)
    for d in range(len(bounds) - 1):
        part = np.sort(values[bounds[d] : bounds[d + 1]])
        if len(part) > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        out.append(part)
        counts[d] = len(part)
    joined = np.concatenate(out) if out else np.empty(0, values.dtype)
    return joined, np.concatenate([[0], np.cumsum(counts)])
