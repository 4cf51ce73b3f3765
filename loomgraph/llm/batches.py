"""Shared parts of the operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import SparkSession

@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not every C library has it
        return lambda _: 0


def give_back() -> None:
    """Return what a worker has freed to the system: idle workers stay, next to the others of their executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


#: Bytes of text that a Python worker turns over at once; a longer single text stands alone.
BATCH_BYTES = 8 << 20
#: Rows of one Arrow batch. Texts differ in length, so bytes are bounded by ``sliced`` as well.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Ask Spark for small Arrow batches, so that very long texts do not pile up in one."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``limit`` bytes."""
    from loomgraph.llm.bytetext import chunks, text_buffer

    for batch in batches:
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        for a, b in chunks(offsets, limit):
            yield batch.slice(a, b - a)
    give_back()


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``limit`` bytes, small ones put together."""
    held, size = [], 0
    for batch in sliced(batches, column, limit):
        more = batch.column(batch.schema.get_field_index(column)).nbytes
        if held and size + more > limit:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


class Recent:
    """A cache in two generations: what is not asked for while a generation fills is forgotten.

    It holds at most ``2 * most`` entries; keys longer than ``LONGEST`` characters
    are never kept, so its bytes are bounded as well.
    """

    LONGEST = 64

    def __init__(self, most: int):
        self.most = most
        self.now: dict = {}
        self.before: dict = {}

    def all_of(self, keys: list, make) -> list:
        """The values of distinct ``keys``; ``make`` gives those of a list of unknown keys as a dict."""
        if len(self.now) >= self.most:
            self.before, self.now = self.now, {}
        now, before = self.now, self.before
        found = list(map(now.get, keys))
        fresh = []
        for j, x in enumerate(found):
            if x is None:
                key = keys[j]
                x = found[j] = before.get(key)
                if x is None:
                    fresh.append(j)
                elif len(now) < self.most:
                    now[key] = x
        if fresh:
            made = make([keys[j] for j in fresh])
            for j in fresh:
                key = keys[j]
                x = found[j] = made[key]
                if len(key) <= self.LONGEST and len(now) < self.most:
                    now[key] = x
        return found
