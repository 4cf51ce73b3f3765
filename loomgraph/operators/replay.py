"""Atomics replayed in order, as a table function over partitions of an address."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf


@arrow_udtf(returnType="addr long, t long, op string, val long, old long, new long")
class ReplayAtomics:
    """What each atomic finds and leaves. Rows of one address come together and in order, a batch at a time; the state is the word at that address."""

    def __init__(self):
        self.word: int | None = None

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        start = rows["start"].to_pylist()
        word = start[0] if self.word is None and start else self.word
        words = []
        for op, val, first in zip(rows["op"].to_pylist(), rows["val"].to_pylist(), start, strict=True):
            if op == "add":
                word = (word + val + (1 << 63)) % (1 << 64) - (1 << 63)
            elif op == "or":
                word |= val
            elif op == "max":
                word = max(word, val)
            elif op == "swap" or word == first:  # cas: the value goes in where the word is still as at the start
                word = val
            words.append(word)
        if words:
            old = [start[0] if self.word is None else self.word, *words[:-1]]
            self.word = word
            yield pa.table([*(rows[c] for c in ("addr", "t", "op", "val")), pa.array(old, pa.int64()), pa.array(words, pa.int64())], names=["addr", "t", "op", "val", "old", "new"])


def replay(ops: DataFrame, start: int = 0) -> DataFrame:
    """(addr, t, op, val, old, new) of atomics (addr, op, val, t) in order of t, then of op and val: add, or, max, swap and cas.

    Additions wrap at 64 bits. Each address starts with ``start``; cas succeeds where
    the word is ``start``. Other operations count as cas; null values are refused.
    An address is replayed by one task, for each step needs the one before; it
    holds one Arrow batch and the word.
    """
    spark = ops.sparkSession
    spark.udtf.register("replay_atomics", ReplayAtomics)
    given = ops.select(F.col("addr").cast("long").alias("addr"), F.col("t").cast("long").alias("t"), F.col("op").cast("string").alias("op"), F.col("val").cast("long").alias("val"), F.lit(start).cast("long").alias("start"))
    return spark.sql("SELECT * FROM replay_atomics(TABLE(SELECT * FROM {ops}) PARTITION BY addr ORDER BY (t, op, val))", ops=given)
