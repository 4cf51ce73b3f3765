"""Token ids in ORC files, written in document order and read back.

Files hold one row per document in ascending doc_id order: integer run-length
encoded ids, the document's place in its file, a row index and a Bloom filter
on doc_id, so that readers skip stripes and row groups by metadata and work on
stripes in parallel.

Defined results: a null or empty text has the end id alone; null doc_ids come
first; rows with equal doc_ids are ordered by a hash of their texts, equal rows
are interchangeable and may fall into several files; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.batches import Recent, bounded_batches, gathered
from loomgraph.llm.word_codec import joined
from loomgraph.plans.scratch import new_path

SCHEMA = "doc_id long, part int, part_start long, n_ids int, ids array<int>"
#: Pre-tokens in one generation of those whose ids a worker keeps, 200 MB in both at most.
HELD = 300_000
BATCH = 8 << 20


class Encoder:
    """Encodes batches of texts by the library, each distinct pre-token of a batch once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from loomgraph.llm.pretokens import Ids, PreTokens

        self.pre = PreTokens(path)
        if self.pre.words:
            raise ValueError("only byte-level BPE files are supported")
        self.ids = Ids(self.pre)
        self.known = Recent(HELD)

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their bounds; ``end_id`` closes each text."""
        cut = self.pre.cut(texts)
        values = self.known.all_of(cut.words, self.ids.of)
        index, bounds = cut.index, cut.bounds
        if end_id is not None:
            index = np.insert(index, bounds[1:], len(values))
            values = [*values, np.array([end_id], "<i4").tobytes()]
            bounds = bounds + np.arange(len(bounds))
        return joined(values, index, bounds)


#: A worker process runs many tasks; its encoders outlive them.
_ENCODERS: dict[str, Encoder] = {}


def _encode(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS[path] if path in _ENCODERS else _ENCODERS.setdefault(path, Encoder(path))
        part, at = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, limit=BATCH):
            n = batch.num_rows
            values, bounds = encoder.encode(batch.column(1), end_id)
            ids = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(values)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(at + bounds[:-1]), pa.array(np.diff(bounds).astype(np.int32)), ids],
                names=["doc_id", "part", "part_start", "n_ids", "ids"],
            )
            at += int(bounds[-1])

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, partitions: int | None = None) -> None:
    """Write the ids of all texts to ORC files at ``path``, files and rows in doc_id order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    # Equal rows are dealt by their place, so that no file gets more than its share of them.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_place"))
    by = ("doc_id", "_tie", "_place")
    dealt = keyed.repartitionByRange(partitions, *by) if partitions else keyed.repartitionByRange(*by)
    ordered = dealt.sortWithinPartitions(*by).select("doc_id", "text")
    made = ordered.mapInArrow(_encode(tokenizer, end_id), SCHEMA)
    made.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "10000").orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids, from the files at ``path``."""
    files = spark.read.schema(SCHEMA).orc(path)
    # One row per file: its first id's place among all ids.
    sizes = files.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_ids")).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return files.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy()
        values = np.ascontiguousarray(lists.values.to_numpy().astype("<u4", copy=False))
        view = memoryview(values).cast("B")
        crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids of each document in the files."""
    bounded_batches(spark)
    return read_ids(spark, path).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """Write the ids of ``docs`` to a new folder of the shared one and digest what the files hold."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write_ids(docs, path, tokenizer, end_id)
    return digests(spark, path)
