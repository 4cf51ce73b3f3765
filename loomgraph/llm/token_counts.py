"""Token counts without token ids per document.

1. The distinct pre-tokens of all texts, with their frequencies, are gathered
   batch by batch, then by a distributed count.
2. The tokenizer counts the pieces of each distinct pre-token once.
3. Per-document pre-token frequencies are joined to these counts and summed.
   The most frequent pre-tokens, a fixed number of bounded length, are joined by
   broadcast in the pass over the texts; all others are joined by a shuffle.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings
inside texts count one token each, as the library has it by default; each row
has its own count, so repeated or null doc_ids keep their rows; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.batches import bounded_batches, gathered
from loomgraph.plans.scratch import stored

#: Pre-tokens joined by broadcast, of ``LONGEST`` characters at most: some 30 MB on the driver and each worker, whatever the input.
HEAD = 1 << 18
LONGEST = 64
BATCH = 8 << 20


def _gather(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomgraph.llm.pretokens import PreTokens

        pre = PreTokens(path)
        for batch in gathered(batches, limit=BATCH):
            cut = pre.cut(batch.column(0))
            n = np.bincount(cut.index, minlength=len(cut.words))
            yield pa.RecordBatch.from_arrays([pa.array(cut.words, pa.string()), pa.array(n, pa.int64())], names=["pretoken", "n"])

    return run


def _count_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from loomgraph.llm.pretokens import Ids, PreTokens

        ids = Ids(PreTokens(path))
        for batch in batches:
            words = batch.column(0).to_numpy(zero_copy_only=False).tolist()
            found = ids.of(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(found[w]) // 4 for w in words], pa.int64())], names=["pretoken", "n", "pieces"])

    return run


ROWS = "row long, doc_id long, n_bytes long, sure long, pretoken string, freq long"


def _join_head(path: str, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomgraph.llm.pretokens import PreTokens

        pre, counts = PreTokens(path), head.value
        row = TaskContext.get().partitionId() << 40
        for batch in gathered(batches, limit=BATCH):
            n = batch.num_rows
            cut = pre.cut(batch.column(1))
            known = np.array([counts.get(w, -1) for w in cut.words], np.int64)
            each = known[cut.index]
            sure = np.diff(np.concatenate([[0], np.cumsum(np.maximum(each, 0))])[cut.bounds])
            rows = np.arange(row, row + n)
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield _rows(rows, batch.column(0), sizes, pa.array(sure), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()))
            # Pre-tokens outside the head, with their frequency in each document.
            rare = np.flatnonzero(each < 0)
            if len(rare):
                of = np.searchsorted(cut.bounds, rare, "right") - 1
                pairs, freq = np.unique(of.astype(np.int64) << 32 | cut.index[rare], return_counts=True)
                words = pa.array(cut.words, pa.string()).take(pa.array(pairs & 0xFFFFFFFF))
                for a in range(0, len(pairs), 50_000):
                    part = slice(a, a + 50_000)
                    none = pa.nulls(len(pairs[part]), pa.int64())
                    yield _rows(row + (pairs[part] >> 32), none, none, none, words[part], pa.array(freq[part], pa.int64()))
            row += n

    return run


def _rows(rows: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *columns], names=["row", "doc_id", "n_bytes", "sure", "pretoken", "freq"])


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select("text")
    distinct = texts.mapInArrow(_gather(path), "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    pieces = stored(distinct.mapInArrow(_count_pieces(path), "pretoken string, n long, pieces long"), "pieces")
    # Classes of frequency, from the highest down, as long as all their pre-tokens fit into the head.
    level = F.floor(F.log2("n") * 8).cast("int")
    short = pieces.where(F.length("pretoken") <= LONGEST)
    room, lowest = head, None
    for r in sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        lowest = r["level"]
    top = [] if lowest is None else short.where(level >= lowest).select("pretoken", "pieces").collect()
    shared = spark.sparkContext.broadcast({r["pretoken"]: r["pieces"] for r in top})
    made = docs.select("doc_id", "text").mapInArrow(_join_head(path, shared), ROWS)
    made = stored(made, "token-counts")
    tail = made.where("pretoken is not null").select("row", "pretoken", "freq").join(pieces.select("pretoken", "pieces"), "pretoken")
    summed = tail.groupBy("row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("rest"))
    n = F.col("sure") + F.coalesce("rest", F.lit(0))
    return made.where("sure is not null").join(summed, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
