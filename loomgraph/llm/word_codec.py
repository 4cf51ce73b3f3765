"""Encoding and decoding of texts with a word-level BPE file (lower case, word ends marked).

A batch is cut into words by ``pretokens``; each distinct word of it is encoded
once by ``PrefixBpe``, or taken from the words that the worker has kept. The ids
and the decoded text of a document are then gathered by number. No token spans
white space or two words in such a file, so words do not depend on each other.

Memory of a worker: ``prefix_bpe``'s tables, ``2 * HELD`` kept words of 64
characters at most (some 25 MB, dropped at the end of a task), and some twenty
times a batch of ``BATCH`` bytes; a longer single text is a batch of its own.

Defined results: a null or empty text has no ids and decodes to the empty
string; special strings inside texts become their ids, as the library has it by
default; each row is coded on its own; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.batches import Recent, bounded_batches, gathered, give_back

#: Words in one generation of those that a task keeps.
HELD = 40_000
BATCH = 1 << 20


class WordCodec:
    def __init__(self, path: str):
        from loomgraph.llm.prefix_bpe import PrefixBpe
        from loomgraph.llm.pretokens import PreTokens

        self.pre = PreTokens(path)
        if not self.pre.words or self.pre.has_decoder:
            raise ValueError("only word-level BPE files without a decoder are supported")
        self.bpe = PrefixBpe(self.pre.model)
        self.pre.model = None  # its tables are the encoder's now
        self.special = self.pre.special
        self.strings = self.bpe.strings | {i: s for s, i in self.special.items()}
        every = range(max(self.strings) + 1)
        self.numbers = pa.array([f" {i}" for i in every], pa.large_string())
        self.tokens = pa.array([f" {self.strings.get(i, '')}" for i in every], pa.large_string())
        self.known = Recent(HELD)

    def _word(self, word: str) -> list[int]:
        from loomgraph.llm.prefix_bpe import visible

        if word in self.special:
            return [self.special[word]]
        return self.bpe.encode(visible(self.pre.bare(word)))

    def _make(self, words: list[str]) -> dict[str, bytes]:
        return {w: array("i", self._word(w)).tobytes() for w in words}

    def forget(self) -> None:
        """Drop what is kept of earlier texts: a worker may be idle for long, next to others."""
        self.known = Recent(HELD)
        self.bpe.forget()
        give_back()

    def encode(self, texts: pa.Array) -> pa.LargeListArray:
        """Ids of each text, as the library gives them without added special tokens."""
        cut = self.pre.cut(texts)
        ids, bounds = joined(self.known.all_of(cut.words, self._make), cut.index, cut.bounds)
        return pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their tokens joined by spaces, as the library gives it for a file without a decoder."""
        return " ".join([self.strings[i] for i in ids])

    def written(self, ids: pa.LargeListArray) -> tuple[list[memoryview], list[memoryview]]:
        """The ids and the tokens of each list, written out with a space between two."""
        index, bounds = ids.values, ids.offsets.to_numpy()
        return tuple(_spelled(table.take(index), bounds) for table in (self.numbers, self.tokens))


def joined(values: list[bytes], index: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit ids of the words that ``index`` names, one after another, and their bounds per text."""
    taken = pa.array(values, pa.large_binary()).take(pa.array(index))
    if not len(taken):
        return np.empty(0, np.int32), np.zeros(len(bounds), np.int64)
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int64, len(taken) + 1)
    return np.frombuffer(data, "<i4", int(ends[-1]) // 4), ends[bounds] // 4


def _spelled(taken: pa.Array, bounds: np.ndarray) -> list[memoryview]:
    if not len(taken):
        return [memoryview(b"")] * (len(bounds) - 1)
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int64, len(taken) + 1)[bounds].tolist()
    view = memoryview(data)
    return [view[a + 1 : b] if b > a else view[:0] for a, b in zip(at, at[1:], strict=False)]


#: A worker process runs many tasks; its codec outlives them.
_KNOWN: dict[str, WordCodec] = {}


def _codec(path: str) -> WordCodec:
    return _KNOWN[path] if path in _KNOWN else _KNOWN.setdefault(path, WordCodec(path))


def _code(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in gathered(batches, limit=BATCH):
            ids = codec.encode(batch.column(1))
            hashed = [pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()) for parts in codec.written(ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids.value_lengths(), *hashed], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            del ids, hashed
        codec.forget()

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each row's text; the count and SHA-256 of ids and decoded text."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_code(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in gathered(batches, limit=BATCH):
            yield pa.RecordBatch.from_arrays([batch.column(0), codec.encode(batch.column(1)).cast(pa.list_(pa.int32()))], names=["doc_id", "ids"])
        codec.forget()

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of each row's text."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_ids(path), "doc_id long, ids array<int>")


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of each row's ids."""
    bounded_batches(ids.sparkSession)
    return ids.select("doc_id", "ids").mapInArrow(_texts(path), "doc_id long, text string")
