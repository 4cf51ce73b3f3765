"""Alignment of two tokenizers' tokens by the bytes they cover.

A text with a space before it is cut into stretches where neither tokenizer has a
token that spans the cut: before a space or line break that follows a character
that is surely no white space. Stretches repeat, so each distinct stretch of a batch
is encoded and aligned once. One DuckDB in the task aligns them as interval tables:

1. the token of B under the first byte of each token of A, by an ASOF join, and the
   tokens of B that begin inside a token of A, by a range join: all overlaps;
2. groups, by a window sum over the starts that both have, the tokens of B by an
   ASOF join to the groups;
3. sums, digests and linked pairs of each document, by joins of its stretches.

A batch gives a row for each document, with its distinct pairs as arrays, and one
row with the documents of each pair. Spark adds these up, finds the highest count
of each id of A (no more rows than A has ids), and joins the counts back: the
``HEAD`` most frequent pairs by broadcast over the stored arrays, all others by a
shuffle.

Defined results: null and empty texts, and texts whose tokens do not give back
their bytes (those with U+2581), have zeros and an empty digest; special strings are
plain text; each row is a document of its own, whatever its doc_id; columns other
than ``doc_id`` and ``text`` are not read; an empty table gives an empty result.
Memory: some fifty times a batch of ``BATCH`` bytes; a longer text is a batch of its
own. A stretch is encoded whole: long ones by ``prefix_bpe`` for A, while the library
of B takes some 100 bytes for each byte of a stretch.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.batches import Recent, bounded_batches, gathered, give_back
from loomgraph.llm.bytetext import text_buffer
from loomgraph.plans.scratch import stored

BATCH = 3 << 20
#: Pairs joined by broadcast: 17 bytes each on the driver and each worker.
HEAD = 1 << 20
#: Pre-tokens of A and stretches for B, of 64 characters at most, in one generation of those that a worker keeps with their ids.
KEPT = 150_000
#: Stretches in one call of a tokenizer.
TOGETHER = 5_000
#: What one DuckDB holds before it writes to its task's temporary folder.
MEMORY = "512MB"
SPACE = "▁"

#: Statements over the tables a and b (k, s, e, id: stretch, bytes, token), sizes (k, n_a, n_b) and places (doc, pos, k).
ALIGN = (
    """
CREATE OR REPLACE TEMP TABLE links AS
  SELECT a.k, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.s >= b.s
  UNION ALL
  SELECT a.k, a.id, b.id FROM a JOIN (SELECT * FROM b ANTI JOIN a USING (s)) b ON b.s > a.s AND b.s < a.e""",
    """
CREATE OR REPLACE TEMP TABLE grouped AS
  WITH c AS (SELECT k, s, id, s IN (SELECT s FROM b) AS first FROM a),
  g AS (SELECT *, sum(first::INT) OVER (ORDER BY s) AS g FROM c),
  x AS (SELECT g, s FROM g WHERE first)
  SELECT k, g, 0 AS side, s, id, first FROM g UNION ALL SELECT b.k, x.g, 1, b.s, b.id, b.s = x.s FROM b ASOF JOIN x ON b.s >= x.s""",
    """
CREATE OR REPLACE TEMP TABLE pairs AS
  WITH p AS (SELECT k, a, b, count(*) AS n FROM links GROUP BY ALL)
  SELECT doc, a, b, sum(n)::INT AS n FROM places JOIN p USING (k) GROUP BY doc, a, b""",
)
#: Each token with the mark that goes before it: the texts of a stretch, one after another, are ``;a1,a2|b1;...``.
WRITTEN = "SELECT k, CASE WHEN NOT first THEN ',' WHEN side = 0 THEN ';' ELSE '|' END || id AS text FROM grouped ORDER BY g, side, s"
DOCS = """
WITH l AS (SELECT k, count(*) AS n_links FROM links GROUP BY k), g AS (SELECT k, count(*) AS n_groups FROM grouped WHERE first AND side = 0 GROUP BY k)
SELECT doc, sum(n_a)::BIGINT AS n_a, sum(n_b)::BIGINT AS n_b, sum(n_groups)::BIGINT AS n_groups, sum(n_links)::BIGINT AS n_links
FROM places JOIN sizes USING (k) JOIN l USING (k) JOIN g USING (k) GROUP BY doc ORDER BY doc"""
PAIRS = "SELECT doc, a, b, n FROM pairs ORDER BY doc"
COUNTS = "SELECT a, b, count(*)::INT AS n FROM pairs GROUP BY a, b"

OUT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, digest string, a array<int>, b array<int>, n array<int>"


class Tokenizers:
    """Both tokenizers of a worker, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        from loomgraph.llm.pretokens import Ids, PreTokens

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.pre = PreTokens(path_a, plain=True)
        if self.pre.words:
            raise ValueError("only byte-level BPE files are supported for A")
        self.of_a = Ids(self.pre)
        self.kept_a, self.kept_b = Recent(KEPT), Recent(KEPT)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        normal = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.space = self.b.piece_to_id(SPACE)
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in normal) or self.b.is_unknown(self.space):
            raise ValueError("pieces of B must not span a space or line break")
        of_byte = {c: b for b, c in enumerate(_byte_letters())}
        vocab = self.pre.tokenizer.get_vocab()
        raw = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            raw[i] = bytes(of_byte[c] for c in token) if all(c in of_byte for c in token) else token.encode()
        self.bytes_a = pa.array(raw, pa.large_binary())
        self.bytes_b = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)], pa.large_binary())

    def ids_a(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        cut = self.pre.cut(texts)
        known = pa.array(self.kept_a.all_of(cut.words, self.of_a.of), pa.large_binary())
        _, off, _ = known.buffers()
        counts = np.diff(np.frombuffer(off, np.int64, len(known) + 1))[cut.index] // 4
        data, _ = text_buffer(known.take(pa.array(cut.index)).view(pa.large_string()))
        return data.view("<i4"), np.diff(np.concatenate([[0], np.cumsum(counts)])[cut.bounds])

    def _new_b(self, texts: list[str]) -> dict[str, bytes]:
        made: dict[str, bytes] = {}
        for part in _parts(texts):
            found = self.b.encode([x[1:] if x[0] == " " else x for x in part], num_threads=1)
            for x, ids in zip(part, found, strict=True):
                ids = ([self.space] if x == " " else ids) if x[0] == " " else ids[1:]
                made[x] = np.array(ids, "<i4").tobytes()
        return made

    def ids_b(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for stretches; the library writes a space before a text, which stands for theirs."""
        found = self.kept_b.all_of(texts.to_pylist(), self._new_b)
        return np.frombuffer(b"".join(found), "<i4"), np.fromiter(map(len, found), np.int64, len(found)) // 4


def _parts(texts: list[str]) -> Iterator[list[str]]:
    for i in range(0, len(texts), TOGETHER):
        yield texts[i : i + TOGETHER]


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 characters for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


@lru_cache(1)
def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where stretches begin: at each text, and before a space or line break that follows a printable ASCII character or a letter of two bytes from U+00C0 on."""
    if not len(buf):
        return np.empty(0, np.int64)
    at = np.flatnonzero((buf[2:] == 0x20) | (buf[2:] == 0x0A)) + 2
    before, lead = buf[at - 1], buf[at - 2]
    at = at[((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF))]
    begins = np.zeros(len(buf), bool)
    begins[at] = True
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(begins)


def _same(pieces: pa.Array, ids: np.ndarray, counts: np.ndarray, buf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which stretches (``sizes`` bytes each of ``buf``) the bytes of their tokens (``counts`` each of ``ids``) give back."""
    _, off, _ = pieces.buffers()
    length = np.diff(np.frombuffer(off, np.int64, len(pieces) + 1))
    ends = np.concatenate([[0], np.cumsum(length[ids])])[np.cumsum(counts)]
    good = np.diff(ends, prepend=0) == sizes
    data, _ = text_buffer(pieces.take(pa.array(ids[np.repeat(good, counts)])).view(pa.large_string()))
    wrong = data != buf[np.repeat(good, sizes)]
    bounds = np.concatenate([[0], np.cumsum(np.where(good, sizes, 0))])
    return good & (np.diff(np.concatenate([[0], np.cumsum(wrong)])[bounds]) == 0)


def _intervals(pieces: pa.Array, ids: np.ndarray, of: np.ndarray) -> pa.Table:
    _, off, _ = pieces.buffers()
    ends = np.cumsum(np.diff(np.frombuffer(off, np.int64, len(pieces) + 1))[ids])
    return pa.table({"k": of, "s": np.concatenate([[0], ends[:-1]]), "e": ends, "id": ids.astype(np.int32)})


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tempfile

        import duckdb

        tools = _tokenizers(path_a, path_b)
        row = TaskContext.get().partitionId() << 40
        with tempfile.TemporaryDirectory() as folder, duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False, "allocator_flush_threshold": "16MB"}) as con:
            for batch in gathered(batches, limit=BATCH):
                yield from _batch(tools, con, batch.column(0), batch.column(1), row)
                row += batch.num_rows
                for table in ("links", "grouped", "pairs"):
                    con.execute(f"DROP TABLE {table}")
                give_back()

    return run


def _batch(tools: Tokenizers, con, doc_id: pa.Array, texts: pa.Array, row: int) -> Iterator[pa.RecordBatch]:
    n = len(texts)
    texts = texts.cast(pa.large_string()).fill_null("")
    spaced = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
    buf, offsets = text_buffer(spaced)
    starts = cuts(buf, offsets)
    named = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(buf))), pa.py_buffer(buf)).dictionary_encode()
    places, k = np.searchsorted(offsets, starts, "right") - 1, named.indices.to_numpy()
    seg_buf, seg_offsets = text_buffer(named.dictionary)
    sizes = np.diff(seg_offsets)
    made, valid = [], np.ones(len(sizes), bool)
    for pieces, (ids, counts) in ((tools.bytes_a, tools.ids_a(named.dictionary)), (tools.bytes_b, tools.ids_b(named.dictionary))):
        valid &= _same(pieces, ids, counts, seg_buf, sizes)
        made.append((pieces, ids, counts))
    broken = np.zeros(n, bool)
    broken[places[~valid[k]]] = True
    for name, (pieces, ids, counts) in zip("ab", made, strict=True):
        good = np.repeat(valid, counts)
        con.register(name, _intervals(pieces, ids[good], np.repeat(np.arange(len(counts)), counts)[good]))
    con.register("sizes", pa.table({"k": np.arange(len(sizes)), "n_a": made[0][2], "n_b": made[1][2]}))
    whole = ~broken[places]
    con.register("places", pa.table({"doc": places[whole], "pos": np.flatnonzero(whole), "k": k[whole]}))
    for statement in ALIGN:
        con.execute(statement)
    found = con.sql(DOCS).to_arrow_table()
    at = found.column("doc").to_numpy()
    columns = []
    for c in ("n_a", "n_b", "n_groups", "n_links"):
        all_of = np.zeros(n, np.int64)
        all_of[at] = found.column(c).to_numpy()
        columns.append(pa.array(all_of))
    digest = _digests(con, len(sizes), places[whole], k[whole], n)
    pairs = con.sql(PAIRS).to_arrow_table().combine_chunks()
    bounds = pa.array(np.searchsorted(pairs.column("doc").to_numpy(), np.arange(n + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, _one(pairs, c)) for c in "abn"]
    yield from _sliced(pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), doc_id, *columns, pa.array(digest, pa.string()), *lists], names=_NAMES))
    counts = con.sql(COUNTS).to_arrow_table().combine_chunks()
    ends = pa.array(np.unique(np.append(np.arange(0, len(counts), 50_000), len(counts))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, _one(counts, c)) for c in "abn"]
    none = [pa.nulls(len(lists[0]), t) for t in (*[pa.int64()] * 6, pa.string())]
    yield from _sliced(pa.RecordBatch.from_arrays([*none, *lists], names=_NAMES))


def _digests(con, stretches: int, places: np.ndarray, k: np.ndarray, n: int) -> list[str]:
    """The sha256 of each document's groups; without tokens empty."""
    written = con.sql(WRITTEN).to_arrow_table()
    buf, offsets = text_buffer(written.column("text"))
    bounds = offsets[np.searchsorted(written.column("k").to_numpy(), np.arange(stretches + 1))]
    texts = pa.LargeStringArray.from_buffers(stretches, pa.py_buffer(bounds), pa.py_buffer(buf)).take(pa.array(k))
    buf, offsets = text_buffer(texts)
    ends = offsets[np.searchsorted(places, np.arange(n + 1))].tolist()
    return [hashlib.sha256(buf[a + 1 : b]).hexdigest() if b > a else "" for a, b in zip(ends, ends[1:], strict=False)]


_NAMES = [x.split()[0] for x in OUT.split(", ")]


def _one(table: pa.Table, column: str) -> pa.Array:
    found = table.column(column)
    return found.chunk(0) if found.num_chunks == 1 else pa.concat_arrays(found.chunks) if found.num_chunks else pa.array([], pa.int32())


def _sliced(batch: pa.RecordBatch, rows: int = 100) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def _join_head(head):
    """Sums over the pairs of the head, and the pairs outside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = head.value
        for batch in batches:
            rows, *lists = batch.columns
            size = lists[0].value_lengths().to_numpy(zero_copy_only=False)
            a, b, n = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            of = np.repeat(np.arange(batch.num_rows), size)
            pair = a << 32 | b
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums, bests = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            np.add.at(sums, of[hit], (count[at] * n)[hit] if len(known) else n[hit])
            np.add.at(bests, of[hit], (best[at] * n)[hit] if len(known) else n[hit])
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([rows, pa.array(sums), pa.array(bests), none, none], names=["row", "count_sum", "n_best", "pair", "n"])
            rest = np.flatnonzero(~hit)
            for i in range(0, len(rest), 50_000):
                j = rest[i : i + 50_000]
                none = pa.nulls(len(j), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(of[j])), none, none, pa.array(pair[j]), pa.array(n[j])], names=["row", "count_sum", "n_best", "pair", "n"])

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (an id of A times 2**32 and one of B), count of documents, and whether that is the highest of its id of A."""
    parts = aligned.where("row is null").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p"))
    counts = stored(parts.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum(F.col("p.n").cast("long")).alias("count")), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # a row for each id of A at most
    pair = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    return counts.join(F.broadcast(highest), "a").select(pair.alias("pair"), "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    aligned = stored(docs.select("doc_id", "text").mapInArrow(_align(path_a, path_b), OUT), "aligned")
    counts = stored(pair_counts(aligned), "pairs")
    # Classes of frequency, from the highest down, as long as all their pairs fit into the head.
    level = F.floor(F.log2("count") * 8).cast("int")
    room, lowest = head, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            break
        lowest = r["level"]
    top = counts.where(F.lit(False) if lowest is None else level >= lowest).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy()[order] for c in ("pair", "count", "best")))
    documents = aligned.where("row is not null")
    made = stored(documents.select("row", "a", "b", "n").mapInArrow(_join_head(shared), "row long, count_sum long, n_best long, pair long, n long"), "pair-sums")
    rest = made.where("pair is not null").select("row", "pair", "n").join(counts, "pair").select("row", (F.col("count") * F.col("n")).alias("count_sum"), (F.col("best") * F.col("n")).alias("n_best"))
    sums = made.where("pair is null").select("row", "count_sum", "n_best").union(rest).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return documents.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
