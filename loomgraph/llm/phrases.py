"""Phrase collocations by contiguous pattern growth, in the manner of PrefixSpan.

1. Words of each language are counted by batch, then by a distributed count.
2. Two-word prefixes are counted in the same way, where both words are frequent.
3. Each place of a frequent prefix is projected: the words that follow it, up to
   the length of the longest phrase, cut before the first pair that is not frequent.
   Equal projections of a batch are counted before they are exchanged. The
   projections of a prefix go to one task, which extends the prefix to the right
   by each next word, depth-first: an extension that is frequent is kept and is the
   prefix of the next step over its own projections. A prefix with more than one in
   ``SHARES`` of all places is dealt over several tasks by what follows; these give
   partial counts, which are added up before the limit is applied.
4. Every cut of a phrase is scored by joins to the counts of its two parts; the
   lowest score counts. Phrases that a longer one covers are dropped, by the
   largest count of a longer phrase around each.

Counts are of strings, so no two words are ever taken for one. The mappers leave out
infrequent words and pairs by a bitmap of fixed size; where it has a false positive,
a row more is counted and found infrequent. So the bitmap, ``BITS`` bits whatever the
input, changes the work and never the result. Products are decimals of 38 digits.

Defined results: a null or empty text has no words; a null language is ``und``;
repeated rows count as often as they stand in the table, whatever their doc_id;
a word of any length is a word; ties in score and count go to the smaller phrase;
an empty table gives an empty result; columns other than ``lang`` and ``text``
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.batches import bounded_batches, gathered
from loomgraph.llm.bytetext import mix64, span_hashes, text_buffer, word_spans
from loomgraph.plans.scratch import stored

#: Bits of the filters of frequent words and pairs: 8 MB each on the driver and each worker.
BITS = 1 << 26
BATCH = 8 << 20
#: A prefix with more than one in so many of all places is dealt over several tasks; so there are at most so many of them.
SHARES = 20_000
#: A prefix of fewer places is never dealt.
FEW = 2_000
#: Rows that a mapper hands on at once.
ROWS = 50_000
UND = "und"

_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_IS_WORD = ~_BREAKS
_IS_WORD[[0x20, 0x09]] = False
_IS_PART = np.ones(256, bool)
_IS_PART[0x20] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_PAIR = np.uint64(0xD1342543DE82EF95)


def string_hashes(strings: pa.Array) -> np.ndarray:
    buf, offsets = text_buffer(strings)
    return span_hashes(buf, offsets[:-1], offsets[1:], lower=False)


def _lang_hash(lang: str) -> np.uint64:
    return string_hashes(pa.array([lang]))[0]


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(mix64(first) * _PAIR + second)


class Found:
    """The words of one language in a batch: distinct words, the number of each word in order, and whether the next word is in the same piece."""

    def __init__(self, lang: str, texts: pa.Array):
        self.lang = lang
        buf, offsets = text_buffer(texts)
        buf = _LOWER[buf]
        starts, ends, bounds = word_spans(buf, offsets, _IS_WORD)
        sizes = np.concatenate([[0], np.cumsum(ends - starts)])
        letters = buf[_IS_WORD[buf]]
        places = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(letters))
        named = places.dictionary_encode()
        self.words, self.index = named.dictionary, named.indices.to_numpy()
        piece = np.searchsorted(np.flatnonzero(_BREAKS[buf]), starts)
        self.joined = np.zeros(len(starts), bool)
        self.joined[:-1] = piece[1:] == piece[:-1]
        last = bounds[1:] - 1
        self.joined[last[last >= 0]] = False

    def hashes(self) -> np.ndarray:
        return string_hashes(self.words) ^ _lang_hash(self.lang) if len(self.words) else np.empty(0, np.uint64)


def languages(batch: pa.RecordBatch) -> Iterator[Found]:
    """``batch`` (lang, text) by language."""
    langs = batch.column(0).fill_null(UND).dictionary_encode()
    codes = langs.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    texts = batch.column(1).cast(pa.large_string()).take(pa.array(order))
    bounds = np.searchsorted(codes[order], np.arange(len(langs.dictionary) + 1))
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        yield Found(lang, texts.slice(bounds[i], bounds[i + 1] - bounds[i]))


def _rows(lang: str, n: np.ndarray, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(n), ROWS):
        part = slice(a, a + ROWS)
        size = len(n[part])
        named = {"lang": pa.array([lang], pa.string()).take(pa.array(np.zeros(size, np.int32)))} | {k: v[part].cast(pa.string()) for k, v in columns.items()}
        yield pa.RecordBatch.from_pydict(named | {"n": pa.array(n[part], pa.int64())})


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches, limit=BATCH):
        for found in languages(batch):
            yield from _rows(found.lang, np.bincount(found.index, minlength=len(found.words)), phrase=found.words)
            yield from _rows(found.lang, np.array([len(found.index)]), phrase=pa.nulls(1, pa.string()))  # all words of the language


def _distinct(found: Found, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs that begin at the places ``at`` (two numbers of words in one), which of them each place has, and their counts."""
    return np.unique(found.index[at].astype(np.int64) << 32 | found.index[at + 1], return_inverse=True, return_counts=True)


def _phrase(found: Found, *numbers: np.ndarray) -> pa.Array:
    parts = [found.words.take(pa.array(x)) for x in numbers]
    return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes & np.uint64(BITS - 1)
    return (bitmap[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) > 0


def _pairs(filter_words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filter_words.value
        for batch in gathered(batches, limit=BATCH):
            for found in languages(batch):
                good = _has(known, found.hashes())[found.index]
                at = np.flatnonzero(found.joined[:-1] & good[:-1] & good[1:])
                code, _, n = _distinct(found, at)
                yield from _rows(found.lang, n, phrase=_phrase(found, code >> 32, code & 0xFFFFFFFF))

    return run


def _projections(filter_words, filter_pairs, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_pairs = filter_words.value, filter_pairs.value
        for batch in gathered(batches, limit=BATCH):
            for found in languages(batch):
                hashes = found.hashes()
                good = _has(known, hashes)[found.index]
                at = np.flatnonzero(found.joined[:-1] & good[:-1] & good[1:])
                code, inverse, _ = _distinct(found, at)
                frequent = _has(known_pairs, pair_hashes(hashes[code >> 32], hashes[code & 0xFFFFFFFF]))
                begins = np.zeros(len(found.index) + longest, bool)  # a frequent pair begins here
                begins[at] = frequent[inverse]
                follow = np.zeros(len(begins), np.int64)  # words that follow the pair
                for j in range(1, longest - 1):
                    reach = begins[: len(begins) - j] & (follow[: len(begins) - j] == j - 1) & begins[j:]
                    follow[: len(begins) - j][reach] = j
                for m in range(1, longest - 1):
                    at = np.flatnonzero(follow == m)
                    part = found.index[at].astype(np.int64)
                    for j in range(1, m + 2):  # names of distinct stretches, word by word
                        keys, part = np.unique(part << 32 | found.index[at + j], return_inverse=True)
                    first = np.zeros(len(keys) if len(at) else 0, np.int64)
                    first[part] = at
                    n = np.bincount(part, minlength=len(first))
                    word = [found.index[first + j] for j in range(m + 2)]
                    yield from _rows(found.lang, n, prefix=_phrase(found, *word[:2]), suffix=_phrase(found, *word[2:]))

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the phrases of one or two words, by 64-bit cell."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        of = string_hashes(langs.dictionary)[langs.indices.to_numpy()]
        buf, offsets = text_buffer(batch.column(1))
        starts, ends, bounds = word_spans(buf, offsets, _IS_PART)
        hashes = span_hashes(buf, starts, ends, lower=False)
        first = hashes[bounds[:-1]] ^ of
        two = np.diff(bounds) == 2
        first[two] = pair_hashes(first[two], hashes[bounds[:-1][two] + 1] ^ of[two])
        cell = first & np.uint64(BITS - 1)
        yield pa.RecordBatch.from_arrays([pa.array((cell >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (cell & np.uint64(63))).view(np.int64))], names=["cell", "bits"])


def bitmap_of(phrases: DataFrame):
    """A broadcast bitmap of the (lang, phrase) rows: ``BITS`` bits, so at most ``BITS / 64`` rows come to the driver."""
    cells = phrases.select("lang", "phrase").mapInArrow(_cells, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(BITS // 64, np.uint64)
    bitmap[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(bitmap)


def extend(prefix: str, projected: list[tuple[list[str], int]], least: int) -> Iterator[tuple[str, int]]:
    """Phrases longer than ``prefix`` found at least ``least`` times in its projections (words that follow, number), depth-first."""
    by_word: dict[str, list[tuple[list[str], int]]] = {}
    for words, n in projected:
        by_word.setdefault(words[0], []).append((words[1:], n))
    for word, rest in by_word.items():
        a = sum(n for _, n in rest)
        if a >= least:
            longer = f"{prefix} {word}"
            yield longer, a
            yield from extend(longer, [x for x in rest if x[0]], least)


def _grow(least: int):
    """Each prefix of a partition in turn; rows of a prefix stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, int]] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "phrase", "n"])
            out.clear()
            return made

        now, held = None, []
        for batch in batches:
            for *key, suffix, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if held:
                        out += [(now[0], *x) for x in extend(now[1], held, 1 if now[3] > 1 else least)]
                    now, held = key, []
                held.append((suffix.split(" "), n))
                if len(out) >= ROWS:
                    yield flush()
        if held:
            out += [(now[0], *x) for x in extend(now[1], held, 1 if now[3] > 1 else least)]
        if out:
            yield flush()

    return run


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, phrase, n) of words, (lang, phrase, n) of phrases of 2 to ``longest`` words, both found at least ``least`` times, and (lang, n) of all words."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    counted = "lang string, phrase string, n long"
    key = ["lang", "phrase"]
    words = texts.mapInArrow(_words, counted).groupBy(*key).agg(F.sum("n").alias("n"))
    words = stored(words.where(F.col("phrase").isNull() | (F.col("n") >= least)), "words")
    totals, words = words.where("phrase is null").select("lang", "n"), words.where("phrase is not null")
    filter_words = bitmap_of(words)
    pairs = texts.mapInArrow(_pairs(filter_words), counted).groupBy(*key).agg(F.sum("n").alias("n"))
    pairs = stored(pairs.where(F.col("n") >= least), "pairs")
    if longest < 3:
        return words, pairs, totals
    filter_pairs = bitmap_of(pairs)
    limit = max(FEW, (pairs.agg(F.sum("n")).first()[0] or 0) // SHARES)
    hot = pairs.where(F.col("n") > limit).select("lang", F.col("phrase").alias("prefix"), F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    projected = texts.mapInArrow(_projections(filter_words, filter_pairs, longest), "lang string, prefix string, suffix string, n long")
    projected = projected.join(F.broadcast(hot), ["lang", "prefix"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    projected = projected.withColumn("part", F.pmod(F.xxhash64("suffix"), F.col("parts")).cast("int"))
    dealt = projected.repartition("lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part").select("lang", "prefix", "part", "parts", "suffix", "n")
    grown = dealt.mapInArrow(_grow(least), counted).groupBy(*key).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return words, stored(pairs.union(grown), "phrases"), totals


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, cover: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of each language that no longer phrase covers."""
    words, phrases, totals = frequent_phrases(docs, least, longest)
    part = words.union(phrases)
    size = F.size(F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    left = F.array_join(F.slice(F.split("phrase", " "), F.lit(1), F.col("k")), " ")
    cuts = cuts.withColumn("left", left).withColumn("right", F.substring("phrase", F.length("left") + 2, F.length("phrase")))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("whole", _exact("a") * 2_000_000).withColumn("both", _exact("l") + _exact("r"))
    cuts = cuts.select("lang", "phrase", F.struct(F.expr("whole div both").alias("score"), "k", "a", "l", "r").alias("cut"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min("cut").alias("cut")).select("lang", "phrase", "cut.*")

    def inside(ws: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(2), F.size(ws) - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size(ws) - m + 1), lambda i: F.array_join(F.slice(ws, i, m), " "))))

    around = phrases.where(size > 2).select("lang", F.explode(inside(F.split("phrase", " "))).alias("phrase"), F.col("n").alias("longer"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    scored = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * cover))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
