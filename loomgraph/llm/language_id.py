"""Language identification by nearest centroids.

A text is a vector of hashed character n-grams (bytes of its lower-cased words,
2 to 4 at a time), weighted by damped frequency times inverse document
frequency and scaled to length one. Each language has several centroids,
clustered by cosine from a bounded sample of its learning documents. A text
gets the language of the nearest centroid; one that is further away than a
language's own learning documents lie is marked as rejected.

The sample is bounded by ``PER_LANGUAGE`` documents of each language, those with
the smallest hashes, of any length; their counts, which have a fixed size, are
moved instead of their texts. Inverse document frequencies are part of the fit.

Defined results: a null or empty text, or one without a letter, is ``und`` with
score 0; if nothing can be learned, all are ``und``; rows are judged one by
one; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.batches import bounded_batches
from loomgraph.llm.folds import held_out
from loomgraph.plans.scratch import stored

UNKNOWN = "und"
DIMS = 8192
SIZES = (2, 3, 4)
PER_LANGUAGE = 400
CENTROIDS = 4
#: Up to so many languages their counts are broadcast (some 4 MB); more are joined by a shuffle.
MOST_LANGUAGES = 100_000
#: Bytes of one text that are turned over at once.
PART = 4 << 20
#: A text is rejected if its cosine is below this share of its language's usual one.
REJECT = 0.35
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[:128] = 0x20  # whatever is no letter separates words
for _c in range(ord("a"), ord("z") + 1):
    _CLASS[_c] = _CLASS[_c - 32] = _c


def counts(texts: pa.Array) -> np.ndarray:
    """Hashed n-gram counts, one row of ``DIMS`` per text."""
    from loomgraph.llm.bytetext import text_buffer

    buf, offsets = text_buffer(pc.utf8_lower(texts))
    n = len(offsets) - 1
    out = np.zeros(n * DIMS, np.int64)
    doc_of = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    # Only a single text is longer than a part, so that batches do not change results.
    for a in range(0, len(buf), PART):
        b = min(len(buf), a + PART + max(SIZES) - 1)
        codes = _CLASS[buf[a:b]].astype(np.uint32)
        gap = codes == 0x20
        keep = np.ones(len(codes), bool)
        keep[1:] = ~(gap[1:] & gap[:-1])  # runs of separators count once
        doc = doc_of[a:b][keep].astype(np.int64) * DIMS
        codes = codes[keep]
        for size in SIZES:
            m = len(codes) - size + 1
            if m <= 0:
                continue
            h = np.full(m, size, np.uint32)
            for j in range(size):
                h = (h * np.uint32(0x01000193)) ^ codes[j : j + m]
            h *= np.uint32(0x9E3779B1)
            same = doc[:m] == doc[size - 1 :]
            at = doc[:m] + (h >> np.uint32(32 - 13)).astype(np.int64)
            out += np.bincount(at[same], minlength=n * DIMS)
    return out.reshape(n, DIMS)


def vectors(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counted).astype(np.float32) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    usual: np.ndarray  # cosine of a centroid's own documents, on average
    idf: np.ndarray


def _cluster(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starting vectors: centroids and each one's mean cosine."""
    start = [int(np.argmax(v @ v.mean(0)))]
    while len(start) < min(k, len(v)):
        start.append(int(np.argmin((v @ v[start].T).max(1))))
    centers = v[start]
    for _ in range(rounds):
        own = np.argmax(v @ centers.T, 1)
        for j in range(len(centers)):
            if (own == j).any():
                c = v[own == j].mean(0)
                centers[j] = c / max(float(np.linalg.norm(c)), 1e-12)
    cosines = v @ centers.T
    own = np.argmax(cosines, 1)
    used = [j for j in range(len(centers)) if (own == j).any()]
    return centers[used], np.array([cosines[own == j, j].mean() for j in used], np.float32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from loomgraph.llm.batches import sliced

    for small in sliced(batches, limit=1 << 20):
        for a in range(0, small.num_rows, 100):
            batch = small.slice(a, 100)
            packed = [zlib.compress(row.tobytes(), 1) for row in counts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(packed, pa.binary())], names=["lang", "h", "counts"])


def _unpacked(packed: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(zlib.decompress(x), np.int64) for x in packed.to_pylist()])


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for a in range(0, batch.num_rows, 100):
            total += (_unpacked(batch.column(0).slice(a, 100)) > 0).sum(0)
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "df"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, k: int = CENTROIDS) -> Model | None:
    """Learn centroids from ``docs`` (doc_id, text, lang); rows without text or language are left out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    usable = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # A threshold on the hash leaves somewhat more than the wanted number of each language; a count settles it.
    sizes = stored(usable.groupBy("lang").count(), "languages")
    few = sizes.count() <= MOST_LANGUAGES
    share = F.least(F.lit(1.0), F.lit(per_language * 2.0) / F.col("count"))
    near = F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)
    picked = usable.join(F.broadcast(sizes) if few else sizes, "lang").where(near).select("text", "lang", "h")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "counts"))
    counted = picked.mapInArrow(_counted, "lang string, h long, counts binary")
    sample = stored(counted.withColumn("r", rank).where(F.col("r") <= per_language).select("lang", "counts"), "language-sample")
    parts = sample.select("counts").mapInArrow(_document_frequency, "n long, df array<long>")
    totals = parts.select("n", F.posexplode("df").alias("i", "df")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).collect()
    if not totals or totals[0]["n"] == 0:
        return None
    idf = np.zeros(DIMS, np.float32)
    for r in totals:
        idf[r["i"]] = np.log((1 + r["n"]) / (1 + r["df"])) + 0.05 if r["df"] else 0.0
    shared = spark.sparkContext.broadcast(idf)

    def cluster(table: pa.Table) -> pa.Table:
        packed = table.column("counts").combine_chunks()
        v = np.concatenate([vectors(_unpacked(packed.slice(a, 100)), shared.value) for a in range(0, len(packed), 100)])
        centers, usual = _cluster(v, k)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(centers), pa.string()), "usual": pa.array(usual.astype(np.float64)), "center": pa.array(list(centers.astype(np.float32)), pa.list_(pa.float32()))})

    found = sorted(sample.groupBy("lang").applyInArrow(cluster, "lang string, usual double, center array<float>").collect(), key=lambda r: (r["lang"], r["usual"]))
    return Model([r["lang"] for r in found], np.array([r["center"] for r in found], np.float32), np.array([r["usual"] for r in found], np.float32), idf)


def _has_letter(texts: pa.Array) -> np.ndarray:
    from loomgraph.llm.bytetext import text_buffer

    buf, offsets = text_buffer(texts)
    letters = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((_CLASS[buf] != 0x20) & (buf < 128), out=letters[1:])
    found = letters[offsets[1:]] > letters[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in texts[i].as_py() or "")
    return found


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomgraph.llm.batches import sliced

        model: Model | None = shared.value
        for small in sliced(batches, limit=512 << 10):
            for a in range(0, small.num_rows, 256):
                batch = small.slice(a, 256)
                texts, n = batch.column(1), batch.num_rows
                labels, scores, rejected = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
                if model is not None and len(model.languages):
                    cosines = vectors(counts(texts), model.idf) @ model.centroids.T
                    best = np.argmax(cosines, 1)
                    top = cosines[np.arange(n), best]
                    ok = _has_letter(texts)
                    labels = [model.languages[b] if x else UNKNOWN for b, x in zip(best, ok, strict=True)]
                    scores = np.where(ok, np.clip(top, 0, 1), 0.0).astype(np.float64)
                    rejected = ~ok | (top < REJECT * model.usual[best])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (cosine) and rejected of each row of ``docs``. The model's size is that of its languages."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and predict all rows."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
