"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are shape statistics of the line itself
and of the lines before and after it. The field is trained by gradient ascent
on the likelihood; lines of a document that is labelled bad but that look good
are relabelled once in between, since such documents may mix both. Forward and
backward messages come from a parallel scan over products of 2 x 2 matrices, so
a batch takes a number of passes that grows with the logarithm of the longest
document. The marginals of a document's lines, weighted by length, and a
logistic curve fitted on the learning documents give its score.

The field is fitted on a bounded sample: the ``TRAIN_DOCS`` labelled documents
with the smallest hashes of their ids, of each the ``ROWS_PER_DOC`` distinct texts
with the smallest hashes, and of a longer text ``TRAIN_LINES`` lines in ``WINDOWS``
windows, one at a hashed place of each equal part of the text. All lines of all
documents are scored, in parts whose messages are carried on from one to the
next; a worker holds some 60 bytes for each line of the text in hand beside the
text. Of a text that is learned from, only the features of its windows are made.

Defined results: a null or empty text has one empty line and is scored by it;
without learnable labels of both kinds, the share of good labels (or 0.5) is
every score; conflicting labels of one doc_id count as the lower one; null
labels are left out; rows are scored one by one; labels, lang, source and
doc_id are never features; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.batches import bounded_batches
from loomgraph.llm.folds import held_out

TRAIN_DOCS = 4000
TRAIN_LINES = 100
WINDOWS = 4
ROWS_PER_DOC = 2
ROUNDS = 120
#: Bytes and lines whose statistics and messages are made at once.
PART = 2 << 20
PART_LINES = 1 << 13

LOWER, UPPER, DIGIT, SPACE, MARK, BAR, BANG, OTHER, HIGH = range(9)
KINDS = 9
_KIND = np.full(256, OTHER, np.uint8)
_KIND[ord("a") : ord("z") + 1] = LOWER
_KIND[ord("A") : ord("Z") + 1] = UPPER
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
_KIND[[ord(c) for c in "#*$%&<>"]] = MARK
_KIND[ord("|")] = BAR
_KIND[ord("!")] = BANG
_KIND[128:] = HIGH
#: Own features of a line; the field sees those of its neighbours as well.
OWN = KINDS + 7


def lines_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and per document the index of its first line."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(buf == 0x0A)
    per_doc = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    starts = np.empty(int(bounds[-1]), np.int64)
    ends = np.empty(int(bounds[-1]), np.int64)
    first = np.zeros(len(starts), bool)
    first[bounds[:-1]] = True
    last = np.zeros(len(starts), bool)
    last[bounds[1:] - 1] = True
    starts[first] = offsets[:-1]
    starts[~first] = breaks + 1
    ends[last] = offsets[1:]
    ends[~last] = breaks
    assert n == int(first.sum())
    return starts, ends, bounds


def _part_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own features of lines that lie one after another in ``buf``, and a hash of each."""
    from loomgraph.llm.bytetext import mix64, span_hashes, word_spans

    a, b, n = int(starts[0]), int(ends[-1]), len(starts)
    part, starts, ends = buf[a:b], starts - a, ends - a
    size = ends - starts
    x = np.zeros((n, OWN), np.float32)
    hashes = np.zeros(n, np.uint64)
    if not len(part):
        x[:, KINDS + 6] = 1
        return x, hashes
    nexts = np.concatenate([starts[1:], [len(part)]])
    line = np.repeat(np.arange(n), nexts - starts)
    kinds = np.bincount(line * KINDS + _KIND[part], minlength=n * KINDS).reshape(n, KINDS)
    kinds[:, SPACE] -= nexts - ends
    x[:, :KINDS] = kinds / np.maximum(size, 1)[:, None]
    ws, we, wb = word_spans(part, np.concatenate([starts, [len(part)]]))
    words = np.diff(wb)
    h = span_hashes(part, ws, we)
    of = np.repeat(np.arange(n), words)
    many = np.maximum(words, 1)
    x[:, KINDS] = np.log1p(size) / 5
    x[:, KINDS + 1] = np.minimum(np.bincount(of, we - ws, n) / many / 10, 5)
    for j in (1, 2):
        same = (h[j:] == h[:-j]) & (of[j:] == of[:-j])
        x[:, KINDS + 1 + j] = np.bincount(of[j:][same], minlength=n) / many
    if len(ws):
        tail = _KIND[part[we - 1]]
        x[:, KINDS + 4] = np.bincount(of[(tail == MARK) | (tail == BANG)], minlength=n) / many
        x[:, KINDS + 5] = np.bincount(of[_KIND[part[ws]] == UPPER], minlength=n) / many
        hashes = np.bincount(of, minlength=n).astype(np.uint64)
        place = (np.arange(len(h)) - wb[of]).astype(np.uint64)
        np.add.at(hashes, of, mix64(h + place * np.uint64(0x9E3779B97F4A7C15)))
    x[:, KINDS + 6] = words < 3
    return x, hashes


class _Lines:
    """The lines of a batch: places, and features of any run of them, made when they are asked for."""

    def __init__(self, texts: pa.Array):
        from loomgraph.llm.bytetext import text_buffer

        self.buf, offsets = text_buffer(texts)
        self.starts, self.ends, self.bounds = lines_of(self.buf, offsets)
        total = len(self.starts)
        self.first, self.last = np.zeros(total, bool), np.zeros(total, bool)
        self.first[self.bounds[:-1]] = self.last[self.bounds[1:] - 1] = True
        self.parts, at = [], 0
        while at < total:
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + PART, side="right")))
            self.parts.append((at, min(to, at + PART_LINES)))
            at = self.parts[-1][1]
        made = [_part_features(self.buf, self.starts[a:b], self.ends[a:b]) for a, b in self.parts[:1]]
        self._whole = made[0][0] if len(self.parts) == 1 else None
        hashes = [h for _, h in made] + [_part_features(self.buf, self.starts[a:b], self.ends[a:b])[1] for a, b in self.parts[1:]]
        self.again = self._repeats(np.concatenate(hashes) if hashes else np.empty(0, np.uint64))

    def _repeats(self, hashes: np.ndarray) -> np.ndarray:
        """Whether the same line stands earlier in its document."""
        again = np.zeros(len(hashes), bool)
        if len(self.bounds) == 2:  # one document, perhaps a very long one
            order = np.argsort(hashes, kind="stable")
            again[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
        else:
            doc = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
            order = np.lexsort((np.arange(len(hashes)), hashes, doc))
            again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        return again & (self.ends > self.starts)

    def rows(self, a: int, b: int) -> np.ndarray:
        """Features of lines ``a`` to ``b`` with their neighbours'."""
        lo, hi = max(a - 1, 0), min(b + 1, len(self.starts))
        own = np.empty((hi - lo + 2, OWN + 1), np.float32)  # a row more at both ends
        own[1:-1, :OWN] = self._whole[lo:hi] if self._whole is not None else _part_features(self.buf, self.starts[lo:hi], self.ends[lo:hi])[0]
        own[1:-1, OWN] = self.again[lo:hi]
        own[0] = own[-1] = 0
        at, n = 1 + a - lo, b - a
        before, after = own[at - 1 : at - 1 + n].copy(), own[at + 1 : at + 1 + n].copy()
        first, last = self.first[a:b], self.last[a:b]
        before[first] = 0
        after[last] = 0
        return np.hstack([own[at : at + n], before, after, first[:, None].astype(np.float32), last[:, None].astype(np.float32)])

    @property
    def length(self) -> np.ndarray:
        return (self.ends - self.starts).astype(np.float64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of a batch with their neighbours', line lengths, and line bounds per document."""
    lines = _Lines(texts)
    made = [lines.rows(a, b) for a, b in lines.parts]
    return np.concatenate(made) if made else np.empty((0, 3 * (OWN + 1) + 2), np.float32), lines.length, lines.bounds


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = a[:, :, 0, None] * b[:, None, 0, :] + a[:, :, 1, None] * b[:, None, 1, :]
    return c / c.sum((1, 2), keepdims=True)


def _emit(unary: np.ndarray) -> np.ndarray:
    good = np.exp(np.clip(unary, -30, 30))
    return np.stack([np.ones(len(unary)), good], 1) / (1 + good)[:, None]


def _factors(emit: np.ndarray, step: np.ndarray, starts: np.ndarray, come: np.ndarray | None) -> np.ndarray:
    """A 2 x 2 matrix for each line; ``come`` is the message to the first line, if its document began before."""
    m = step[None] * emit[:, None, :]
    m[starts] = emit[starts][:, None, :]  # equal rows forget what came before
    if come is not None:
        m[0] = (come @ step * emit[0])[None, :]
    return m


def _forward(m: np.ndarray, longest: int) -> np.ndarray:
    fore, d = m / m.sum((1, 2), keepdims=True), 1
    while d < longest:
        fore[d:] = _times(fore[:-d], fore[d:])
        d *= 2
    return fore[:, 0] / fore[:, 0].sum(1, keepdims=True)


def _backward(m: np.ndarray, ends: np.ndarray, go: np.ndarray | None, longest: int) -> np.ndarray:
    """Messages back to each line; ``go`` is that to the last line, if its document goes on."""
    back, d = np.full_like(m, 0.25), 1
    back[:-1] = m[1:]
    back[ends] = 0.25
    if go is not None:
        back[-1] = go[:, None]
    back /= back.sum((1, 2), keepdims=True)
    while d < longest:
        back[:-d] = _times(back[:-d], back[d:])
        d *= 2
    beta = back.sum(2)
    return beta / beta.sum(1, keepdims=True)


def marginals(unary: np.ndarray, trans: np.ndarray, bounds: np.ndarray, pairs: bool = False):
    """P(good) of each line; with ``pairs``, also the expected transition counts and the log-likelihood's normaliser is left out.

    Without ``pairs``, lines are taken in parts of ``PART_LINES``: the messages at
    a part's ends are carried on, so memory hardly depends on a document's length.
    """
    n, step = len(unary), np.exp(trans)
    if not pairs:
        return _marginals_in_parts(unary, step, bounds)
    longest = int(np.diff(bounds).max(initial=0))
    m = _factors(_emit(unary), step, bounds[:-1], None)
    alpha, beta = _forward(m, longest), _backward(m, bounds[1:] - 1, None, longest)
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    inner = np.ones(n, bool)
    inner[bounds[:-1]] = False
    t = np.flatnonzero(inner)
    joint = alpha[t - 1][:, :, None] * m[t] * beta[t][:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return p[:, 1], joint.sum(0)


def _marginals_in_parts(unary: np.ndarray, step: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(unary)
    alpha, out = np.empty((n, 2)), np.empty(n)
    parts = [(a, min(a + PART_LINES, n)) for a in range(0, n, PART_LINES)]

    def part(a: int, b: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Starts of documents in a part, ends of documents in it, and its longest run."""
        starts, ends = (bounds[np.searchsorted(bounds, x) : np.searchsorted(bounds, x + b - a)] - x for x in (a, a + 1))
        runs = np.diff(np.concatenate([[0], starts, [b - a]]))
        return starts, ends, int(runs.max(initial=0))

    for a, b in parts:
        starts, _, longest = part(a, b)
        come = None if len(starts) and starts[0] == 0 else alpha[a - 1]
        alpha[a:b] = _forward(_factors(_emit(unary[a:b]), step, starts, come), longest)
    go = None
    for a, b in reversed(parts):
        starts, ends, longest = part(a, b)
        emit = _emit(unary[a:b])
        beta = _backward(_factors(emit, step, starts, None), ends, go, longest)
        p = alpha[a:b] * beta
        out[a:b] = p[:, 1] / p.sum(1)
        go = None if len(starts) and starts[0] == 0 else step @ (emit[0] * beta[0])
    return out


@dataclass
class Field:
    """A trained field: line weights, transition scores and the curve from line marginals to a score."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    trans: np.ndarray | None = None
    curve: tuple[float, float] = (1.0, 0.0)

    def unary(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return z @ self.weights[:-1] + self.weights[-1]

    def lines(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return marginals(self.unary(x), self.trans, bounds)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        lines = _Lines(texts)
        unary = [np.empty(0)]
        for a, b in lines.parts:
            unary.append(self.unary(lines.rows(a, b)))
        p = marginals(np.concatenate(unary), self.trans, lines.bounds)
        return _curve(share_good(p, lines.length, lines.bounds), *self.curve)


def share_good(p: np.ndarray, length: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    weight = length + 1e-3
    return np.add.reduceat(p * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1]) if len(bounds) > 1 else np.empty(0)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _curve(share: np.ndarray, a: float, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * _logit(share) + b, -50, 50)))


def _ascend(z: np.ndarray, y: np.ndarray, bounds: np.ndarray, w: np.ndarray, trans: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent with momentum and per-weight steps on the penalised likelihood."""
    n = len(y)
    inner = np.ones(n, bool)
    inner[bounds[:-1]] = False
    t = np.flatnonzero(inner)
    seen = np.bincount(y[t - 1] * 2 + y[t], minlength=4).reshape(2, 2).astype(float)
    theta = np.concatenate([w, trans.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs = marginals(z @ w[:-1] + w[-1], trans, bounds, pairs=True)
        miss = y - p
        g = np.concatenate([z.T @ miss, [miss.sum()], (seen - pairs).ravel()]) / n - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -8, 8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def train(x: np.ndarray, length: np.ndarray, bounds: np.ndarray, quality: np.ndarray, rounds: int = ROUNDS, chains: np.ndarray | None = None) -> Field:
    """Fit a field to documents' lines and quality labels (1 good, 0 bad); ``chains`` bounds the runs of lines that follow one another."""
    chains = bounds if chains is None else chains
    prior = float(quality.mean()) if len(quality) else 0.5
    if len(quality) == 0 or quality.min() == quality.max():
        return Field(prior)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -6, 6).astype(np.float64)
    y = np.repeat(quality, np.diff(bounds)).astype(np.int64)
    w, trans = _ascend(z, y, chains, np.zeros(z.shape[1] + 1), np.zeros((2, 2)), rounds)
    # Lines of bad documents that look good are good, if the document keeps a bad one.
    alone = 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))
    lowest = np.minimum.reduceat(alone, bounds[:-1])
    flips = (y == 0) & (alone > 0.5) & (alone > np.repeat(lowest, np.diff(bounds)))
    y = np.where(flips, 1, y)
    w, trans = _ascend(z, y, chains, w, trans, rounds)
    field = Field(prior, mean, scale, w, trans)
    share = _logit(share_good(field.lines(x, chains), length, bounds))
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton steps for the logistic curve
        p = 1 / (1 + np.exp(-np.clip(a * share + b, -50, 50)))
        s = p * (1 - p) + 1e-9
        g = np.array([((quality - p) * share).sum() - 1e-2 * a, (quality - p).sum()])
        h = np.array([[(s * share * share).sum() + 1e-2, (s * share).sum()], [(s * share).sum(), s.sum() + 1e-6]])
        da, db = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + da, b + db
    field.curve = (float(max(a, 1e-3)), float(b))
    return field


def _windows(n: int, seed: int) -> list[tuple[int, int]]:
    """The runs of lines of a text of ``n`` that are learned: all, or a window at a hashed place of each equal part."""
    if n <= TRAIN_LINES:
        return [(0, n)]
    rng, size = np.random.default_rng(seed), TRAIN_LINES // WINDOWS
    parts = [(n * i // WINDOWS, n * (i + 1) // WINDOWS) for i in range(WINDOWS)]
    return [(at, at + size) for at in (int(rng.integers(a, b - size + 1)) for a, b in parts)]


def _collect_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from loomgraph.llm.batches import sliced

    seen: dict[int, list[int]] = {}  # of each document, the smallest hashes of its texts so far
    for batch in sliced(batches, limit=1 << 20):
        keep = []
        for d, (i, h) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            least = seen.setdefault(i, [])
            if h not in least and (len(least) < ROWS_PER_DOC or h < least[-1]):
                seen[i] = sorted([*least, h])[:ROWS_PER_DOC]
                keep.append(d)
        if not keep:
            continue
        batch = batch.take(pa.array(keep, pa.int64()))
        lines, hashes = _Lines(batch.column(0)), batch.column(3).to_pylist()
        first, count = lines.bounds[:-1].tolist(), np.diff(lines.bounds).tolist()
        runs = [[(f + a, f + b) for a, b in _windows(n, h % (1 << 63))] for f, n, h in zip(first, count, hashes, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(2),
                batch.column(3),
                batch.column(1),
                pa.array([own[0][1] - own[0][0] for own in runs], pa.int32()),
                pa.array([b"".join(lines.rows(a, b).tobytes() for a, b in own) for own in runs], pa.binary()),
                pa.array([b"".join((lines.ends[a:b] - lines.starts[a:b]).astype(np.float64).tobytes() for a, b in own) for own in runs], pa.binary()),
            ],
            names=["doc_id", "h", "quality", "chain", "x", "length"],
        )


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """Fit a field on at most ``train_docs`` labelled documents; ``labels`` has doc_id and quality."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = min(1.0, 1.5 * train_docs / max(1, known.count()))  # no task then sorts or sends more than it must
    chosen = known.where(place < int(share * (1 << 30))).orderBy(place, "doc_id").limit(train_docs)
    chosen = spark.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, quality int")
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality", "doc_id", F.xxhash64("text").alias("h"))
    made = picked.mapInArrow(_collect_features, "doc_id long, h long, quality int, chain int, x binary, length binary")
    # Tasks send few rows of a repeated doc_id; of equal texts from several tasks one counts.
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("h"))
    got = made.dropDuplicates(["doc_id", "h"]).withColumn("r", rank).where(F.col("r") <= ROWS_PER_DOC).select("quality", "chain", "x", "length").collect()
    got.sort(key=lambda r: (bytes(r["x"]), r["quality"]))  # in the same order on every run
    if not got:
        return Field(0.5)
    length = [np.frombuffer(r["length"], np.float64) for r in got]
    x = np.concatenate([np.frombuffer(r["x"], np.float32) for r in got]).reshape(-1, 3 * (OWN + 1) + 2)
    bounds = np.concatenate([[0], np.cumsum([len(v) for v in length])])
    steps = np.concatenate([np.full(len(v) // r["chain"], r["chain"]) for r, v in zip(got, length, strict=True)])
    chains = np.concatenate([[0], np.cumsum(steps)])
    return train(x, np.concatenate(length), bounds, np.array([r["quality"] for r in got]), chains=chains)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomgraph.llm.batches import sliced

        field: Field = shared.value
        for batch in sliced(batches, limit=1 << 20):
            scores = field.scores(batch.column(batch.num_columns - 1))
            columns = [*batch.columns[:-1], pa.array(np.clip(scores, 0, 1), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score and predicted of each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    made = docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double")
    return made.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that are not held out and score all documents."""
    field = fit(docs, labels.where(~held_out()))
    return score(docs, field).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose score is 0.5 or more."""
    field = fit(docs, labels.where(~held_out()))
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns
    place = [c.lower() for c in names].index("text")
    wide = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"))
    made = wide.mapInArrow(_score_rows(shared, place), wide.select("_row", F.lit(0.0).alias("score")).schema)
    return made.where("score >= 0.5").select("_row.*")


def _score_rows(shared, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomgraph.llm.batches import sliced

        field: Field = shared.value
        def with_text() -> Iterator[pa.RecordBatch]:
            for batch in batches:  # the text is a view of the row's own
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).field(place)], names=["_row", "_text"])

        for batch in sliced(with_text(), column="_text", limit=1 << 20):
            scores = field.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(scores, 0, 1), pa.float64())], names=["_row", "score"])

    return run
