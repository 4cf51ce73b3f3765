"""N-gram Jaccard join with adaptive multi-match prefixes, and its components.

1. Each text becomes a set of hashed word shingles; equal sets form a class, of
   which one text goes on.
2. A fixed-size table counts, over all documents, how many sets fall on each
   slot of the hash space. It orders shingles from rare to frequent.
3. Each set keeps a prefix of its rarest shingles. A prefix of the usual length
   guarantees one shared shingle with every partner; each further shingle
   guarantees one more. A set takes the number of matches that makes its
   estimated cost (rows scanned, candidates verified) least.
4. In the list of a shingle, all sets are first compared with one hub, the set
   in which the shingle stands earliest. Links that verify form components.
5. Then every pair of one list that lies in different components, has the
   sizes, places and number of matches that a link needs, is verified. So copies
   are not expanded into all pairs, and no link between components is lost.
6. In lists of more than ``LIST`` sets, each set is first measured against one
   reference set of its family. Two sets share in the reference at most what the
   lesser of them shares with it; where that is too little for a link, they must
   share a shingle that the reference has not, so they are paired by prefixes of
   such shingles instead. Sets that changed a common text each in its own way
   have none in common, so they are not paired with each other.

Defined results: null, empty and blank texts have an empty set and are linked
with nothing; a text shorter than a shingle is one shingle; repeated rows share
a class; a null doc_id never names a component unless all its rows have none;
other columns are not read; an empty table gives an empty result. Sets are
compared by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.batches import bounded_batches, give_back
from loomgraph.llm.skew import join_one
from loomgraph.operators.components import connected_components
from loomgraph.plans.scratch import stored

#: Slots of the frequency table: 4 MB, whatever the input.
SLOT_BITS = 20
BLOCKS = 64
#: Most matches that a prefix is lengthened for.
MOST_MATCHES = 4
#: Cost of comparing one shingle of a candidate, in rows scanned.
VERIFY = 0.02
#: Other sets that any shingle is expected in, beside those that the table shows.
CHANCE = 0.1
#: Of the sets that share so many shingles with another by chance, the part that shares one more.
DECAY = 0.25
#: Rounds in which sets are compared with hubs before all pairs between components are.
HUB_ROUNDS = 3
#: In lists of at most so many sets, all are compared; in longer ones, by what they have beside a reference.
LIST = 32
#: Classes whose keys are broadcast to fetch their texts (some 20 MB); more are fetched by a shuffle.
BROADCAST_ROWS = 500_000


def _sets(texts: pa.Array, k: int):
    """Distinct shingle hashes of each text, sorted, with bounds; in parts of bounded size."""
    from loomgraph.llm.bytetext import chunks, distinct_per_doc, shingles, span_hashes, text_buffer, word_spans

    buf, offsets = text_buffer(texts)
    for a, b in chunks(offsets, 1 << 20):
        part, inner = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, bounds = word_spans(part, inner)
        values, at = shingles(span_hashes(part, starts, ends), bounds, k)
        yield a, b, *distinct_per_doc(values, at)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    from loomgraph.llm.bytetext import mix64

    out = np.zeros(len(bounds) - 1, np.uint64)
    some = np.diff(bounds) > 0
    if some.any():
        out[some] = np.add.reduceat(mix64(values), bounds[:-1][some])
    return mix64(out + np.diff(bounds).astype(np.uint64))


def _classes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SLOT_BITS, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for a, b, values, bounds in _sets(batch.column(2), k):
                table += np.bincount((values >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(table))
                yield _row(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), np.diff(bounds), _sums(values, bounds).view(np.int64), b - a)
        yield _table_rows(table, task)
        give_back()

    return run


CLASS_SCHEMA = "doc_id long, hash long, n_shingles long, class long, block int, task int, counts binary"


def _row(ids, hashes, sizes, classes, n):
    return pa.RecordBatch.from_arrays(
        [ids, hashes, pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
        names=["doc_id", "hash", "n_shingles", "class", "block", "task", "counts"],
    )


def _table_rows(table: np.ndarray, task: int):
    parts = [zlib.compress(x.astype(np.int64).tobytes(), 1) for x in np.split(table, BLOCKS)]
    none = pa.nulls(BLOCKS, pa.int64())
    return pa.RecordBatch.from_arrays(
        [none, none, none, none, pa.array(range(BLOCKS), pa.int32()), pa.array([task] * BLOCKS, pa.int32()), pa.array(parts, pa.binary())],
        names=["doc_id", "hash", "n_shingles", "class", "block", "task", "counts"],
    )


def _add_blocks(table: pa.Table) -> pa.Table:
    total = None
    for chunk in table.column("counts").to_pylist():
        x = np.frombuffer(zlib.decompress(chunk), np.int64)
        total = x if total is None else total + x
    return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _frequency_table(parts: DataFrame, tasks: int) -> np.ndarray:
    """Sum the tasks' tables block by block, in two steps, so that no task holds more than about sqrt(tasks) of them."""
    width = max(1, math.isqrt(tasks))
    schema = "block int, counts binary"
    some = parts.withColumn("group", F.col("task") % width).groupBy("block", "group").applyInArrow(_add_blocks, schema)
    rows = some.groupBy("block").applyInArrow(_add_blocks, schema).collect()
    out = np.zeros((BLOCKS, (1 << SLOT_BITS) // BLOCKS), np.int64)
    for r in rows:
        out[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out.reshape(-1)


def _order(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of sorted shingles from rare to frequent, in one order for all sets."""
    key = (count.astype(np.uint64) << np.uint64(32)) | (values & np.uint64(0xFFFFFFFF))
    return np.argsort(key, kind="stable")  # values are sorted, so equal keys keep one order everywhere


def _slots(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefix(values: np.ndarray, table: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set, in order, and the number of matches that they guarantee."""
    n = len(values)
    need = -(-percent * n // 100)
    count = table[_slots(values)]
    most = min(MOST_MATCHES, need)
    longest = n - need + most
    order = _order(values, count)[:longest]
    others = np.cumsum(np.maximum(count[order] - noise, 0.0) + CHANCE)
    sizes = n - need + np.arange(1, most + 1)
    scanned = others[sizes - 1]
    cost = sizes + scanned + scanned * DECAY ** np.arange(most) * n * VERIFY
    matches = int(np.argmin(cost)) + 1
    return values[order[: n - need + matches]], matches


def _postings(k: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        noise = float(np.median(table)) + 3 * math.sqrt(float(np.median(table)) + 1)
        seen: set[int] = set()
        for batch in batches:
            for _, _, values, bounds in _sets(batch.column(0), k):
                classes = _sums(values, bounds).view(np.int64)
                tokens, own, facts = [], [], []
                for d in range(len(bounds) - 1):
                    n, c = int(bounds[d + 1] - bounds[d]), int(classes[d])
                    if not n or c in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(c)
                    first, matches = prefix(values[bounds[d] : bounds[d + 1]], table, noise, percent)
                    tokens.append(first)
                    own.append(np.full(len(first), c, np.int64))
                    facts.append((np.int64(n) << 35) | (np.arange(len(first), dtype=np.int64) << 3) | matches)
                if tokens:
                    cat = np.concatenate
                    yield pa.RecordBatch.from_arrays([pa.array(cat(tokens).view(np.int64)), pa.array(cat(own)), pa.array(cat(facts))], names=["token", "class", "facts"])
        give_back()

    return run


def _sides(batches: Iterator[pa.RecordBatch], k: int):
    """Small batches of pairs (a, b, text_a, text_b), each with the sets of both texts."""
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            batch, sides = whole.slice(at, 200), []
            for column in (2, 3):
                sides.append([values[bounds[d] : bounds[d + 1]] for a, b, values, bounds in _sets(batch.column(column), k) for d in range(b - a)])
            yield batch, zip(*sides, strict=True)


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sides(batches, k):
            ok = []
            for x, y in sets:
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])
        give_back()

    return run


def beside(values: np.ndarray, reference: np.ndarray, table: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """How many shingles a set shares with a reference, and the prefix of the others.

    If two sets must share one of the others, their prefixes share one: two sets
    that need ``o`` in common and can share ``c`` in the reference need ``o - c``
    more of ``n - c`` or fewer others, so ``n - o + 1`` of them are prefix enough.
    """
    own = np.setdiff1d(values, reference, assume_unique=True)
    own = own[_order(own, table[_slots(own)])]
    return len(values) - len(own), own[: len(values) + percent * len(values) // -100 + 1]


BESIDE = "class long, ref long, common long, own array<long>"


def _beside(k: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sides(batches, k):
            made = [beside(x, r, shared.value, percent) for x, r in sets]
            common, own = pa.array([c for c, _ in made], pa.int64()), pa.array([o.view(np.int64) for _, o in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), common, own], names=["class", "ref", "common", "own"])
        give_back()

    return run


def _lists(placed: DataFrame) -> DataFrame:
    """Rows of the lists that hold several components: the component with most sets, the list's size, its earliest set."""
    counts = placed.groupBy("token", "part").agg(F.count("*").alias("count"), F.min(F.struct("place", "class")).alias("first"))
    most = F.max(F.struct("count", "part"))["part"].alias("major")
    lists = counts.groupBy("token").agg(most, F.sum("count").alias("sets"), F.min("first")["class"].alias("hub"), F.count("*").alias("parts"))
    return placed.join(lists.where("parts > 1").drop("parts"), "token")


def _across(lists: DataFrame, may) -> DataFrame:
    """Pairs (a, b, need) of sets of one list in different components that ``may`` link; of the largest, none with its own."""
    minor = lists.where("part <> major").withColumn("to", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)]))).alias("x")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    once = (y("part") == y("major")) | (x("class") < y("class"))
    pairs = minor.join(lists.alias("y"), (x("token") == y("token")) & (x("to") == y("band")) & (x("part") != y("part")) & once & may(x, y))
    # Which side is minor may differ between the shingles of one pair, so it is named in one order.
    return pairs.select(F.least(x("class"), y("class")).alias("a"), F.greatest(x("class"), y("class")).alias("b"), F.least(x("matches"), y("matches")).alias("need"))


def _paired(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes with their texts."""
    left = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")


def duplicates(docs: DataFrame, k: int = 5, percent: int = 80, *more: str) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs``; ``more`` may name class,
    group (a key of the component) and hash (of the text).

    Two rows are linked if ``100 * intersection >= percent * union`` of their
    sets of ``k``-word shingles; ``component_id`` is the smallest doc_id that
    links reach.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    hashed = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    made = stored(hashed.mapInArrow(_classes(k), CLASS_SCHEMA), "classes")
    rows = made.where("block is null").select("doc_id", "hash", "n_shingles", "class")
    parts = made.where("block is not null").select("block", "task", "counts")
    shared = spark.sparkContext.broadcast(_frequency_table(parts, parts.select("task").distinct().count()))
    classes = stored(rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("low"), F.min(F.struct("hash", "doc_id")).alias("sample")), "class-table")

    postings = stored(docs.select("text").mapInArrow(_postings(k, percent, shared), "token long, class long, facts long"), "postings")
    # Most shingles of prefixes stand in one set; a count finds the others before anything else is moved.
    often = postings.groupBy("token").count().where("count > 1").select("token")
    facts = F.col("facts")
    shared_tokens = postings.join(often, "token", "left_semi").dropDuplicates(["token", "class"])
    parted = shared_tokens.select("token", "class", F.shiftright(facts, 35).alias("n"), F.shiftright(facts.bitwiseAND((1 << 35) - 1), 3).alias("place"), facts.bitwiseAND(7).alias("matches"))
    # How many of the shingles before one, in its set's prefix, stand in another prefix as well.
    shown = stored(parted.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy("place")) - 1), "shared-postings")
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent

    def reach(x, y) -> Column:
        """Whether sets that share a shingle can still overlap enough: a shared shingle before it is in both prefixes."""
        before = F.least(x("rank"), y("rank"))
        after = F.least(x("n") - x("place"), y("n") - y("place"))
        return (before + after) * (100 + percent) >= (x("n") + y("n")) * percent

    def fetched(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.select("a", "b"), "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes, "class").select("class", "sample.hash", "sample.doc_id")
        wanted = stored(wanted, "wanted")
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        texts = hashed.join(wanted, (hashed["hash"] == wanted["hash"]) & hashed["doc_id"].eqNullSafe(wanted["doc_id"])).select("class", "text")
        return _paired(pairs, stored(texts, "texts"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose sets are similar enough."""
        return stored(fetched(pairs).mapInArrow(_verify(k, percent), "a long, b long"), "links")

    hubs = shown.groupBy("token").agg(F.count("*").alias("sets"), F.min(F.struct("place", "class", "n", "matches", "rank")).alias("hub")).where("sets > 1").select(F.col("token").alias("t"), "hub")
    beside = shown.join(hubs, shown["token"] == hubs["t"]).where((F.col("class") != F.col("hub.class")) & near(F.col("n"), F.col("hub.n")) & reach(F.col, lambda c: F.col(f"hub.{c}")))
    stars = beside.groupBy("class", F.col("hub.class").alias("hub")).agg(F.count("*").alias("got"), F.min(F.least("matches", "hub.matches")).alias("need")).where("got >= need")
    stars = stored(stars.select("class", "hub", "got"), "stars")
    links = tested = parts = None
    for _ in range(HUB_ROUNDS):
        # Each set tries, of the hubs it has not tried, the one in another component with which it shares most.
        rest = stars
        if parts is not None:
            side = lambda c: parts.select(F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
            rest = rest.join(tested, (rest["class"] == tested["a"]) & (rest["hub"] == tested["b"]), "left_anti")
            rest = rest.join(side("x"), F.col("class") == F.col("x_node"), "left").join(side("y"), F.col("hub") == F.col("y_node"), "left")
            rest = rest.where(F.coalesce("x_root", "class") != F.coalesce("y_root", "hub"))
        best = rest.groupBy("class").agg(F.max(F.struct("got", "hub"))["hub"].alias("b")).select(F.col("class").alias("a"), "b")
        best = stored(best, "hub-pairs")
        found = linked(best)
        links = found if links is None else links.union(found)
        tested = best if tested is None else tested.union(best)
        parts = connected_components(links)
        if not found.limit(1).count():
            break

    placed = shown.join(parts, shown["class"] == parts["node"], "left").select(shown["*"], F.coalesce("root", "class").alias("part"))
    placed = stored(placed.withColumn("band", F.floor(F.log("n") / -math.log(percent / 100 - 0.01)).cast("int")), "placed")
    lists = stored(_lists(placed), "lists")
    fits = lambda x, y: near(x("n"), y("n")) & reach(x, y)
    long = lists.where(F.col("sets") > LIST)
    pairs = _across(lists.where(F.col("sets") <= LIST), fits)
    if long.limit(1).count():
        # The reference of a family: of the earliest sets of its lists, the one of most rows.
        refs = long.groupBy("major", "hub").count().groupBy("major").agg(F.max(F.struct("count", "hub"))["hub"].alias("ref"))
        long = stored(join_one(long, stored(refs, "references"), "major"), "long-lists")
        measured = fetched(long.select(F.col("class").alias("a"), F.col("ref").alias("b")).distinct())
        measured = stored(measured.mapInArrow(_beside(k, percent, shared), BESIDE), "beside-references")
        # Whether two sets could link by what they share within the reference.
        inside = lambda x, y: F.least(x("common"), y("common")) * (100 + percent) >= (x("n") + y("n")) * percent
        within = long.join(measured.drop("own"), ["class", "ref"])
        others = long.select("class", "ref", "part", "n", "band").distinct().join(measured, ["class", "ref"])
        others = others.select("class", "part", "n", "band", "common", "ref", F.posexplode("own").alias("place", "shingle"))
        others = others.select("class", "part", "n", "band", "common", "place", F.xxhash64("ref", "shingle").alias("token"), F.lit(1).cast("long").alias("matches"))
        pairs = pairs.union(_across(within, lambda x, y: fits(x, y) & inside(x, y)))
        pairs = pairs.union(_across(stored(_lists(others), "other-lists"), lambda x, y: near(x("n"), y("n")) & ~inside(x, y)))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("got"), F.min("need").alias("need")).where("got >= need")
    links = links.union(linked(pairs))
    parts = connected_components(links)

    parts = stored(parts, "parts")
    lowest = parts.join(classes, parts["node"] == classes["class"]).groupBy("root").agg(F.min("low").alias("component_id"))
    named = join_one(parts, lowest, "root").select(F.col("node").alias("class"), "root", "component_id")
    whole = stored(classes.join(named, "class", "left").select("class", F.coalesce("root", "class").alias("group"), F.coalesce("component_id", "low").alias("component_id")), "class-groups")
    shown = ("doc_id", "n_shingles", "component_id", *more)
    full = join_one(rows.where("n_shingles > 0"), whole, "class").select(*shown)
    empty = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("group", F.lit(None).cast("long"))
    return full.union(empty.select(*shown))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Of each component one row of ``docs``, all columns: that of its smallest (doc_id, hash of the text).

    Rows with an empty set stay. The rows to drop, by doc_id and hash, are joined
    to ``docs``; of rows that agree in both with the one that stays, one stays.
    """
    names = docs.columns
    found = duplicates(docs.select("doc_id", "text"), k, percent, "group", "hash").where("n_shingles > 0")
    keys = stored(found.groupBy("group", "doc_id", "hash").count(), "keys")
    one = keys.groupBy("group").agg(F.min(F.struct("doc_id", "hash")).alias("one"))
    marked = join_one(keys, one, "group").withColumn("stays", F.struct("doc_id", "hash").eqNullSafe(F.col("one")))
    drop = stored(marked.where("not stays or count > 1").select("doc_id", "hash", "stays"), "drop")
    small = drop.count() <= BROADCAST_ROWS
    near = lambda df: F.broadcast(df) if small else df
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_hash"))
    on = lambda df: (F.col("_hash") == df["hash"]) & F.col("_id").eqNullSafe(df["doc_id"])
    repeated = drop.where("stays")
    kept = keyed.join(near(drop), on(drop), "left_anti").select("_row.*")
    if not repeated.limit(1).count():
        return kept
    return kept.union(keyed.join(near(repeated), on(repeated), "left_semi").dropDuplicates(["_id", "_hash"]).select("_row.*"))
