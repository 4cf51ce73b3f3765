"""Line dedup: lines that many documents share are dropped, by levelled sorted runs of line hashes.

1. One pass over the texts stores a row for each line with a key: the hashes of
   the key and of the whole text, the line's place, and whether the key stands
   there for the first time in its document.
2. ``LineRuns`` takes these rows batch by batch. A batch is counted by key, then
   joined by a merge anti-join to the run of keys that are already known to be
   common; what is left is added as a sorted run of the lowest level. A level of
   ``FANOUT`` runs is compacted: counts of a key are added up, keys that reach the
   limit go to the common run, the others become one run of the next level. Runs
   are tables bucketed and sorted by the hashes, so neither the anti-join nor a
   compaction shuffles or moves a row that is already in a run.
3. Keys whose counts over all runs reach the limit are joined to the stored lines.
   The places to drop, by text hash, are joined to the texts; whole texts are
   exchanged once, and lines never.

Keys and texts are named by two 64-bit hashes with different seeds. Copies of a
text share one set of places. A key that holds many lines is one row of a run,
and is joined to its lines by broadcast, up to ``BROADCAST_ROWS`` common keys, or
by a merge join, which adaptive execution splits.

Defined results: a null or empty text is one empty line; a line of white space
alone has no key and stays; each row is a document of its own, whatever its
doc_id, so repeated rows count as often as they stand in the table; all lines
dropped leaves an empty text; an empty table gives an empty result; columns other
than ``doc_id`` and ``text`` are not read. A text is held with an array of its
lines by one task, some 50 bytes for each line.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.quality_rules import let
from loomgraph.plans.scratch import new_path, stored

#: Runs of a level that are merged into one run of the next.
FANOUT = 4
#: Batches into which one table is cut.
BATCHES = 8
#: Common keys are broadcast up to this number (16 bytes each), else joined by a merge join.
BROADCAST_ROWS = 1 << 20
#: White space that is stripped from both ends of a line.
STRIPPED = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ("h1", "h2")


def names(value: Column, prefix: str) -> list[Column]:
    """Two 64-bit hashes of ``value``."""
    return [F.xxhash64(value).alias(f"{prefix}1"), F.xxhash64(F.lit(1), value).alias(f"{prefix}2")]


def text_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, UPPER.lower())


def hashed_lines(docs: DataFrame, least_length: int = 1) -> DataFrame:
    """t1, t2, h1, h2, pos and first of each line whose key has at least ``least_length`` code points."""
    keys = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(key_of(x).alias("key"), i.alias("pos")))
    keys = F.filter(keys, lambda x: F.length(x["key"]) >= max(1, least_length))
    found = F.sort_array(F.transform(keys, lambda x: F.struct(*names(x["key"], "h"), x["pos"].alias("pos"))))

    def mark(rows: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(rows, i - 1)
            return F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), ((i == 0) | (before["h1"] != x["h1"]) | (before["h2"] != x["h2"])).alias("first"))

        return F.transform(rows, one)

    return text_of(docs).select(*names(F.col("text"), "t"), F.explode(let(found, mark)).alias("line")).select("t1", "t2", "line.*")


class LineRuns:
    """Levelled sorted runs of line hashes with the number of documents of each, and the run of common keys.

    ``add`` takes batches of ``hashed_lines``; ``common`` gives the keys found in at
    least ``least`` documents so far, after which further batches may be added.
    Tables stay until ``drop``; their files lie in the shared folder.
    """

    def __init__(self, spark: SparkSession, least: int, fanout: int = FANOUT):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[int] = []
        self.decided = False

    def _write(self, rows: DataFrame, table: str) -> None:
        name = f"{self.name}_{table}"
        new = not self.spark.catalog.tableExists(name)
        writer = rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").mode("append")
        (writer.option("path", new_path(self.spark, name)) if new else writer).saveAsTable(name)

    def _read(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def add(self, lines: DataFrame) -> None:
        """Count a batch by key, leave out the keys that are decided, and add the rest as a run."""
        batch = lines.where("first").groupBy(*KEY).agg(F.count("*").alias("n"))
        if self.decided:
            batch = batch.join(self._read("common").hint("merge"), list(KEY), "left_anti")
        self._push(batch, 0)

    def _push(self, run: DataFrame, level: int) -> None:
        self._write(run, f"level{level}")
        if level == len(self.runs):
            self.runs.append(0)
        self.runs[level] += 1
        if self.runs[level] == self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        sums = self._read(f"level{level}").groupBy(*KEY).agg(F.sum("n").alias("n"))
        self._write(sums.where(F.col("n") >= self.least).select(*KEY), "common")
        self.decided = True
        self._push(sums.where(F.col("n") < self.least), level + 1)
        self.spark.sql(f"DROP TABLE {self.name}_level{level}")
        self.runs[level] = 0

    def common(self) -> DataFrame:
        """h1 and h2 of the keys in at least ``least`` documents, each once."""
        levels = [self._read(f"level{i}") for i, n in enumerate(self.runs) if n]
        found = self._read("common") if self.decided else None
        if levels:
            rest = levels[0]
            for more in levels[1:]:
                rest = rest.union(more)
            rest = rest.groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") >= self.least).select(*KEY)
            found = rest if found is None else found.union(rest)
        if found is None:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return found.distinct()

    def drop(self) -> None:
        for table in ["common", *(f"level{i}" for i in range(len(self.runs)))]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")


def kept_lines(text: Column, places: Column) -> Column:
    """``text`` without the lines at the sorted ``places``, by the stretches between them."""

    def cut(lines: Column) -> Column:
        def stretch(j: Column) -> Column:
            start = F.coalesce(F.get(places, j - 1) + 1, F.lit(0))
            return F.slice(lines, start + 1, F.coalesce(F.get(places, j), F.size(lines)) - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), stretch)), "\n")

    return F.when(places.isNull(), text).otherwise(let(lines_of(text), cut))


def dedup_lines(docs: DataFrame, least_docs: int = 10, least_length: int = 1, batches: int = BATCHES, fanout: int = FANOUT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, the text that stays, n_lines before dropping and n_dropped of each row of ``docs``."""
    lines = stored(hashed_lines(docs, least_length).withColumn("batch", F.pmod("t1", F.lit(batches)).cast("int")), "lines")
    runs = LineRuns(docs.sparkSession, least_docs, fanout)
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i))
    common = stored(runs.common(), "common-lines")
    runs.drop()
    common = F.broadcast(common) if common.count() <= broadcast_rows else common.hint("merge")
    hits = lines.join(common, list(KEY), "left_semi").groupBy("t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("places"))
    hits = stored(hits, "dropped-lines")
    found = text_of(docs).select("doc_id", "text", *names(F.col("text"), "t")).join(hits, ["t1", "t2"], "left")
    places = F.col("places")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    return found.select("doc_id", kept_lines(F.col("text"), places).alias("text"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.array_size(places), F.lit(0)).cast("long").alias("n_dropped"))
