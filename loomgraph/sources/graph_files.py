"""Readers and writers of graph and matrix files: Matrix-Market, COO, edge lists, features, vertex and edge tables, raw int8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.scratch import stored
from loomgraph.sources import binary_files


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, block, n): trimmed lines of a file, or of a folder's files in order of their names.

    Spark gives the largest files to the first tasks, so ``n`` rises only inside a
    ``block``, the part of a file that one task reads; ``AT`` orders all lines.
    """
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return spark.read.text(path).select(F.trim("value").alias("line"), block.alias("block"), F.monotonically_increasing_id().alias("n"))


#: The place of a line among all lines of ``_lines``.
AT = ("block", "n")


def _first(lines: DataFrame):
    """The first of ``lines`` with its place, or None."""
    return lines.agg(F.min_by(F.struct("line", "block", "n"), F.struct(*AT)).alias("first")).first()["first"]


def _others(lines: DataFrame, one) -> DataFrame:
    """``lines`` without the line at the place of ``one``."""
    return lines.where((F.col("block.file") != one["block"]["file"]) | (F.col("n") != one["n"]))


def _with_bases(lines: DataFrame, size: Column) -> DataFrame:
    """``lines`` with ``base``, the sum of ``size`` over all blocks before their own; one window orders the blocks."""
    totals = lines.groupBy("block").agg(F.sum(size).alias("total"))
    bases = totals.select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("base"))
    return lines.join(F.broadcast(bases), "block")


def _parts(df: DataFrame) -> DataFrame:
    return df.withColumn("p", F.split("line", r"\s+"))


def banner(spark: SparkSession, path: str) -> dict:
    """Field (real, integer, pattern) and symmetry of a Matrix-Market file, and its size line."""
    head = _lines(spark, path).where("line <> ''")
    first = _first(head)
    words = first["line"].lower().split() if first else []
    if len(words) != 5 or words[0] != "%%matrixmarket" or words[1] != "matrix" or words[2] != "coordinate":
        raise ValueError(f"{path} is not a Matrix-Market coordinate file")
    if words[3] not in ("real", "integer", "pattern") or words[4] not in ("general", "symmetric"):
        raise ValueError(f"unsupported Matrix-Market field or symmetry: {words[3]} {words[4]}")
    size = _first(head.where(~F.col("line").startswith("%")))
    if size is None:
        raise ValueError(f"{path} has no size line")
    rows, cols, entries = (int(x) for x in size["line"].split())
    return {"field": words[3], "symmetry": words[4], "rows": rows, "cols": cols, "entries": entries, "size_line": size}


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, val) with ids from 0. Symmetric files give every entry in both directions, entries on the diagonal too."""
    about = banner(spark, path)
    body = _parts(_others(_lines(spark, path), about["size_line"]).where((F.col("line") != "") & ~F.col("line").startswith("%")))
    val = F.lit(1.0).cast("float") if about["field"] == "pattern" else F.col("p")[2].cast("float")
    made = body.select((F.col("p")[0].cast("long") - 1).alias("row"), (F.col("p")[1].cast("long") - 1).alias("col"), val.alias("val"))
    if about["symmetry"] == "symmetric":
        made = made.union(made.select("col", "row", "val"))
    return made


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a Matrix-Market file."""
    return read_matrix(spark, path).select(F.col("row").alias("src"), F.col("col").alias("dst"))


def write_lines(lines: DataFrame, header: list[str], path: str) -> None:
    """Write ``header`` and then the lines (at, value) in order of ``at``, as one folder of parts in order."""
    head = lines.sparkSession.createDataFrame([(0, i, h) for i, h in enumerate(header)], "o int, at long, value string")
    every = head.union(lines.select(F.lit(1).alias("o"), F.col("at").cast("long").alias("at"), "value"))
    every.repartitionByRange("o", "at").sortWithinPartitions("o", "at").select("value").write.text(path)


def write_matrix(matrix: DataFrame, path: str, rows: int, cols: int, field: str = "real") -> None:
    """Write (row, col, val) as Matrix-Market text: header and entries, ids from 1, as one folder of parts in order."""
    spark = matrix.sparkSession
    matrix = stored(matrix, "matrix")
    head = spark.createDataFrame([(0, f"%%MatrixMarket matrix coordinate {field} general"), (1, f"{rows} {cols} {matrix.count()}")], "o long, value string")
    columns = [F.col("row") + 1, F.col("col") + 1] + ([] if field == "pattern" else [F.col("val")])
    body = matrix.select(F.lit(2).cast("long").alias("o"), F.concat_ws(" ", *columns).alias("value"), "row", "col")
    every = head.select("o", "value", F.lit(-1).cast("long").alias("row"), F.lit(-1).cast("long").alias("col")).union(body)
    every.repartitionByRange("o", "row", "col").sortWithinPartitions("o", "row", "col").select("value").write.text(path)


def read_coo(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, val = 1) of a file whose first line is ``rows cols entries`` and whose ids start at 0."""
    lines = _lines(spark, path).where("line <> ''")
    first = _first(lines)
    body = _parts(lines if first is None else _others(lines, first))
    return body.select(F.col("p")[0].cast("long").alias("row"), F.col("p")[1].cast("long").alias("col"), F.lit(1.0).cast("float").alias("val"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(node, feat) of a file whose first line is ``rows width``; values may be broken over lines at will."""
    lines = _lines(spark, path).where("line <> ''")
    first = _first(lines)
    width = int(first["line"].split()[1])
    # A running count gives each value its place: per part of a file first, then over the parts.
    parts = _parts(_others(lines, first)).select("block", "n", "p", F.size("p").alias("k"))
    inside = _with_bases(parts, F.col("k")).withColumn("before", F.sum("k").over(Window.partitionBy("block").orderBy("n")) - F.col("k"))
    each = inside.select((F.col("base") + F.col("before")).alias("at"), F.posexplode("p").alias("i", "x"))
    place = F.col("at") + F.col("i")
    each = each.select(F.floor(place / width).alias("node"), (place % width).alias("k"), F.col("x").cast("float").alias("x"))
    return each.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("feat"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, ord) of an edge list; blank lines, ``#`` lines and lines without exactly two fields are skipped."""
    lines = _parts(_lines(spark, path).where((F.col("line") != "") & ~F.col("line").startswith("#"))).where(F.size("p") == 2)
    # Places among the lines of a block follow from its first one, so no window orders a block's lines.
    starts = lines.groupBy("block").agg(F.min("n").alias("start"), F.max("n").alias("end"))
    taken = F.col("end") - F.col("start") + 1
    bases = starts.select("block", (F.sum(taken).over(Window.orderBy("block")) - taken - F.col("start")).alias("base"))
    return lines.join(F.broadcast(bases), "block").select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"), (F.col("base") + F.col("n")).alias("ord"))


# Fields of vertex and edge records, in order.
VERTEX = (("id", "long"), ("edges", "long"), ("start", "long"), ("type", "int"))
EDGE = (("src", "long"), ("dst", "long"), ("type", "int"), ("src_type", "int"), ("dst_type", "int"), ("src_glbid", "long"), ("dst_glbid", "long"))


def read_records(spark: SparkSession, path: str, fields: tuple) -> DataFrame:
    """Space-separated vertex (``VERTEX``) or edge (``EDGE``) records; write them as Parquet for later use."""
    schema = ", ".join(f"{n} {t}" for n, t in fields)
    return spark.read.schema(schema).option("sep", " ").csv(path)


def read_record_image(spark: SparkSession, path: str, fields: tuple, range_bytes: int = binary_files.RANGE_BYTES) -> DataFrame:
    """Records of a binary image, or of a folder of images, of any size: each range of ``range_bytes`` is a task."""
    binary_files.register(spark)
    named = ",".join(f"{n}:{t}" for n, t in fields)
    return spark.read.format("record_image").option("fields", named).option("range_bytes", range_bytes).load(path)


def write_record_image(records: DataFrame, path: str, fields: tuple, range_bytes: int = binary_files.RANGE_BYTES) -> None:
    """Write records as a folder of images, by tasks."""
    binary_files.register(records.sparkSession)
    named = ",".join(f"{n}:{t}" for n, t in fields)
    typed = records.select(*[F.col(n).cast(t) for n, t in fields])
    typed.write.format("record_image").option("fields", named).option("range_bytes", range_bytes).mode("append").save(path)


def record_image(rows: list[tuple], fields: tuple) -> bytes:
    """The image of a small number of records."""
    import numpy as np

    return len(rows).to_bytes(8, "little") + np.array(rows, binary_files.record_type(fields)).tobytes()


def read_int8_matrix(spark: SparkSession, path: str, cols: int, range_bytes: int = binary_files.RANGE_BYTES) -> DataFrame:
    """(i, j, v) of a raw row-major int8 file, or of a folder of such files in order of their names."""
    binary_files.register(spark)
    return spark.read.format("int8_matrix").option("cols", cols).option("range_bytes", range_bytes).load(path)


def write_int8_matrix(rows: DataFrame, path: str, range_bytes: int = binary_files.RANGE_BYTES) -> None:
    """Write numeric columns as matrix rows, in the order of the partitions and of the rows in them."""
    binary_files.register(rows.sparkSession)
    rows.write.format("int8_matrix").option("range_bytes", range_bytes).mode("append").save(path)
