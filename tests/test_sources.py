"""Readers on small files."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from loomgraph.operators import telemetry
from loomgraph.sources import graph_files, telemetry_files
from tests.helpers import rows


def put(path, text):
    path.write_text(text)
    return f"file://{path}"


def test_matrix_market(spark, tmp_path):
    general = put(tmp_path / "g.mtx", "%%MatrixMarket matrix coordinate real general\n% note\n3 3 2\n1 2 0.5\n3 3 2\n")
    assert rows(graph_files.read_matrix(spark, general)) == [(0, 1, 0.5), (2, 2, 2.0)]
    symmetric = put(tmp_path / "s.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n3 3 2\n2 1\n3 3\n")
    assert rows(graph_files.read_graph(spark, symmetric)) == [(0, 1), (1, 0), (2, 2), (2, 2)]
    integer = put(tmp_path / "i.mtx", "%%MatrixMarket matrix coordinate integer general\n2 2 1\n1 1 7\n")
    assert rows(graph_files.read_matrix(spark, integer)) == [(0, 0, 7.0)]


def test_coo_and_features(spark, tmp_path):
    coo = put(tmp_path / "a.txt", "4 4 2\n0 0\n3 1\n")
    assert rows(graph_files.read_coo(spark, coo)) == [(0, 0, 1.0), (3, 1, 1.0)]
    feats = put(tmp_path / "f.txt", "2 2\n1 2\n3\n4\n")
    assert rows(graph_files.read_features(spark, feats)) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]


def test_folders_whose_later_parts_are_larger(spark, tmp_path):
    """Lines count in order of the parts' names, though Spark reads the largest file first."""

    def folder(name, *parts):
        (tmp_path / name).mkdir()
        for i, text in enumerate(parts):
            put(tmp_path / name / f"part-{i:05d}.txt", text)
        return f"file://{tmp_path / name}"

    lines = [f"{i} {i + 1}" for i in range(1, 2001)]
    body = "\n".join(lines[1:]) + "\n"
    expected = [(i, i + 1) for i in range(1, 2001)]
    matrix = folder("m", "%%MatrixMarket matrix coordinate pattern general\n2002 2002 2000\n" + lines[0] + "\n", body)
    assert sorted(map(tuple, graph_files.read_graph(spark, matrix).collect())) == [(a - 1, b - 1) for a, b in expected]
    assert sorted(map(tuple, graph_files.read_coo(spark, folder("c", "2002 2002 2000\n" + lines[0] + "\n", body)).select("row", "col").collect())) == expected
    feats = graph_files.read_features(spark, folder("f", "2000 2\n" + lines[0] + "\n", body))
    assert sorted((r["node"], *r["feat"]) for r in feats.collect()) == [(a - 1, float(a), float(b)) for a, b in expected]
    edges = graph_files.read_edges(spark, folder("e", lines[0] + "\n", body)).orderBy("ord")
    assert [tuple(r) for r in edges.select("src", "dst").collect()] == expected


def test_edge_lists_skip_what_is_no_edge(spark, tmp_path):
    path = put(tmp_path / "e.txt", "# head\n1 2\n\n3 4 5\n 6 7 \n")
    assert rows(graph_files.read_edges(spark, path), "src", "dst") == [(1, 2), (6, 7)]


def test_records(spark, tmp_path):
    text = put(tmp_path / "v.txt", "1 2 0 5\n2 1 2 6\n")
    assert rows(graph_files.read_records(spark, text, graph_files.VERTEX)) == [(1, 2, 0, 5), (2, 1, 2, 6)]
    image = tmp_path / "v.bin"
    image.write_bytes(struct.pack("<q", 2) + struct.pack("<qqqi4x", 1, 2, 0, 5) + struct.pack("<qqqi4x", 2, 1, 2, 6))
    assert rows(graph_files.read_record_image(spark, f"file://{image}", graph_files.VERTEX)) == [(1, 2, 0, 5), (2, 1, 2, 6)]
    edge = tmp_path / "e.bin"
    edge.write_bytes(struct.pack("<q", 1) + struct.pack("<qqiii4xqq", 1, 2, 3, 4, 5, 6, 7))
    assert rows(graph_files.read_record_image(spark, f"file://{edge}", graph_files.EDGE)) == [(1, 2, 3, 4, 5, 6, 7)]


def test_raw_int8(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes([1, 255, 128, 127]))
    assert rows(graph_files.read_int8_matrix(spark, f"file://{tmp_path / 'a.bin'}", 2)) == [(0, 0, 1), (0, 1, -1), (1, 0, -128), (1, 1, 127)]


def test_larger_binary_files(spark, tmp_path):
    import numpy as np

    values = np.random.default_rng(1).integers(-128, 128, (20_000, 64), np.int8)
    (tmp_path / "m.bin").write_bytes(values.tobytes())
    found = graph_files.read_int8_matrix(spark, f"file://{tmp_path / 'm.bin'}", 64)
    weighted = found.selectExpr("sum(v * (i % 101 + 1) * (j + 1)) as s", "count(*) as n", "max(i) as i", "max(j) as j").first()
    i, j = np.indices(values.shape)
    assert tuple(weighted) == (int((values.astype(np.int64) * (i % 101 + 1) * (j + 1)).sum()), values.size, 19_999, 63)
    records = [(k, k % 5, 3 * k, k % 7) for k in range(250_000)]
    (tmp_path / "v.bin").write_bytes(graph_files.record_image(records, graph_files.VERTEX))
    read = graph_files.read_record_image(spark, f"file://{tmp_path / 'v.bin'}", graph_files.VERTEX, range_bytes=32_000)
    assert tuple(read.selectExpr("count(*)", "sum(id * (type + 1))", "max(start)").first()) == (250_000, sum(a * (t + 1) for a, _, _, t in records), 3 * 249_999)


def test_binary_files_are_split_between_records(spark, tmp_path):
    from loomgraph.sources.binary_files import Int8Matrix, RecordImage

    records = [(k, k % 5, 3 * k, k % 7) for k in range(1000)]
    (tmp_path / "v.bin").write_bytes(graph_files.record_image(records, graph_files.VERTEX) + b"beyond the count" * 4)
    path = f"file://{tmp_path / 'v.bin'}"
    ranges = RecordImage({"path": path, "fields": "id:long,edges:long,start:long,type:int", "range_bytes": "1000"}).reader(None).partitions()
    assert [(r.first, r.last) for r in ranges[:2]] == [(0, 31), (31, 62)] and max(r.last - r.first for r in ranges) == 31
    read = graph_files.read_record_image(spark, path, graph_files.VERTEX, range_bytes=1000)
    assert read.rdd.getNumPartitions() == len(ranges) and rows(read) == sorted(records, key=repr)
    for name, n in (("b.bin", 6), ("a.bin", 4), ("_hidden.bin", 2)):
        (tmp_path / "rows").mkdir(exist_ok=True)
        (tmp_path / "rows" / name).write_bytes(bytes(range(n)))
    folder = f"file://{tmp_path / 'rows'}"
    assert len(Int8Matrix({"path": folder, "cols": "2", "range_bytes": "2"}).reader(None).partitions()) == 5
    assert rows(graph_files.read_int8_matrix(spark, folder, 2, range_bytes=2)) == [(i, j, v) for i, j, v in [(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3), (2, 0, 0), (2, 1, 1), (3, 0, 2), (3, 1, 3), (4, 0, 4), (4, 1, 5)]]


def test_images_beyond_two_gigabytes(spark, tmp_path):
    n = (9 << 28) // 48  # 2.25 GB of records, all zero but the last; the file has holes
    with open(tmp_path / "large.bin", "wb") as f:
        f.write(n.to_bytes(8, "little"))
        f.seek(8 + (n - 1) * 48)
        f.write(struct.pack("<qqiii4xqq", 1, 2, 3, 4, 5, 6, 7))
    read = graph_files.read_record_image(spark, f"file://{tmp_path / 'large.bin'}", graph_files.EDGE)
    assert read.rdd.getNumPartitions() > 30
    assert tuple(read.selectExpr("count(*)", "sum(src)", "max(dst_glbid)").first()) == (n, 1, 7)


def test_images_are_written_by_tasks(spark, tmp_path):
    made = spark.range(10_000).selectExpr("id", "id % 7 AS edges", "id * 3 AS start", "id % 4 AS type").repartition(3)
    path = f"file://{tmp_path / 'image'}"
    graph_files.write_record_image(made, path, graph_files.VERTEX, range_bytes=32_000)
    files = [x.name for x in (tmp_path / "image").iterdir()]
    assert len(files) >= 10 and all(x.startswith("part-") for x in files)  # whole files, none hidden
    assert max((tmp_path / "image" / x).stat().st_size for x in files) <= 32_008
    assert rows(graph_files.read_record_image(spark, path, graph_files.VERTEX)) == sorted(((k, k % 7, 3 * k, k % 4) for k in range(10_000)), key=repr)
    none = f"file://{tmp_path / 'none'}"
    graph_files.write_record_image(made.limit(0), none, graph_files.VERTEX)
    assert graph_files.read_record_image(spark, none, graph_files.VERTEX).count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    import pytest

    bad = spark.range(2000).selectExpr("id", "CASE WHEN id < 1999 THEN id ELSE assert_true(false) END AS b")
    with pytest.raises(Exception, match="not true"):
        graph_files.write_int8_matrix(bad.selectExpr("id % 100", "CAST(b AS INT) % 100"), f"file://{tmp_path / 'bad'}", range_bytes=200)
    assert not (tmp_path / "bad").exists() or all(x.name.startswith("_") for x in (tmp_path / "bad").iterdir())


def test_unsupported_matrix_files_are_refused(spark, tmp_path):
    import pytest

    for n, kind in enumerate(("coordinate complex general", "coordinate real skew-symmetric", "array real general")):
        with pytest.raises(ValueError):
            graph_files.read_matrix(spark, put(tmp_path / f"{n}.mtx", f"%%MatrixMarket matrix {kind}\n1 1 1\n1 1 1\n"))


def test_scratch_folders_are_removed(spark, tmp_path):
    from loomgraph.plans import scratch

    df = scratch.stored(spark.range(3).toDF("x"), "gone")
    assert df.count() == 3
    path = scratch._WRITTEN[-1]
    assert path in scratch.clear() and path not in scratch._WRITTEN


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from loomgraph.plans import scratch

    class Session:
        conf = {"spark.master": "spark://host:7077"}

    with pytest.raises(ValueError):
        scratch.shared_folder(Session())


def test_scratch_without_a_named_folder(tmp_path):
    """The README's first example, in a session of its own that names no folder."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = """
from loomgraph.plans.session import local_session
from loomgraph.plans import scratch
from loomgraph.operators import graph, traverse
spark = local_session(2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
found = traverse.bfs(graph.grid(spark, 5, 4), root=0)
assert found.distances.count() == 20 and scratch.stored(found.levels, "levels").count() > 0
assert scratch.shared_folder(spark) == scratch.shared_folder(spark) and len(scratch.clear()) > 0
"""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parent.parent), "SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], env=env, check=True, timeout=300, cwd=tmp_path)


def test_stats_tags_and_traces(spark, tmp_path):
    stats = telemetry_files.read_stats(spark, put(tmp_path / "stats.csv", "StatisticName,Sum.u64,SimTime\nADD_instruction,18446744073709551615,5\nLW_instruction,1,7\n"))
    tags = telemetry_files.read_tags(spark, put(tmp_path / "tags.csv", "SimTime,TagName\n5,a\n5,b\n"))
    assert rows(telemetry.join_tags(stats, tags), "TagName") == [("a",), ("b",)]
    mix = telemetry.opcode_mix(stats).first()
    assert int(mix.total) == 18446744073709551616 and int(mix.memory) == 1 and int(mix.integer) == 18446744073709551615
    trace = put(tmp_path / "t.txt", "@12: OP=READ:SRC_PXN=0:SRC_POD=1:SRC_CORE=2:SRC_THREAD=3:DST_PXN=1:ADDR=0x10\nnoise\n")
    assert rows(telemetry_files.read_trace(spark, trace).withColumn("addr", F.col("addr").cast("long"))) == [("READ", 0, 1, 2, 3, 1, 16)]


def test_streaming_reports(spark):
    from loomgraph.streaming import tags

    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    for name, df in (("counts", tags.windowed_counts(events)), ("visits", tags.sessions(events))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() > 0
