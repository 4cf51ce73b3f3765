"""Joins on time, balanced products, bitmaps, sketches, grouping sets and streaming runs: results and the bounds that they promise."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, linalg, sketches, spread, telemetry, temporal, triangles
from loomgraph.plans.scratch import new_path
from loomgraph.streaming import runs
from tests.helpers import rows


def last_tags(stats, tags, within=None):
    out = []
    for t, s in stats:
        found = [] if t is None else [x for x in tags if x[0] is not None and x[0] <= t and (within is None or t - x[0] <= within)]
        out.append((t, s, *(max(found) if found else (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("within", (None, 5))
@pytest.mark.parametrize("span", (1, 50, 10**7, 10**15))
def test_as_of(spark, monkeypatch, span, within):
    monkeypatch.setattr(temporal, "LEVEL_BITS", 3)
    rng = random.Random(span)
    time = lambda: rng.choice([rng.randrange(-span, span), 7, 7, 7])
    stats = [(time(), i) for i in range(300)] + [(None, -1), (-(10**16), -2)]
    tags = [(time(), i) for i in range(40)] + [(None, 99), (7, 50), (7, 50)]
    a = spark.createDataFrame(stats, "SimTime long, stat long").repartition(3)
    b = spark.createDataFrame(tags, "SimTime long, tag long").repartition(2)
    assert rows(temporal.as_of_join(a, b, "SimTime", "tag", within)) == last_tags(stats, tags, within)


def test_as_of_empty_sides_and_clashes(spark):
    a = spark.createDataFrame([(5, 1)], "SimTime long, stat long")
    b = spark.createDataFrame([(5, 2)], "SimTime long, tag long")
    assert rows(temporal.as_of_join(a, b.limit(0), "SimTime", "tag")) == [(5, 1, None, None)]
    assert temporal.as_of_join(a.limit(0), b, "SimTime", "tag").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        temporal.as_of_join(a, b.withColumn("stat", F.lit(1)), "SimTime", "tag")


def test_as_of_groups_are_bounded(spark, monkeypatch):
    """No window orders more than 2**LEVEL_BITS rows, though half of all rows lie at one time."""
    monkeypatch.setattr(temporal, "LEVEL_BITS", 4)
    seen = []
    plain = temporal._last_before

    def watched(lasts, bits):
        seen.append(lasts.groupBy(F.shiftright("b", 4)).count().agg(F.max("count")).first()[0])
        return plain(lasts, bits)

    monkeypatch.setattr(temporal, "_last_before", watched)
    stats = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 777).otherwise(F.col("id") * 3).alias("SimTime"), F.col("id").alias("stat"))
    tags = spark.range(500).select((F.col("id") * 100).alias("SimTime"), F.col("id").alias("tag"))
    found = temporal.as_of_join(stats, tags, "SimTime", "tag")
    assert found.where("tag <> least(SimTime div 100, 499)").count() == 0 and found.count() == 20_000
    assert len(seen) == 4 and max(seen) <= 16
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # all orders were taken over distinct times, in tables of their own


def test_rows_of_hot_keys_are_dealt(spark):
    many = spark.range(8000).select(F.when(F.col("id") < 6000, 1).otherwise(F.col("id")).alias("k"), "id")
    one = spark.range(7000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    found = spread.join_one(many, one, "k", "left")
    assert found.count() == 8000 and found.where("v <> 2 * k OR (v IS NULL) <> (k >= 7000)").count() == 0
    assert spread.join_one(many, one, "k").count() == 7000


def overlaps(a, b):
    ok = lambda x: x[1] is not None and x[2] is not None and x[1] < x[2]
    return sorted(((x[0], y[0]) for x in a if ok(x) for y in b if ok(y) and x[1] < y[2] and y[1] < x[2]), key=repr)


@pytest.mark.parametrize("longest", (1, 30, 10**6, 10**15))
def test_overlaps(spark, longest):
    rng = random.Random(longest)

    def some(n):
        made = [(i, s := rng.randrange(-200, 200) * max(1, longest // 50), s + rng.choice([1, 2, 4, 16, 17, rng.randrange(1, longest + 1)])) for i in range(n)]
        return [*made, (n, 0, 0), (n + 1, 5, 3), (n + 2, None, 3), (n + 3, 0, None), (n + 4, 3, 4), (n + 5, -longest, longest)]

    a, b = some(80), some(70)
    x = spark.createDataFrame(a, "i long, s long, e long")
    y = spark.createDataFrame(b, "j long, t long, u long")
    assert rows(temporal.overlap_join(x, y, ("s", "e"), ("t", "u")), "i", "j") == overlaps(a, b)


def test_long_intervals_are_repeated_no_more_than_twice_a_level(spark):
    spans = spark.createDataFrame([(0, 0, 10**15), (1, 5, 6), (2, 10**9, 10**9 + 10**6)], "i long, s long, e long")
    levels = sorted({r.level for r in spans.select(temporal._level(F.col("e") - F.col("s")).alias("level")).collect()})
    assert len(levels) == 3
    for own, most in ((True, 2), (False, 2 * len(levels))):
        assert max(r["count"] for r in temporal._pieces(spans, "s", "e", own, levels).groupBy("i").count().collect()) <= most


# Products, bitmaps


def test_entries_of_a_long_row_fill_many_parts(spark):
    rng = random.Random(1)
    entries = [(3, c, 1.0) for c in range(4000)] + [(rng.randrange(1000), c % 50, 2.0) for c in range(4000)]
    matrix = spark.createDataFrame(entries, "row long, col long, val float")
    parts = linalg.entry_parts(matrix, per_part=250)
    sizes = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert len(sizes) == 32 and max(sizes.values()) < 400
    assert parts.where("row = 3").select("part").distinct().count() >= 16
    features = spark.createDataFrame([(c, [float(c), 1.0, -0.5]) for c in range(3900)], "node long, feat array<float>")  # some have none
    plain = {r.row: r.out for r in linalg.spmm(matrix, features).collect()}
    for per_part in (1, 250, 10**6):
        assert {r.row: r.out for r in linalg.spmm_balanced(matrix, features, per_part).collect()} == plain
    assert linalg.spmm_balanced(matrix.limit(0), features).count() == 0


@pytest.mark.parametrize("seed", (1, 2))
def test_bitmap_triangles(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(3000)] + [(1000, i) for i in range(300)] + [(5, 5), (7, 8), (8, 7)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    assert triangles.count_by_bitmaps(edges).first()[0] == triangles.count_triangles(edges).first()[0] > 0
    assert triangles.count_by_bitmaps(edges.limit(0)).first()[0] == 0


def test_overlap_sums_without_pairs(spark):
    rng = random.Random(7)
    spans = lambda n: [(i, s, s + rng.choice([-3, 0, 1, 2, 40, 500])) for i, s in enumerate(rng.randrange(-100, 400) for _ in range(n))] + [(n, None, 5), (n + 1, 5, None)]
    a, b = spans(150), spans(200)
    expected = []
    for i, s, e in a:
        if s is not None and e is not None and s < e:
            met = [min(e, u) - max(s, t) for _, t, u in b if t is not None and u is not None and t < u and s < u and t < e]
            expected += [(i, len(met), sum(met))] if met else []
    found = temporal.overlap_sums(spark.createDataFrame(a, "i long, s long, e long"), spark.createDataFrame(b, "j long, t long, u long"), ("s", "e"), ("t", "u"))
    assert sorted(map(tuple, found.select("i", "n", "shared").collect())) == sorted(expected)


@pytest.mark.parametrize("block_edges", (40, 1 << 24))
def test_triangles_in_blocks(spark, block_edges):
    """Lists meet closing edges in blocks, whose tasks are shared where many lists come; no wedge is a row of a join."""
    rng = random.Random(3)
    pairs = [(rng.randrange(-20, 100), rng.randrange(-20, 100)) for _ in range(1500)] + [(10**12, i) for i in range(90)] + [(10**12, 2 * 10**12), (4, 2 * 10**12)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    counts = {}
    for a, b in pairs:
        if a > b:
            counts[a, b] = counts.get((a, b), 0) + 1
    simple = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    near = lambda of: {(a, b, c) for a, b in of for x, c in of if x == b and (a, c) in of}
    expected = near(simple)
    undirected = graph.symmetrize_simple(edges)
    found = triangles._triangles(undirected, listed=True, block_edges=block_edges)
    assert sorted(tuple(sorted(r)) for r in found.collect()) == sorted(expected)
    for words in (False, True):
        assert triangles._sum(triangles._triangles(undirected, words=words, block_edges=block_edges)).first()[0] == len(expected)
    multi = edges.where("src > dst").groupBy("src", "dst").agg(F.count("*").alias("k"))
    wanted = sum(counts[n, v] * counts[v, w] * counts[n, w] for n, v, w in near(set(counts)))
    assert triangles._sum(triangles._triangles(multi, block_edges=block_edges)).first()[0] == wanted
    assert "LeftSemi" not in triangles.list_triangles(edges)._jdf.queryExecution().executedPlan().toString()


def test_cells_hold_each_pair_of_ranges_once_and_send_ends_a_few_times(spark):
    """A random graph's ends go about as often as the root of twice the cells, not once for each; and no edges stay on disk but the lists."""
    from pathlib import Path

    import numpy as np

    from loomgraph.plans.scratch import shared_folder

    closing = np.triu(np.full((64, 64), 100)) * 2 - np.diag(np.full(64, 100))
    cells = triangles._cells(closing, closing * 50, closing.sum() // 23, 10**9)
    seen = np.zeros((64, 64), int)
    for i0, i1, j0, j1, tasks in cells:
        seen[i0:i1, j0:j1] += 1
        assert tasks == 1 and (closing[i0:i1, j0:j1].sum() <= closing.sum() // 23)
    assert (np.triu(seen) == np.triu(np.ones((64, 64), int))).all() and len(cells) > 23
    assert sum(i1 - i0 + (j1 - j0 if i0 != j0 else 0) for i0, i1, j0, j1, _ in cells) / 64 <= (2 * len(cells)) ** 0.5 < 10
    edges = spark.createDataFrame([(i, (i * 7 + j) % 50) for i in range(50) for j in range(5)], "src long, dst long")
    left = lambda: set(Path(shared_folder(spark).removeprefix("file://")).glob("oriented-*"))
    before = left()
    assert triangles.count_triangles(edges).first()[0] > 0 and left() == before


def test_a_list_lies_in_blocks(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 1001)], "src long, dst long")
    found = triangles.adjacency_bitmaps(star)
    assert found.count() == 16 and found.agg(F.sum(F.bit_count("bits"))).first()[0] == 1000


# Sketches, grouping sets


def test_sketches_merge_within_their_bounds(spark):
    events = spark.range(60_000).select((F.col("id") % 30).alias("day"), F.pmod(F.xxhash64("id"), F.lit(9000)).alias("item"), (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(10**6)) / 1000).alias("value"))
    events = events.union(spark.createDataFrame([(0, None, None)], "day long, item long, value double"))
    days = sketches.daily(events, F.col("day"), "item", "value")
    assert days.selectExpr("max(length(items))", "max(length(ranks))").first()[0] < 10_000
    for span in (F.lit(0), F.floor(F.col("day") / 7)):
        exact = {r.span: r for r in events.groupBy(span.alias("span")).agg(F.countDistinct("item").alias("n"), F.collect_list("value").alias("v")).collect()}
        for r in sketches.estimates(sketches.over(days, span), (0.1, 0.5, 0.99)).collect():
            values = sorted(exact[r.span].v)
            assert abs(r.distinct_items - exact[r.span].n) <= sketches.COUNT_ERROR * exact[r.span].n
            for share, q in zip((0.1, 0.5, 0.99), r.q, strict=True):
                rank = sum(v <= q for v in values) / len(values)
                assert abs(rank - share) <= sketches.RANK_ERROR


def test_tier_sets_tell_nulls_from_totals(spark):
    accesses = spark.createDataFrame([(0, 1, "load", "dram"), (0, 2, "load", "dram"), (None, None, "store", "l2sp"), (0, None, "load", "l1sp")], "node long, thread long, op string, tier string")
    found = {(r.level, r.node, r.thread): (r.load_dram, r.load_l1sp, r.store_l2sp) for r in telemetry.tier_sets(accesses).collect()}
    assert found == {
        ("thread", 0, 1): (1, 0, 0), ("thread", 0, 2): (1, 0, 0), ("thread", 0, None): (0, 1, 0), ("thread", None, None): (0, 0, 1),
        ("node", 0, None): (2, 1, 0), ("node", None, None): (0, 0, 1), ("all", None, None): (2, 1, 1),
    }
    plan = telemetry.tier_sets(accesses)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and "Union" not in plan


# Streams


def events_of(spark, made):
    return spark.createDataFrame(made, "event_id long, user_id long, ts double, event_type string, value double").withColumn("ts", F.timestamp_seconds("ts"))


def test_visits_end_by_event_or_timer(spark):
    runs.rocks_state(spark)
    rng = random.Random(6)
    made = [(i, rng.randrange(5), float(rng.randrange(200_000)), "view", 1.0) for i in range(150)] + [(1000, 99, 300_000.0, "view", 1.0)]
    events = events_of(spark, made)
    found = runs.finish(runs.visits(runs.stream_of(spark, runs.in_order(events, 5), events.schema, 1), gap=3600), "visits")
    times = defaultdict(list)
    for _, user, t, *_ in made:
        times[user].append(int(t))
    expected = Counter()
    for user, ts in times.items():
        ts.sort()
        start = last = ts[0]
        n = 1
        for t in [*ts[1:], 10**9]:
            if t - last >= 3600:
                if last + 3600 <= 300_000 or t < 10**9:
                    expected[user, start * 10**6, last * 10**6, n] += 1
                start, n = t, 0
            last, n = t, n + 1
    assert Counter((r.user_id, r.start, r.last, r.n) for r in found.collect()) == expected


def test_users_of_a_group_keep_their_own_visits(spark):
    """All users in one group, one of them unknown: late events of others do not close or join a visit."""
    runs.rocks_state(spark)
    made = [(1, 7, 100.0, "v", 1.5), (2, 8, 200.0, "v", 1.0), (3, None, 300.0, "v", 4.0), (4, 7, 900.0, "v", 2.0), (5, 8, 5_000.0, "v", 1.0), (6, 9, 50_000.0, "v", 1.0)]
    events = events_of(spark, made)
    found = runs.finish(runs.visits(runs.stream_of(spark, runs.in_order(events, 2), events.schema, 1), gap=3600, groups=1), "visits")
    s = 10**6
    expected = [(7, 100 * s, 900 * s, 2, 3.5), (8, 200 * s, 200 * s, 1, 1.0), (8, 5_000 * s, 5_000 * s, 1, 1.0), (None, 300 * s, 300 * s, 1, 4.0)]
    assert rows(found) == sorted(expected, key=repr)


def test_late_rows_meet_nothing(spark):
    stats = events_of(spark, [(1, 7, 100_000.0, "s", 0.0), (2, 7, 500_000.0, "s", 0.0), (3, 7, 600_000.0, "s", 0.0)])
    tags = events_of(spark, [(11, 7, 100_100.0, "t", 0.0), (12, 7, 500_100.0, "t", 0.0), (14, 7, 600_100.0, "t", 0.0)])
    late = events_of(spark, [(13, 7, 100_200.0, "t", 0.0)])  # comes two batches after both streams have gone far beyond it
    folders = [new_path(spark, "side") for _ in range(2)]
    for i in range(3):
        for folder, side in zip(folders, (stats, tags), strict=True):
            side.orderBy("ts").limit(i + 1).orderBy(F.desc("ts")).limit(1).coalesce(1).write.mode("append").parquet(folder)
    late.coalesce(1).write.mode("append").parquet(folders[1])
    streams = [runs.stream_of(spark, f, stats.schema, 1) for f in folders]
    found = runs.finish(runs.tags_near(*streams, within="10 minutes", late="1 hour"), "near")
    assert rows(found) == [(1, 11, 7), (2, 12, 7), (3, 14, 7)]


def test_an_explicit_order_is_used_for_relabelling(spark):
    edges = spark.createDataFrame([(10, 20), (20, 30)], "src long, dst long")
    order = spark.createDataFrame([(10, 1, 2), (20, 2, 1), (30, 1, 0)], "src long, degree long, new_id long")
    assert rows(graph.relabel_by_degree(edges, order)) == [(1, 0), (2, 1)]
