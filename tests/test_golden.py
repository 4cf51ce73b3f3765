"""Published and derived answers of the reference's own inputs."""

from __future__ import annotations

import math
import random

import pytest

from pyspark.sql import functions as F

from loomgraph.functions import intmath
from loomgraph.operators import address, community, graph, irregular, linalg, rank, replay, sampling, telemetry, traverse, triangles

# The built-in graph of 12 vertices.
EDGES12 = [(1, 2), (2, 3), (3, 1), (2, 4), (3, 4), (5, 6), (6, 7), (7, 5), (6, 8), (7, 8), (9, 10), (10, 11), (11, 9), (11, 12)]
from tests.helpers import rows


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def mix(x):
    x ^= x >> 16
    x = x * 0x7FEB352D & 0xFFFFFFFF
    x ^= x >> 15
    x = x * 0x846CA68B & 0xFFFFFFFF
    return x ^ x >> 16


def test_triangles_of_the_built_in_graph(spark):
    found = rows(triangles.list_triangles(edges(spark, EDGES12)))
    assert found == [(1, 2, 3), (2, 3, 4), (5, 6, 7), (6, 7, 8), (9, 10, 11)]


def test_triangles_ignore_ids_out_of_range(spark):
    dirty = EDGES12 + [(30, 1412), (1412, 30), (30, 3352), (30, 7478), (3, 28)]
    clean = graph.undirected(edges(spark, dirty), max_id=12)
    assert triangles.count_triangles(clean).first()[0] == 5
    assert triangles.count_by_intersection(clean).first()[0] == 5


def test_parallel_edges_count_in_the_ordered_count(spark):
    once = graph.undirected(edges(spark, [(1, 2), (2, 3), (1, 3)]))
    twice = graph.undirected(edges(spark, [(1, 2), (2, 3), (1, 3), (1, 3)]))
    assert triangles.count_ordered_multi(once).first()[0] == 1
    assert triangles.count_ordered_multi(twice).first()[0] == 2


def test_grid_searches(spark):
    found = traverse.bfs(graph.grid(spark, 5, 5), 0)
    assert tuple(traverse.summary(found.distances).first()) == (25, 8, 100)
    assert triangles.count_triangles(graph.grid(spark, 6, 6)).first()[0] == 0


def test_directions_agree_and_unreachable_is_minus_one(spark):
    e = graph.symmetrize_both(edges(spark, EDGES12))
    push, pull = (rows(traverse.bfs(e, 1, d).distances) for d in ("push", "pull"))
    assert push == pull
    assert dict(push)[4] == 2 and dict(push)[12] == -1


def test_pagerank_sums_to_one(spark):
    ranks = rank.pagerank(graph.grid(spark, 6, 6), iterations=12)
    assert abs(ranks.agg(F.sum("rank")).first()[0] - 1) < 1e-9
    corner = {r.v: r["rank"] for r in ranks.collect()}
    assert math.isclose(corner[0], corner[35])


def test_leiden_like_in_ascending_order(spark):
    parts = community.local_moving(edges(spark, EDGES12))
    refined = community.refine(edges(spark, EDGES12), parts)
    groups = sorted(tuple(r.members) for r in community.members(refined).collect())
    assert groups == [(1, 2, 3, 4), (5, 6, 7, 8), (9, 11, 12), (10,)]


def test_components_move_apart_with_the_same_result(spark):
    """Each component is moved by itself, and as in one run over the whole graph."""
    pairs = EDGES12 + [(a + 100, b + 100) for a, b in EDGES12[:9]] + [(200, 201), (201, 202), (5, 5)]
    for gain, order in (("reference", None), ("standard", None), ("reference", list(range(300, -1, -1)))):
        made = community.local_moving(edges(spark, pairs), 10, gain, order)
        assert dict(map(tuple, made.collect())) == community._move([p for p in pairs if p[0] != p[1]], 10, gain, order)
    assert "FlatMapGroupsInPandas [root" in made._jdf.queryExecution().optimizedPlan().toString()


def test_parallel_moving_keeps_components_apart(spark):
    own = {r.v: r.comm for r in community.parallel_moving(edges(spark, EDGES12)).collect()}
    assert not {own[v] for v in (1, 2, 3, 4)} & {own[v] for v in (5, 6, 7, 8)}


def test_parallel_moving_by_blocks_equals_plain_rounds(spark):
    """Blocks of a few edges, and one for all, give what rounds over all edges give; repeated edges, loops and null ends too."""
    import random

    rng = random.Random(3)
    pairs = [(rng.randint(0, 40) - 9, rng.randint(0, 40) - 9) for _ in range(150)] + [(None, 3), (7, 7), (10**12, 5)]
    kept = [p for p in pairs if None not in p and p[0] != p[1]]
    ids = sorted({v for p in kept for v in p})
    near = {v: [b for a, b in kept if a == v] + [a for a, b in kept if b == v] for v in ids}
    hashes = spark.createDataFrame([(v,) for v in ids], "v long").select("v", *[F.pmod(F.xxhash64("v", F.lit(i)), F.lit(2)) for i in range(3)]).collect()
    parity = {r[0]: r[1:] for r in hashes}
    own, m2 = {v: v for v in ids}, 2 * len(kept)
    for i in range(5):
        total = {}
        for v in ids:
            total[own[v]] = total.get(own[v], 0) + len(near[v])
        then = dict(own)
        for v in ids:
            if parity[v][i // 2] != i % 2:
                continue
            there = [then[u] for u in near[v]]
            k, stay, rest = len(there), there.count(then[v]), total[then[v]] - len(there)
            offers = [((there.count(c) - stay) * m2 - k * total[c] + k * rest, -c) for c in set(there) - {then[v]}]
            best = max(offers, default=(0, 0))
            if best[0] > 0:
                own[v] = -best[1]
    given = spark.createDataFrame(pairs, "src long, dst long")
    for size in (7, 1 << 20):
        assert dict(map(tuple, community.parallel_moving(given, block_edges=size).collect())) == own
    assert community.parallel_moving(given.limit(0)).count() == 0


def test_a_round_of_moves_sends_packed_rows_of_pairs_of_blocks(spark, monkeypatch):
    """No row stands for a vertex that a block reads; a round's files go with the next."""
    from loomgraph.plans import scratch

    plans, real = [], scratch.Rounds.keep
    monkeypatch.setattr(scratch.Rounds, "keep", lambda self, df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(self, df))[1])
    pairs = [(i, (i * 7 + j) % 60) for i in range(60) for j in range(4) if i != (i * 7 + j) % 60]
    small, large = (dict(map(tuple, community.parallel_moving(edges(spark, pairs), 3, size).collect())) for size in (9, 1 << 20))
    assert small == large and len(plans) == 8
    assert all(p.count("FlatMapCoGroupsInArrow") == 2 and p.count("Join Inner") == 1 for p in plans[1:4])


def test_pulling_meets_the_frontier_before_edges_are_exchanged(spark, monkeypatch):
    plans, real = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1])
    path = edges(spark, [(i, i + 1) for i in range(12)] + [(3, 20), (20, 3), (30, 31), (5, 5)])
    found = traverse.bfs(graph.symmetrize_both(path), 0, "pull")
    assert dict(map(tuple, found.distances.collect())) == {i: i for i in range(13)} | {20: 4, 30: -1, 31: -1}
    assert any("LeftSemi, (src" in p for p in plans) and not any("LeftSemi, (dst" in p for p in plans)


@pytest.mark.parametrize("gain", ("reference", "standard"))
def test_moves_by_colour_equal_serial_moves(spark, gain):
    from loomgraph.plans import derived

    sf = "/root/testdata/sf0.001"
    graph12 = edges(spark, EDGES12 + [(1, 12), (12, 12), (1, 2)])
    sparse = derived.supply(spark, sf).where("src % 5 = 0")
    for graph_edges, passes in ((graph12, 10), (sparse, 2)):
        coloured = community.colours(graph_edges)
        of = {r.v: r.colour for r in coloured.collect()}
        pairs = [tuple(r) for r in graph_edges.collect() if r.src != r.dst]
        assert all(of[a] != of[b] for a, b in pairs) and set(of) == {v for p in pairs for v in p}
        groups = [[v for v in sorted(of) if of[v] == c] for c in sorted(set(of.values()))]
        found = {r.v: r.comm for r in community.moving_by_colours(graph_edges, passes, gain, coloured).collect()}
        assert found == community._move(pairs, passes, gain, None, groups)
    assert community.moving_by_colours(graph12.limit(0)).count() == 0


def test_components_are_coloured_and_moved_by_tasks(spark, monkeypatch):
    """Small components take no job for each colour; the result is that of the jobs."""
    pairs = EDGES12 + [(200, 201), (1, 2), (5, 5)]
    some = dict(map(tuple, community.moving_by_colours(edges(spark, pairs), 1, "standard", None, 4).collect()))
    monkeypatch.setattr(community, "_moving_jobs", None)
    assert dict(map(tuple, community.moving_by_colours(edges(spark, pairs), 1, "standard").collect())) == some


def test_components_reach_their_task_in_packed_blocks(spark):
    """Blocks of a few edges give what plain serial moves give; a task holds four bytes for each end of an edge."""
    import random

    import numpy as np

    rng, held = random.Random(5), []
    pairs = list({(a, b) for a, b in ((rng.randint(0, 60), rng.randint(0, 60) + 10**10 * (i % 2)) for i in range(300)) if a != b}) + [(-9, -8), (-8, -7)]
    simple = spark.createDataFrame(pairs, "src long, dst long")
    vertices = community.connected_components(community.forest(simple)).withColumn("tag", F.lit(0))

    def move(graph, _):
        assert graph.near.dtype == np.int32
        return community._moves(graph, 4, "reference", list(range(len(graph.ids))), None, 2 * len(pairs))

    for size in (7, 1 << 20):
        held.append(dict(map(tuple, community._by_component(simple, vertices, move, size).collect())))
    assert held[0] == held[1] == community._move(pairs, 4, "reference", None)


def test_colours_of_a_component_beyond_four_million_edges_are_moved_by_a_task(spark):
    """Such a component takes no job for each colour: the driver's tables have 36 million edges, six times them 216 million."""
    assert community.TASK_EDGES >= 216_000_000
    graph12 = edges(spark, EDGES12)
    coloured = community.colours(graph12)
    plain = {r.v: r.comm for r in community.moving_by_colours(graph12, 3, "standard").collect()}
    assert plain == {r.v: r.comm for r in community.moving_by_colours(graph12, 3, "standard", coloured).collect()}


def test_forest_keeps_components(spark, monkeypatch):
    from loomgraph.operators import components

    monkeypatch.setattr(components, "FOREST_EDGES", 5)
    e = edges(spark, EDGES12 + [(i, i + 1) for i in range(50, 20, -1)] + [(7, 7), (90, 80), (80, 90)])
    assert rows(components.connected_components(components.forest(e))) == rows(components.connected_components(e))


def test_numbered_edges_of_a_hub(spark):
    hub = [(0, i) for i in range(500)] + [(1, 7), (1, 7), (2, 0)]
    found = sampling.numbered_edges(edges(spark, hub), per_block=20)
    assert rows(found, "src", "pos") == sorted(((v, i) for v, n in ((0, 500), (1, 2), (2, 1)) for i in range(n)), key=repr)
    assert rows(found, "src", "dst") == sorted(hub, key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "[src" in plan and sampling.numbered_edges(edges(spark, hub), per_block=20).where("src = 0").count() == 500


def test_atomics_are_replayed(spark):
    ops = [(1, "add", 5, 0), (1, "cas", 9, 1), (1, "max", 3, 2), (1, "or", 8, 3), (1, "swap", -1, 4), (2, "cas", 7, 0), (2, "cas", 8, 1), (2, "add", 1, 2), (3, "max", 2**63 - 1, 0), (3, "add", 1, 1), (3, "max", 4, 1)]
    found = replay.replay(spark.createDataFrame(ops[::-1], "addr long, op string, val long, t long"))
    expected = [(1, 0, "add", 5, 0, 5), (1, 1, "cas", 9, 5, 5), (1, 2, "max", 3, 5, 5), (1, 3, "or", 8, 5, 13), (1, 4, "swap", -1, 13, -1), (2, 0, "cas", 7, 0, 7), (2, 1, "cas", 8, 7, 7), (2, 2, "add", 1, 7, 8), (3, 0, "max", 2**63 - 1, 0, 2**63 - 1), (3, 1, "add", 1, 2**63 - 1, -(2**63)), (3, 1, "max", 4, -(2**63), 4)]
    assert rows(found) == expected


def test_ranks_go_on_from_where_they_were(spark):
    e = edges(spark, EDGES12 + [(b, a) for a, b in EDGES12])
    last, changes = rank.pagerank_rounds(e, 7)
    plain = {r.v: r.rank for r in rank.pagerank(e, 7).collect()}
    again = {r.v: r.rank for r in rank.pagerank(e, 4, start=rank.pagerank(e, 3)).collect()}
    assert all(math.isclose(plain[r.v], r.rank) and math.isclose(plain[r.v], again[r.v]) for r in last.collect())
    l1 = [r.l1 for r in changes.orderBy("round").collect()]
    assert len(l1) == 7 and l1 == sorted(l1, reverse=True)
    assert rank.pagerank(e.limit(0), 3).count() == 0


def test_rounds_of_ranks_do_not_pile_up_on_disk(spark):
    """The shared folder holds the last round only, and shuffle files go with the round that wrote them."""
    from pathlib import Path

    from loomgraph.plans.scratch import shared_folder

    place, e = Path(shared_folder(spark).removeprefix("file://")), graph.grid(spark, 30, 40)
    files = lambda: sum(1 for p in place.rglob("*") if p.is_file())
    grown = []
    for rounds in (2, 12):
        before = files()
        assert rank.pagerank_rounds(e, rounds)[1].count() == rounds
        grown.append(files() - before)
    assert grown[0] == grown[1]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_counter_generator(spark):
    state, first = 123, []
    for _ in range(5):
        state = (state + 0x9E3779B9) & 0xFFFFFFFF
        first.append(mix(state))
    draws = spark.range(1, 6).select("id", intmath.splitmix32(123, F.col("id")).alias("r"))
    assert [r.r for r in draws.orderBy("id").collect()] == first


def test_softmax_modes(spark):
    scores = spark.createDataFrame([(0, j, s * 65536) for j, s in enumerate((0, -1, -2))], "i long, j long, s long")
    exact = {r.j: r.p for r in linalg.softmax_q16(scores, mode="exact").collect()}
    total = sum(math.exp(-x) for x in range(3))
    assert all(abs(exact[j] / 65536 - math.exp(-j) / total) < 1e-4 for j in range(3))


def test_series_of_exp(spark):
    xs = spark.createDataFrame([(-1,), (-2,), (-4,), (-8,)], "x long")
    got = [r.y / 65536 for r in xs.select(intmath.exp_q16(F.col("x") * 65536).alias("y")).collect()]
    assert [round(y, 5) for y in got] == [0.375, 0.33325, 4.99805, 110.29688]


def test_spmm_small(spark):
    entries = [(0, 0), (0, 2), (2, 2), (2, 3), (3, 0), (3, 1), (3, 2), (3, 3)]
    m = spark.createDataFrame([(r, c, 1.0) for r, c in entries], "row long, col long, val float")
    f = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(4)], "node long, feat array<float>")
    out = {r.row: r.out for r in linalg.spmm(m, f, spark.range(4).select(F.col("id").alias("row"))).collect()}
    assert out == {0: [2, 2], 1: [0, 0], 2: [2, 2], 3: [4, 4]}


def test_gemm_forms_agree(spark):
    rng = random.Random(1)
    a = spark.createDataFrame([(i, k, rng.randint(-8, 7)) for i in range(9) for k in range(7)], "i long, k long, v long")
    b = spark.createDataFrame([(k, j, rng.randint(-8, 7)) for k in range(7) for j in range(5)], "k long, j long, v long")
    assert rows(linalg.gemm(a, b)) == rows(linalg.gemm_tiled(a, b, tile=4))


def test_list_and_ring(spark):
    nodes = spark.range(10_000).select("id", F.when(F.col("id") < 9_999, F.col("id") + 1).otherwise(-1).alias("next"), intmath.mix32(F.col("id")).alias("val"))
    head = irregular.list_rank(nodes).where("id = 0").first()
    assert (head.steps, head.sum_val, head.xor_ids, head["last"]) == (10_000, 21246795055050, 0, 9_999)
    assert tuple(irregular.ptr_chase(spark, 10_000, 7, 0, 10_000).first()) == (0, 49995000, 21246795055050)


def test_a_cycle_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError):
        irregular.list_rank(spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "id long, next long, val long"))


def test_generator_against_plain_python(spark):
    word = (1 << 64) - 1

    def step(x):
        x ^= x << 13 & word
        x ^= (~x & word) >> 7
        return x ^ (x << 17 & word)

    found = rows(irregular.gups_updates(spark, 3, 6, 1000), "thread", "u", "idx")
    expected = []
    for t in range(3):
        x = t
        for u in range(6):
            x = step(x)
            expected.append((t, u, x % 1000))
    assert found == sorted(expected, key=repr)


def test_fib(spark):
    assert irregular.fib(spark, 14).first()[0] == 377


def test_addresses(spark):
    layout = address.Layout(1, 1, 1)
    info = F.struct(F.lit(True).alias("absolute"), F.lit("dram").alias("tier"), *[F.lit(0).cast("long").alias(n) for n in ("pxn", "pod", "core")], F.lit(4096).cast("long").alias("offset"))
    got = spark.range(1).select(layout.encode(info).alias("a")).first().a
    assert got & ((1 << 64) - 1) == (3 << 62) | 4096
    assert address.banks(0, 0) == 1 and address.bank_range(1, 1024, 256, 512) == (256, 2047)


def test_opcode_classes():
    from collections import Counter

    found = telemetry.opcode_classes()
    assert Counter(found.values()) == {"memory": 106, "integer": 54, "branch": 8, "float": 242}
    assert "LRW_RL" not in found and found["FLW"] == "float"


def test_samples_with_replacement_take_existing_edges(spark):
    e = graph.symmetrize_both(edges(spark, EDGES12))
    roots = spark.createDataFrame([(1,), (9,)], "v long")
    known = {tuple(r) for r in e.collect()}
    assert {(r.src, r.dst) for r in sampling.random_k(e, roots).collect()} <= known
    per_slot = sampling.cache_hits(spark.createDataFrame([(1, 1), (1, 2), (9, 3), (1, 4)], "id long, t long"), 8)
    assert rows(per_slot) == [(1, 4, 1)]
    assert sampling.hit_rate(per_slot).first().percent == 25.0


def test_ranks_by_small_blocks_of_a_directed_graph(spark):
    """Several blocks, sinks, sources and repeated edges; a round is exchanged by pairs of blocks, not by edges."""
    from loomgraph.operators.rank import _blocks, _ranks

    pairs = [(i, (i * 7 + j) % 40) for i in range(30) for j in range(1 + i % 4)] + [(3, 99), (3, 99), (-5, 3)]
    ids = sorted({v for p in pairs for v in p})
    out = {v: sum(a == v for a, _ in pairs) for v in ids}
    expected = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(6):
        got = dict.fromkeys(ids, 0.0)
        for a, b in pairs:
            got[b] += expected[a] / out[a]
        expected = {v: 0.15 / len(ids) + 0.85 * got[v] for v in ids}
    e = edges(spark, pairs)
    found = {r.v: r["rank"] for r in _ranks(e, 6, 0.85, None, False, 10)[0].collect()}
    assert found.keys() == expected.keys() and all(math.isclose(found[v], expected[v]) for v in ids)
    read = _blocks(e, 10)
    assert read.count() > 4 and read.select(F.explode("idx").alias("x")).agg(F.sum(F.octet_length("x") / 4)).first()[0] < len(pairs)


def test_replay_goes_on_over_batches(spark):
    ops = [(1, ("add", "or", "max", "cas", "swap")[i * 3 % 5], i * 5 % 7, i) for i in range(50)]
    word, expected = 0, []
    for addr, op, val, t in ops:
        new = {"add": word + val, "or": word | val, "max": max(word, val), "swap": val, "cas": val if word == 0 else word}[op]
        expected.append((addr, t, op, val, word, new))
        word = new
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = replay.replay(spark.createDataFrame(ops, "addr long, op string, val long, t long"))
        assert rows(found) == sorted(expected, key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "ArrowEvalPythonUDTF" in found._jdf.queryExecution().executedPlan().toString()


def test_last_level_of_samples_is_not_looked_up(spark, monkeypatch):
    """Each level's edges are written once, and nothing is written of what the last one reaches."""
    made, kept = [], sampling.stored
    monkeypatch.setattr(sampling, "stored", lambda df, name: made.append(name) or kept(df, name))
    e = edges(spark, [(1, 2), (1, 3), (2, 1), (2, 4), (3, 5), (4, 1)])
    found = sampling.first_k(e, spark.createDataFrame([(1,)], "v long"), (2, 1))
    assert rows(found, "root", "level", "src", "dst") == [(1, 0, 1, 2), (1, 0, 1, 3), (1, 1, 2, 1), (1, 1, 3, 5)]
    assert made == ["heads", "drawn", "frontier"]


def test_a_loop_is_kept_once(spark):
    assert rows(graph.symmetrize_both(edges(spark, [(1, 1), (1, 2), (2, 1), (1, 1)]), keep_loops=True)) == [(1, 1), (1, 2), (2, 1)]


@pytest.mark.parametrize("simple", (True, False))
def test_relabelling_takes_more_tasks_for_more_edges(spark, monkeypatch, simple):
    monkeypatch.setattr(graph, "TASK_ROWS", 20, raising=False)
    pairs = sorted({(min(a, b), max(a, b)) for a in range(100) for b in ((a * 7 + 1) % 100, a * a % 31) if a != b})
    degree = {v: sum(v in p for p in pairs) for p in pairs for v in p}
    ids = {v: i for i, v in enumerate(sorted(degree, key=lambda v: (degree[v], v), reverse=True))}
    given = pairs if simple else pairs + [(b, a) for a, b in pairs[:30]] + [(5, 5), pairs[0]]
    found = graph.relabel_by_degree(edges(spark, given), **({"simple": True} if simple else {}))
    assert rows(found) == sorted(((ids[a], ids[b]) for a, b in given), key=repr)
    assert found.rdd.getNumPartitions() == -(-len(given) // 20) > 4


def test_pairs_of_lines_take_more_tasks_for_more_lines(spark, monkeypatch):
    from loomgraph.plans import derived

    monkeypatch.setattr(graph, "TASK_ROWS", 500, raising=False)
    sf = "/root/testdata/sf0.001"
    parts = -(-derived.table(spark, sf, "lineitem").count() // 500)
    assert derived.pairs(spark, sf).rdd.getNumPartitions() == parts > 4
    assert derived.co_part(spark, sf).rdd.getNumPartitions() == derived.co_part_both(spark, sf).rdd.getNumPartitions() == 2 * parts
