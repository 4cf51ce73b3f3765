"""Attention and theta joins by tiles."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import attention, linalg, theta
from tests.helpers import rows


@pytest.mark.parametrize(("causal", "n", "block"), [(True, 4, 64), (True, 9, 2), (False, 7, 3)])
def test_attention_and_its_gradients_against_differences(spark, causal, n, block):
    import numpy as np

    rng = np.random.default_rng(2)
    q, k, v, g = (3 * rng.normal(size=(n, 3)) for _ in range(4))

    def whole(q, k, v):
        s = np.where(np.tril(np.ones((n, n))) if causal else 1, q @ k.T / 3**0.5, -np.inf)
        p = np.exp(s - s.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True) @ v

    frame = lambda m, i, x: spark.createDataFrame([(a, b, float(m[a, b])) for a in range(n) for b in range(3)], f"{i} long, d long, {x} double").repartition(3)
    fq, fk, fv = frame(q, "i", "v"), frame(k, "j", "v"), frame(v, "j", "v")
    out = attention.outputs(attention.forward(fq, fk, fv, 3, causal, block)).collect()
    assert len(out) == 3 * n and all(math.isclose(r.o, whole(q, k, v)[r.i, r.d], abs_tol=1e-9) for r in out)
    found = attention.gradients(fq, fk, fv, frame(g, "i", "g"), 3, causal, block)
    for at, df in enumerate(found):
        slopes = {(r.id, r.d): r.g for r in df.collect()}
        assert len(slopes) == 3 * n
        for (i, d), slope in slopes.items():
            up, down = [q, k, v], [q, k, v]
            up[at], down[at] = up[at].copy(), down[at].copy()
            up[at][i, d] += 1e-6
            down[at][i, d] -= 1e-6
            assert math.isclose(slope, ((whole(*up) - whole(*down)) * g).sum() / 2e-6, abs_tol=1e-5)


def test_attention_merges_large_scores_in_any_order(spark):
    parts = [(0, 700.0, 1.0, [1.0, 0.0]), (0, -700.0, 5.0, [9.0, 9.0]), (0, 700.0, 1.0, [0.0, 1.0]), (1, -1e9, 2.0, [4.0, 2.0])]
    for order in (parts, parts[::-1]):
        found = attention.merged(spark.createDataFrame(order, "i long, m double, l double, o array<double>"), ["i"]).collect()
        assert {r.i: (r.o, round(r.lse, 6)) for r in found} == {0: ([0.5, 0.5], round(700 + math.log(2), 6)), 1: ([2.0, 1.0], round(-1e9 + math.log(2), 6))}


def test_attention_of_queries_without_keys(spark):
    q = spark.createDataFrame([(0, 0, 1.0), (5, 0, 1.0), (None, 0, 1.0)], "i long, d long, v double")
    k = spark.createDataFrame([(3, 0, 2.0), (4, 1, 1.0), (9, 0, 7.0)], "j long, d long, v double")
    found = attention.outputs(attention.forward(q, k, k, 2, block=4)).collect()
    near = 1 / (1 + math.exp(-(2**0.5)))
    assert {(r.i, r.d): round(r.o, 9) for r in found} == {(5, 0): round(2 * near, 9), (5, 1): round(1 - near, 9)}
    assert attention.forward(q.limit(0), k, k, 2).count() == 0 == attention.forward(q, k.limit(0), k, 2).count()


def test_blocked_fixed_point_attention_equals_the_row_form(spark):
    import random

    rng = random.Random(4)
    made = [(i, d, rng.randint(-40_000, 40_000)) for i in range(11) for d in range(4)]
    q = spark.createDataFrame(made, "i long, d long, v long")
    k = q.withColumnRenamed("i", "j")
    for wrap, mode in ((True, "reference"), (False, "reference"), (True, "exact")):
        scores = linalg.scores_q16(q.withColumnRenamed("d", "k"), k.withColumnRenamed("d", "k"), dim=4, wrap=wrap)
        plain = linalg.apply_probs_q16(linalg.softmax_q16(scores, wrap, mode), k, tile=4)
        assert rows(attention.attention_q16(q, k, k, 4, tile=4, wrap=wrap, mode=mode)) == rows(plain)


@pytest.mark.parametrize("most", [3, 60, 40_000])
def test_fixed_point_kernels_multiply_in_floats_and_add_far_keys_together(most):
    """Few, most and all keys near the largest score, over blocks of several tiles, against 64-bit words throughout."""
    import numpy as np

    from loomgraph.functions.intmath import exp_q16_array, i32_array

    rng = np.random.default_rng(most)
    q, k = rng.integers(-most, most + 1, (23, 4)), rng.integers(-most, most + 1, (300, 4))
    j = np.sort(rng.choice(1000, 300, replace=False))
    largest, totals, applied = attention._q16_kernels(4, 8, True, "reference")
    assert attention._whole_products(q, k.T)[0].dtype == (np.float32 if most < 1000 else np.float64)
    assert attention._whole_products(q, k.T, 1 << 53)[0].dtype == np.int64
    s = i32_array(q @ k.T * 32768)
    e = exp_q16_array(i32_array(s - s.max(1, keepdims=True)))
    p = (e << 16) // e.sum(1, keepdims=True)
    expected = sum((p[:, j // 8 == t] @ k[j // 8 == t]) >> 16 for t in np.unique(j // 8))
    n = int(np.searchsorted(j, 504))
    tiles = [{"o_m": q, "o_ids": np.arange(23), "i_m": k[a:b], "i_v": k[a:b], "i_ids": j[a:b]} for a, b in ((0, n), (n, 300))]

    def run(kernel, **more):
        state = None
        for t in tiles:
            state = kernel(state, t | more)
        return state

    top = run(largest)[1]
    assert (top == s.max(1)).all()
    _, total, n = run(totals, o_top=top.tobytes())
    assert (total == e.sum(1)).all() and (n == 300).all()
    assert (run(applied, o_top=top.tobytes(), o_sums=np.stack([total, n], 1).tobytes())[1] == expected).all()


def test_gradients_make_each_tile_again_once(spark, monkeypatch):
    """One pass for the outputs, one for all gradients; those of queries are the same when a task writes them after each block of keys."""
    import numpy as np

    rng = np.random.default_rng(4)
    frame = lambda x, n, v: spark.createDataFrame([(i, d, float(x[i, d])) for i in range(len(x)) for d in range(4)], f"{n} long, d long, {v} double")
    q, k, v, g = (rng.integers(-3, 4, (40, 4)) for _ in range(4))
    passes, real, found = [], attention.tiles, []
    monkeypatch.setattr(attention, "tiles", lambda *a: (passes.append(1), real(*a))[1])
    for most in (0, 256):
        monkeypatch.setattr(attention, "QUERY_BLOCKS", most)
        made = attention.gradients(frame(q, "i", "v"), frame(k, "j", "v"), frame(v, "j", "v"), frame(g, "i", "g"), 4, True, 8)
        found.append([{(r.id, r.d): r.g for r in x.collect()} for x in made])
    assert len(passes) == 4
    for a, b in zip(*found, strict=True):
        assert a.keys() == b.keys() and len(a) == 160 and all(abs(a[x] - b[x]) < 1e-9 for x in a)


def test_exponentials_of_whole_and_other_scores():
    import numpy as np

    rng = np.random.default_rng(5)
    for q, k in ((rng.integers(-2, 2, (9, 4)) * 1.0, rng.integers(-2, 2, (17, 4)) * 1.0), (rng.normal(size=(9, 4)), rng.normal(size=(17, 4))), (np.full((9, 4), np.inf), np.zeros((17, 4)))):
        with np.errstate(invalid="ignore"):
            assert attention._products(q, k)[0].dtype == (np.float32 if abs(q[0, 0]) in (0, 1, 2) else np.float64)
        for first in (0, 12, 30):
            if np.isinf(q).any():
                continue
            top, e = attention._exponentials(q, k, np.arange(first, first + 9), np.arange(17), True)
            s = np.where(np.arange(17) <= np.arange(first, first + 9)[:, None], q @ k.T / 2, -np.inf)
            assert np.allclose(top, s.max(1)) and np.allclose(e, np.exp(s - s.max(1, keepdims=True)))


def test_heads_are_split_and_joined(spark):
    packed = spark.createDataFrame([(b, n, c, float(100 * b + 10 * n + c)) for b in range(2) for n in range(3) for c in range(12)], "b long, n long, c long, v double")
    q, k, v = attention.split_heads(packed, heads=2, dim=2)
    assert rows(k.where("b = 1 AND h = 1 AND j = 2").select("d", "v")) == [(0, 126.0), (1, 127.0)]
    back = attention.pack_gradients(*(x.withColumnRenamed("i" if "i" in x.columns else "j", "id").withColumnRenamed("v", "g") for x in (q, k, v)), heads=2, dim=2)
    assert rows(back) == rows(packed)
    assert attention.join_heads(q.withColumnRenamed("v", "o"), dim=2).where("b = 0 AND n = 1").orderBy("c").collect()[2].o == 12.0


@pytest.mark.parametrize(("na", "nb", "tiles"), [(40, 30, 12), (200, 3, 7), (0, 5, 4), (1, 1, 9)])
def test_theta_join(spark, na, nb, tiles):
    a = spark.createDataFrame([(i % 5, i) for i in range(na)], "x int, i int")
    b = spark.createDataFrame([(i % 7, i) for i in range(nb)] + [(None, -1)], "y int, j int")
    found = theta.theta_join(a, b, (F.col("x") < F.col("y")) & (F.col("i") + F.col("j") > 3), tiles)
    assert rows(found, "i", "j") == sorted(((i, j) for i in range(na) for j in range(nb) if i % 5 < j % 7 and i + j > 3), key=repr)


def test_theta_tiles_are_even_and_nothing_is_broadcast(spark):
    hot = spark.range(6000).selectExpr("1 AS x")  # equal rows
    other = spark.range(1500).selectExpr("2 AS y")
    assert theta.tile_counts(6000, 1500, 16) == (8, 2) and theta.tile_counts(5, 10**9, 16) == (1, 16)
    a, b = theta.tiled(hot, other, 8, 2)
    sizes = [r["count"] for side in (a, b) for r in side.groupBy(theta.ROW, theta.COLUMN).count().collect()]
    assert len(sizes) == 32 and max(sizes) < 1.2 * 750 and min(sizes) > 0.8 * 750
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = theta.theta_join(hot, other, F.col("x") < F.col("y"))._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "CartesianProduct" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="both sides"):
        theta.theta_join(hot, hot, F.lit(True))


def test_sums_above_without_pairs(spark):
    """Counts and sums of the pairs of an inequality equal those of the pairs, with ties, repeats and nulls."""
    a = [(i, i * 7 % 30 / 2, i % 3) for i in range(60)] + [(60, None, 1), (61, 3.0, None), (62, -50.0, 1), (63, 1e9, 9)]
    b = [(i * 11 % 31 / 2, i % 4, 1, i) for i in range(80)] + [(None, 1, 1, 500), (2.0, None, 1, 700)]
    left, right = spark.createDataFrame(a, "i long, x double, g long"), spark.createDataFrame(b, "y double, h long, n long, total long")
    found = theta.sums_above(left, right, ("x", "y"), ("g", "h"), ["n", "total"])
    expected = []
    for i, x, g in a:
        if x is not None and g is not None:
            met = [t for y, h, _, t in b if y is not None and h is not None and y < x and h != g]
            expected.append((i, len(met), sum(met)))
    assert sorted(map(tuple, found.select("i", "n", "total").collect())) == sorted(expected)
