import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from fleetlake.llm.whitening import distinct_vectors, fit, grid_vectors, whitened_components

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=16):
    """By an eigendecomposition of the covariance of the distinct grid vectors; None where signs are free."""
    grid = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in e]) for i, e in rows
            if e is not None and len(e) and all(c is not None and math.isfinite(c) for c in e)]
    distinct = sorted({tuple(x) for _, x in grid})
    n = len(distinct)
    sums = [sum(col) for col in zip(*distinct)]
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums)] for x in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    values_all = values
    out = {}
    for i, x in grid:
        apart = [n * v - s for v, s in zip(x, sums)]
        out[i] = (sum(a * a for a in apart), (np.array(apart) / n) @ vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-300)))
    return n, values[order] / values_all.sum(), out


def check(rows, got, components):
    n, explained, expected = brute(rows, components)
    assert len(got) == len(expected) * components
    signs = {}
    for r in got:
        deviation, white = expected[r["vec_id"]]
        c = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["explained"] / explained[c] - 1) < 1e-6
        assert r["identity_error"] < 1e-8
        if abs(white[c]) > 1e-3:
            signs.setdefault(c, np.sign(white[c]) * np.sign(r["whitened"]))
            assert abs(r["whitened"] * signs[c] - white[c]) < 1e-6 * max(1, abs(white[c]))


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).repartition(3)


def test_query_equals_eigendecomposition(run_query):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pylist()]
    check(rows, run_query("op11_embedding_whitening"), 16)


def test_copies_nulls_and_broken_vectors(spark):
    pick = np.random.default_rng(3)
    rows = [(i, pick.normal(size=5).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]
    broken = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (203, [0.0, float("-inf"), 0.0, 0.0, 0.0]), (204, [])]
    got = whitened_components(vectors(spark, rows + broken + [(205, [1.0, 2.0])])).collect()
    check(rows + broken, got, 5)
    assert {r.vec_id for r in got} == {i for i, _ in rows}


@pytest.mark.parametrize("small", [1.0, 1e-2])
def test_ill_conditioned_vectors_keep_their_small_components(spark, small):
    """One direction is 10^6 and more times longer than another, so the Gram matrix has a condition of 10^12 and more."""
    pick = np.random.default_rng(4)
    base = pick.normal(size=(300, 3))
    data = np.column_stack([base[:, 0] * 2e6, base[:, 0] * 2e6 + base[:, 1] * small * 50, base[:, 2]]).astype(np.float32)
    rows = [(i, e) for i, e in enumerate(data.tolist())]
    x = np.floor(64 * data.astype(float))
    centred = x - x.mean(axis=0)
    deviations = np.linalg.svd(centred, compute_uv=False)
    got = whitened_components(vectors(spark, rows)).collect()
    found = {r.component: r.explained for r in got}
    assert sorted(found) == [1, 2, 3]
    for c, s in enumerate(deviations ** 2 / (deviations ** 2).sum(), 1):
        assert abs(found[c] / s - 1) < 1e-4
    assert got[0].identity_error < 1e-4


def test_vectors_in_a_subspace_have_fewer_components(spark):
    pick = np.random.default_rng(5)
    a, b = (pick.integers(-50, 50, size=200) for _ in range(2))
    rows = [(i, [float(x), float(y), float(x + y), 3.0]) for i, (x, y) in enumerate(zip(a, b))]
    got = whitened_components(vectors(spark, rows)).collect()
    assert sorted({r.component for r in got}) == [1, 2]
    assert abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-9
    assert got[0].identity_error < 1e-9


def test_no_rows_and_one_vector(spark):
    assert whitened_components(vectors(spark, [])).collect() == []
    assert whitened_components(vectors(spark, [(1, None)])).collect() == []
    assert whitened_components(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_large_values_are_exact(spark):
    rows = [(1, [1e13, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 3.0]), (None, [5.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fitted = fit(distinct_vectors(grid_vectors(df)))
    assert fitted.n == 3 and [int(s) for s in fitted.sums] == [64 * 10 ** 13 + 5 * 64 + 3 * 10 ** 6, 4 * 64 + 3 * 10 ** 6]
    got = whitened_components(df).collect()
    assert len(got) == 4 and {r.deviation for r in got if r.vec_id == 1} == {None}


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)], i, "y") for i in range(9)], "vec_id long, embedding array<float>, x int, component string")
    check([(i, [float(i), float(i * i % 7)]) for i in range(9)], [r.asDict() for r in whitened_components(df).collect()], 2)
