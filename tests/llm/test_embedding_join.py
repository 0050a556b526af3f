import numpy as np
import pyarrow.parquet as pq
import pytest

from fleetlake.llm.embedding_join import _assign, _pivots, near_duplicate_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    def usable(r):
        v = r[1]
        return r[0] is not None and r[2] is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    distinct = {(r[0], r[2], tuple(r[1])) for r in rows if usable(r)}
    ids, links, least = [], {}, {}
    for a in distinct:
        for b in distinct:
            if a[0] != b[0] and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2], float), np.array(b[2], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links.setdefault(a[0], set()).add(b[0])
    for start in sorted(links):
        todo = [start]
        while todo:
            i = todo.pop()
            if i not in least:
                least[i] = start
                todo += links[i]
    for r in rows:
        component = least.get(r[0], r[0])
        ids.append((r[0], len(links.get(r[0], ())), component, r[0] == component))
    return sorted(ids, key=str)


def clustered(seed, n, dim, labels=3, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dim))
    v = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, dim))
    return [(i, v[i].astype(np.float32).tolist(), int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("cell_rows, block_rows", [(8192, 4096), (20, 4096), (20, 7), (1000, 16)])
def test_cells_and_blocks_against_brute_force(spark, cell_rows, block_rows):
    rows = clustered(cell_rows + block_rows, 240, 6)
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    got = near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), cell_rows=cell_rows, block_rows=block_rows).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_pivots_of_many_labels_and_planes_between_them(spark):
    rows = clustered(3, 900, 48, labels=12, spread=0.25)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, near_duplicate_vectors(df, cell_rows=10, block_rows=64).collect()), key=str) == brute(rows)
    vectors = df.selectExpr("cast(label AS string) AS label", "embedding", "vec_id AS rep", "1L AS weight", "size(embedding) AS dim")
    pivots = _pivots(vectors, 10)
    sizes = {str(k): sum(r[2] == k for r in rows) for k in range(12)}
    assert set(pivots) == {(label, 48) for label in sizes}
    assert all(2 <= len(p) <= -(-sizes[label] // 10) for (label, _), p in pivots.items())
    assert pivots == _pivots(vectors.repartition(7), 10)
    reach, by_triangle = np.sqrt(0.14), 0
    unit = lambda v: np.array(v, float) / np.linalg.norm(np.array(v, float), axis=1, keepdims=True)
    for (label, _), p in pivots.items():
        d = np.sqrt(np.maximum(0, 2 - 2 * unit([r[1] for r in rows if str(r[2]) == label]) @ unit(p).T))
        by_triangle += int((d <= d.min(axis=1, keepdims=True) + 2 * reach).sum()) - len(d)
    visits = _assign(vectors, pivots, reach).selectExpr("sum(size(visits)) AS n").first().n
    assert 0 < visits < by_triangle


def test_unusable_vectors_nulls_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, [1.0, 0.01], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0),
            (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [1.0, None], 0), (9, [], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1.0, 0.0], 1),
            (12, [3e38, 0.0], 0), (13, [1e-40, 0.0], 0), (None, [1.0, 0.0], 0)]
    got = near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (12, 3, 1, False), (13, 3, 1, False), (None, 0, None, True)]
        + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)], key=str)


def test_chain_has_one_component_and_empty_table(spark):
    step = np.arccos(0.94)
    rows = [(i, [float(np.cos(i * step)), float(np.sin(i * step))], 7) for i in range(12)]
    got = {r.vec_id: r for r in near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), cell_rows=3).collect()}
    assert {r.component_id for r in got.values()} == {0}
    assert [got[i].n_links for i in range(12)] == [1, *[2] * 10, 1]
    assert near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    extra = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "label AS rep", "vec_id AS cell", "label AS home")
    assert near_duplicate_vectors(extra).count() == 12


def test_query_against_brute_force(run_query):
    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.001/embeddings.parquet").select(["vec_id", "embedding", "label"]).to_pylist()]
    assert sorted((tuple(r.values()) for r in run_query("op10_embedding_near_dedup")), key=str) == brute(rows)
