import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from fleetlake.llm import quality_crf as q

GOOD = "The committee met on a quiet morning, and most of its members agreed. It was a short session.\nNothing else was planned for that day."
BAD = "### $$$ word%%% other&&& WORD!! WORD!! WORD!!\n| a | b | c | d |\n%%% &&& *** $$$ !!"


@pytest.fixture(scope="module")
def model():
    texts = [f"{GOOD} Number {i}." for i in range(60)] + [f"{BAD} {i}$$" for i in range(60)]
    shape, weight, counts = q.line_shapes(texts)
    return q.fit(shape, weight, counts, np.array([1.0] * 60 + [0.0] * 60))


def test_marginals_equal_brute_force_over_all_labellings():
    rng = np.random.default_rng(3)
    for n in range(1, 8):
        u = rng.normal(size=n) * 2
        m = q.QualityModel(np.zeros(1), np.ones(1), np.ones(1), 0.7, 1.3)
        total, good = 0.0, np.zeros(n)
        for bits in range(2 ** n):
            y = np.array([bits >> i & 1 for i in range(n)])
            stay = (0.7 * ((y[1:] == 0) & (y[:-1] == 0)) + 1.3 * ((y[1:] == 1) & (y[:-1] == 1))).sum()
            p = np.exp((u * y).sum() + stay)
            total += p
            good += p * y
        assert np.allclose(m.good_lines(u.tolist()), good / total)


def test_fit_tells_the_kinds_apart_and_scores_lines_by_their_neighbours(model):
    good, bad = model.quality([GOOD, BAD])
    assert good > 0.8 and bad < 0.2
    mixed = model.quality([GOOD + "\n" + BAD])[0]
    assert bad < mixed < good
    assert all(0 <= s <= 1 for s in model.quality(["", "\n\n", " ", "x", "é" * 10_000, "a b " * 200_000, "😀\x00﻿"]))


def test_long_batches_and_slices_give_the_same_scores(model, monkeypatch):
    texts = [GOOD, "", BAD, "one\n\nthree", GOOD + BAD]
    whole = model.quality(texts)
    monkeypatch.setattr(q, "_SLICE_CHARS", 10)
    assert np.allclose(model.quality(texts), whole)
    assert np.allclose([model.quality([t])[0] for t in texts], whole)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_rows_nulls_and_clashing_columns(spark, make_docs):
    texts = [(i, (GOOD if i % 2 else BAD) + f" {i}") for i in range(60)] + [(100, None), (101, ""), (101, ""), (None, GOOD)]
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(60)] + [(3, None, 0), (5, 7, 0), (None, 1, 0), (2, 0, 1)])
    docs = make_docs(texts).selectExpr("*", "doc_id AS label_id", "lang AS label", "lang AS score")
    rows = q.classify(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == held and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None and r.doc_id < 60:
            assert r.predicted == r.doc_id % 2
    assert q.classify(make_docs([]), labels).collect() == []


def test_without_both_labels_everything_is_kept(spark, make_docs):
    for rows in ([], [(i, 1, 0) for i in range(9)]):
        assert [r.score for r in q.classify(make_docs({1: BAD, 2: GOOD}), labels_of(spark, rows)).collect()] == [1.0, 1.0]


def test_held_out_labels_are_not_learned(spark, make_docs):
    docs = make_docs({i: (GOOD if i % 2 else BAD) + f" {i}" for i in range(60)})
    true = [(i, i % 2, 0) for i in range(60)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, 0) for i, y, _ in true]
    a, b = (sorted(map(tuple, q.classify(docs, labels_of(spark, rows)).collect())) for rows in (true, flipped))
    assert a == b


def test_query_is_accurate_on_held_out_documents(run_query):
    d = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist()}
    rows = run_query("op8_quality_classifier", d)
    held = [(r["score"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    good, bad = (np.array([s for s, y in held if y == k]) for k in (1, 0))
    assert np.mean([(good > s).mean() for s in bad]) > 0.995
    assert (good >= 0.3).mean() > 0.98 and (bad < 0.3).mean() > 0.95
