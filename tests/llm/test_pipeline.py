import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from fleetlake.llm import quality_crf
from fleetlake.session import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage, each written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def shingles(text, k=5, short=True):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1) if short else len(w) - k + 1)} if w else set()


def test_each_stage_against_brute_force(spark, stages):
    first, good, single, clean, mixture, tokens = stages
    labels, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "documents"))
    predicted = {r.doc_id: r.predicted for r in quality_crf.classify(docs, labels).collect()}
    assert {r.doc_id for r in good} == {i for i, p in predicted.items() if p}
    assert all(r in first for r in good) and 0.7 < len(good) / len(first) < 1

    sets = {r.doc_id: shingles(r.text) for r in good}
    group = {i: i for i in sets}
    changed = True
    near = [(i, j) for i in sets for j in sets if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in near:
            low = min(group[i], group[j])
            changed |= group[i] != low or group[j] != low
            group[i] = group[j] = low
    assert sorted(r.doc_id for r in single) == sorted({g for g in group.values()})

    items = [shingles(t, short=False) for t in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()]
    leaks = {r.doc_id for r in single if any(x and len(x & shingles(r.text, short=False)) >= 0.8 * len(x) for x in items)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in single} - leaks

    n_tokens = lambda rows: sum(len(r.text.split()) for r in rows)
    assert {r.doc_id for r in mixture} <= {r.doc_id for r in clean}
    assert 0.9 * n_tokens(clean) < n_tokens(mixture) <= n_tokens(clean)

    from tokenizers import Tokenizer

    from fleetlake.llm.token_output import TOKENIZER

    whole, start = Tokenizer.from_file(TOKENIZER), 0
    expected = []
    for r in sorted(mixture, key=lambda r: r.doc_id):
        ids = [*whole.encode(r.text, add_special_tokens=False).ids, 2]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens) == sorted(expected)


def test_stages_return_the_columns_of_documents(stages):
    for rows in stages[1:-1]:
        assert rows[0].__fields__ == stages[0][0].__fields__


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1]))


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
