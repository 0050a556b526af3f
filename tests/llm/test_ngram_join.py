import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

import fleetlake.llm.ngram_join as m
from fleetlake.llm.common import components, shingle_hashes, word_hashes
from fleetlake.llm.ngram_join import forest_labels, matched_depth, near_duplicates, one_of_each_group


def shingles(text, k=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, similarity=0.8):
    """{doc_id: (class_id, n_links)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs.items()}
    links = {i: {j for j in sets if j != i and sets[i] and sets[j]
                 and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])} for i in sets}
    out = {}
    for i in sorted(sets):
        todo, seen = [i], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links[x]
        out[i] = (min(seen), len(links[i]))
    return out


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n)]


def near_copies(rng, groups, size):
    docs, at = {}, 0
    for _ in range(groups):
        base = words(rng, rng.randint(20, 120))
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = words(rng, 1)[0]
            docs[at] = " ".join(copy)
            at += 1
    return docs


def result(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


@pytest.mark.parametrize("block_words", [100_000, 300])
def test_all_links_of_near_copies(make_docs, monkeypatch, block_words):
    monkeypatch.setattr(m, "BLOCK_WORDS", block_words)
    docs = near_copies(random.Random(block_words), 30, 14)
    assert result(near_duplicates(make_docs(docs))) == brute(docs)


def test_one_large_group_goes_through_the_matrix_form(make_docs):
    docs = near_copies(random.Random(9), 1, 90) | {1000 + i: "the same text of a few words, again" for i in range(40)}
    assert result(near_duplicates(make_docs(docs))) == brute(docs)


def test_case_marks_short_texts_nulls_and_repeated_rows(make_docs):
    docs = [(1, "One, two: three!"), (2, "one two three"), (3, "one two four"), (4, None), (5, ""), (6, " ... "),
            (7, "É é à"), (8, "é É À"), (9, "x" * 3000), (9, "x" * 3000), (10, "x" * 3000)]
    got = result(near_duplicates(make_docs(docs)))
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 1), 8: (7, 1), 9: (9, 1), 10: (9, 1)}
    assert result(near_duplicates(make_docs([(None, "a b c"), (2, "a b c")]))) == {None: (None, 1), 2: (None, 1)}
    assert near_duplicates(make_docs([])).collect() == []


def test_one_row_of_each_group_stays_with_all_columns(make_docs):
    docs = make_docs([(5, "a b c d e f"), (3, "A B C D E F"), (3, "A B C D E F"), (8, "other words here"), (9, None), (9, None)])
    docs = docs.selectExpr("*", "doc_id AS stays", "lang AS cluster", "text AS rep")
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 8, 9]


def test_different_texts_of_null_and_repeated_ids_are_all_kept(make_docs):
    rng = random.Random(6)
    texts = [" ".join(words(rng, 40)) for _ in range(8)]
    near = texts[0].split()
    near[-1] = "edited"
    rows = [(None, t) for t in texts[:5]] + [(None, " ".join(near)), (7, texts[5]), (7, texts[6]), (9, texts[1].upper()), (9, texts[7]), (4, texts[5])]
    rows += [(None, texts[2]), (None, "..."), (None, "!"), (None, None)]
    kept = [(r.doc_id, r.text) for r in one_of_each_group(make_docs(rows)).collect()]
    group = lambda t: texts[0] if t == " ".join(near) else (t or "").lower()
    assert sorted(group(t) for _, t in kept) == sorted([*texts, "...", "!", ""])
    assert (4, texts[5]) in kept and (7, texts[6]) in kept and (None, texts[1]) in kept
    links = sorted(str((r.doc_id, r.n_links)) for r in near_duplicates(make_docs(rows)).collect())
    assert links == sorted(map(str, [(None, 1)] * 3 + [(None, 0)] * 6 + [(7, 1), (7, 0), (9, 1), (9, 0), (4, 1)]))


def test_prefix_is_shortened_until_the_recall_is_met():
    assert matched_depth(recall=0.5) == 8
    assert [matched_depth(recall=r) for r in (0.99, 0.999, 0.9999)] == [7, 5, 4]


def test_forest_nodes_collide_as_often_as_the_similarity():
    rng = random.Random(5)
    hits = []
    for _ in range(150):
        a = words(rng, 150)
        b = list(a)
        for i in rng.sample(range(150), 3):
            b[i] = "changed" + str(rng.random())
        labels = forest_labels(*word_hashes([" ".join(a), " ".join(b)]))
        s, t = shingles(" ".join(a)), shingles(" ".join(b))
        hits.append(((labels[0] == labels[1]).mean(), len(s & t) / len(s | t)))
    got, true = np.mean(hits, axis=0)
    assert abs(got - true) < 0.02


@pytest.mark.parametrize("size", [5, 10, 20])
def test_short_pairs_at_the_bound_meet_in_some_tree(size):
    """Pairs of 5 to 20 shingles at a similarity of 0.8: next to none is missed by all trees."""
    pairs, depth, rng = 10_000, matched_depth(), np.random.default_rng(size)
    hits = 0
    for _ in range(5):
        union = rng.integers(0, 1 << 63, (pairs, size), dtype=np.uint64)
        # one word a shingle: both hold the first 0.8 of the union, the other shingles belong to the second text alone
        sets = [row[:n] for row in union for n in (size * 4 // 5, size)]
        labels = forest_labels(np.concatenate(sets), np.array([len(s) for s in sets]), k=1)[:, :, :depth]
        hits += int((labels[0::2] == labels[1::2]).all(axis=2).any(axis=1).sum())
    assert hits >= 0.9997 * 5 * pairs


def test_word_hashes_do_not_depend_on_batching(monkeypatch):
    import fleetlake.llm.common as c

    texts = ["One two, three", "", "two", "THREE one\ntwo three four five six", "é ü 漢字 x_y", " "]
    whole, counts = word_hashes(texts)
    assert counts.tolist() == [3, 0, 1, 7, 5, 0]
    assert whole[1] == whole[3] and whole[2] == whole[4] and whole[0] == whole[5]
    monkeypatch.setattr(c, "PIECE_CHARS", 8)
    cut, n = word_hashes(texts)
    assert n.tolist() == counts.tolist() and (cut == whole).all()
    assert shingle_hashes(whole, counts)[1].tolist() == [1, 0, 1, 3, 1, 0]


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(6, 40)] + [(3, 3), (41, 2), (2, 41)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 40)}, 2: 2, 41: 2}
    assert components(spark.createDataFrame([], "a long, b long"), "test").collect() == []


def test_query_against_brute_force(run_query):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    docs = dict(zip(*[c.to_pylist() for c in table.columns]))
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in run_query("op7_ngram_jaccard_join")} == brute(docs)
