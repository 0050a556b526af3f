import random

import pytest

from fleetlake.llm.substring_dedup import MIN_CHARS, REACH, chunk_ends, dedup_substrings, repeated_passages


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeghilmnorstué", k=rng.randint(2, 9))) for _ in range(n))


def test_chunks_cover_the_text_and_resist_an_insertion():
    rng = random.Random(1)
    text = words(rng, 3000).encode()
    ends = chunk_ends(text).tolist()
    assert ends == sorted(set(ends)) and ends[-1] == len(text)
    assert min(b - a for a, b in zip(ends, ends[1:-1])) >= REACH
    assert 25 < len(text) / len(ends) < 45
    moved = chunk_ends(text[:5000] + b"inserted words " + text[5000:]).tolist()
    same = {text[a:b] for a, b in zip([0, *ends], ends)} & {
        (text[:5000] + b"inserted words " + text[5000:])[a:b] for a, b in zip([0, *moved], moved)}
    assert len(same) >= len(ends) - 5


def test_parts_of_a_long_text_cut_like_the_whole(monkeypatch):
    import fleetlake.llm.substring_dedup as m

    text = words(random.Random(2), 4000).encode()
    whole = chunk_ends(text).tolist()
    monkeypatch.setattr(m, "PIECE_CHARS", 1000)
    assert chunk_ends(text).tolist() == whole


@pytest.mark.parametrize("text", ["", "a", "a" * 5000, "ab" * 3000, "Is onhe. " * 500, "é" * 3000])
def test_periodic_and_tiny_texts_have_bounded_chunks(text):
    data = text.encode()
    ends = chunk_ends(data).tolist()
    assert (not data and not ends) or ends[-1] == len(data)
    assert len(ends) <= len(data) / REACH + 2
    data[: ends[0] if ends else 0].decode()


def test_planted_passages_are_found_and_clean_documents_left_alone(make_docs):
    rng = random.Random(3)
    docs, expected = {}, {}
    for i in range(0, 300, 3):
        passage = words(rng, 51)
        for j in (i, i + 1):
            head, tail = words(rng, rng.randint(0, 80)), words(rng, rng.randint(0, 80))
            docs[j] = f"{head} {passage}\n{tail}"
            expected[j] = (len(head) + 1, len(head) + 1 + len(passage), i)
        docs[i + 2] = words(rng, 200) + "\nA line of boilerplate that many documents share at the end."
    rows = repeated_passages(make_docs(docs)).collect()
    assert {r.doc_id for r in rows} == set(expected)
    for r in rows:
        start, end, first = expected[r.doc_id]
        assert start - 1 <= r.start and r.end <= end + 1 and r.end - r.start >= MIN_CHARS
        assert r.first_doc_id == first and r.kept == (r.doc_id == first)


def test_cutting_leaves_the_first_and_removes_the_rest(make_docs):
    rng = random.Random(4)
    text = words(rng, 300)
    got = {r.doc_id: r for r in dedup_substrings(make_docs({5: text, 6: text, 7: "é" + text, 8: None, 9: ""})).collect()}
    assert got[5].text == text and got[5].n_cut == 0
    assert got[6].text == "" and got[6].n_cut == len(text)
    assert len(got[7].text) < 80 and ("é" + text).startswith(got[7].text)
    assert got[8].text == "" and got[9].text == ""


def test_repeats_inside_one_document_null_ids_and_clashing_columns(make_docs):
    passage = words(random.Random(5), 80)
    docs = make_docs([(1, passage + " and " + passage), (2, "x"), (2, "x")]).selectExpr("*", "doc_id AS start", "text AS digest", "lang AS run")
    assert repeated_passages(docs).collect() == []
    rows = repeated_passages(make_docs([(None, passage), (3, passage), (3, passage)])).collect()
    assert sorted((str(r.doc_id), r.start, r.end, str(r.first_doc_id), r.kept) for r in rows) == [
        ("3", 0, len(passage), "None", False), ("None", 0, len(passage), "None", True)]
    assert repeated_passages(make_docs([])).collect() == []


def test_texts_of_one_id_or_of_none_are_told_apart(make_docs):
    rng = random.Random(6)
    repeated, other, third = (words(rng, 80) for _ in range(3))
    docs = make_docs([(1, repeated), (5, repeated), (5, other), (None, third), (None, "new " + third), (None, other[:40])])
    assert {(r.doc_id, r.first_doc_id, r.kept) for r in repeated_passages(docs).collect()} == {
        (1, 1, True), (5, 1, False), (None, None, True), (None, None, False)}
    texts = sorted(r.text for r in dedup_substrings(docs).where("doc_id = 5").collect())
    assert texts == ["", other]
    left = sorted(len(r.text) for r in dedup_substrings(docs).where("doc_id is null").collect())
    assert left[0] < 80 and left[1] == 40 or left[0] == 40 and left[1] < 80
    assert left[2] >= len(third)


def test_query_against_brute_force(run_query):
    """Every reported part is a substring that another document holds, and every 51 shared words are reported."""
    import pyarrow.parquet as pq

    docs = dict(zip(*[c.to_pylist() for c in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).columns]))
    rows = run_query("op1_substring_dedup")
    for r in rows:
        part = docs[r["doc_id"]][r["start"]:r["end"]]
        if not r["kept"] and r["end"] - r["start"] < 400:
            assert any(part[:REACH] in t for i, t in docs.items() if i != r["doc_id"])
    seen = {}
    for i, t in docs.items():
        w = t.split()
        for k in range(len(w) - 50):
            seen.setdefault(" ".join(w[k:k + 51]), set()).add(i)
    shared = {i for ids in seen.values() if len(ids) > 1 for i in ids}
    assert shared <= {r["doc_id"] for r in rows}
