import random
import re

import pytest

import fleetlake.llm.decontamination as m
from fleetlake.llm.decontamination import contaminated, decontaminate


def shingles(text, k=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items, t=0.8):
    out = {}
    for i, text in items:
        n = min(5, len(re.findall(r"[^\W_]+", (text or "").lower())))
        own = shingles(text, n) if n else set()
        for d, body in docs:
            shared = len(own & shingles(body, n))
            if own and shared >= t * len(own) - 1e-9:
                out[d, i] = max(out.get((d, i), 0), shared)
    return {(d, i, n) for (d, i), n in out.items()}


@pytest.fixture()
def make_items(spark):
    return lambda rows: spark.createDataFrame(list(rows), "item_id long, text string")


def got(df):
    return {(r.doc_id, r.item_id, r.n_shared) for r in df.collect()}


def words(rng, n):
    return ["".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(n)]


@pytest.mark.parametrize("rows", [200_000, 0])
def test_items_inside_long_documents_with_edits(make_docs, make_items, monkeypatch, rows):
    monkeypatch.setattr(m, "BROADCAST_ROWS", rows)
    rng = random.Random(rows)
    items = [(i, " ".join(words(rng, rng.choice([5, 6, 9, 14, 31, 32, 60])))) for i in range(40)]
    docs = []
    for d in range(60):
        body = words(rng, rng.randint(0, 600))
        for _ in range(rng.randint(0, 2)):
            item = items[rng.randrange(40)][1].split()
            for _ in range(rng.randint(0, 2)):
                item[rng.randrange(len(item))] = "edited"
            at = rng.randint(0, len(body))
            body[at:at] = item
        docs.append((d, " ".join(body).upper() if d % 3 else ", ".join(body)))
    expected = brute(docs, items)
    assert expected and got(contaminated(make_docs(docs), make_items(items))) == expected


def test_nulls_short_texts_and_repeats(make_docs, make_items):
    five = "one two three four five"
    docs = [(1, five), (1, five), (2, None), (3, ""), (4, "one two three four"), (None, "x " + five.upper() + " y"), (5, "\t".join(five.split()))]
    items = [(7, five), (7, five), (7, five + " six"), (8, "one two"), (9, None), (None, five)]
    rows = got(contaminated(make_docs(docs), make_items(items)))
    assert rows == {(d, i, 1) for d in (1, None, 5) for i in (7, None)} | {(d, 8, 1) for d in (1, None, 5, 4)}
    left = decontaminate(make_docs(docs).selectExpr("*", "doc_id AS bad_id", "lang AS item"), make_items(items))
    assert sorted(r.doc_id for r in left.collect()) == [2, 3] and left.columns[-2:] == ["bad_id", "item"]


def test_empty_tables(make_docs, make_items):
    assert contaminated(make_docs([]), make_items([(1, "a b c d e f")])).collect() == []
    docs = make_docs({1: "a b c d e f"})
    assert contaminated(docs, make_items([])).collect() == []
    assert decontaminate(docs, make_items([])).count() == 1


def test_clean_texts_of_a_contaminated_id_stay(make_docs, make_items):
    five = "one two three four five"
    docs = [(None, "x " + five), (None, "a clean text of some words"), (None, None), (3, five), (3, "another clean text of words"), (4, five)]
    left = decontaminate(make_docs(docs), make_items([(7, five)])).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([docs[1], docs[2], docs[4]], key=str)


@pytest.mark.parametrize("rows", [200_000, 0])
def test_items_of_one_to_four_words(make_docs, make_items, monkeypatch, rows):
    monkeypatch.setattr(m, "BROADCAST_ROWS", rows)
    rng = random.Random(rows + 1)
    some = words(rng, 14)
    phrase = lambda *sizes: " ".join(rng.choices(some, k=rng.choice(sizes)))
    items = [(i, phrase(2, 3, 4, 4, 6)) for i in range(60)] + [(60, "capital of france paris")]
    docs = [(d, phrase(0, 1, 3, 40, 400).replace(" ", ", ")) for d in range(60)]
    docs += [(60, "The Capital of France: Paris."), (61, "capital of france parisian"), (62, "the capital of france"), (63, "paris")]
    expected = brute(docs, items)
    found = got(contaminated(make_docs(docs), make_items(items)))
    assert found == expected and (60, 60, 1) in found and len({i for _, i, _ in found}) > 5
    assert not {(61, 60, 1), (62, 60, 1)} & found
    left = {r.doc_id for r in decontaminate(make_docs(docs), make_items(items)).collect()}
    assert left == {d for d, _ in docs} - {d for d, _, _ in expected}
