import json
import random

import pyarrow.parquet as pq
import pytest

import fleetlake.llm.token_counts as m
from fleetlake.llm.token_counts import VOCABULARY, WORD, LongestMatch, TokenCounter, token_counts, vocabulary_pieces


def greedy(pieces, symbols):
    """Longest match first, with backtracking over lengths: the definition."""
    n = at = 0
    longest = max(map(len, pieces), default=0)
    while at < len(symbols):
        for length in range(min(longest, len(symbols) - at), 0, -1):
            if tuple(symbols[at:at + length]) in pieces:
                break
        else:
            return None
        n, at = n + 1, at + length
    return n


@pytest.fixture(scope="module")
def pieces():
    return set(vocabulary_pieces(VOCABULARY))


def test_random_vocabularies_against_greedy_splitting():
    rng = random.Random(1)
    for _ in range(300):
        pieces = {tuple(rng.choices(range(3), k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = LongestMatch(iter(sorted(pieces)))
        for _ in range(30):
            word = rng.choices(range(3), k=rng.randint(0, 12))
            assert automaton.count(word) == greedy(pieces, word), (pieces, word)


def brute(pieces, text):
    words = WORD.findall(text.lower())
    return len(words), sum(greedy(pieces, (*w.encode(), 256)) or 1 for w in words)


ODD = ["", "Don't we'll", "a1b2 3.14 ---", "Éçàü漢字 русский", "thanedble ntationing", "x" * 700, "😀👍", "\x00\x01", "\n \t", "ﬁ İΣ ῌ"]


def test_texts_against_greedy_splitting(pieces):
    counter = TokenCounter(VOCABULARY, remembered=5)
    for text in ODD + ODD:
        assert counter.text(text) == brute(pieces, text), text


def test_words_that_end_in_an_inner_piece_are_counted_whole():
    """Against a splitter of bytes that reads the vocabulary file itself: the last piece in its inner or its end form."""
    model = json.load(open(VOCABULARY, encoding="utf-8"))["model"]
    suffix = model["end_of_word_suffix"]
    inner = {p for p in model["vocab"] if not p.endswith(suffix)}
    last = {p.removesuffix(suffix) for p in model["vocab"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}

    def split(word):
        rest, out = "".join(char[b] for b in word.encode()), []
        while rest:
            if rest in last:
                return [*out, rest]
            out.append(next(rest[:n] for n in range(len(rest), 0, -1) if rest[:n] in inner))
            rest = rest[len(out[-1]):]
        return out

    rng = random.Random(2)
    texts = ["für", "anan", "für anan für"]
    texts += ["".join(rng.choices("абвгдежзиклмнопрстуя", k=9)) for _ in range(200)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéüñ", k=500)) for _ in range(100)]
    counter = TokenCounter(VOCABULARY)
    for text in texts:
        assert counter.text(text) == (len(text.split()), sum(len(split(w)) for w in text.split())), text
    assert counter.word("für") > 1


def test_a_word_without_pieces_stays_one_unknown_token(tmp_path):
    path = tmp_path / "small.json"
    path.write_text(json.dumps({"model": {"end_of_word_suffix": "</w>", "vocab": {"a": 0, "ab</w>": 1}}}))
    counter = TokenCounter(str(path))
    assert [counter.word(w) for w in ("a", "aa", "aab", "ax", "x")] == [1, 2, 2, 1, 1]


def test_long_texts_are_counted_in_stretches(monkeypatch):
    text = "some words, and\nothers " * 50 + "y" * 100 + " end"
    whole = TokenCounter(VOCABULARY).text(text)
    monkeypatch.setattr(m, "STRETCH_CHARS", 20)
    assert TokenCounter(VOCABULARY).text(text) == whole


def test_rows_nulls_and_clashing_columns(make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x")])
    rows = token_counts(docs.selectExpr("*", "doc_id AS n_words", "lang AS n_tokens")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, 0, 0), (2, 0, 0), (3, 2, 2), (3, 2, 2), (None, 1, 1)], key=str)
    assert token_counts(make_docs([])).collect() == []


def test_query_against_greedy_splitting(run_query, pieces):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in run_query("op4_token_counts")}
    assert len(rows) == len(docs)
    for d in docs[:60]:
        assert rows[d["doc_id"]] == brute(pieces, d["text"] or "")
