import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

from fleetlake.llm import merge_replay, pretokens
from fleetlake.llm.merge_replay import RANKS, Merges, Replayer, decode, encode

ODD = [
    "", " ", "\n\n \t", "Hello, world's end!", "a  b   c\n", "don't we'll I'M", "x\x1cy\x1f z\x00", "café İstanbul straße", "漢字 かな 한글",
    "͸͹ ࢏1࢏", "\U00010940\U00010941 \U0002ffff", "\U0001f600\U0001f44d\U0001f3fd ok", "<|endoftext|> is text", "1234567890 1 22 333",
    "  　x\u0085", "w" * 3000, "ab" * 1500, " " * 2000, "!?" * 900,
]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def replayer():
    return Replayer(RANKS)


def ids_of(replayer, texts):
    return [np.frombuffer(x, "<i4").tolist() for x in replayer.encode(texts)]


def test_odd_texts_equal_the_library(replayer, library):
    texts = [*ODD, " ".join(ODD)]
    assert ids_of(replayer, texts) == [library.encode_ordinary(t) for t in texts]
    assert ids_of(replayer, texts[::-1]) == [library.encode_ordinary(t) for t in texts[::-1]]  # all words known by now


def test_random_words_and_texts_equal_the_library(replayer, library):
    pick = random.Random(7)
    letters = ["a", "aa", "b", "the", "ing", "zz", "q", " ", "  ", "\n", "'s", "'re", "1", "23", "!", "...", "é", "İ", "漢", "\U0001f600", "\xa0", "͸"]
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 50))) for _ in range(5000)]
    texts += ["".join(pick.choice("abcdefgh"[:k]) for _ in range(pick.randint(1, 60))) for k in range(1, 9) for _ in range(400)]
    assert ids_of(replayer, texts) == [library.encode_ordinary(t) for t in texts]


def by_rank(merges, word):
    """The rule itself: of all pairs that make a token, the one of lowest rank, and of these the leftmost."""
    if word in merges.id_of:
        return [merges.id_of[word]]
    parts = [bytes([b]) for b in word]
    while True:
        found = [(merges.id_of[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in merges.id_of]
        if not found:
            return [merges.id_of[p] for p in parts]
        _, i = min(found)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_tokens_made_of_other_parts_than_learnt(tmp_path):
    """Random rank files, where a merge often makes a pair of a lower rank."""
    pick = random.Random(11)
    for n in range(30):
        tokens = [bytes([b]) for b in range(256)]
        more = {bytes(pick.choice(b"abc") for _ in range(pick.randint(2, 5))) for _ in range(25)}
        more = sorted(more)
        pick.shuffle(more)
        path = tmp_path / f"ranks{n}"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([*tokens, *more])))
        merges = Merges(str(path))
        words = [bytes(pick.choice(b"abcd") for _ in range(pick.randint(1, 14))) for _ in range(300)]
        words = [w for w in words if w not in merges.id_of]
        expected = [by_rank(merges, w) for w in words]
        for array_ranks in (0, 260, 1000):
            assert [np.frombuffer(x, "<i4").tolist() for x in merges.replay(words, array_ranks)] == expected


def test_every_code_point_of_the_fast_patterns_is_split_as_in_the_library():
    def around(c):
        return f"a{c}1{c}. {c} \t{c}{c}"

    same = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and pretokens._SAME.fullmatch(chr(c))]
    assert len(same) > 30000
    assert [c for c in same if pretokens._ANY.findall(around(c)) != pretokens._library_split(around(c))] == []


def test_other_code_points_equal_the_library(replayer, library):
    texts = [f"a{c}1{c}. {c} \t{c}{c}" for c in map(chr, range(0x530, 0x20000, 5)) if not "\ud800" <= c < ""]
    assert ids_of(replayer, texts) == [library.encode_ordinary(t) for t in texts]


def test_stretches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pretokens, "STRETCH_CHARS", 50)
    monkeypatch.setattr(pretokens.stretches, "__defaults__", (50,))
    texts = ["one  two \n three's 4 5! " * 40, "x" * 500 + " y " * 100, " " * 300 + "a b" * 100]
    assert [pretokens.split(t) for t in texts] == [pretokens._ANY.findall(t) for t in texts]


def test_forgetting_changes_nothing(library):
    small = Replayer(RANKS, remembered_bytes=500)
    texts = [f"word{i} again and again {'y' * i}" for i in range(120)]
    for t in texts + texts:
        assert ids_of(small, [t]) == [library.encode_ordinary(t)]


def test_long_word_in_bounded_time(replayer, library):
    word = "ab" * 60000 + "c"
    ids = ids_of(replayer, [word])[0]
    assert replayer.decode(ids) == word.encode()
    assert ids[:50] == library.encode_ordinary("ab" * 2000)[:50]


def expected(doc_id, text, library):
    ids = library.encode_ordinary(text or "")
    return (doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_query_equals_the_library(run_query, library):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = run_query("op13_merge_replay")
    assert sorted(tuple(r.values()) for r in rows) == sorted(expected(d["doc_id"], d["text"], library) for d in docs)


def test_defined_cases(spark, make_docs, library):
    docs = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "no id"), *((10 + i, t) for i, t in enumerate(ODD))]
    rows = decode(encode(make_docs(docs))).collect()
    key = lambda r: (r[0] is not None, r[0], r[1])
    assert sorted(((r.doc_id, list(r.ids), bytes(r.data)) for r in rows), key=key) == sorted(
        ((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in docs), key=key)
    assert encode(make_docs([])).collect() == []
    clash = spark.createDataFrame([(1, "a b", [7], "x")], "doc_id long, text string, ids array<int>, data string")
    assert [list(r.ids) for r in encode(clash).collect()] == [library.encode_ordinary("a b")]
    assert merge_replay.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()[0].data == b""
