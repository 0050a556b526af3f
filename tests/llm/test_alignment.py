import hashlib
import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fleetlake.llm.alignment import BYTE_LEVEL, PIECES, Pair, aligned_blocks, alignments

ODD = [
    "", " ", "plain words", "  two spaces", "tab\there\nand line", "café straße İ", "漢字かな", "\U0001f600\U0001f44d\U0001f3fd", "<|endoftext|> in text", "<s> </s> <unk> <0x41>",
    "▁ is not a space", "ﬁ ligature ½", "é combining", "x\x00y", "trailing ", "antidisestablishmentarianism" * 3, "1234567890" * 5, "한글 русский", "a b",
]


@pytest.fixture(scope="module")
def brute():
    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    from fleetlake.llm.token_output import _byte_letters
    byte_of = {c: b for b, c in _byte_letters().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def sides(text):
        if not text:
            return [], []
        whole = (" " + text).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        ids_b = b.encode(text)
        bytes_b = []
        for i in ids_b:
            p = b.id_to_piece(i)
            bytes_b.append(bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return [], []
        return list(zip(ids_a, bytes_a)), list(zip(ids_b, bytes_b))

    def spans(side):
        out, at = [], 0
        for i, data in side:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out

    def run(docs):
        found, counts = [], Counter()
        for doc_id, text in docs:
            side_a, side_b = map(spans, sides(text))
            links, first = [], 0
            for x in side_a:
                while first < len(side_b) and side_b[first][2] <= x[1]:
                    first += 1
                for y in side_b[first:]:
                    if y[1] >= x[2]:
                        break
                    links.append((x[0], y[0]))
            ends = sorted({x[2] for x in side_a} & {y[2] for y in side_b})
            groups, start = [], 0
            for e in ends:
                groups.append("|".join(",".join(str(i) for i, s, t in side if start <= s and t <= e) for side in (
                    [x for x in side_a if x[1] >= start and x[2] <= e], [y for y in side_b if y[1] >= start and y[2] <= e])))
                start = e
            counts.update(links)
            found.append((doc_id, len(side_a), len(side_b), len(groups), links, ";".join(groups)))
        highest = defaultdict(int)
        for (_, y), n in counts.items():
            highest[y] = max(highest[y], n)
        return [(i, na, nb, ng, len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), text)
                for i, na, nb, ng, links, text in found]

    return run


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0], r[1:]))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1:]))


def test_odd_texts(make_docs, brute):
    docs = [*enumerate(ODD), (100, None), (None, "no id"), (7, "same id"), (7, "same id")]
    assert rows_of(alignments(make_docs(docs))) == ordered(brute(docs))


def test_random_texts_and_small_blocks(make_docs, brute):
    pick = random.Random(5)
    parts = ["ab", "the", "ing", " ", "é", "strange", "ly", "漢", "12", "-", ", ", "zq", "Ab"]
    docs = [(i, "".join(pick.choice(parts) for _ in range(pick.randint(0, 80)))) for i in range(150)]
    assert rows_of(alignments(make_docs(docs), block_chars=300)) == ordered(brute(docs))
    assert aligned_blocks(make_docs(docs), block_chars=300).count() > 10


def test_hot_words_and_long_text(make_docs, brute):
    docs = [(i, "the same words again and again") for i in range(200)] + [(500, "a long text of words " * 3000)]
    assert rows_of(alignments(make_docs(docs))) == ordered(brute(docs))


def test_query_equals_brute_force(run_query, brute):
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    rows = run_query("op12_tokenizer_alignment")
    expected = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[3] else "") for r in brute(docs)]
    assert sorted(tuple(r.values()) for r in rows) == sorted(expected)


def test_empty_table_and_clashing_names(spark, make_docs, brute):
    assert alignments(make_docs([])).collect() == []
    clash = spark.createDataFrame([(1, "two words", "x", 3)], "doc_id long, text string, groups string, block int")
    assert rows_of(alignments(clash)) == brute([(1, "two words")])


def test_fast_encoding_equals_the_file():
    """The texts of the rule's own check: every token, and code points that libraries put into different classes."""
    pair = Pair(BYTE_LEVEL, PIECES)
    assert pair._fast is not None
    texts = [f"a{c}1{c}. {c} \t{c}{c}" for c in map(chr, [*range(0, 0x3000, 3), *range(0xA000, 0x20000, 17)]) if not "\ud800" <= c < "\ue000"]
    texts += ["ab" * 5000, *ODD]
    assert [pair._encode_a(t).tolist() for t in texts] == [pair._a.encode(t, add_special_tokens=False).ids for t in texts]
