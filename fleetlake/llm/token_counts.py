"""Greedy word-piece token counts by a linear longest-match automaton.

The pieces of a vocabulary form a trie over bytes and one end-of-word symbol. Each node has a failure link and the number of
pieces that are popped on the way along it, worked out once when the trie is built: reading on from a node that lacks the
next symbol adds that number and goes on from the linked node, so a word costs a step for each symbol and link, and neither
backtracks nor builds a piece. The count equals that of greedy longest-match-first splitting.

The vocabulary is that of a public tokenizer file: pieces that end a word carry its end-of-word suffix, and are matched with
the end symbol; no piece is trained here. Pieces without the suffix may end a word too, as they are: the last piece of a word
is matched in either form, so the end symbol costs nothing and is never left alone. Words are what the fixed pattern below finds in the lower-cased text. Words that
a worker has met are remembered up to a bound, and counting is one pass over the text without a shuffle.

Defined cases: a null or empty text has no tokens. A word that no pieces cover counts as one unknown token, as in
word-piece. Rows that repeat a ``doc_id`` each get their row; a null ``doc_id`` stays. Extra columns are left out.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fleetlake.llm.common import keyed_texts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
REMEMBERED_WORDS = 500_000
#: Texts are cut into words in stretches of this many characters, at white space.
STRETCH_CHARS = 1 << 18
#: Fixed value: the words of this vocabulary's tokenizer.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_END = 256


def vocabulary_pieces(path: str) -> Iterator[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary file as symbols: bytes, and the end of a word. Each piece can be the last of a
    word; one without the suffix can also stand before others."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix = model.get("end_of_word_suffix") or ""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in byte_of.values())})
    for piece in model["vocab"]:
        ends = bool(suffix) and piece.endswith(suffix)
        body = piece[:-len(suffix)] if ends else piece
        if body and all(c in byte_of for c in body):
            symbols = tuple(byte_of[c] for c in body)
            yield (*symbols, _END)
            if not ends:
                yield symbols


class LongestMatch:
    """The automaton: ``count(symbols)`` is the number of greedy longest pieces, or None if they don't cover it."""

    def __init__(self, pieces: Iterator[tuple[int, ...]]) -> None:
        child: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                following = child[node].get(symbol)
                if following is None:
                    following = child[node][symbol] = len(child)
                    child.append({})
                    is_piece.append(False)
                node = following
            is_piece[node] = True
        # breadth first: a link's target stands nearer to the root
        fail: list[int] = [-1] * len(child)
        popped = [0] * len(child)
        queue = [0]
        for node in queue:
            for symbol, below in child[node].items():
                queue.append(below)
                if is_piece[below]:
                    fail[below], popped[below] = 0, 1
                    continue
                at, n = fail[node], popped[node]
                while at >= 0 and symbol not in child[at]:
                    n += popped[at]
                    at = fail[at]
                if at >= 0:
                    fail[below], popped[below] = child[at][symbol], n
        self._child, self._fail, self._popped = child, fail, popped

    def count(self, symbols) -> int | None:
        child, fail, popped = self._child, self._fail, self._popped
        node = n = 0
        for symbol in symbols:
            following = child[node].get(symbol)
            while following is None:
                if fail[node] < 0:
                    return None
                n += popped[node]
                node = fail[node]
                following = child[node].get(symbol)
            node = following
        while node:
            if fail[node] < 0:
                return None
            n += popped[node]
            node = fail[node]
        return n


class TokenCounter:
    """Counts of whole texts for one vocabulary file."""

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS) -> None:
        self._automaton = LongestMatch(vocabulary_pieces(path))
        self._remembered = remembered
        self._known: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self._automaton.count((*word.encode(), _END))
        return 1 if n is None else n

    def text(self, text: str) -> tuple[int, int]:
        """The number of words and of tokens."""
        words = tokens = 0
        for stretch in _stretches(text):
            known = self._known
            if len(known) > self._remembered:
                known.clear()
            found = Counter(WORD.findall(stretch.lower()))
            for word in [w for w in found if w not in known]:
                known[word] = self.word(word)
            words += found.total()
            tokens += sum([known[word] * n for word, n in found.items()])
        return words, tokens


def _stretches(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > STRETCH_CHARS:
        cut = max(text.rfind(" ", start + 1, start + STRETCH_CHARS), text.rfind("\n", start + 1, start + STRETCH_CHARS))
        if cut < 0:  # no white space so far: on to the next
            ahead = [i for i in (text.find(" ", start + STRETCH_CHARS), text.find("\n", start + STRETCH_CHARS)) if i >= 0]
            cut = min(ahead, default=len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """This process's counter for a vocabulary file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` for every row of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_text = counter(vocabulary).text
        for batch in batches:
            words, tokens = zip(*(of_text(t.as_py()) for t in batch.column(1))) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return keyed_texts(docs).mapInArrow(count, "doc_id long, n_words long, n_tokens long")
