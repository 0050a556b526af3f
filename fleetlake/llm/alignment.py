"""Alignment of two tokenizers over the same texts, and how often their tokens meet in the corpus.

For each text, the byte offsets at which tokens end are kept in a dictionary from end to index for each tokenizer. The
keys that both hash sets share, sorted, slice both id lists into groups that cover the same bytes. Each slice is expanded
to its links, the pairs of tokens whose bytes overlap: it holds no common end inside, so each end in it closes one link.

Texts are aligned once, in blocks. A block is stored as one row: the distinct id pairs of its links with their counts, and
for every link, in order, the pair's number and whether its tokens end there; ids, groups and links follow from that. Counts
over the corpus are sums of the blocks' counts by pair. They come back to a block by a join on the pair, one row for each
distinct pair of a block, so a pair that stands in every text is a row a block and no hot key. No table of all pairs is
sent anywhere. The memory of a task is bounded by a block (``block_chars`` of text, and the text that exceeds it).

Defined cases: a text that is null, empty, or that either tokenizer does not give back byte for byte has no tokens, groups
or links. Rows that repeat a ``doc_id`` each get their row; a null ``doc_id`` stays. Extra columns are left out.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import keyed_texts, row_slices, stored
from fleetlake.llm.token_output import _byte_letters

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Text of a block; a longer text is a block of its own.
BLOCK_CHARS = 8 << 20
#: Texts handed to the tokenizers at once hold so many characters (one text at least).
CALL_CHARS = 1 << 18
#: Texts with a longer word go to the library whose time does not grow with the square of a word.
LONGEST_WORD = 2000
_SHIFT = 32
#: Fixed value: how the piece vocabulary writes a space.
_SPACE = "▁"

BLOCK_SCHEMA = (
    "block long, pairs array<long>, counts array<long>, doc_ids array<long>, doc_links array<int>, codes binary, ends binary")
_BLOCK_TYPES = [
    pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
RESULT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class Pair:
    """The two tokenizers, with the bytes of each id."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(byte_level)
        self._a.encode_special_tokens = True
        byte_of = {c: b for b, c in _byte_letters().items()}
        vocabulary = self._a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            letters = [byte_of.get(c) for c in token]
            self.bytes_a[i] = token.encode() if None in letters else bytes(letters)
        self._fast = self._ranked(byte_level, vocabulary)
        self._b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bytes_b = [self._piece_bytes(i) for i in range(self._b.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))

    def _piece_bytes(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self._b.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def _ranked(self, byte_level: str, vocabulary: dict[str, int]):
        """The byte-level vocabulary for the tiktoken library, which is several times faster, or None where its rule could
        give other ids. It merges any neighbours that make a token, by rank of the token, where the file merges the pairs
        it lists; that is the same if tokens are numbered in the order of the merges and each token comes out of its own
        bytes alone: what has merged in a stretch never depends on what stands around it."""
        with open(byte_level, encoding="utf-8") as f:
            made = json.load(f)
        before, model = made["pre_tokenizer"] or {}, made["model"]
        plain = made["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        special = {t["content"] for t in made["added_tokens"]}
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if not plain or not all(t["special"] for t in made["added_tokens"]) or merged != sorted(merged):
            return None
        tokens = {t: i for t, i in vocabulary.items() if t not in special}
        if any([x.id for x in self._a.model.tokenize(t)] != [i] for t, i in tokens.items()):
            return None
        import tiktoken

        return tiktoken.Encoding(
            "byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.bytes_a[i]: i for i in tokens.values()}, special_tokens={})

    def _encode_a(self, text: str) -> np.ndarray | None:
        """The ids of a text, None if they do not give it back."""
        if self._fast is None or (len(text) > LONGEST_WORD and len(max(text.split(), key=len, default="")) > LONGEST_WORD):
            ids = self._a.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype=np.int64) if b"".join(map(self.bytes_a.__getitem__, ids)) == text.encode() else None
        return self._fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)  # bytes merge to tokens of the same bytes

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Both id lists of each text, None where either does not give the text back."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, ids_b in zip(texts, self._b.encode(texts, num_threads=1)):
            whole = " " + text
            ids_a = self._encode_a(whole) if text and b"".join(map(self.bytes_b.__getitem__, ids_b)) == whole.encode() else None
            out.append(None if ids_a is None else (ids_a, np.array(ids_b)))
        return out

    def links(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every link, in order: index of its token in either list, and whether that token ends with the link."""
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        index_a, index_b = (dict(zip(ends.tolist(), range(len(ends)))) for ends in (ends_a, ends_b))
        common = sorted(index_a.keys() & index_b.keys())
        # A slice lies between two common ends. Every end inside it, and the common one behind it, closes one link.
        closes_slice = np.zeros(len(ends_a), dtype=bool)
        closes_slice[list(map(index_a.__getitem__, common))] = True
        inner_b = np.ones(len(ends_b), dtype=bool)
        inner_b[list(map(index_b.__getitem__, common))] = False
        order = np.argsort(np.concatenate([ends_a, ends_b[inner_b]]), kind="stable")
        end_a = order < len(ends_a)
        end_b = ~end_a
        end_b[end_a] = closes_slice[order[end_a]]
        return np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b, end_a, end_b


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(byte_level: str, pieces: str) -> Pair:
    if (byte_level, pieces) not in _pairs:
        _pairs[byte_level, pieces] = Pair(byte_level, pieces)
    return _pairs[byte_level, pieces]


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 by byte planes, compressed; small numbers have empty upper planes."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def aligned_blocks(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The alignments of all texts, one stored row a block."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part = _pair(byte_level, pieces), TaskContext.get().partitionId()
        seq, chars = 0, 0
        doc_ids: list[int | None] = []
        doc_links: list[int] = []
        held: list[np.ndarray] = []
        flags: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            links = np.concatenate(held) if held else np.zeros(0, np.int64)
            coded = pa.array(links).dictionary_encode()
            pairs, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            counts = np.bincount(codes, minlength=len(pairs))
            order = np.argsort(-counts, kind="stable")
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.arange(len(order))
            bits = np.concatenate(flags) if flags else np.zeros(0, bool)
            row = [part << 33 | seq, pairs[order], counts[order], list(doc_ids), list(doc_links),
                   _pack(number[codes]), zstandard.compress(np.packbits(bits).tobytes(), 1)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES)], names=BLOCK_SCHEMA.replace(",", " ").split()[::2])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in row_slices(map(len, texts), min(CALL_CHARS, block_chars)):
                for doc_id, text, sides in zip(ids[a:b], texts[a:b], pair.encode(texts[a:b])):
                    doc_ids.append(doc_id)
                    doc_links.append(0)
                    chars += len(text)
                    if sides:
                        ids_a, ids_b = sides
                        at_a, at_b, end_a, end_b = pair.links(ids_a, ids_b)
                        doc_links[-1] = len(at_a)
                        held.append(ids_a[at_a] << _SHIFT | ids_b[at_b])
                        flags.append(np.column_stack([end_a, end_b]).ravel())
                if chars >= block_chars:
                    yield close()
                    seq, chars = seq + 1, 0
                    for column in (doc_ids, doc_links, held, flags):
                        column.clear()
        if doc_ids:
            yield close()

    return stored(keyed_texts(docs).mapInArrow(aligned, BLOCK_SCHEMA), "alignment-blocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, count, best)`` of every linked id pair: its links in the corpus, and whether no other pair of the same
    second id has more."""
    one = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    counts = one.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("count"))
    second = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    highest = F.max("count").over(Window.partitionBy(second))
    return counts.select("pair", "count", (F.col("count") == highest).alias("best"))


def _groups_text(ids_a: np.ndarray, ids_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, names: list[str]) -> str:
    """The groups as ``a1,a2|b1;...``: groups end before the indexes ``to_a`` and ``to_b``. ``names`` are the decimal ids with
    a comma, then with a bar, then with a semicolon."""
    third = len(names) // 3
    codes = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    before_b, size_a, size_b = np.concatenate([[0], to_b[:-1]]), np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    codes_a, codes_b = ids_a.copy(), ids_b.copy()
    codes_a[to_a - 1] += third
    codes_b[to_b - 1] += 2 * third
    codes[np.arange(len(ids_a)) + np.repeat(before_b, size_a)] = codes_a
    codes[np.arange(len(ids_b)) + np.repeat(to_a, size_b)] = codes_b
    return "".join(map(names.__getitem__, codes.tolist()))[:-1]


def alignments(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per text: ``groups`` (``a1,a2|b1;a3|b2``, ids in order), the numbers of tokens, groups and links, the links whose
    pair is the most frequent of its second id (``n_best``), and the sum over links of the pair's count (``count_sum``)."""
    blocks = aligned_blocks(docs, byte_level, pieces, block_chars)
    places = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    support = places.join(pair_counts(blocks), "pair").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("at", "count", "best"))).alias("support"))
    support = support.select("block", F.col("support.count").alias("corpus"), F.col("support.best").alias("best"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        third = max(len(side) for side in (_pair(byte_level, pieces).bytes_a, _pair(byte_level, pieces).bytes_b))
        names = [f"{i}{mark}" for mark in ",|;" for i in range(third)]
        columns = RESULT_SCHEMA.replace(",", " ").split()[::2]
        for batch in batches:
            for row in range(batch.num_rows):
                pairs, doc_ids, doc_links, codes, ends, corpus, best = (batch.column(c)[row].as_py() if c in ("codes", "ends") else batch.column(c)[row] for c in (
                    "pairs", "doc_ids", "doc_links", "codes", "ends", "corpus", "best"))
                pair = pairs.values.to_numpy()
                if len(pair):
                    counts, is_best = corpus.values.to_numpy(), best.values.to_numpy(zero_copy_only=False)
                numbers = _unpack(codes)
                flags = np.unpackbits(np.frombuffer(zstandard.decompress(ends), np.uint8), count=2 * len(numbers)).reshape(-1, 2).astype(bool)
                out: list[tuple] = []
                start = chars = 0
                for doc_id, n in zip(doc_ids.values.to_pylist(), doc_links.values.to_pylist()):
                    if not n:
                        out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
                        continue
                    at, (end_a, end_b) = numbers[start:start + n], flags[start:start + n].T
                    start += n
                    ids = pair[at]
                    ids_a, ids_b = ids[end_a] >> _SHIFT, ids[end_b] & ((1 << _SHIFT) - 1)
                    both = end_a & end_b
                    text = _groups_text(ids_a, ids_b, np.cumsum(end_a)[both], np.cumsum(end_b)[both], names)
                    out.append((doc_id, len(ids_a), len(ids_b), int(both.sum()), n, int(is_best[at].sum()), int(counts[at].sum()), text))
                    chars += len(text)
                    if chars >= block_chars:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(zip(*out))], names=columns)
                        out, chars = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(zip(*out))], names=columns)

    return blocks.join(support, "block", "left").mapInArrow(texts, RESULT_SCHEMA)
