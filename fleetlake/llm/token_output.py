"""Token ids of whole texts, written as one wavelet-matrix file a shard and read back.

Texts are dealt by ranges of ``doc_id`` (one shuffle of the text; the ranges come from a sample of ids) and sorted
there, so the shards hold all documents in ascending order. A task encodes one document after the other and closes a
shard at ``shard_tokens`` ids: memory is bounded by a shard, not by a partition. Each shard is one row of one Parquet
file below ``path``, written by Spark's own committer, so a lost executor or a repeated task leaves no half file and
any store that Spark can write will do.

File format: ``part, seq`` (place of the shard), ``first_doc_id``, ``n_tokens``, ``doc_ids`` and ``doc_tokens`` (its
documents in order, and the number of ids of each, the end id included) and ``matrix``, the bytes of
:class:`fleetlake.llm.wavelet.WaveletMatrix` over all its ids.

Defined cases: a null text is an empty one, which has only its end id. Rows that repeat a ``doc_id`` stay apart and
stand next to each other in no fixed order among themselves; a null ``doc_id`` comes first. A text longer than a shard
makes one larger shard. Extra columns are left out. No rows give no files.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import keyed_texts
from fleetlake.llm.wavelet import WaveletMatrix
from fleetlake.session import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
SHARD_TOKENS = 1 << 22
#: Encoded words that a Python worker remembers; beyond it, it starts anew.
REMEMBERED_WORDS = 1_000_000
#: Longer words are not remembered.
REMEMBERED_CHARS = 64
#: The normaliser and the splitting for which a text's ids are those of its words.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Fixed value: the white space that the tokenizer's own splitting drops (Unicode White_Space).
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_OTHER_SPLITS = re.compile("[\x1c-\x1f]")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

SHARD_SCHEMA = (
    "part int, seq int, first_doc_id long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, matrix binary")


def _byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)})
    return letters


class WordEncoder:
    """Ids of whole texts, encoded by the tokenizers library word by word and remembered.

    No token of this tokenizer spans white space, so a text's ids are those of its words in order. A word of letters,
    or letters and closing marks, goes to the library's normaliser and BPE model directly; any other word takes the
    library's whole encode, as does every text if the file's normaliser or splitting is another. Ids come as bytes, unsigned 32-bit little-endian.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._normalizer = self._tokenizer.model, self._tokenizer.normalizer
        self._letters = {b: ord(c) for b, c in _byte_letters().items()}
        ids = range(max(self._tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
        self._packed = [i.to_bytes(4, "little") for i in ids]
        self._remembered = remembered
        self._known: dict[str, bytes] = {}
        # Ids of the letters before closing marks: what is known of a word says nothing of it as a stem, as the library's
        # lower case may end in a combining mark, which forms one piece with the marks behind it.
        self._stems: dict[str, bytes] = {}
        made = json.loads(self._tokenizer.to_str())
        self._by_words = (made["normalizer"], made["pre_tokenizer"]) == (_NORMALIZER, _PRE_TOKENIZER)

    def _whole(self, text: str) -> bytes:
        packed = self._packed
        return b"".join([packed[i] for i in self._tokenizer.encode(text, add_special_tokens=False).ids])

    def _letters_only(self, word: str) -> bytes | None:
        if not (word.isascii() and word.islower()):
            word = self._normalizer.normalize_str(word)
            if not word.isalpha() or max(word) > "\u024f":
                return None
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self._letters)
        packed = self._packed
        return b"".join([packed[t.id] for t in self._model.tokenize(word)])

    def _word(self, word: str) -> bytes:
        """Ids of a word that is not known yet; its stem is remembered too, as other marks may follow it elsewhere."""
        plain = word.lower() if word.isascii() else word
        stem = plain.rstrip(_MARKS)
        if not stem.isalpha():
            return self._whole(word)
        ids = self._stems.get(stem)
        if ids is None:
            ids = self._letters_only(stem)
            if ids is None:
                return self._whole(word)
            if len(stem) <= REMEMBERED_CHARS:
                self._stems[stem] = ids
        if len(stem) == len(plain):
            return ids
        marks = plain[len(stem):]
        tail = self._known.get(marks)
        if tail is None:
            tail = self._whole(marks)
            if len(marks) <= REMEMBERED_CHARS:
                self._known[marks] = tail
        return ids + tail

    def encode(self, text: str) -> bytes:
        if not self._by_words:
            return self._whole(text)
        if text.isascii() and "<|" not in text:  # special tokens are spelled in one case
            text = text.lower()
        words = _SPACE.split(text) if _OTHER_SPLITS.search(text) else text.split()
        known = self._known
        if len(known) + len(self._stems) > self._remembered:
            known.clear()
            self._stems.clear()
        new = set(words).difference(known)
        for word in new:
            known[word] = self._word(word) if word else b""
        ids = b"".join([known[word] for word in words])
        for word in new:
            if len(word) > REMEMBERED_CHARS:
                del known[word]
        return ids


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_token_shards(
    docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
) -> str:
    """Encode every row of ``docs``, append ``end_id`` to each, and write the shards below ``path``."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, end = TaskContext.get().partitionId(), encoder(tokenizer).encode, np.uint32(end_id).tobytes()
        seq, held = 0, 0
        ids: list[int | None] = []
        tokens: list[bytes] = []

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(tokens), dtype="<u4"))
            row = [part, seq, ids[0], held, list(ids), [len(t) // 4 for t in tokens], matrix]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "seq", "first_doc_id", "n_tokens", "doc_ids", "doc_tokens", "matrix"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                tokens.append(encode(text.as_py()) + end)
                held += len(tokens[-1]) // 4
                if held >= shard_tokens:
                    yield close()
                    seq, held = seq + 1, 0
                    ids.clear()
                    tokens.clear()
        if ids:
            yield close()

    ranged = keyed_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(shards, SHARD_SCHEMA).write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards below ``path``, one row each."""
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(part, seq, shard_start)``: the number of ids in all shards before each. One small row a shard is summed
    in order; shards hold millions of ids, so this stays short."""
    shards = read_shards(spark, path).select("part", "seq", "first_doc_id", "n_tokens")
    before = Window.orderBy(F.col("first_doc_id").asc_nulls_first(), "part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start"))


def read_token_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, part, seq)`` for every document, from the files alone."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, doc_ids, sizes, matrix = (batch.column(c)[i] for c in ("part", "seq", "doc_ids", "doc_tokens", "matrix"))
                data = WaveletMatrix(matrix.as_py()).decode().astype("<u4").tobytes()
                n = sizes.values.to_numpy()
                start = np.cumsum(n) - n
                crc = [zlib.crc32(data[4 * a:4 * (a + b)]) for a, b in zip(start.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(start), pa.array(n), pa.array(crc, pa.int64()),
                     pa.array([part.as_py()] * len(n), pa.int32()), pa.array([seq.as_py()] * len(n), pa.int32())],
                    names=["doc_id", "local_start", "n_tokens", "ids_crc32", "part", "seq"])

    found = read_shards(spark, path).mapInArrow(
        documents, "doc_id long, local_start long, n_tokens long, ids_crc32 long, part int, seq int")
    return found.join(shard_starts(spark, path), ["part", "seq"]).select(
        "doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def token_binary(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write the token ids of ``docs`` to a fresh folder of the shared scratch space and read them back."""
    spark = docs.sparkSession
    path = write_token_shards(docs, scratch_path(spark, "token-shards"), tokenizer)
    return read_token_documents(spark, path)
