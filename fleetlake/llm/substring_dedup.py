"""Substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of each text (a random 16-bit value for each byte, shifted in, so that it
depends on the last 16 bytes). A chunk ends where that hash is the smallest within ``reach`` bytes on either side, so
cuts depend on nearby bytes alone: an insertion moves the cuts around it and no others, chunks are ``reach`` bytes or
longer and about twice that on average. Chunks are deduplicated by a 64-bit digest: one is repeated if different
documents hold it, and belongs to the smallest of these ids. Neighbouring repeated chunks of a document are joined
to a run; runs of ``min_chars`` characters or more count as repeated passages (a shared short line is none). With the
defaults, a repeated passage of over 50 words keeps enough whole chunks to be found even when all around it differs.

What is shuffled: one row of some 50 bytes for each chunk, twice (smallest and largest document by digest, summed before
the shuffle; then the look-up, a sort-merge join whose skewed keys Spark splits), and the repeated chunks once more by
document. The text itself is not shuffled to find passages, and once, by document, to cut them out.

Defined cases: a null or empty text has no chunks. A document is its ``doc_id`` and its text (by hash): different texts
of one id, or of none, are different documents, ordered by that hash, and each is cut at its own passages only. Rows that
repeat both are one document: what repeats only there is left alone, as are repeats inside one text. A null ``doc_id``
is read as the smallest long integer, and is null again in the result. Offsets are code points, the end is exclusive.
Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import PIECE_CHARS, keyed_texts, mix64, stored

#: Bytes on either side among which a cut has the smallest hash.
REACH = 16
#: Characters of a repeated passage, at least.
MIN_CHARS = 120
_HASH_BYTES = 16
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
_NO_ID = -(1 << 63)


def _gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte; doubling the covered width gives it for all places at once."""
    h = _GEAR[data]
    width = 1
    while width < _HASH_BYTES:
        h[width:] += h[:-width] << np.uint16(width)
        width *= 2
    return h


def _least_around(h: np.ndarray, reach: int) -> np.ndarray:
    """The smallest value within ``reach`` places on either side of each place (ends count as the largest)."""
    size = 2 * reach + 1
    m = np.full(len(h) + 2 * reach, 0xFFFF, dtype=np.uint16)
    m[reach:reach + len(h)] = h
    width = 1
    while 2 * width <= size:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = size - width
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def _cuts_of_part(data: np.ndarray, reach: int) -> np.ndarray:
    h = _gear_hash(data)
    inner = (data[1:] & 0xC0) == 0x80  # a cut never falls inside a character
    h[:-1][inner] = 0xFFFF
    return np.flatnonzero((h == _least_around(h, reach)) & (h != 0xFFFF)) + 1


def chunk_ends(data: bytes, reach: int = REACH) -> np.ndarray:
    """Byte offsets at which chunks end; the last is the length of ``data``. Works on parts of bounded size."""
    whole = np.frombuffer(data, dtype=np.uint8)
    margin = _HASH_BYTES + reach
    found = []
    for a in range(0, len(whole), PIECE_CHARS):
        b = min(len(whole), a + PIECE_CHARS)
        lo, hi = max(0, a - margin), min(len(whole), b + margin)
        cuts = _cuts_of_part(whole[lo:hi], reach) + lo
        found.append(cuts[(cuts > a) & (cuts <= b)])
    cuts = np.concatenate(found) if found else np.zeros(0, np.int64)
    if len(cuts) and (np.diff(cuts) < reach).any():  # equal hashes in a periodic text
        kept, last = [], -reach
        for c in cuts.tolist():
            if c - last >= reach:
                kept.append(c)
                last = c
        cuts = np.array(kept)
    return np.append(cuts[cuts < len(whole)], len(whole)) if len(whole) else cuts


def _chunks(text: str, reach: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Start and length in code points, and the digest, of each chunk of a text."""
    data = text.encode()
    ends = chunk_ends(data, reach)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    view = memoryview(data)
    digests = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
    if len(data) != len(text):
        chars = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80, out=chars[1:])
        starts, ends = chars[starts], chars[ends]
    return starts, ends - starts, digests


def _identified(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, text)``: ``h`` tells the texts of one id apart, no id is the smallest long."""
    return keyed_texts(docs).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def chunk_table(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``(doc_id, h, start, n, digest)``: every chunk of every row."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "h", "start", "n", "digest"]
        for batch in batches:
            held, size = [], 0
            for doc_id, h, text in zip(*batch.columns):
                starts, n, digests = _chunks(text.as_py(), reach)
                of_doc = np.full(len(n), doc_id.as_py()), np.full(len(n), h.as_py())
                held.append((*of_doc, starts, n, np.array(digests, dtype=np.uint64).view(np.int64)))
                size += len(n)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
                    held, size = [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)

    return _identified(docs).where("text <> ''").mapInArrow(explode, "doc_id long, h long, start long, n long, digest long")


def repeated_passages(docs: DataFrame, min_chars: int = MIN_CHARS, reach: int = REACH) -> DataFrame:
    """``(doc_id, start, end, first_doc_id, kept)``: the parts of each document that repeat across documents.

    ``kept`` parts belong to this document, the first that holds their chunks; the others repeat
    ``first_doc_id`` (the smallest owner of their chunks) and are what :func:`dedup_substrings` cuts out.
    """
    named = lambda c: F.nullif(F.col(c), F.lit(_NO_ID)).alias(c)
    return _passages(docs, min_chars, reach).select(named("doc_id"), "start", "end", named("first_doc_id"), "kept")


def _passages(docs: DataFrame, min_chars: int, reach: int) -> DataFrame:
    """``(doc_id, h, start, end, first_doc_id, kept)``, with the smallest long for no id."""
    chunks = chunk_table(docs, reach)
    doc = F.struct("doc_id", "h")
    owners = chunks.groupBy("digest").agg(F.min(doc).alias("owner"), F.max(doc).alias("last"))
    owners = stored(owners.where("owner <> last").select("digest", "owner"), "chunk-owners")
    hits = chunks.join(owners, "digest").select("doc_id", "h", "start", "n", "owner")
    hits = hits.repartition("doc_id", "h").groupBy("doc_id", "h", "start", "n").agg(F.min("owner").alias("owner"))
    by_place = Window.partitionBy("doc_id", "h").orderBy("start", "n")
    before = F.lag(F.col("start") + F.col("n")).over(by_place)
    hits = hits.withColumn("kept", F.col("owner") == doc)
    marked = hits.withColumn("new_run", F.when(before == F.col("start"), 0).otherwise(1)).withColumn(
        "new_part", F.when((F.col("new_run") == 0) & (F.lag("kept").over(by_place) == F.col("kept")), 0).otherwise(1))
    placed = marked.withColumn("run", F.sum("new_run").over(by_place)).withColumn("part", F.sum("new_part").over(by_place))
    parts = placed.groupBy("doc_id", "h", "run", "part").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"),
        F.min("owner.doc_id").alias("first_doc_id"), F.first("kept").alias("kept"))
    whole_run = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy("doc_id", "h", "run"))
    return parts.withColumn("run_chars", whole_run).where(F.col("run_chars") >= min_chars).drop("run", "part", "run_chars")


def dedup_substrings(docs: DataFrame, min_chars: int = MIN_CHARS, reach: int = REACH) -> DataFrame:
    """``(doc_id, n_cut, text)`` for every row: its text without the parts that repeat another document."""
    spans = (
        _passages(docs, min_chars, reach).where(~F.col("kept"))
        .groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_cut, kept = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at, parts = 0, []
                for span in spans or ():
                    parts.append(text[at:span["start"]])
                    at = span["end"]
                parts.append(text[at:])
                kept.append("".join(parts))
                n_cut.append(len(text) - len(kept[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_cut, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_cut", "text"])

    joined = _identified(docs).join(spans, ["doc_id", "h"], "left").select(
        F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_cut long, text string")
