"""Line deduplication over whole documents.

Lines are normalised, hashed and counted by distinct document; a line found in ``min_docs`` documents or more is
dropped everywhere but in the largest ``doc_id`` that holds it, and each text is put together again by position.

What is shuffled: one row of 24 bytes for each distinct long line of a document, twice (count, then look-up), and
each text once, to meet the hashes it loses. Counting deals rows by (line, document) before it deals them by line, so
a line that a third of all documents share is summed before it meets in one place; the look-up is a plain sort-merge
join whose skewed keys Spark splits.

Defined cases: a null or empty text has one empty line. Rows that repeat a ``doc_id`` count as one document and lose
the same lines; a null ``doc_id`` is an id like any other, smaller than all. Lines shorter than ``min_chars`` code
points after normalising always stay. When every line is dropped the kept text is empty. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import keyed_texts, stored

MIN_CHARS = 20
MIN_DOCS = 3
#: Fixed values of the line key: what is stripped at both ends, and the letters that are lower-cased.
STRIPPED = " \t\n\x0b\x0c\r"
_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def line_key(line: str) -> str:
    """The line stripped of white space at both ends, A-Z in lower case."""
    key = line.strip(STRIPPED)
    return key.lower() if key.isascii() else key.translate(_ASCII_LOWER)


def _digests(lines: list[str], min_chars: int) -> list[bytes | None]:
    """The 128-bit digest of each line's key; None for keys that are too short to be dropped."""
    keys = [line_key(x) for x in lines]
    return [xxhash.xxh3_128_digest(k.encode()) if len(k) >= min_chars else None for k in keys]


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, h1, h2)``: each distinct long line of each row, as the two halves of its digest."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, counts = batch.column(0), [], []
            for text in batch.column(1):
                own = set(_digests(text.as_py().split("\n"), min_chars))
                own.discard(None)
                digests += own
                counts.append(len(own))
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["doc_id", "h1", "h2"])

    return keyed_texts(docs).mapInArrow(explode, "doc_id long, h1 long, h2 long")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)`` for every row of ``docs``; ``text`` has the lines that stay."""
    keys = stored(line_keys(docs, min_chars), "line-keys")
    # a null id is counted as a value of its own
    counted = F.struct(F.col("doc_id"))
    counts = keys.groupBy("h1", "h2").agg(F.countDistinct(counted).alias("n"), F.max("doc_id").alias("keeper"))
    repeated = stored(counts.where(F.col("n") >= min_docs).select("h1", "h2", "keeper"), "repeated-lines")
    drops = (
        keys.join(repeated, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
    )
    texts = keyed_texts(docs)
    joined = texts.join(drops, texts.doc_id.eqNullSafe(drops.drop_id), "left").select("doc_id", "text", "drops")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drops in zip(batch.column(1), batch.column(2)):
                text, drops = text.as_py(), drops.as_py()
                if not drops:
                    n_lines.append(text.count("\n") + 1)
                    n_dropped.append(0)
                    kept.append(text)
                    continue
                gone = {np.array([d["h1"], d["h2"]], dtype="<i8").tobytes() for d in drops}
                lines = text.split("\n")
                stay = [x for x, digest in zip(lines, _digests(lines, min_chars)) if digest not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "text"])

    return joined.mapInArrow(assemble, "doc_id long, n_lines long, n_dropped long, text string")
