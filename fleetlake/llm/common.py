"""Helpers shared by the operators of this subpackage.

Table access, Arrow batch slicing, sorted-group streaming, scratch tables,
vectorised word and shingle hashing, and connected components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.session import ensure_conf, scratch_path

#: Word shingles of near-duplicate operators, unless a contract says otherwise.
SHINGLE_WORDS = 5
#: Similarity from which two texts are near duplicates.
SIMILARITY = 0.8
#: Bytes of rows that an Arrow batch takes on before it goes to a Python worker.
BATCH_BYTES = 4 << 20
#: Text handed to one vectorised hashing step; longer texts are hashed in pieces of this many characters.
PIECE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with the library's session settings applied."""
    ensure_conf(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, to be handed to Python in Arrow batches of ``BATCH_BYTES``: some long texts never meet in one batch
    of Spark's usual size. A setting of the session; it changes no result."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of a documents table; a null text is an empty one, extra columns are left out."""
    bounded_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared scratch folder and read back: lineage is cut there, so a lost
    executor never makes the steps before it run again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose sizes add up to ``most`` or less (one row at least)."""
    first = last = total = 0
    for last, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield first, last
            first, total = last, 0
    if last > first:
        yield first, last


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of a partition that is sorted by ``keys``, one at a time: one group is held, never the partition."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


# --- hashing of words and shingles -------------------------------------------------------------------------

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _char_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it part of a word (letter, mark, number), and its random 64-bit value."""
    if "word" not in _tables:
        import unicodedata

        category = unicodedata.category
        _tables["word"] = np.fromiter((category(chr(c))[0] in "LMN" for c in range(0x110000)), dtype=bool, count=0x110000)
        _tables["value"] = mix64(np.arange(1, 0x110001, dtype=_U) * _U(_BASE))
    return _tables["word"], _tables["value"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if "power" not in _tables or len(_tables["power"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=_U)
    return _tables["power"], _tables["inverse"]


def _pieces(text: str, most: int) -> Iterator[str]:
    """``text`` in pieces of ``most`` characters or fewer, cut at white space; a longer word is cut hard."""
    start = 0
    while len(text) - start > most:
        cut = max(text.rfind(" ", start, start + most), text.rfind("\n", start, start + most))
        cut = start + most if cut <= start else cut
        yield text[start:cut]
        start = cut
    yield text[start:]


def _hash_piece(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several pieces, and the number of words of each."""
    is_word, value = _char_tables()
    joined = "\n".join(pieces)
    cp = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    if not len(cp):
        return np.zeros(0, _U), np.zeros(len(pieces), np.int64)
    inside = np.zeros(len(cp) + 2, dtype=np.int8)
    inside[1:-1] = is_word[cp]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(cp) + 1)
    total = np.zeros(len(cp) + 1, dtype=_U)
    np.cumsum(value[cp] * power[: len(cp)], out=total[1:])
    words = mix64((total[ends] - total[starts]) * inverse[starts])
    bounds = np.cumsum([len(p) + 1 for p in pieces])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return words, counts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the word count of each text.

    Words are the maximal runs of letters, marks and digits of the lower-cased text. Memory beside the result is
    bounded by ``PIECE_CHARS``, whatever the length of a text.
    """
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    held: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            words, n = _hash_piece(held)
            hashes.append(words)
            np.add.at(counts, owner, n)
            held.clear()
            owner.clear()
            size = 0

    for i, text in enumerate(texts):
        for piece in _pieces(text.lower(), PIECE_CHARS):
            if size + len(piece) > PIECE_CHARS:
                flush()
            held.append(piece)
            owner.append(i)
            size += len(piece) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, _U)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of each text, and their number (not yet distinct).

    A text of 1 to ``k`` - 1 words has one shingle, all its words; a text without words has none.
    """
    ends = np.cumsum(counts)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    total = int(n.sum())
    if not total:
        return np.zeros(0, _U), n
    first = np.repeat(ends - counts, n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    stop = np.repeat(ends, n)
    out = np.zeros(total, dtype=_U)
    for j in range(k):
        at = first + j
        if j and len(words):
            inside = at < stop
            part = words[np.minimum(at, len(words) - 1)]
            part = np.where(inside, part, _U(0))
        else:
            part = words[at]
        out = out * _U(0xD6E8FEB86659FD93) + part
    return mix64(out), n


# --- connected components ----------------------------------------------------------------------------------


def components(edges: DataFrame, label: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; ``component`` is the smallest node reachable. Nodes
    are of one type that has an order, such as a long integer or a struct of them.

    Contraction rounds: every node moves to the first node of its closed neighbourhood, by id in even rounds (a star
    is done in one) and by a seeded hash in odd ones (a path halves in expectation), and edges are renamed and
    deduplicated. Each round only joins and pre-aggregated minima on node ids, so a hub is a skewed key of a plain
    join, never a group held in one task. Rounds are stored in the shared folder.
    """
    def rank(c, seed):
        return F.struct(F.xxhash64(F.lit(seed), c).alias("r"), c.alias("n")) if seed else F.struct(F.lit(0).cast("long").alias("r"), c.alias("n"))

    edges = stored(edges.select("a", "b").where("a <> b").distinct(), label)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    moved = nodes.select("node", F.col("node").alias("at"))
    for n in itertools.count():
        if edges.isEmpty():
            break
        seed = n if n % 2 else 0
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        here = stored(
            both.groupBy("a").agg(F.min(rank(F.col("b"), seed)).alias("m"))
            .select("a", F.least(F.col("m"), rank(F.col("a"), seed)).getField("n").alias("to")), label)
        ends = here.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        edges = stored(
            edges.join(here, "a").join(ends, "b").where("to <> to_b")
            .select(F.least("to", "to_b").alias("a"), F.greatest("to", "to_b").alias("b")).distinct(), label)
        moved = stored(
            moved.join(here.withColumnRenamed("a", "at"), "at", "left")
            .select("node", F.coalesce("to", "at").alias("at")), label)
    least = moved.groupBy("at").agg(F.min("node").alias("component"))
    return moved.join(least, "at").select("node", "component")

