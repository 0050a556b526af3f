"""Near-duplicate texts: an n-gram Jaccard self-join through a MinHash LSH forest, verified exactly.

1. *Signatures.* One pass over the text. The distinct word shingles of a text give ``TREES`` labels, each a path of
   ``DEPTH`` MinHash values of 16 bits. The pass also gives a digest of the normalised words.
2. *Exact classes.* Texts of equal digest are one class with a weight, and the row with the smallest id and text hash as its
   representative; only representatives go on, so thousands of copies are one row.
3. *Forest.* A tree is the sorted prefix trie of its labels. The matched prefix starts at the full path and is shortened
   level by level until ``1 - (1 - s ** depth) ** TREES``, the chance that a pair at the similarity bound shares a node in
   some tree, reaches ``RECALL``. Nodes of deeper levels lie inside those of the last level, so its nodes hold all
   candidates. Each node links its members to its smallest id (a pre-aggregated minimum and a join, in proportion to the
   members); connected components of these links are the candidate clusters.
4. *Verification.* All pairs inside a cluster are verified by exact Jaccard similarity on shingles, candidates or not.
   Texts of clusters are dealt by cluster; one of more than ``BLOCK_WORDS`` words is cut into pairs of blocks by a hash
   of the id. A task holds one pair of blocks. It returns sums of links and a link to the local root for each text,
   never pairs: a group of thousands of near copies costs rows in proportion to its members.

Defined cases: the words of a text are its runs of letters, marks and digits in lower case; 1 to 4 words are one shingle.
A text without words (null, empty) links with nothing. A document is a ``doc_id`` and its words (a text without words: its
characters): rows that repeat both count as one, and rows that share an id, or have a null one, are as many documents as
they have different texts. A null ``doc_id`` is read as the smallest long integer, and is null again in the result. Extra
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import (
    SHINGLE_WORDS, SIMILARITY, bounded_batches, components, keyed_texts, mix64, row_slices, shingle_hashes, sorted_groups,
    stored, word_hashes,
)

TREES = 20
DEPTH = 8
RECALL = 0.9999
#: Words of the texts of a cluster that are held on either side of a pair of blocks.
BLOCK_WORDS = 100_000
_SLICE_CHARS = 1 << 18
_NO_ID = -(1 << 63)
_COLUMNS = 1024


def matched_depth(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of that similarity meets in some tree with the target probability."""
    while depth > 1 and 1 - (1 - similarity ** depth) ** trees < recall:
        depth -= 1
    return depth


def forest_labels(words: np.ndarray, counts: np.ndarray, k: int = SHINGLE_WORDS, depth: int = DEPTH) -> np.ndarray:
    """For each text with words, in order: its labels to that depth, as ``[text, tree, level]`` of 16-bit MinHash values."""
    shingles, n = shingle_hashes(words, counts, k)
    starts = (np.cumsum(n) - n)[n > 0]
    out = np.zeros((len(starts), TREES, depth), dtype=np.uint16)
    if len(starts):
        masks = mix64(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)).reshape(TREES, DEPTH)
        for tree in range(TREES):
            for level in range(depth):
                # mixed anew for every function: minima of one hash under different masks depend on each other
                least = np.minimum.reduceat(mix64(shingles ^ masks[tree, level]), starts)
                out[:, tree, level] = (mix64(least) >> np.uint64(48)).astype(np.uint16)
    return out


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _hashed_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, h)``: id and hash name a text, also where ids are null or repeated."""
    return keyed_texts(docs).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text", _text_hash(F.col("text")).alias("h"))


def signatures(docs: DataFrame, depth: int, k: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, h, n_words, d1, d2, nodes)`` for every row: the hash of the text, the digest of the words, and the node of
    each tree at that depth. A row without words has no nodes, and the digest of its id and text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in row_slices(map(len, texts), _SLICE_CHARS):
                words, counts = word_hashes(texts[a:b])
                ends = np.cumsum(counts)
                digests = b"".join(
                    xxhash.xxh3_128_digest(words[ends[i] - n:ends[i]].tobytes()) if n else
                    xxhash.xxh3_128_digest(f"{ids[a + i]} {texts[a + i]}".encode(), seed=1) for i, n in enumerate(counts.tolist()))
                halves = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
                prefix = forest_labels(words, counts, k, depth)
                nodes = np.zeros(prefix.shape[:2], dtype=np.uint64)
                for level in range(depth):
                    nodes = mix64(nodes * np.uint64(0x9E3779B97F4A7C15) + prefix[:, :, level])
                nodes = mix64(nodes + np.arange(TREES, dtype=np.uint64))  # nodes of different trees stay apart
                offsets = np.concatenate([[0], np.cumsum((counts > 0) * TREES)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(counts), pa.array(halves[:, 0].copy()),
                     pa.array(halves[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(nodes.view(np.int64).ravel()))],
                    names=["doc_id", "h", "n_words", "d1", "d2", "nodes"])

    return _hashed_texts(docs).mapInArrow(sign, "doc_id long, h long, n_words long, d1 long, d2 long, nodes array<long>")


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``left``, the sets of ``right`` (other than itself) of that Jaccard similarity or more."""
    size = np.array([len(s) for s in sets], dtype=np.float64)
    if len(left) * len(right) <= 64:
        for i in left.tolist():
            hits = []
            for j in right.tolist():
                if i != j and min(size[i], size[j]) >= similarity * max(size[i], size[j]):
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if common >= similarity * (size[i] + size[j] - common) - 1e-9:
                        hits.append(j)
            yield i, np.array(hits, dtype=np.int64)
        return
    # shared shingles as columns of zeros and ones, a slice at a time; their products sum to the intersections
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column)
    kept = often[column] > 1
    owner, column = owner[kept], (np.cumsum(new[kept] if kept.any() else new[:0]) - 1)
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    n_columns = int(column[-1]) + 1 if len(column) else 0
    bounds = np.searchsorted(column, np.arange(0, n_columns + _COLUMNS, _COLUMNS))
    for c, (a, b) in enumerate(zip(bounds, bounds[1:])):
        grid = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        grid[owner[a:b], column[a:b] - c * _COLUMNS] = 1
        rows = np.zeros(len(sets), dtype=bool)
        rows[owner[a:b]] = True
        li, ri = np.flatnonzero(rows[left]), np.flatnonzero(rows[right])
        if len(li) and len(ri):
            common[np.ix_(li, ri)] += grid[left[li]] @ grid[right[ri]].T
    for x, i in enumerate(left.tolist()):
        hit = common[x] >= similarity * (size[i] + size[right] - common[x]) - 1e-9
        hit &= right != i
        yield i, right[hit]


def _verify(similarity: float, k: int):
    """Of one pair of blocks of a cluster: the weight of each text's links found here, and its local root."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c)) for c in zip(*done)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=["rep", "h", "links", "root", "root_h"])

        for (_, left_block, right_block), t in sorted_groups(batches, ["cluster", "left_block", "right_block"]):
            rep, h, weight, block = (t.column(c).to_numpy() for c in ("rep", "h", "weight", "block"))
            words, counts = word_hashes(t.column("text").to_pylist())
            shingles, n = shingle_hashes(words, counts, k)
            sets = [np.unique(s) for s in np.split(shingles, np.cumsum(n)[:-1])]
            del words, shingles
            left, right = np.flatnonzero(block == left_block), np.flatnonzero(block == right_block)
            links = np.zeros(len(rep), dtype=np.int64)
            parent = list(range(len(rep)))

            def root(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i, hits in _linked(sets, left, right, similarity):
                links[i] += int(weight[hits].sum())
                if left_block != right_block:
                    links[hits] += weight[i]
                for j in hits.tolist():
                    if parent[j] != parent[i]:
                        p, q = root(i), root(j)
                        if p != q:
                            low, high = (p, q) if (rep[p], h[p]) < (rep[q], h[q]) else (q, p)
                            parent[high] = low
            at = np.flatnonzero(links)
            if len(at):
                roots = [root(i) for i in at.tolist()]
                done.append((rep[at], h[at], links[at], rep[roots], h[roots]))
                size += len(at)
                if size >= 10_000:
                    yield out()
                    size = 0
        if done:
            yield out()

    return verify


def _documents(docs: DataFrame, similarity: float, k: int) -> DataFrame:
    """``(doc_id, d1, d2, class, n_links, exact)`` for every document; ``class`` and ``exact`` are the ``(rep, h)``, id and text
    hash, of a row. Ids are not null here."""
    signed = stored(signatures(docs, matched_depth(similarity), k), "forest")
    first = F.min(F.struct(F.col("doc_id").alias("rep"), "h")).alias("first")
    classes = stored(
        signed.groupBy("d1", "d2").agg(
            first, F.countDistinct("doc_id").alias("weight"), F.first("n_words").alias("n_words"), F.first("nodes").alias("nodes"),
        ).select("first.rep", "first.h", "d1", "d2", "weight", "n_words", "nodes"), "text-classes")
    # members of a node of the forest are linked to its smallest digest
    entries = classes.select("d1", F.explode("nodes").alias("node"))
    ends = entries.groupBy("node").agg(F.min("d1").alias("head"), F.max("d1").alias("last"))
    heads = stored(ends.where("head <> last").select("node", "head"), "forest-heads")
    candidates = entries.join(heads, "node").where("d1 <> head").select(
        F.col("d1").alias("a"), F.col("head").alias("b"))
    clusters = components(candidates, "text-clusters").select(F.col("node").alias("d1"), F.col("component").alias("cluster"))
    members = stored(
        classes.select("rep", "h", "d1", "weight", "n_words").join(clusters, "d1").drop("d1"), "cluster-members")
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum("n_words") / BLOCK_WORDS).cast("int").alias("n_blocks"))
    own = F.when(F.col("n_blocks") == 1, 0).otherwise(F.pmod(F.xxhash64(F.lit(7), "rep", "h"), "n_blocks")).cast("int")
    dealt = members.join(blocks, "cluster").withColumn("block", own)
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    dealt = dealt.select("rep", "h", "weight", "cluster", "block", other.alias("other")).select(
        "rep", "h", "weight", "cluster", "block", F.least("block", "other").alias("left_block"),
        F.greatest("block", "other").alias("right_block"))
    texts = _hashed_texts(docs).withColumnRenamed("doc_id", "rep")
    # rows that repeat an id and text are one
    # sorted and merged at every size, so that the work grows evenly
    once = texts.join(dealt.hint("merge"), ["rep", "h"]).groupBy("cluster", "left_block", "right_block", "rep", "h").agg(
        F.max("text").alias("text"), F.first("weight").alias("weight"), F.first("block").alias("block"))
    key = ["cluster", "left_block", "right_block"]
    pairs = once.select(*key, "rep", "h", "weight", "block", "text").repartition(*key).sortWithinPartitions(*key)
    found = stored(
        bounded_batches(pairs).mapInArrow(_verify(similarity, k), "rep long, h long, links long, root long, root_h long"), "text-links")
    links = found.groupBy("rep", "h").agg(F.sum("links").alias("links"))
    groups = components(
        found.select(F.struct("rep", "h").alias("a"), F.struct(F.col("root").alias("rep"), F.col("root_h").alias("h")).alias("b")),
        "text-groups").select("node.rep", "node.h", F.col("component").alias("class"))
    known = (
        classes.select("rep", "h", "weight", "d1", "d2").join(links, ["rep", "h"], "left").join(groups, ["rep", "h"], "left")
        .withColumn("exact", F.struct("rep", "h"))
        .select("d1", "d2", "exact", F.coalesce("class", "exact").alias("class"),
                (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    return signed.select("doc_id", "d1", "d2").distinct().join(known, ["d1", "d2"])


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, class_id, n_links, exact_id)`` for every document: every distinct ``doc_id`` and words of ``docs``.

    ``class_id`` is the smallest id that can be reached by links (the id itself if there is none), ``n_links`` the number
    of other documents whose similarity is ``similarity`` or more, ``exact_id`` the smallest id with the same words.
    """
    named = lambda c, name: F.nullif(c, F.lit(_NO_ID)).alias(name)
    return _documents(docs, similarity, k).select(
        named(F.col("doc_id"), "doc_id"), named(F.col("class.rep"), "class_id"), "n_links", named(F.col("exact.rep"), "exact_id"))


def one_of_each_group(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE_WORDS) -> DataFrame:
    """Of each group one row of ``docs``, with all its columns: that of the smallest id, and of the smallest text hash where an
    id has several texts of the group."""
    stay = _documents(docs, similarity, k).select(F.col("class.rep").alias("stays"), F.col("class.h").alias("stays_h")).distinct()
    own = "near_duplicates_text_hash"
    keyed = docs.withColumn(own, _text_hash(F.col("text")))
    same = (F.coalesce(keyed["doc_id"].cast("long"), F.lit(_NO_ID)) == stay["stays"]) & (keyed[own] == stay["stays_h"])
    return keyed.join(stay, same).select(keyed["*"]).dropDuplicates(["doc_id", own]).drop(own)
