"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A document is contaminated by a test item if it holds ``containment`` or more of the item's distinct word shingles,
wherever they stand in a document of whatever length. An item of fewer than ``k`` words is one shingle of all its words,
and is searched among the documents' shingles of that width.

Items are partitioned by the number of their shingles, in powers of two. The signature of an item is its bottom-k MinHash
sketch, the ``k`` smallest hashes of its shingles, with ``k`` tuned for each partition: the largest number of shingles that
a contaminated document may lack, and one more. By the pigeonhole principle such a document holds a member of the sketch,
so the search loses nothing. A document is sketched by the same hash order: its shingles with a hash above the largest in
any sketch can meet none, and are dropped where they are made.

Documents are read twice, never shuffled: the first pass meets the sketches (another one those of short items, if there
are any; each width has its own bound on hashes), the last only documents that hold a member of one, to count shared shingles exactly, as text. Sketches and candidate pairs are sent to every task while they are under
``BROADCAST_ROWS`` rows (counted first); beyond that the same joins deal rows by hash. All is DataFrame code.

Defined cases: words are the runs of letters, marks and digits in lower case; texts and items without words (null and
empty ones among them) match nothing, and a text of fewer than ``k`` words matches short items only. Rows that repeat an ``item_id`` or a ``doc_id`` give
one pair, with the largest containment. A null ``doc_id`` or ``item_id`` is an id like any other. A row
is dropped for its own text, never for another text of its id. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import SHINGLE_WORDS, SIMILARITY, stored

#: Rows of a small table (40 bytes each, or a candidate's id and its items) that are sent to every task.
BROADCAST_ROWS = 200_000
_WORD_BREAK = r"[^\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _WORD_BREAK), "")


def _shingle_at(w: Column, i: Column, k: int) -> list[Column]:
    return [F.get(w, i + j) for j in range(k)]


def _places(w: Column, k: int) -> Column:
    """Where the shingles of an array of words start."""
    return F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))


def shingles(column: str, k: int) -> Column:
    """The distinct shingles of a column of word arrays, as text. It takes a column and no expression, which would be
    worked out again for every place."""
    w = F.col(column)
    return F.array_distinct(F.transform(_places(w, k), lambda i: F.concat_ws(" ", *_shingle_at(w, i, k))))


def item_sketches(items: DataFrame, containment: float, k: int) -> DataFrame:
    """``(item, item_id, width, shingles, n_shingles, partition, sketch)`` for every item with words; ``width`` is the
    number of words of its shingles."""
    own = F.when(F.size("w") >= k, shingles("w", k)).when(F.size("w") > 0, F.array(F.array_join("w", " "))).otherwise(F.array())
    sets = items.select(
        F.xxhash64(F.col("item_id").cast("string"), F.col("text")).alias("item"), F.col("item_id"), words(F.col("text")).alias("w"),
    ).select("item", "item_id", F.least(F.lit(k), F.size("w")).alias("width"), own.alias("shingles")).dropDuplicates(["item"])
    sized = sets.withColumn("n_shingles", F.size("shingles")).where("n_shingles > 0")
    partition = F.floor(F.log2("n_shingles")).cast("int")
    # a contaminated document lacks n - ceil(containment * n) shingles at most; the partition's largest size lacks most
    largest = F.pow(F.lit(2), F.col("partition") + 1).cast("int") - 1
    size = (largest - F.ceil(F.lit(containment) * largest - 1e-9) + 1).cast("int")
    hashes = F.sort_array(F.transform("shingles", lambda s: F.xxhash64(*_shingle_at(F.split(s, " "), F.lit(0), k))))  # a null word adds nothing
    return sized.withColumn("partition", partition).withColumn("sketch", F.slice(hashes, 1, F.least(size, F.size(hashes))))


def _small(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """``df`` stored, and the same with a broadcast hint if it is counted to be small."""
    kept = stored(df, label)
    return kept, F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def contaminated(
    docs: DataFrame, items: DataFrame, containment: float = SIMILARITY, k: int = SHINGLE_WORDS,
) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_shingles, containment)`` for every pair of that containment or more."""
    pairs = _contaminated_texts(docs, items, containment, k)
    share = F.col("n_shared") / F.col("n_shingles")
    best = F.max(F.struct(share.alias("containment"), F.col("n_shared"), F.col("n_shingles"))).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("best.n_shared").cast("long").alias("n_shared"),
        F.col("best.n_shingles").cast("long").alias("n_shingles"), "best.containment")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _contaminated_texts(docs: DataFrame, items: DataFrame, containment: float, k: int) -> DataFrame:
    """``(doc_id, h, item_id, n_shared, n_shingles)``: such pairs by row; ``h`` tells the texts of one id apart."""
    known = stored(item_sketches(items, containment, k), "item-sketches")
    members, sketch = _small(known.select("item", "width", F.explode("sketch").alias("h")), "sketch-members")
    ceilings = {r.width: r.h for r in members.groupBy("width").agg(F.max("h").alias("h")).collect()}  # k rows or fewer
    sketch = sketch.drop("width")
    texts = docs.select(F.struct("doc_id", _text_hash(F.col("text")).alias("h")).alias("doc"), words(F.col("text")).alias("w"))
    places = texts.select("doc", "w", F.explode(_places(F.col("w"), k)).alias("i"))
    hashed = places.select("doc", F.xxhash64(*_shingle_at(F.col("w"), F.col("i"), k)).alias("h"))
    below = hashed.where(F.col("h") <= F.lit(ceilings.pop(k, None)).cast("long"))
    if ceilings:
        below = below.union(_short_hashes(texts, ceilings, k))
    found = below.join(sketch, "h").select("doc", "item").distinct()
    joined = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    n_shared = F.when(F.col("width") == k, F.size(F.array_intersect("shingles", "own"))).otherwise(
        F.contains(F.col("joined"), joined(F.col("shingles"))).cast("int"))
    candidates, small = _small(found.groupBy("doc").agg(F.collect_set("item").alias("items")), "candidates")
    checked = (
        docs.select(F.struct("doc_id", _text_hash(F.col("text")).alias("h")).alias("doc"), F.col("text")).join(small, "doc")
        .select("doc", words(F.col("text")).alias("w"), "items")
        .select("doc", shingles("w", k).alias("own"), (joined("w") if ceilings else F.lit("")).alias("joined"), "items")
        .select("doc", "own", "joined", F.explode("items").alias("item"))
        .join(known.select("item", "item_id", "width", "n_shingles", "shingles"), "item")
        .select("doc.doc_id", "doc.h", "item_id", n_shared.alias("n_shared"), "n_shingles")
    )
    return checked.where(F.col("n_shared") >= F.lit(containment) * F.col("n_shingles") - 1e-9)


def _short_hashes(texts: DataFrame, ceilings: dict[int, int], k: int) -> DataFrame:
    """``(doc, h)`` for the shingles of fewer than ``k`` words, of the widths that items have."""
    w = F.col("w")
    of_width = lambda n: F.transform(_places(w, n), lambda i: F.struct(i.alias("i"), F.lit(n).alias("width")))
    places = F.flatten(F.array(*[of_width(n) for n in ceilings]))
    at = texts.select("doc", "w", F.explode(places).alias("at")).select("doc", "w", "at.i", "at.width")
    within = [F.get(w, F.when(F.col("width") > j, F.col("i") + j)) for j in range(k - 1)]
    ceiling = F.lit(None).cast("long")
    for width, h in ceilings.items():
        ceiling = F.when(F.col("width") == width, h).otherwise(ceiling)
    return at.select("doc", F.xxhash64(*within).alias("h"), ceiling.alias("most")).where("h <= most").select("doc", "h")


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = SIMILARITY, k: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item: each row is judged by its own text."""
    found = _contaminated_texts(docs, items, containment, k).select(F.col("doc_id").alias("bad_id"), F.col("h").alias("bad_h")).distinct()
    bad, small = _small(found, "contaminated")
    return docs.join(small, docs["doc_id"].eqNullSafe(small["bad_id"]) & (_text_hash(docs["text"]) == small["bad_h"]), "left_anti")
