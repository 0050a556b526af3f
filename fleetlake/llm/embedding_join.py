"""Near-duplicate embeddings: an exact metric range join inside each label.

Equal vectors of a label are first joined to one row with a weight. Vectors of unit length have the chord distance
sqrt(2 - 2 cos), a metric, so a cosine of ``threshold`` or more is a distance of ``reach`` or less. A label with more
than ``cell_rows`` vectors gets pivots from a seeded sample; each vector's home is the cell of its nearest pivot, at
distance ``d``. By the triangle inequality a partner with home at pivot ``p`` can only exist if ``d(x, p) <= d + 2 reach``
and ``d(x, p) <= radius(p) + reach``. The chord is a straight distance too, so ``x`` must also lie within ``reach`` of the
plane halfway between ``p`` and its own pivot, ``(d(x, p)^2 - d^2) / 2 <= reach * distance of the two pivots``, which
excludes more, in many dimensions above all. The cells that are left get a copy of ``x`` as a visitor. Every home vector
so meets all its partners in its own cell, and cells join independently. Cells beyond ``block_rows`` are cut into pairs of
blocks: the home vectors of block ``i`` against all members of block ``j``.

Pivots are the only thing that reaches the driver or is sent to every task: ``MAX_PIVOT_VALUES`` numbers at most, given
to the largest labels first; a label without pivots is one cell, joined in blocks like any other. Inside a task one pair of
blocks is held, and compared in slices by matrix products. Only sums and links to a local root leave a task, never pairs,
so a large group of copies costs rows in proportion to its members.

Defined cases: a vector that is null, zero, or holds a null or non-finite component links with nothing, nor does one with
a null label or a null ``vec_id``; vectors of different lengths never link. Rows that repeat ``vec_id``, label and vector
count once as a partner and each get their row. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import bounded_batches, components, sorted_groups, stored

THRESHOLD = 0.93
#: Vectors of a label that share one cell; larger labels get a pivot for each such share.
CELL_ROWS = 8192
#: Rows on either side of a block pair.
BLOCK_ROWS = 4096
#: Numbers in all pivots together (at 8 bytes: 16 MB), and pivots of one label.
MAX_PIVOT_VALUES = 1 << 21
MAX_LABEL_PIVOTS = 512
_SLICE = 512
#: Vectors by hash for each pivot wanted.
_OVERSAMPLE = 4
_ROUNDING = 1e-6


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; scaled by the largest component first, so that no square overflows."""
    if not len(column):
        return np.zeros((0, 0))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pivots(vectors: DataFrame, cell_rows: int) -> dict[tuple[str, int], list]:
    """For each large (label, length): its pivots, vectors with small seeded hashes of their ids. One job for the sizes and
    one for all pivots, whatever the number of labels; by chance a label may get fewer than wanted, or none (one cell)."""
    large = (
        vectors.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
        .orderBy(F.desc("n"), "label", "dim").limit(MAX_PIVOT_VALUES // 2).collect()
    )
    sizes = {(r.label, r.dim): r.n for r in large}
    budget, wanted = MAX_PIVOT_VALUES, []
    for r in large:
        k = min(MAX_LABEL_PIVOTS, math.ceil(r.n / cell_rows), budget // r.dim)
        if k > 1:
            wanted.append((r.label, r.dim, k))
            budget -= k * r.dim
    found: dict[tuple[str, int], list] = {}
    if not wanted:
        return found
    shares = vectors.sparkSession.createDataFrame(
        [(label, dim, k, _OVERSAMPLE * k / sizes[label, dim]) for label, dim, k in wanted], "label string, dim int, k int, share double")
    order = F.xxhash64(F.lit(17), "rep")
    # any vectors may be pivots: a share by hash is about _OVERSAMPLE times as many as are wanted, the first of it are taken
    some = vectors.join(F.broadcast(shares), ["label", "dim"]).where(F.pmod(order, F.lit(1 << 40)) < F.col("share") * (1 << 40))
    first = Window.partitionBy("label", "dim").orderBy(order, "rep")
    chosen = some.withColumn("place", F.row_number().over(first)).where(
        (F.col("place") <= MAX_LABEL_PIVOTS) & (F.col("place") <= F.col("k")))
    for r in chosen.select("label", "dim", "place", "embedding").orderBy("label", "dim", "place").collect():
        found.setdefault((r.label, r.dim), []).append(r.embedding)
    return {key: pivots for key, pivots in found.items() if len(pivots) > 1}


def _assign(vectors: DataFrame, pivots: dict[tuple[str, int], list], reach: float) -> DataFrame:
    """``(label, dim, cell, home, rep, weight, unit, far)``: the home cell of each vector, and the distances to the cells
    it may have to visit (``visits``, with their distances)."""
    unit_pivots = {k: _unit(pa.array([list(map(float, v)) for v in p])) for k, p in pivots.items()}
    apart = {k: np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (p @ p.T))) for k, p in unit_pivots.items()}
    schema = ("label string, dim int, rep long, weight long, unit array<double>, cell int, near double, "
              "visits array<int>, distances array<double>")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            rows: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(label, dim)):
                rows.setdefault(key, []).append(i)
            for key, own in rows.items():
                part = batch.take(pa.array(own))
                unit = _unit(part.column("embedding"))
                n = len(own)
                cell, near = np.zeros(n, np.int32), np.zeros(n)
                visits: list[list[int]] = [[]] * n
                distances: list[list[float]] = [[]] * n
                if key in unit_pivots:
                    cosine = unit @ unit_pivots[key].T
                    d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))
                    cell = d.argmin(axis=1).astype(np.int32)
                    near = d[np.arange(n), cell]
                    may = d <= near[:, None] + 2 * reach + _ROUNDING
                    gain = cosine[np.arange(n), cell][:, None] - cosine
                    may &= gain <= reach * apart[key][cell] + _ROUNDING
                    may[np.arange(n), cell] = False
                    visits = [np.flatnonzero(m).tolist() for m in may]
                    distances = [d[i, v].tolist() for i, v in enumerate(visits)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("dim"), part.column("rep"), part.column("weight"),
                     pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), unit.shape[1]).cast(pa.list_(pa.float64())),
                     pa.array(cell), pa.array(near), pa.array(visits, pa.list_(pa.int32())),
                     pa.array(distances, pa.list_(pa.float64()))],
                    names=["label", "dim", "rep", "weight", "unit", "cell", "near", "visits", "distances"])

    return bounded_batches(vectors).mapInArrow(place, schema)


def _join_blocks(reach_cosine: float):
    """Of one pair of blocks: the weight of each home vector's partners, and links to the smallest id of its local group."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in sorted_groups(batches, ["label", "dim", "cell", "home_block", "member_block"]):
            unit = _unit(t.column("unit").combine_chunks())
            rep, weight = t.column("rep").to_numpy(), t.column("weight").to_numpy()
            is_home = t.column("is_home").to_numpy(zero_copy_only=False)
            is_member = t.column("is_member").to_numpy(zero_copy_only=False)
            home, member = np.flatnonzero(is_home), np.flatnonzero(is_member)
            if not len(home) or not len(member):
                continue
            parent = np.arange(len(rep))

            def root(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            links = np.zeros(len(rep), dtype=np.int64)
            touched = np.zeros(len(rep), dtype=bool)
            for a in range(0, len(home), _SLICE):
                own = home[a:a + _SLICE]
                hit = unit[own] @ unit[member].T >= reach_cosine
                hit &= rep[own][:, None] != rep[member][None, :]
                links[own] += hit @ weight[member]
                for r in np.flatnonzero(hit.any(axis=1)).tolist():
                    x, others = int(own[r]), member[np.flatnonzero(hit[r])]
                    touched[x] = True
                    touched[others] = True
                    for o in others.tolist():
                        if parent[o] != parent[x]:
                            p, q = root(x), root(o)
                            if p != q:
                                low, high = (p, q) if rep[p] < rep[q] else (q, p)
                                parent[high] = low
            at = np.flatnonzero(touched)
            if len(at):
                roots = np.array([root(i) for i in at.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(links[at]), pa.array(rep[roots])], names=["rep", "links", "root"])

    return join


def near_duplicate_vectors(
    embeddings: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``embeddings (vec_id, embedding, label)``."""
    reach = math.sqrt(2.0 - 2.0 * threshold)
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    valid = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    same = stored(
        valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("weight"))
        .withColumn("dim", F.size("embedding")), "vectors")
    pivots = _pivots(same, cell_rows)
    placed = stored(_assign(same, pivots, reach), "vector-cells")
    cells = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("n_home"), F.max("near").alias("radius"))
    # a visit stays possible only within the radius of the cell that is visited
    visits = (
        placed.select("label", "dim", "rep", "weight", "unit", F.explode(F.arrays_zip("visits", "distances")).alias("v"))
        .select("label", "dim", "rep", "weight", "unit", F.col("v.visits").alias("cell"), F.col("v.distances").alias("distance"))
        .join(cells.select("label", "dim", "cell", "radius"), ["label", "dim", "cell"])
        .where(F.col("distance") <= F.col("radius") + reach + _ROUNDING)
        .select("label", "dim", "cell", "rep", "weight", "unit", F.lit(False).alias("home"))
    )
    members = placed.select("label", "dim", "cell", "rep", "weight", "unit", F.lit(True).alias("home")).unionByName(visits)
    sizes = members.groupBy("label", "dim", "cell").agg(
        F.ceil(F.count_if("home") / block_rows).cast("int").alias("home_blocks"),
        F.ceil(F.count("*") / block_rows).cast("int").alias("member_blocks"))
    spread = members.join(sizes, ["label", "dim", "cell"])
    own_home = F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("home_blocks")).cast("int")
    own_member = F.pmod(F.xxhash64(F.lit(2), "rep"), F.col("member_blocks")).cast("int")
    key = ["label", "dim", "cell", "home_block", "member_block"]
    base = ["label", "dim", "cell", "rep", "weight", "unit"]
    # a home vector is needed in every pair of its home block, a member in every pair of its member block
    as_home = spread.where("home").select(
        *base, own_home.alias("home_block"), F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1)).alias("member_block"),
        (F.col("member_block") == own_member).alias("is_member"), F.lit(True).alias("is_home"))
    as_member = spread.select(
        *base, F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1)).alias("home_block"), own_member.alias("member_block"),
        F.lit(True).alias("is_member"), (F.col("home") & (F.col("home_block") == own_home)).alias("is_home"),
    ).where(~F.col("is_home"))
    pairs = as_home.unionByName(as_member).repartition(*key).sortWithinPartitions(*key)
    found = stored(
        bounded_batches(pairs).mapInArrow(_join_blocks(threshold), "rep long, links long, root long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vector-groups")
    info = (
        same.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    )
    marked = rows.withColumn("compared", F.col("vec_id").isNotNull())
    joined = marked.join(info.withColumn("compared", F.lit(True)), ["label", "embedding", "compared"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
