"""Mixing sources to target weights by hierarchical budgeting, in DataFrame code only.

The tree is domain - language - source. The total budget of tokens is split among domains by their weights, each domain's
among its languages, and each language's among its sources. A node can take ``max_epochs`` times the tokens below it. Where
a node can't take its share, the shortage goes to its siblings by their weights (again up to what they can take), and so to
other branches only when the whole branch is full. All shares are whole numbers that add up to their parent's: siblings
are cut from one line of tokens, each from the rounded end of the one before it.

A leaf reads its documents in epochs, each in the order of md5(seed:epoch:doc_id:md5(text)). It takes whole epochs while
they fit, and then the prefix of the next one that has the rest in tokens: whole documents, and of the next one its first
``cut_tokens``. So every leaf takes its share to the token, and nothing is left to redistribute.

The prefix is found without sorting a leaf: the order is cut into ranges of about ``RANGE_DOCS`` documents, their tokens
are pre-aggregated, and only the one range of each leaf in which the budget ends is sorted. The plan is one row a leaf:
whole epochs, the key of the last whole document of the prefix, and that of the cut one. Applying it is a join on the leaf, so no text is shuffled; the
plan is sent to every task if it is counted to be small, else rows are dealt by leaf and Spark splits skewed ones.

Defined cases: a text's tokens are its runs of non-space characters; null and empty texts have none, cost nothing, and are
taken when the prefix reaches their place. Rows that repeat both ``doc_id`` and text in a leaf stand in one place: they
are taken together, and where the prefix ends among them each is cut at an equal number of tokens (fewer tokens than there
are such rows stay unspent). A cut text ends behind its last token; white space before and between is kept. A null source, language or ``doc_id`` is a value like any other. An empty table gives no rows. Extra columns
are left out of the plan, and kept where documents are returned (``n_chars`` is counted anew for a cut text).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import stored

RANGE_DOCS = 1_000
BROADCAST_LEAVES = 100_000
_SPACES = r"[ \t\n\r\f\x0B]+"
_TREE = ["domain", "lang", "source"]
_PLAN = ["epochs", "last_key", "cut_key", "cut_tokens"]


@dataclass(frozen=True)
class Mix:
    """Targets of a mixture: whole-number weights by name (others have ``other``), and the total as a share of all tokens."""

    domains: dict[str, int] = field(default_factory=lambda: {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 1
    percent_of_tokens: int = 100
    max_epochs: int = 4
    seed: int = 2

    def weight(self, level: int) -> Column:
        names = (self.domains, self.languages, self.sources)[level]
        out = F.lit(self.other)
        for name, weight in names.items():
            out = F.when(F.col(_TREE[level]) == name, weight).otherwise(out)
        return out.cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source: the number at its end mod 4; 'other' without one."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (F.try_to_number(number, F.lit("999999999")) % 4).cast("string"))).otherwise("other")


def with_leaf(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", "text")


def count_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACES), "")).cast("long")


def first_tokens(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th token."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^ \t\n\r\f\x0B])(?=[ \t\n\r\f\x0B])"), 1, n.cast("int")), "")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def order_key(seed: int, epoch: Column, doc_id: Column, text: Column) -> Column:
    """The place of a document in an epoch's order; ``text`` is its :func:`text_key`."""
    name = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), name, text))


def _same_leaf(left: DataFrame, right: DataFrame) -> Column:
    out = F.lit(True)
    for c in _TREE:
        out = out & left[c].eqNullSafe(right[c])
    return out


def _split(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``share`` for each node: its parent's ``budget`` by weight, up to ``room``; shortages go to its siblings.

    Siblings are taken by room for their weight, smallest first: one is full if its part of what is left by weight is more
    than its room; all behind the first that isn't share the rest, whose rounded parts add up to it. Products of tokens and
    weights are decimals, which no corpus overflows.
    """
    siblings = Window.partitionBy(*parents)
    order = siblings.orderBy(F.col("room") / F.col("weight"), F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    behind = order.rowsBetween(0, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    wide = lambda c: c.cast("decimal(38,0)")
    left = F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0))
    full = nodes.withColumn("full", wide(F.col("room")) * F.sum("weight").over(behind) <= wide(left) * F.col("weight"))
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(siblings), F.lit(0))
    open_weight = F.when(~F.col("full"), F.col("weight"))
    part = F.expr("rest * reached_weight div open_weight - rest * (reached_weight - weight) div open_weight")
    return (
        full.withColumn("rest", wide(rest)).withColumn("open_weight", F.sum(open_weight).over(siblings))
        .withColumn("reached_weight", F.sum(open_weight).over(upto))
        .withColumn("share", F.when(F.col("full"), F.col("room")).otherwise(part))
        .drop("full", "rest", "open_weight", "reached_weight")
    )


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``(domain, lang, source, tokens, n_docs, share)`` from the tokens of each leaf."""
    room = F.col("tokens") * mix.max_epochs
    level = leaves.withColumn("room", room)
    root = leaves.agg(F.sum("tokens").alias("all"))
    out = None
    for depth in range(3):
        parents, name = _TREE[:depth], _TREE[depth]
        nodes = level.groupBy(*_TREE[:depth + 1]).agg(F.sum("room").alias("room")).withColumn("weight", mix.weight(depth))
        if out is None:
            total = F.least(F.expr(f"cast(`all` as decimal(38,0)) * {mix.percent_of_tokens} div 100"), F.expr(f"`all` * {mix.max_epochs}"))
            nodes = nodes.crossJoin(F.broadcast(root.select(total.alias("budget"))))  # one row
        else:
            up = out.select(*[F.col(p).alias(f"up_{p}") for p in parents], F.col("share").alias("budget"))
            same = F.lit(True)
            for p in parents:
                same = same & nodes[p].eqNullSafe(up[f"up_{p}"])
            nodes = nodes.join(up, same).drop(*[f"up_{p}" for p in parents])
        out = _split(nodes, parents, name).select(*parents, name, "share")
    shares = out.select(*[F.col(c).alias(f"s_{c}") for c in _TREE], "share")
    same = F.lit(True)
    for c in _TREE:
        same = same & leaves[c].eqNullSafe(shares[f"s_{c}"])
    return leaves.join(shares, same).drop(*[f"s_{c}" for c in _TREE])


def mixing_plan(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``(domain, lang, source, tokens, share, epochs, last_key, cut_key, cut_tokens)``: one row a leaf."""
    text = F.col("text")
    counted = stored(
        with_leaf(docs).select("doc_id", *_TREE, text_key(text).alias("text_key"), count_tokens(text).alias("tokens")), "doc-tokens")
    leaves = stored(counted.groupBy(*_TREE).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")), "leaves")
    whole = F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(F.lit(0))
    planned = stored(
        budgets(leaves, mix).withColumn("epochs", whole).withColumn("rest", F.col("share") - F.col("epochs") * F.col("tokens"))
        .withColumn("n_ranges", F.ceil(F.col("n_docs") / RANGE_DOCS)), "leaf-shares")
    own = planned.select(*_TREE, "epochs", "rest", "n_ranges")
    key = order_key(mix.seed, F.col("epochs"), F.col("doc_id"), F.col("text_key"))
    placed = _join_leaves(counted, own).withColumn("key", key)
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("range", F.shiftright(at * F.col("n_ranges"), 32))
    sums = placed.groupBy(*_TREE, "range", "rest").agg(F.sum("tokens").alias("in_range"), F.max("key").alias("last_key"))
    along = Window.partitionBy(*_TREE).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = stored(sums.withColumn("reached", F.sum("in_range").over(along)), "leaf-ranges")
    fits = ranges.where("reached <= rest").select(*_TREE, "last_key")
    ends = ranges.where("reached > rest and reached - in_range <= rest").select(
        *_TREE, "range", (F.col("rest") - F.col("reached") + F.col("in_range")).alias("left"))
    inside = _join_leaves(placed.drop("rest"), ends.withColumnRenamed("range", "end_range")).where("range = end_range")
    in_order = Window.partitionBy(*_TREE).orderBy("key")  # rows of one key stand in one place
    alike = Window.partitionBy(*_TREE, "key")
    inside = stored(
        inside.withColumn("reached", F.sum("tokens").over(in_order)).withColumn("in_place", F.sum("tokens").over(alike))
        .withColumn("n_rows", F.count("*").over(alike)).select(*_TREE, "key", "reached", "in_place", "n_rows", "left"), "leaf-ends")
    prefix = inside.where("reached <= left").select(*_TREE, F.col("key").alias("last_key"))
    last = fits.union(prefix).groupBy(*_TREE).agg(F.max("last_key").alias("last_key"))
    cut = inside.where("reached > left and reached - in_place <= left").select(
        *_TREE, F.col("key").alias("cut_key"), F.expr("(left - reached + in_place) div n_rows").alias("cut_tokens")).distinct()
    found = last.select(*_TREE, "last_key", F.lit(None).cast("string").alias("cut_key"), F.lit(0).cast("long").alias("cut_tokens")).union(
        cut.select(*_TREE, F.lit(None).cast("string"), "cut_key", "cut_tokens"))
    found = found.groupBy(*_TREE).agg(*[F.max(c).alias(c) for c in ("last_key", "cut_key", "cut_tokens")])
    found = found.select(*[F.col(c).alias(f"l_{c}") for c in _TREE], "last_key", "cut_key", "cut_tokens")
    same = F.lit(True)
    for c in _TREE:
        same = same & planned[c].eqNullSafe(found[f"l_{c}"])
    return planned.join(found, same, "left").select(*_TREE, "tokens", "share", *_PLAN)


def _join_leaves(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` with the columns of their leaf."""
    renamed = leaves.select(*[F.col(c).alias(f"leaf_{c}") if c in _TREE else F.col(c) for c in leaves.columns])
    small = F.broadcast(renamed) if leaves.count() <= BROADCAST_LEAVES else renamed
    same = F.lit(True)
    for c in _TREE:
        same = same & rows[c].eqNullSafe(small[f"leaf_{c}"])
    return rows.join(small, same).drop(*[f"leaf_{c}" for c in _TREE])


def _taken(mix: Mix) -> list[Column]:
    """``copies``, how often a row is taken whole, and ``cut_tokens``, how many of its tokens once more."""
    key = order_key(mix.seed, F.col("epochs"), F.col("doc_id"), F.col("text_key"))
    in_prefix = F.coalesce(key <= F.col("last_key"), F.lit(False))
    cut = F.when(key == F.col("cut_key"), F.col("cut_tokens")).otherwise(0).cast("long")
    return [(F.col("epochs") + in_prefix.cast("long")).alias("copies"), cut.alias("cut_tokens")]


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``(doc_id, domain, lang, source, tokens, copies, cut_tokens)`` for every row that is taken: whole, once or in several
    epochs, and the first ``cut_tokens`` of its tokens."""
    plan = stored(mixing_plan(docs, mix), "mix-plan").select(*_TREE, *_PLAN)
    text = F.col("text")
    own = with_leaf(docs).select("doc_id", *_TREE, text_key(text).alias("text_key"), count_tokens(text).alias("tokens"))
    return _join_leaves(own, plan).select("doc_id", *_TREE, "tokens", *_taken(mix)).where("copies > 0 or cut_tokens > 0")


def realised(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``(domain, share, taken)``: the tokens that each domain was given, and those that it takes."""
    plan = stored(mixing_plan(docs, mix), "mix-plan")
    own = with_leaf(docs).select(
        "doc_id", *_TREE, text_key(F.col("text")).alias("text_key"), count_tokens(F.col("text")).alias("tokens"))
    rows = _join_leaves(own, plan.select(*_TREE, *_PLAN)).select("domain", "tokens", *_taken(mix))
    taken = rows.groupBy("domain").agg(F.sum(F.col("tokens") * F.col("copies") + F.col("cut_tokens")).alias("taken"))
    return plan.groupBy("domain").agg(F.sum("share").alias("share")).join(taken, "domain")


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mixture takes it; a cut one comes first."""
    plan = stored(mixing_plan(docs, mix), "mix-plan").select(*_TREE, *_PLAN)
    whole = docs.select(
        F.struct("*").alias("row"), "doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source",
        text_key(F.col("text")).alias("text_key"))
    taken = _join_leaves(whole, plan).select("row", *_taken(mix)).where("copies > 0 or cut_tokens > 0")
    first = F.when(F.col("cut_tokens") > 0, 0).otherwise(1)
    copies = taken.select("row", "cut_tokens", F.explode(F.sequence(first, F.col("copies").cast("int"), F.lit(1))).alias("copy"))
    text = F.when(F.col("copy") == 0, first_tokens(F.col("row.text"), F.col("cut_tokens"))).otherwise(F.col("row.text"))
    out = copies.withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in docs.columns:
        counted = F.char_length("row.text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("row", F.col("row").withField("n_chars", F.when(F.col("copy") == 0, counted).otherwise(F.col("row.n_chars"))))
    return out.select("row.*")
