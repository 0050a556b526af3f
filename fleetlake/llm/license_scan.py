"""Licence families of paragraphs: sparse n-gram logistic regression, a calibrated unknown class, template comparison.

Features of a paragraph (a line, or neighbouring lines joined) are the distinct words and word pairs that occur in the templates. A multinomial logistic
regression gives each family and an unknown class a probability. It is fitted on the driver from variations of the
templates (words dropped, cut, joined with ordinary paragraphs) and from ordinary paragraphs, ``SAMPLE_LINES`` lines of
``SAMPLE_DOCS`` documents in the order of a seeded hash of their id, less those that hold much of a template. One in five
of both is held out, to fit a temperature and the least probability at which a paragraph counts as a licence. A prediction
is confirmed if the paragraph holds ``CONFIRMED`` of the features of one of the family's templates.

A notice may be wrapped over lines. From each line on, it and the lines below it are joined, up to a line without words or one
that holds a notice itself, until ``_LONGEST`` words follow the first line. A joined paragraph is reported if it is a confirmed
licence, at the line on which it starts: without that line it holds less of the template, and with the line above no more.
Only texts are joined that hold a word without which no template can be confirmed, and only joins that hold
``CONFIRMED`` of a template's features leave the row.

Scoring is DataFrame code. An upper bound of a paragraph's evidence comes first, in the row: each template word is worth its
own positive weight and those of the pairs in which it is the rarer word, and the words that are worth something are summed.
Paragraphs whose bound is below what the least probability asks for are unknown, whatever else they hold; the few others are
scored exactly, by a join with the weights.
The weights are sent to every task; they are bounded by the templates' words. Text is read once more for the sample; only
paragraphs that pass the bound are shuffled.

Defined cases: a null or empty text has one empty paragraph, which is unknown. Unknown paragraphs give no row. Rows that
repeat a ``doc_id`` and paragraph give one row; a null ``doc_id`` stays. Extra columns are left out. Without documents to
sample, the unknown class is fitted on paragraphs without features alone.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm.license_templates import TEMPLATES

SAMPLE_DOCS = 400
SAMPLE_LINES = 3000
VARIATIONS = 60
CONFIRMED = 0.7
_BREAK = "[^a-z0-9]+"
_SEED = 9


def template_grams(text: str) -> list[str]:
    """The distinct words and word pairs of a notice, in order."""
    words = [w for w in re.split(_BREAK, text.lower()) if w]
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), _BREAK), "")


def _grams(column: str) -> Column:
    """The distinct words and pairs of a column of word arrays (an expression would be worked out for every pair)."""
    words = F.col(column)
    at = F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(words, F.transform(at, lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``(doc_id, paragraph, line)``: the lines of every text."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("paragraph", "line"))


def anchors(ordinary: Counter[str], templates: dict[str, tuple[str, ...]] = TEMPLATES) -> set[str]:
    """Words of which every confirmed paragraph holds one: of each template the rarest, until too few features lack them."""
    out: set[str] = set()
    for text in (t for texts in templates.values() for t in texts):
        grams = template_grams(text)
        words = sorted((g for g in grams if " " not in g), key=lambda w: (ordinary[w], w))
        own: set[str] = set()
        while sum(own.isdisjoint(g.split(" ")) for g in grams) >= CONFIRMED * len(grams) - 1e-9:
            own.add(words[len(own)])
        out |= own
    return out


_KNOWN = [template_grams(t) for texts in TEMPLATES.values() for t in texts]
#: Words that may follow a line of a wrapped notice, and lines that they may take.
_LONGEST = max(len(re.split(_BREAK, t.lower())) for texts in TEMPLATES.values() for t in texts)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _where(df: DataFrame, condition: Column, column: str, kind: str, *keys: str) -> DataFrame:
    """``keys`` and ``column`` of the rows that meet a condition; by a generator, as a filter would be moved below the columns that
    it names, and work them out for every template."""
    kept = F.when(condition, F.array(column)).otherwise(F.array().cast(f"array<{kind}>"))
    return df.select(*keys, F.explode(kept).alias(column))


def joined_paragraphs(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """``(doc_id, paragraph, grams)``: the neighbouring lines that hold ``CONFIRMED`` of a template together, by their first
    line. ``doc_id`` is a struct of the id and the text's hash; ``grams`` has the features of templates."""
    rare = sorted(anchors(model.ordinary))
    search = f"(?<![a-z0-9])(?:{'|'.join(rare)})(?![a-z0-9])"
    text = F.coalesce("text", F.lit(""))
    held = docs.where(F.lower(text).rlike(search)).select(
        F.struct("doc_id", F.xxhash64(text).alias("h")).alias("doc_id"), F.split(text, "\n").alias("lines"))
    held = held.withColumn("rare", F.transform("lines", lambda x: F.lower(x).rlike(search)))
    near = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.exists(F.slice("rare", i + 1, _LONGEST), lambda x: x))
    starts = F.transform(near, lambda i: F.struct(i.alias("paragraph"), F.slice("lines", i + 1, _LONGEST + 1).alias("lines")))
    wide = held.select("doc_id", F.explode(starts).alias("x")).select("doc_id", "x.paragraph", "x.lines")
    wide = wide.withColumn("words", F.transform("lines", _words))
    # how many lines are joined: up to an empty one, until enough words follow the first
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("after"), F.lit(True).alias("open"))

    def on(s: Column, w: Column) -> Column:
        go = s["open"] & (F.size(w) > 0) & (s["after"] < _LONGEST)
        return F.struct((s["n"] + go.cast("int")).alias("n"), (s["after"] + F.when(s["n"] > 0, F.size(w)).otherwise(0)).alias("after"), go.alias("open"))

    wide = wide.withColumn("n", F.aggregate("words", state, on)["n"])
    wide = _where(wide, F.col("n") > 1, "words", "array<array<string>>", "doc_id", "paragraph", "n").withColumn("words", F.slice("words", F.lit(1), F.col("n")))
    templates = F.array(*[_strings(k) for k in _KNOWN])
    features = _strings(sorted({g for k in _KNOWN for g in k}))
    holds = lambda grams: F.exists(
        templates, lambda t: F.size(F.array_intersect(t, grams)) >= F.lit(CONFIRMED) * F.size(t) - 1e-9)
    whole = wide.withColumn("flat", F.flatten("words")).withColumn("grams", F.array_intersect(features, _grams("flat")))
    whole = _where(whole, holds(F.col("grams")), "words", "array<array<string>>", "doc_id", "paragraph")
    # few rows are left: end them at a line that is a notice itself
    line = whole.select("doc_id", "paragraph", F.posexplode("words").alias("n", "words")).withColumn("grams", _grams("words"))
    line = _where(line, F.col("n") >= 0, "grams", "array<string>", "doc_id", "paragraph", "n", "words")
    ended = line.groupBy("doc_id", "paragraph").agg(
        F.min(F.when(holds(F.col("grams")), F.col("n"))).alias("end"),
        F.sort_array(F.collect_list(F.struct("n", "words"))).alias("lines"))
    kept = F.filter("lines", lambda x: F.col("end").isNull() | (x["n"] < F.col("end")))
    ended = ended.select("doc_id", "paragraph", F.transform(kept, lambda x: x["words"]).alias("words")).where("size(words) > 1")
    again = ended.withColumn("flat", F.flatten("words")).withColumn("grams", F.array_intersect(features, _grams("flat")))
    return _where(again, holds(F.col("grams")), "grams", "array<string>", "doc_id", "paragraph")


@dataclass
class LicenceModel:
    """Weights by class (families in order, then unknown), temperature, and the least probability of a licence."""

    families: list[str]
    grams: list[str]
    weights: np.ndarray
    offsets: np.ndarray
    temperature: float
    least: float
    ordinary: Counter[str]

    def against_unknown(self) -> np.ndarray:
        """By feature and family: evidence for the family against unknown."""
        return (self.weights[:, :-1] - self.weights[:, -1:]) / self.temperature

    def worth(self) -> dict[str, float]:
        """By word: the most that its own weight and those of the pairs in which it is the rarer word can add."""
        out: dict[str, float] = {}
        for gram, most in zip(self.grams, self.against_unknown().max(axis=1)):
            if most > 0:
                word = min(reversed(gram.split(" ")), key=lambda w: self.ordinary[w])
                out[word] = out.get(word, 0.0) + float(most)
        return out

    def asked(self) -> float:
        """The evidence that the strongest family of any licence has at least."""
        n = len(self.families)
        start = (self.offsets[:n] - self.offsets[n]) / self.temperature
        return float(np.log(self.least / (1 - self.least) / n) - start.max())

    def probabilities(self, grams: set[str]) -> np.ndarray:
        at = [i for i, g in enumerate(self.grams) if g in grams]
        return _softmax(((self.weights[at].sum(axis=0) + self.offsets) / self.temperature)[None])[0]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(ordinary: list[list[str]], templates: dict[str, tuple[str, ...]] = TEMPLATES) -> LicenceModel:
    """Fit the regression; ``ordinary`` has the features found in each sampled paragraph."""
    rng = random.Random(_SEED)
    families = sorted(templates)
    grams = sorted({g for texts in templates.values() for t in texts for g in template_grams(t)})
    place = {g: i for i, g in enumerate(grams)}
    known = [set(template_grams(t)) for texts in templates.values() for t in texts]
    plain = [set(o) & place.keys() for o in ordinary]
    plain = [o for o in plain if all(len(o & k) < 0.5 * len(k) for k in known)] + [set()] * 100
    samples = [(o, len(families)) for o in plain]
    for label, family in enumerate(families):
        for text in templates[family]:
            words = text.split()
            for n in range(VARIATIONS):
                kept = words
                if n % 3 == 1:
                    kept = [w for w in words if rng.random() > 0.1]
                elif n % 3 == 2:
                    size = rng.randint(max(3, round(0.8 * len(words))), max(3, len(words)))
                    start = rng.randint(0, max(0, len(words) - size))
                    kept = words[start:start + size]
                beside = rng.choice(plain) if n % 2 else set()
                samples.append((set(template_grams(" ".join(kept))) | beside, label))
    rng.shuffle(samples)
    x = np.zeros((len(samples), len(grams)), dtype=np.float32)
    for i, (own, _) in enumerate(samples):
        x[i, [place[g] for g in own if g in place]] = 1
    y = np.eye(len(families) + 1, dtype=np.float32)[[label for _, label in samples]]
    held = np.arange(len(samples)) % 5 == 0
    size = y[~held].sum(axis=0)
    balance = (1 / np.maximum(size, 1))[y[~held].argmax(axis=1)][:, None]
    balance[y[~held][:, -1] == 1] *= len(families)  # half of the weight is unknown
    balance /= balance.sum()
    weights, offsets = np.zeros((len(grams), y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    moments = [[np.zeros_like(a), np.zeros_like(a)] for a in (weights, offsets)]
    for step in range(1, 201):
        error = balance * (_softmax(x[~held] @ weights + offsets) - y[~held])
        for a, grad, m in ((weights, x[~held].T @ error + 1e-5 * weights, moments[0]), (offsets, error.sum(axis=0), moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * grad
            m[1] = 0.99 * m[1] + 0.01 * grad * grad
            a -= 0.1 * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-8)
    raw, truth = x[held] @ weights + offsets, y[held]
    loss = lambda t: -np.log(np.maximum((_softmax(raw / t) * truth).sum(axis=1), 1e-9)).mean()
    temperature = min((0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=loss)
    chance = 1 - _softmax(raw / temperature)[:, -1]
    ordinary_chance = np.sort(chance[truth[:, -1] == 1])
    least = float(np.clip(ordinary_chance[int(0.999 * (len(ordinary_chance) - 1))] if len(ordinary_chance) else 0.5, 0.5, 0.99))
    ordinary_words = Counter(g for o in plain for g in o)
    return LicenceModel(families, grams, weights.astype(np.float64), offsets.astype(np.float64), temperature, least, ordinary_words)


def sample_features(docs: DataFrame) -> list[list[str]]:
    """The template features of the sampled paragraphs; bounded by ``SAMPLE_LINES``."""
    spark = docs.sparkSession
    chosen = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64(F.lit(_SEED), "doc_id"), "doc_id").limit(SAMPLE_DOCS)
    lines = paragraphs(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).withColumn("words", _words(F.col("line")))
    grams = spark.createDataFrame([(sorted({g for t in TEMPLATES.values() for x in t for g in template_grams(x)}),)], "known array<string>")
    found = lines.join(F.broadcast(grams)).select(  # one row
        F.xxhash64("doc_id", "paragraph").alias("place"), F.array_intersect("known", _grams("words")).alias("own"))
    return [list(r.own) for r in found.orderBy("place", F.size("own")).limit(SAMPLE_LINES).collect()]


def train(docs: DataFrame) -> LicenceModel:
    return fit(sample_features(docs))


def licences(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """``(doc_id, paragraph, family, probability, template_share, confirmed)`` for every paragraph that is a licence."""
    model = model or train(docs)
    worth = model.worth()
    words = sorted(worth) or [""]
    table = F.map_from_arrays(F.array(*[F.lit(x) for x in words]), F.array(*[F.lit(worth.get(x, 0.0)) for x in words]))
    lines = paragraphs(docs).withColumn("words", _words(F.col("line")))
    lines = lines.withColumn("found", F.array_intersect("words", F.array(*[F.lit(x) for x in words])))
    reach = F.aggregate("found", F.lit(0.0), lambda total, x: total + F.element_at(table, x))
    # a generator and no filter: a filter would be moved below the column of words, and split the line for every word
    kept = F.when((F.size("found") > 0) & (reach >= model.asked() - 1e-6), F.array("words")).otherwise(F.array().cast("array<array<string>>"))
    passed = lines.select("doc_id", "paragraph", F.explode(kept).alias("words"))
    features = _strings(model.grams)
    # features alone are shuffled: no other words and pairs count
    passed = passed.select("doc_id", "paragraph", F.array_intersect(features, _grams("words")).alias("grams")).distinct()
    alone = _judged(passed, model)
    starts = Window.partitionBy("doc_id", "family").orderBy("paragraph")
    share = lambda step: F.when(
        F.lag("paragraph", step).over(starts) == F.col("paragraph") - step, F.lag("template_share", step).over(starts))
    joined = _judged(joined_paragraphs(docs, model).distinct(), model).where("confirmed")
    joined = joined.withColumn("above", share(1)).withColumn("below", share(-1))
    joined = joined.where("(above IS NULL OR above <= template_share) AND (below IS NULL OR below < template_share)")
    joined = joined.select("doc_id.doc_id", "paragraph", "family", "probability", "template_share", "confirmed").distinct()
    # a line that is a part of a confirmed notice gives no row of its own as its first line
    taken = joined.select(F.col("doc_id").alias("taken_id"), F.col("paragraph").alias("taken"))
    first = F.col("doc_id").eqNullSafe(F.col("taken_id")) & (F.col("paragraph") == F.col("taken")) & ~F.col("confirmed")
    return alone.join(taken, first, "left_anti").unionByName(joined)


def _judged(passed: DataFrame, model: LicenceModel) -> DataFrame:
    """The licences among paragraphs ``(doc_id, paragraph, grams)``, scored exactly and compared with the templates."""
    spark = passed.sparkSession
    n = len(model.families)
    weights = spark.createDataFrame(
        [(g, [float(v) for v in row / model.temperature]) for g, row in zip(model.grams, model.weights)], "gram string, w array<double>")
    sums = (
        passed.select("doc_id", "paragraph", "grams", F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram")
        .groupBy("doc_id", "paragraph", "grams").agg(*[F.sum(F.col("w")[c]).alias(f"s{c}") for c in range(n + 1)])
    )
    scores = F.array(*[F.col(f"s{c}") + float(model.offsets[c] / model.temperature) for c in range(n + 1)])
    scored = sums.select("doc_id", "paragraph", "grams", scores.alias("scores"))
    top = F.array_max("scores")
    scored = scored.withColumn("odds", F.transform("scores", lambda s: F.exp(s - top)))
    total = F.aggregate("odds", F.lit(0.0), lambda a, o: a + o)
    best = F.array_max(F.slice("odds", 1, n))
    names = F.array(*[F.lit(f) for f in model.families])
    named = scored.withColumn("total", total).withColumn("best", best).where((1 - F.col("odds")[n] / F.col("total")) >= model.least).select(
        "doc_id", "paragraph", "grams", F.element_at(names, F.array_position(F.slice("odds", 1, n), F.col("best")).cast("int")).alias("family"),
        (F.col("best") / F.col("total")).alias("probability"))
    known = spark.createDataFrame(
        [(f, template_grams(t)) for f in model.families for t in TEMPLATES.get(f, ())], "family string, template array<string>")
    share = F.size(F.array_intersect("template", "grams")) / F.size("template")
    compared = named.join(F.broadcast(known), "family").groupBy("doc_id", "paragraph", "family", "probability").agg(F.max(share).alias("template_share"))
    return compared.select("doc_id", "paragraph", "family", "probability", "template_share", (F.col("template_share") >= CONFIRMED).alias("confirmed"))

