"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its score is linear in shape features of the line (shares of letters, capitals, symbols and
digits, word and sentence lengths, each also at fixed cut points) and of its neighbour lines; two weights couple equal
neighbours. Forward-backward gives each line's probability of being good, and a document's quality is the mean over its
lines weighted by length, calibrated to the document label by a logistic curve.

The model is fitted on the driver from a bounded sample: ``TRAIN_DOCS`` labelled documents in the order of a seeded hash
of their id, whose crc32(doc_id as text) mod 5 is not 0, of ``TRAIN_LINES`` lines or fewer, and of these as many as have
``TRAIN_TOTAL_LINES`` lines together; each line takes its document's label. Labels, lang, source and doc_id are never features. Scoring reads every whole text once, in one pass
without a shuffle; a task holds one small batch, and a line's features are sums over it, so length is no limit.

Defined cases: a null or empty text is one empty line. Documents without a label are scored like all others; labels that
are null or neither 0 nor 1 are ignored, and of several labels of one id the smallest counts. Without labels of both
kinds in the sample every document scores 1 (nothing is known against it). Rows that repeat a ``doc_id`` each get their
row, and count as one in the sample (the text whose features sort first); a null ``doc_id`` is scored and counts as not held out. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import bounded_batches, keyed_texts, mix64, row_slices

TRAIN_DOCS = 4000
TRAIN_LINES = 200
TRAIN_TOTAL_LINES = 60_000
THRESHOLD = 0.3
FOLDS = 5
_SEED = 8
_STEPS = 200
_L2 = 1e-3
_L2_COUPLING = 2e-2
_SLICE_CHARS = 1 << 20

#: Shape features of a line, in order, with the cut points at which each is also taken as a step.
SHAPES: dict[str, tuple[float, ...]] = {
    "capitals of letters": (0.1, 0.3, 0.7),
    "symbols of non-spaces": (0.05, 0.15, 0.3),
    "digits of non-spaces": (0.05, 0.2, 0.5),
    "letters of non-spaces": (0.6, 0.8, 0.95),
    "characters a word, tenths": (0.3, 0.6, 0.9),
    "lone symbols of words": (0.02, 0.1, 0.3),
    "doubled symbols of non-spaces": (0.02, 0.1, 0.2),
    "doubled letters of non-spaces": (0.05, 0.1, 0.3),
    "capitalised of words": (0.1, 0.4, 0.8),
    "sentence ends of words": (0.02, 0.1, 0.3),
    "commas of words": (0.02, 0.1, 0.3),
    "short words of words": (0.1, 0.3, 0.5),
    "log words": (0.2, 0.4, 0.8),
    "words equal to the one before": (0.02, 0.1, 0.3),
    "words equal to the one two before": (0.02, 0.1, 0.3),
}
N_SHAPES = len(SHAPES)
#: Shapes of the neighbour lines that a line sees.
NEIGHBOURS = (0, 1, 3, 5, 6, 9, 11, 12, 13)
_UPPER, _LETTER, _DIGIT, _SPACE, _SYMBOL = 1, 2, 3, 4, 5
_tables: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    """By code point: capital, other letter (or mark), digit, white space, or symbol."""
    if "class" not in _tables:
        import unicodedata

        kinds = {"Lu": _UPPER, "Lt": _UPPER}
        by_first = {"L": _LETTER, "M": _LETTER, "N": _DIGIT, "Z": _SPACE, "C": _SPACE}
        category = unicodedata.category
        _tables["class"] = np.fromiter(
            (kinds.get(k := category(chr(c))) or by_first.get(k[0], _SYMBOL) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    return _tables["class"]


def line_shapes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape features and weights (characters, at least 1) of the lines of all texts, and the lines of each text."""
    parts, weights = [], []
    counts = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    for a, b in row_slices(map(len, texts), _SLICE_CHARS):
        shape, weight = _shapes_of("\n".join(texts[a:b]) + "\n")
        parts.append(shape)
        weights.append(weight)
    if not parts:
        return np.zeros((0, N_SHAPES)), np.zeros(0), counts
    return np.concatenate(parts), np.concatenate(weights), counts


def _shapes_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line of a text that ends in a line break."""
    cp = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    kind = _classes()[cp]
    ends = np.flatnonzero(cp == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, starts, dtype=np.int64).astype(np.float64)

    before = np.concatenate([[_SPACE], kind[:-1]])
    after = np.concatenate([kind[1:], [_SPACE]])
    solid, symbol, upper = kind != _SPACE, kind == _SYMBOL, kind == _UPPER
    first, last = solid & (before == _SPACE), solid & (after == _SPACE)
    again = np.concatenate([[False], cp[1:] == cp[:-1]])
    solids, words, letters = total(solid), total(first), total(kind == _LETTER) + total(upper)
    word_length = np.flatnonzero(last) - np.flatnonzero(first) + 1
    short = np.zeros(len(cp), dtype=bool)
    short[np.flatnonzero(first)[word_length <= 3]] = True
    # words are told apart by their length and two sums over their code points
    sums = np.zeros((2, len(cp) + 1), dtype=np.uint64)
    value = cp.astype(np.uint64)
    np.cumsum(value, out=sums[0, 1:])
    np.cumsum(value * value * np.arange(1, len(cp) + 1, dtype=np.uint64), out=sums[1, 1:])
    heads, tails = np.flatnonzero(first), np.flatnonzero(last) + 1
    total_1 = sums[0, tails] - sums[0, heads]
    squares = np.zeros(len(cp) + 1, dtype=np.uint64)
    np.cumsum(value * value, out=squares[1:])
    # weighted by the place in the word: the weighted sum less the start times the plain one
    total_2 = sums[1, tails] - sums[1, heads] - heads.astype(np.uint64) * (squares[tails] - squares[heads])

    def equal_to(back: int) -> np.ndarray:
        same = np.zeros(len(cp), dtype=bool)
        if len(heads) > back:
            equal = (word_length[back:] == word_length[:-back]) & (total_1[back:] == total_1[:-back]) & (total_2[back:] == total_2[:-back])
            same[heads[back:][equal]] = True
        return total(same)

    stops, commas = np.isin(cp, [33, 46, 63]), cp == 44
    per = lambda x, n: x / np.maximum(n, 1.0)
    shape = np.stack([
        per(total(upper), letters), per(total(symbol & ~stops & ~commas), solids), per(total(kind == _DIGIT), solids),
        per(letters, solids), per(solids, words) / 10, per(total(symbol & first & last), words),
        per(total(symbol & again), solids), per(total(solid & ~symbol & again), solids), per(total(upper & first), words),
        per(total(stops), words), per(total(commas), words), per(total(short), words), np.log1p(words) / 5,
        per(equal_to(1), words), per(equal_to(2), words),
    ], axis=1)
    return shape, np.maximum(1.0, (ends - starts).astype(np.float64))


def line_features(shape: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The feature rows of the lines: own shapes, their steps, the shapes of the lines before and after, the place."""
    n = len(shape)
    first = np.zeros(n, dtype=bool)
    last = np.zeros(n, dtype=bool)
    ends = np.cumsum(counts)
    first[(ends - counts)[counts > 0]] = True
    last[ends[counts > 0] - 1] = True
    steps = np.concatenate([shape[:, [i]] > np.array([cuts]) for i, cuts in enumerate(SHAPES.values())], axis=1)
    near = shape[:, NEIGHBOURS]
    before = np.where(first[:, None], 0.0, np.roll(near, 1, axis=0))
    after = np.where(last[:, None], 0.0, np.roll(near, -1, axis=0))
    return np.concatenate([np.ones((n, 1)), shape, steps, before, after, first[:, None], last[:, None]], axis=1)


@dataclass
class QualityModel:
    """Weights of the chain, and the calibration of a document's mean."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    stay_bad: float
    stay_good: float
    slope: float = 1.0
    offset: float = 0.0

    def line_scores(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) / self.scale @ self.weights

    def good_lines(self, scores: list[float]) -> list[float]:
        """Each line's probability of being good, given the scores of all lines of one document."""
        ahead = _messages(scores, self.stay_bad, self.stay_good)
        back = _messages(scores[::-1], self.stay_bad, self.stay_good)[::-1]
        return [_sigmoid(u + a + b) for u, a, b in zip(scores, ahead, back)]

    def quality(self, texts: list[str]) -> list[float]:
        """The calibrated quality of each text."""
        shape, weight, counts = line_shapes(texts)
        scores = self.line_scores(line_features(shape, counts)).tolist()
        out, at = [], 0
        for n in counts.tolist():
            good = np.array(self.good_lines(scores[at:at + n]))
            w = weight[at:at + n]
            out.append(_sigmoid(self.slope * _logit(float(good @ w / w.sum())) + self.offset))
            at += n
        return out


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _messages(scores: list[float], stay_bad: float, stay_good: float) -> list[float]:
    """What each line hears from the lines before it, as log odds of good."""
    out, heard, exp, log1p = [], 0.0, math.exp, math.log1p
    for u in scores:
        out.append(heard)
        x = u + heard
        # log(e^(x + stay_good) + 1) - log(e^x + e^stay_bad)
        p, q = x + stay_good, x - stay_bad
        top = p + log1p(exp(-p)) if p > 0 else log1p(exp(p))
        low = q + log1p(exp(-q)) if q > 0 else log1p(exp(q))
        heard = top - low - stay_bad
    return out


def _chain_messages(u: np.ndarray, active: list[int], stay_bad: float, stay_good: float) -> np.ndarray:
    """:func:`_messages` for many documents at once; row ``i`` of ``u`` is line ``i`` of each, longest document first."""
    out = np.zeros_like(u)
    for i in range(1, len(u)):
        k = active[i]
        x = u[i - 1, :k] + out[i - 1, :k]
        out[i, :k] = np.logaddexp(x + stay_good, 0.0) - np.logaddexp(x, stay_bad)
    return out


def fit(shape: np.ndarray, weight: np.ndarray, counts: np.ndarray, label: np.ndarray) -> QualityModel:
    """Fit the chain by gradient steps on the mean log-likelihood a line, then the calibration of documents."""
    order = np.argsort(-counts, kind="stable")
    starts = np.cumsum(counts) - counts
    features = line_features(shape, counts)
    mean, scale = features.mean(axis=0), features.std(axis=0)
    mean[0], scale[0] = 0.0, 1.0
    scale = np.where(scale > 1e-9, scale, 1.0)
    x = (features - mean) / scale
    n, longest = counts[order], int(counts.max())
    active = [int((n > i).sum()) for i in range(longest)]
    # line i of document d (longest first) stands at [i, d]; the reversed chain at [n - 1 - i, d]
    doc = np.repeat(np.arange(len(n)), n)
    line = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(starts[order], n) + line
    back = np.repeat(n, n) - 1 - line
    ordered = x[row]
    y = np.repeat(label[order], n).astype(float)
    share = np.repeat(1.0 / n, n) / len(n)
    share *= np.where(y > 0, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
    follows = line > 0
    weights, stay = np.zeros(x.shape[1]), np.zeros(2)
    moment, square = np.zeros(len(weights) + 2), np.zeros(len(weights) + 2)
    for step in range(1, _STEPS + 1):
        u = ordered @ weights
        grid, mirror = np.zeros((longest, len(n))), np.zeros((longest, len(n)))
        grid[line, doc], mirror[back, doc] = u, u
        ahead = _chain_messages(grid, active, *stay)[line, doc]
        behind = _chain_messages(mirror, active, *stay)[back, doc]
        p = 1 / (1 + np.exp(-np.clip(u + ahead + behind, -50, 50)))
        grad_w = ordered.T @ (share * (y - p)) - _L2 * weights
        at = np.flatnonzero(follows)
        left, right = u[at - 1] + ahead[at - 1], u[at] + behind[at]
        both = np.stack([np.full(len(at), stay[0]), right, left, left + right + stay[1]])
        both = np.exp(both - both.max(axis=0))
        both /= both.sum(axis=0)
        grad_s = np.array([(share[at] * ((1 - y[at]) - both[0])).sum(), (share[at] * (y[at] - both[3])).sum()]) - _L2_COUPLING * stay
        grad = np.concatenate([grad_w, grad_s])
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        move = 0.08 * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        weights, stay = weights + move[:-2], stay + move[-2:]
    model = QualityModel(mean, scale, weights, float(stay[0]), float(stay[1]))
    u = x @ weights
    raw = []
    for a, c in zip(starts.tolist(), counts.tolist()):
        good = np.array(model.good_lines(u[a:a + c].tolist()))
        raw.append(_logit(float(good @ weight[a:a + c] / weight[a:a + c].sum())))
    model.slope, model.offset = _calibrate(np.array(raw), label.astype(float))
    return model


def _calibrate(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with smoothed targets."""
    good, bad = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([raw, np.ones(len(raw))], axis=1)
    beta = np.array([0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p) - 1e-3 * beta)
        beta = beta + np.clip(step, -1, 1)
    return float(max(beta[0], 1e-3)), float(beta[1])


def fold(doc_id) -> object:
    """crc32(doc_id as text) mod 5; remainder 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> QualityModel | None:
    """Fit on the bounded sample; None if it lacks one of the two labels."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0))
        .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(_SEED), "label_id"), "label_id").limit(train_docs)
    )
    texts = keyed_texts(docs)
    sample = texts.join(F.broadcast(known), texts.doc_id == known.label_id).select("doc_id", "text", "label")

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, label in zip(*(batch.column(i) for i in range(3))):
                shape, weight, counts = line_shapes([text.as_py()])
                if counts[0] <= TRAIN_LINES:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id.as_py()]), pa.array([label.as_py()], pa.int32()),
                         pa.array([shape.astype("<f4").tobytes()]), pa.array([weight.astype("<f4").tobytes()])],
                        names=["doc_id", "label", "shape", "weight"])

    found = sample.mapInArrow(shapes, "doc_id long, label int, shape binary, weight binary")
    by_id: dict[int, object] = {}
    for r in found.collect():  # of the texts of one id, whatever their order, the one with the smallest features
        held = by_id.setdefault(r.doc_id, r)
        if (r.shape, r.weight) < (held.shape, held.weight):
            by_id[r.doc_id] = r
    rows, lines = [], 0
    for r in sorted(by_id.values(), key=lambda r: mix64(np.array([r.doc_id], dtype=np.int64))[0]):
        lines += len(r.weight) // 4
        if lines > TRAIN_TOTAL_LINES:
            break
        rows.append(r)
    label = np.array([r.label for r in rows], dtype=float)
    if not len(rows) or label.min() == label.max():
        return None
    shape = np.concatenate([np.frombuffer(bytes(r.shape), "<f4").reshape(-1, N_SHAPES) for r in rows]).astype(np.float64)
    weights = [np.frombuffer(bytes(r.weight), "<f4").astype(np.float64) for r in rows]
    return fit(shape, np.concatenate(weights), np.array([len(w) for w in weights]), label)


def _quality_of(column: pa.Array, model: QualityModel) -> np.ndarray:
    """The quality of each text of a batch, computed in slices of bounded size."""
    texts = [t or "" for t in column.to_pylist()]
    return np.array([q for a, b in row_slices(map(len, texts), _SLICE_CHARS) for q in model.quality(texts[a:b])], dtype=np.float64)


def scored(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``."""
    texts = keyed_texts(docs)
    if model is None:
        return texts.select("doc_id", F.lit(1.0).alias("score"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_quality_of(batch.column(1), model))], names=["doc_id", "score"])

    return texts.mapInArrow(score, "doc_id long, score double")


def accepted(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose quality is ``threshold`` or more."""
    if model is None:
        return docs
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_quality_of(batch.column(at), model) >= threshold))

    return bounded_batches(docs).mapInArrow(keep, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    model = train(docs, labels, train_docs)
    return scored(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
