"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins. Cyclic boosting visits the features
in turn, fits a shallow tree of one feature to the gradient of the logistic
loss and adds its leaves to the feature's table. Then the pairs with the most to
explain get tables of their own in the same way, from trees that cut both
features once. A score is the sum of one entry of each table: only bin
look-ups and additions.

The model is fitted on the driver, on at most SAMPLE labelled texts: those with the
smallest hash of doc_id. Only their features travel, not their texts.

Cases: null texts are scored as empty ones. Rows with a null doc_id are scored and not
learned from; they count as held out if crc32('') mod 5 is 0. Repeated
labels of a document count once, by the lowest; of different texts under one doc_id the one with the smallest hash is learned from. Without labels of both kinds every
score is the smoothed share of good labels. Repeated rows get equal scores. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlark.llm import _features, _words as W
from ledgerlark.llm._shared import bound_batches

SAMPLE = 20_000
BINS = 48
PAIR_BINS = 8
ROUNDS = 60
PAIRS = 6
PAIR_ROUNDS = 30
RATE = 0.15
LEAVES = 4
LEAST_WEIGHT = 4.0  #: of a leaf, in summed Hessian
THRESHOLD = 0.3
FOLDS = 5

FEATURES = ("log_words", "word_length", "symbols", "capitals", "digits", "marks", "dup_lines", "repeats", "again", "distinct", "line_words", "marks_per_word")


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; shares have a few units added to the base, so short texts are not extreme."""
    s = {k: v.astype(np.float64) for k, v in _features.statistics(raw, at).items()}
    words, chars, letters, lines = s["n_words"], s["word_chars"], s["n_letters"], s["n_lines"]
    return np.stack(
        [
            np.log1p(words),
            chars / (words + 1),
            s["n_symbols"] / (chars + 20),
            s["n_capitals"] / (letters + 20),
            s["n_digits"] / (chars + 20),
            s["n_marks"] / (chars + 20),
            s["n_dup_lines"] / (lines + 1),
            s["n_repeat_words"] / (words + 10),
            s["n_again"] / (words + 10),
            s["n_distinct"] / (np.sqrt(words) + 1),
            words / (lines + 1),
            s["n_marks"] / (words + 5),
        ],
        axis=1,
    )


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, f], "right")]
        if self.pairs:
            coarse = {f: np.searchsorted(self.pair_cuts[f], x[:, f], "right") for f in {f for p in self.pairs for f in p}}
            for (f, g), table in zip(self.pairs, self.pair_tables):
                total += table[coarse[f], coarse[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Bounds between bins of about equal size, halfway between neighbouring values."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.arange(bins + 1) / bins))
    return (values[1:] + values[:-1]) / 2


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values over the bins of one feature: the best cut first, then the best cut of the best leaf, up to LEAVES."""
    leaves = [(0, len(g))]
    G, H = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))

    def best(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a + 1, b)
        if not len(at):
            return 0.0, 0
        hl, hr = H[at] - H[a], H[b] - H[at]
        gain = _gain(G[at] - G[a], hl) + _gain(G[b] - G[at], hr) - _gain(G[b] - G[a], H[b] - H[a])
        gain[(hl < LEAST_WEIGHT) | (hr < LEAST_WEIGHT)] = 0
        k = int(np.argmax(gain))
        return float(gain[k]), int(at[k])

    while len(leaves) < LEAVES:
        gain, cut, k = max(((*best(a, b), k) for k, (a, b) in enumerate(leaves)), key=lambda x: x[0])
        if gain <= 1e-9:
            break
        a, b = leaves[k]
        leaves[k : k + 1] = [(a, cut), (cut, b)]
    out = np.empty(len(g))
    for a, b in leaves:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the tree that cuts each of two features once."""
    G, H = (np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (g, h))
    n, m = g.shape
    best, out = 0.0, np.zeros_like(g)
    for i in range(1, n):
        for j in range(1, m):
            quarters = [((0, i), (0, j)), ((0, i), (j, m)), ((i, n), (0, j)), ((i, n), (j, m))]
            sums = [(S[b, d] - S[a, d] - S[b, c] + S[a, c]) for (a, b), (c, d) in quarters for S in (G, H)]
            gain = sum(_gain(sums[2 * k], sums[2 * k + 1]) for k in range(4)) - _gain(G[n, m], H[n, m])
            if gain > best:
                best, leaf = gain, [(q, sums[2 * k] / (sums[2 * k + 1] + 1.0)) for k, q in enumerate(quarters)]
                out = np.zeros_like(g)
                for ((a, b), (c, d)), value in leaf:
                    out[a:b, c:d] = value
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1 - share)))
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    model = Model(base, [np.zeros(0)] * width, [np.zeros(1)] * width, [], [np.zeros(0)] * width, [])
    if len(y) == 0 or y.min() == y.max():
        return model
    model.cuts = [_cuts(x[:, f], BINS) for f in range(width)]
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = slopes()
            n = len(model.tables[f])
            step = RATE * _tree(np.bincount(bins[f], g, n), np.bincount(bins[f], h, n))
            model.tables[f] += step
            total += step[bins[f]]
    model.pair_cuts = [_cuts(x[:, f], PAIR_BINS) for f in range(width)]
    coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]

    def cells(f: int, g: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[f] * sizes[g] + coarse[g], v, sizes[f] * sizes[g]).reshape(sizes[f], sizes[g])

    g, h = slopes()
    found = sorted(((_pair_tree(cells(a, b, g), cells(a, b, h))[0], a, b) for a in range(width) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in found[:PAIRS] if gain > 1e-6]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _pair_tree(cells(a, b, g), cells(a, b, h))[1]
            model.pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id: str = "doc_id"):
    """Is the document of the fold that nothing is learned from?"""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    bound_batches(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def measure(stream):
        for rows, raw, at in W.batches("text")(stream):
            x = features(raw, at)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("print"), rows.column("quality").cast(pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "print", "quality", "x"])

    rows = texts.select("doc_id", F.xxhash64("text").alias("print"), F.col("quality").cast("int").alias("quality"), "text").mapInArrow(measure, "doc_id long, print long, quality int, x array<double>")
    # one row of a repeated doc_id, so at most `sample` rows come to the driver
    got = rows.groupBy("doc_id").agg(F.min_by(F.struct("quality", "x"), "print").alias("row")).select("doc_id", "row.*").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    return fit(x, (got["quality"].to_numpy() > 0).astype(np.float64))


def add_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a further column: the score of `text`."""
    bound_batches(docs.sparkSession)
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def work(stream):
        for rows, raw, at in W.batches("text")(stream):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(model.score(features(raw, at)))], [*rows.schema.names, name])

    return docs.mapInArrow(work, schema)


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    bound_batches(docs.sparkSession)
    model = learn(docs, labels, sample)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, score double"

    def work(stream):
        for rows, raw, at in W.batches("text")(stream):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(model.score(features(raw, at)))], ["doc_id", "score"])

    scored = base.mapInArrow(work, schema)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
