"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins by quantiles of the training rows. Boosting goes round the features in
turn; each step fits a shallow tree to the gradients over the feature's bins and adds a damped copy to
that feature's lookup table. Then the pairs of features that explain most of what is left get tables
over coarser bins, filled the same way. Scoring a text adds up table entries, vectorised over texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.features import NAMES, map_features, text_features
from contactloom.llm.words import blocks, held_out, make_room

SCORED = "doc_id long, score double"


@dataclass(frozen=True)
class Training:
    """``rows`` bounds the labelled rows that training takes, in order of their hashed id."""

    rows: int = 20_000
    bins: int = 32
    pair_bins: int = 8
    rounds: int = 120
    pairs: int = 8
    pair_rounds: int = 40
    rate: float = 0.1
    leaves: int = 3
    ridge: float = 5.0


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[k], x[:, k], side="left")]
        for a, b, table in self.pairs:
            rows = np.searchsorted(self.coarse[a], x[:, a], side="left")
            out += table[rows, np.searchsorted(self.coarse[b], x[:, b], side="left")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Value per bin of a tree with so many leaves at most; g and h are sums of each bin."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        best = (1e-9, None)
        for at, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gains = _gain(left_g, left_h, ridge) + _gain(all_g - left_g, all_h - left_h, ridge) - _gain(all_g, all_h, ridge)
            k = int(np.argmax(gains))
            if gains[k] > best[0]:
                best = (gains[k], (at, a + k + 1))
        if best[1] is None:
            break
        at, cut = best[1]
        a, b = spans.pop(at)
        spans += [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Best cut of the first feature, then of the second on either side: four leaves."""
    best = (-1.0, np.zeros_like(g))
    for cut in range(1, g.shape[0]):
        out, gain = np.zeros_like(g), 0.0
        for side in (slice(0, cut), slice(cut, None)):
            tree = shallow_tree(g[side].sum(0), h[side].sum(0), 2, ridge)
            out[side] = tree
            gain += float((-g[side].sum(0) * tree).sum())
        if gain > best[0]:
            best = (gain, out)
    return best[1], max(best[0], 0.0)


def fit(x: np.ndarray, y: np.ndarray, how: Training = Training()) -> Model:
    """Without rows, or rows of one label only, the smoothed share of label 1 decides alone."""
    features = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [_edges(x[:, k], how.bins) for k in range(features)]
    coarse = [_edges(x[:, k], how.pair_bins) for k in range(features)]
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], coarse, [])
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)]
    logit = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return p - y, p * (1 - p)

    for _ in range(how.rounds):
        for k in range(features):
            g, h = slopes()
            sums = (np.bincount(bins[k], v, len(edges[k]) + 1) for v in (g, h))
            step = how.rate * shallow_tree(*sums, how.leaves, how.ridge)
            model.tables[k] += step
            logit += step[bins[k]]
    low = [np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(coarse)]

    def pair_sums(a, b):
        wide = len(coarse[b]) + 1
        shape = (len(coarse[a]) + 1, wide)
        return [np.bincount(low[a] * wide + low[b], v, shape[0] * wide).reshape(shape) for v in slopes()]

    gains = sorted(
        ((pair_tree(*pair_sums(a, b), how.ridge)[1], a, b) for a in range(features) for b in range(features) if a < b),
        reverse=True,
    )
    model.pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in gains[: how.pairs]]
    for _ in range(how.pair_rounds):
        for a, b, table in model.pairs:
            step = how.rate * pair_tree(*pair_sums(a, b), how.ridge)[0]
            table += step
            logit += step[low[a], low[b]]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents, in order of hashed id: ``doc_id, label, text``."""
    sample = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("_id"), (F.col(label) == 1).cast("double").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id", "label")
        .limit(rows)
    )
    # The sample is bounded by its limit: at most ``rows`` pairs of numbers are broadcast.
    return docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text")


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", how: Training = Training()) -> Model:
    """Fits the model to labelled documents; only their features, of ``how.rows`` rows, reach the driver."""
    schema = "label double, " + ", ".join(f"{n} double" for n in NAMES)
    rows = training_rows(docs, labels, label, how.rows)
    table = map_features(rows, "label", lambda x: [pa.array(c) for c in x.T.copy()], schema).toArrow()
    values = np.column_stack([table.column(k).to_numpy() for k in range(table.num_columns)])
    values = values[np.lexsort(values.T)]
    return fit(values[:, 1:], values[:, 0], how)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row; a null text scores as an empty one, a null id is carried along."""
    return map_features(docs, "doc_id", lambda x: [pa.array(model.scores(x))], SCORED)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, how: Training = Training()) -> DataFrame:
    """Trains on labels outside the held-out fold and scores every row: ``doc_id, held_out, score, predicted``."""
    model = train_quality(docs, labels.filter(~held_out("doc_id", folds, fold)), how=how)
    return score_quality(docs, model).select(
        "doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, in one pass, all columns unchanged."""
    names, text = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            scores = [model.scores(text_features(w)) for w in blocks(batch.column(text))]
            good = np.concatenate(scores) >= threshold if scores else np.zeros(0, dtype=bool)
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(good)).columns, names=names)

    return docs.mapInArrow(run, docs.schema)
