"""Toxicity by noisy channel: disguised words are restored, then the restored text is scored.

A disguised word is a lattice: each character stands for itself, for the letters it is used for
(leetspeak), or for nothing (a repeated letter, a mark between letters). A Viterbi search with two
letters of context finds the cheapest path under a character language model, whose trigram counts come
from the words of all documents. Numbers, and words without a lookalike, an inner mark or a doubled
letter, are not searched. Single characters set apart by white space are joined before. Punctuation
around a word is no letter, so a last exclamation mark is not read as one.

The scorer is a logistic regression over words and word beginnings of the restored text: the features
that differ most between the labels are chosen by grouped counts, so only a bounded table and the
chosen features of a bounded number of labelled rows reach the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.quality_model import training_rows
from contactloom.llm.word_cache import WordCache
from contactloom.llm.words import blocks, held_out, worker_store
from contactloom.operators.shared import cut

#: Letters of the language model: a to z, any other letter, and the border of a word.
OTHER, BORDER, SIZE = 26, 27, 28
#: What characters are used for in place of letters.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
KEEP, SWAP, SKIP, DROP, LOOSE = 0.0, 0.7, 0.4, 1.5, 6.0
#: Single characters of UTF-8 set apart by white space, three or more.
ONE = rb"(?:[^ \t\n\v\f\r\x80-\xff]|[\xc2-\xf4][\x80-\xbf]{1,3})"
APART = re.compile(rb"(?:(?<=[ \t\n\v\f\r])|^)" + ONE + rb"(?:[ \t\n\v\f\r]+" + ONE + rb"){2,}(?=[ \t\n\v\f\r]|$)")
ODD = regex.compile(r"\p{L}[^\p{L}\s]+\p{L}|(\p{L})\1", regex.V1)
NUMERIC = re.compile(r"[-+]?[$€£]?\d[\d.,:/()+%-]*[$€£%]?")
#: Punctuation around a word, also where it could stand for a letter.
OPENING, CLOSING = "\"'([<¡¿«“„‘", ".,;:?!)]>\"'»”’…"
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…¿¡"
COUNTS = "gram int, n long"


@dataclass(frozen=True)
class Learning:
    rows: int = 20_000
    features: int = 2048
    least: int = 5
    ridge: float = 0.1
    steps: int = 200


def letter(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else OTHER


def trigram_counts(docs: DataFrame) -> DataFrame:
    """Character trigrams of the words of all texts, added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(256, OTHER, dtype=np.int64)
        table[97:123] = table[65:91] = np.arange(26)
        table[[*range(9, 14), *range(32, 65), *range(91, 97), *range(123, 127)]] = BORDER
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in batches:
            for words in blocks(batch.column(0)):
                data = words.data[(words.data & 0xC0) != 0x80]
                codes = np.concatenate(([BORDER], table[data], [BORDER]))
                if len(codes) > 2:
                    total += np.bincount(codes[:-2] * SIZE**2 + codes[1:-1] * SIZE + codes[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, COUNTS).groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: dict[int, int]) -> np.ndarray:
    """Cost of a letter after two others, in nats; trigrams are smoothed by bigrams, those by letters."""
    table = np.zeros(SIZE**3)
    table[list(counts)] = list(counts.values())
    table = table.reshape(SIZE, SIZE, SIZE)
    one = (table.sum((0, 1)) + 1) / (table.sum() + SIZE)
    two = table.sum(0)
    two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
    return -np.log((table + 5 * two) / (table.sum(2, keepdims=True) + 5))


def restore(word: str, cost: list | np.ndarray) -> str:
    """Cheapest reading of one lower-case word: letters only, unless it has none. ``cost`` is read a
    number at a time, which is faster from lists."""
    paths = {(BORDER, BORDER): (0.0, "", "")}
    for c in word:
        is_letter = c.isalpha()
        options = [(c, KEEP, letter(c))] if is_letter else []
        options += [(x, SWAP, letter(x)) for x in LOOKALIKES.get(c, "")]
        loose = 0.0 if is_letter else LOOSE if c.isdigit() else 2.5 if c in LOOKALIKES else SKIP
        found: dict = {}
        for (a, b), (spent, text, last) in paths.items():
            prices = cost[a][b]
            moves = [((b, code), x, spent + price + prices[code]) for x, price, code in options]
            if not is_letter:
                moves.append(((a, b), "", spent + loose))
            elif c == last:
                moves.append(((a, b), "", spent + DROP))
            for key, x, total in moves:
                # ``last`` is the source letter, so a run of one letter can be dropped step by step.
                if key not in found or total < found[key][0]:
                    found[key] = total, text + x, c if is_letter else last
        paths = found
    ends = ((spent + cost[a][b][BORDER], text) for (a, b), (spent, text, _) in paths.items())
    return min(ends)[1] or word


def cleaned(word: str, cost: list | np.ndarray) -> str:
    """A word in lower case without marks around it, restored if it looks disguised."""
    low = word.lower()
    core, body = low.strip(EDGES), low.lstrip(OPENING).rstrip(CLOSING)
    if body.isalpha():  # neither a number nor a lookalike
        return restore(body, cost) if ODD.search(body) else core
    if NUMERIC.fullmatch(body):
        return core
    alike = sum(c in LOOKALIKES for c in body)
    if ODD.search(body) or alike > 1 or (alike and any(c.isalpha() for c in body)):
        return restore(body, cost)
    return core


def word_features(word: str) -> tuple[str, ...]:
    """A word, and its first 5 and 6 letters if it is longer."""
    return (word, *(f"{word[:k]}*" for k in (5, 6) if len(word) > k)) if len(word) > 1 else ()


class Restorer:
    """What each distinct word becomes, and which of its features count."""

    def __init__(self, cost: np.ndarray, chosen: dict[str, int] | None = None):
        self.cost, self.chosen = cost.tolist(), chosen
        self.words = WordCache(self._word)

    def _word(self, raw: bytes):
        features = word_features(cleaned(raw.decode(), self.cost))
        return features if self.chosen is None else tuple(self.chosen[f] for f in features if f in self.chosen)

    def features(self, text: str | None) -> set:
        raw = (text or "").encode()
        out = {f for found in map(self.words.__getitem__, raw.split()) if found for f in found}
        for run in APART.finditer(raw):
            out.update(self.words[b"".join(run[0].split())])
        return out

    def restored(self, text: str | None) -> str:
        raw = APART.sub(lambda run: b"".join(run[0].split()), (text or "").encode())
        return " ".join(cleaned(w.decode(), self.cost) for w in raw.split())


def restored_texts(docs: DataFrame, cost: np.ndarray) -> DataFrame:
    """``doc_id, restored``: the text as the scorer sees it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Restorer(cost)
        for batch in batches:
            texts = [reader.restored(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "restored"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, restored string")


def _features(rows: DataFrame, cost: np.ndarray) -> DataFrame:
    schema = "doc_id long, label double, features array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Restorer(cost)
        for batch in batches:
            found = [sorted(reader.features(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "label", "features"]
            )

    return rows.select("doc_id", "label", "text").mapInArrow(run, schema)


@dataclass
class Scorer:
    intercept: float
    weights: dict[str, float]


def train_toxicity(docs: DataFrame, labels: DataFrame, cost: np.ndarray, label: str = "toxic", how: Learning = Learning()) -> Scorer:
    """Without labelled rows, or with one label only, the smoothed share of label 1 decides alone."""
    rows = cut(_features(training_rows(docs, labels, label, how.rows), cost))
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    share = (positive + 1) / (n + 2)
    base = math.log(share / (1 - share))
    if positive in (0, n):
        return Scorer(base, {})
    seen = rows.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("with")
    )
    # Difference of the two labels' shares in units of its standard error.
    apart = F.expr(f"abs(with / {positive} - (n - with) / {n - positive})")
    spread = F.sqrt(F.col("n") / n * (1 - F.col("n") / (n + 1)) * (1 / positive + 1 / (n - positive)))
    top = seen.filter(F.col("n") >= how.least).orderBy((apart / spread).desc(), "feature").limit(how.features)
    chosen = {r.feature: k for k, r in enumerate(sorted(top.select("feature").collect()))}
    names = top.select("feature")
    kept = (
        rows.withColumn("row", F.monotonically_increasing_id())
        .select("row", "label", F.explode_outer("features").alias("feature"))
        .join(F.broadcast(names.withColumn("there", F.lit(True))), "feature", "left")
        .groupBy("row", "label")
        .agg(F.sort_array(F.collect_list(F.when(F.col("there"), F.col("feature")))).alias("features"))
    )
    data = sorted((tuple(r.features), r.label) for r in kept.select("features", "label").collect())
    return _regression(data, chosen, base, how)


def _regression(data, chosen: dict[str, int], base: float, how: Learning) -> Scorer:
    y = np.array([label for _, label in data])
    row = np.repeat(np.arange(len(data)), [len(f) for f, _ in data])
    column = np.array([chosen[f] for features, _ in data for f in features], dtype=np.int64)
    w, b, size = np.zeros(len(chosen)), base, len(chosen)
    rates, rate_b = np.full(size, 1e-8), 1e-8
    for _ in range(how.steps):
        logit = b + np.bincount(row, w[column], len(y)) if len(row) else np.full(len(y), b)
        error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y
        g = np.bincount(column, error[row], size) + how.ridge * w
        rates += g * g
        rate_b += error.sum() ** 2
        w -= 0.5 * g / np.sqrt(rates)
        b -= 0.5 * error.sum() / math.sqrt(rate_b)
    return Scorer(float(b), {f: float(w[k]) for f, k in chosen.items() if w[k]})


def score_toxicity(docs: DataFrame, scorer: Scorer, cost: np.ndarray) -> DataFrame:
    """``doc_id, score`` of every row; a null text scores as an empty one, a null id is carried along."""
    chosen = {f: k for k, f in enumerate(scorer.weights)}
    weights = np.array(list(scorer.weights.values()))
    key = f"toxicity-{hash((scorer.intercept, tuple(scorer.weights.items()), cost.tobytes()))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("restorers")
        if key not in store:
            store.clear()
            store[key] = Restorer(cost, chosen)
        reader = store[key]
        for batch in batches:
            logits = np.array([scorer.intercept + sum(weights[k] for k in reader.features(t)) for t in batch.column(1).to_pylist()])
            scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, how: Learning = Learning()) -> DataFrame:
    """Trains on labels outside the held-out fold and scores every row: ``doc_id, held_out, score, predicted``."""
    grams = trigram_counts(docs).collect()  # at most SIZE ** 3 rows
    cost = language_model({r.gram: r.n for r in grams})
    scorer = train_toxicity(docs, labels.filter(~held_out("doc_id", folds, fold)), cost, how=how)
    return score_toxicity(docs, scorer, cost).select(
        "doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
