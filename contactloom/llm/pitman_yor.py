"""Language-model scoring with a hierarchical Pitman-Yor model (bigram contexts over a unigram root).

Tokens: words ``[^\\x20\\x09-\\x0D]+`` of the whole text with only A-Z lower-cased, then one end
token; a null text has the end token alone. Words are told apart by 64-bit hashes (two words merge
only on a hash collision, about V**2 / 2**65 likely). Every token is predicted from the one before
(a begin token before the first).

Model: each context word b has a restaurant whose dishes are the words that followed it in the
training documents; its tables send customers to the root restaurant, whose tables draw from a
uniform base over the V training words and one unknown. With c customers of a dish, t its tables and
C, T the restaurant's totals, a restaurant with discount d and strength theta predicts

    P(w | b) = (c - d t + (theta + d T) P(w | parent)) / (theta + C)

and an unseen context defers to its parent. Seating is sampled by Gibbs sweeps over all dishes in
parallel: a dish's customers are re-seated one after the other given its parent's probability and the
restaurant's tables of the sweep before (so dishes of one restaurant are sampled side by side, as in
distributed samplers of topic models). A dish with one customer always has one table and is never
sampled; re-seating looks one by one only at customers that may open a table, at all others in bulk. Draws come from a counter-based hash of (dish, sweep, customer), so
a task run again after a lost executor draws the same. The predictive probabilities of the last
``keep`` sweeps are averaged per token; ``score`` is the sum of their log10 over the document.

``lm_scores`` learns and scores in place, on packed blocks of bigrams (``packed_sampler``); ``train`` and ``score`` make
the same model as tables of dishes, contexts and words, to score other pairs with. Both draw alike.

``base_score`` sums ``log10((c + 0.1) / (N + 0.1 (V + 1)))`` with c the token's count in the training
tokens, N their number and V their distinct count. Every count covers all training documents.

Rows with a null doc_id are scored together as one document with a null id; rows sharing an id are one
document. Empty tables give no rows; without training rows every probability is 1 and both scores 0.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from contactloom.llm.lexical_search import LOWER, UPPER, stored
from contactloom.llm.packed_sampler import document_scores
from contactloom.llm.words import mix
from contactloom.operators.shared import fits_broadcast

SPACES = r"[\x20\x09-\x0D]+"
#: Marks that no word can be: words never hold white space.
BEGIN, END = "\t", "\n"
#: Additive smoothing of the base score (fixed by its definition).
BASE_ADD = 0.1
GOLDEN = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Prior:
    """Discounts and strengths of the root (0) and the context level (1); sweeps; sweeps averaged."""

    discount: tuple[float, float] = (0.6, 0.75)
    strength: tuple[float, float] = (1.0, 1.0)
    sweeps: int = 4
    keep: int = 2


def tokens(text: Column) -> Column:
    """Hashes of the words, then of the end token."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPACES), lambda w: w != "")
    return F.concat(F.transform(words, lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(END))))


def bigrams(df: DataFrame) -> DataFrame:
    """``doc_id, train, b, w, n``: one row per token (n = 1), b the token before it; repeats are
    combined by the aggregations that follow, before their shuffles."""
    toks = F.col("_tok")
    before = F.concat(F.array(F.xxhash64(F.lit(BEGIN))), F.slice(toks, 1, F.size(toks) - 1))
    pairs = F.arrays_zip(before.alias("b"), toks.alias("w"))
    return df.select("doc_id", "train", F.explode(pairs).alias("_p")).select(
        "doc_id", "train", "_p.b", "_p.w", F.lit(1).cast("long").alias("n")
    )


# ----------------------------------------------------------------------------------- re-seating


def uniforms(seed: np.ndarray, step: np.ndarray) -> np.ndarray:
    x = mix(seed.astype(np.uint64) + step.astype(np.uint64) * np.uint64(GOLDEN))
    return (x >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


LOCKSTEP, WINDOW = 64, 1 << 14


def seat(c: np.ndarray, a: np.ndarray, seed: np.ndarray, d: float) -> np.ndarray:
    """Tables of each dish after seating its ``c`` customers one after the other.

    A customer opens a table with probability ``a / (i - d t + a)`` (i customers and t tables before
    it), else joins one. ``a`` is the restaurant's new-table weight times the parent's probability.
    """
    c = c.astype(np.int64)
    t = np.minimum(c, 1)
    few = np.flatnonzero((c >= 2) & (c <= LOCKSTEP))
    if len(few):
        few = few[np.argsort(-c[few], kind="stable")]  # those that still seat customers are always the first ones
        cf, af, sf, tf = c[few], a[few], seed[few], t[few].astype(np.float64)
        for i in range(1, int(cf[0])):
            n = int(np.searchsorted(-cf, -i))
            tf[:n] += uniforms(sf[:n], np.full(n, i)) < af[:n] / (i - d * tf[:n] + af[:n])
        t[few] = tf.astype(np.int64)
    for k in np.flatnonzero(c > LOCKSTEP):
        t[k] = _seat_many(int(c[k]), float(a[k]), np.uint64(seed[k]), d)
    return t


def _seat_many(c: int, a: float, seed, d: float) -> int:
    """One dish with many customers: looks only at those who may open a table."""
    i, t = 1, 1
    while i < c:
        steps = np.arange(i, min(i + WINDOW, c))
        draws = uniforms(np.full(len(steps), seed), steps)
        # No customer sees more tables than if all before it in the window had opened one.
        near = np.flatnonzero(draws < a / (steps - d * (t + steps - i) + a))
        for step, draw in zip(steps[near].tolist(), draws[near].tolist()):
            t += draw < a / (step - d * t + a)
        i += len(steps)
    return t


def _seater(d: float):
    @pandas_udf("long")
    def seated(c: pd.Series, a: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series(seat(c.to_numpy(), a.to_numpy(dtype=np.float64), seed.to_numpy().astype(np.uint64), d))

    return seated


# ----------------------------------------------------------------------------------- the model


@dataclass
class Model:
    dishes: DataFrame  # b, w, logp, cw: every (context, word) of the training tokens
    contexts: DataFrame  # b, back: per kept sweep, the weight a context leaves to its parent
    words: DataFrame  # w, p0, cw: per kept sweep, the root's probability; raw count
    unknown: list[float]  # per kept sweep, the root's probability of a word never seen
    n_tokens: int
    n_distinct: int


def train(spark, pairs: DataFrame, prior: Prior = Prior()) -> Model:
    """Gibbs sweeps over the seating of all training bigrams ``b, w, n`` (n repeats)."""
    d0, d1 = prior.discount
    s0, s1 = prior.strength
    counts = stored(pairs.groupBy("b", "w").agg(F.sum("n").alias("c")))
    raw = stored(counts.groupBy("w").agg(F.sum("c").alias("cw")))
    n_tokens, n_distinct = raw.agg(F.coalesce(F.sum("cw"), F.lit(0)), F.count(F.lit(1))).first()
    base = 1.0 / (n_distinct + 1)
    if not n_distinct:
        empty = spark.createDataFrame([], "b long, w long, logp double, cw long")
        return Model(empty, spark.createDataFrame([], "b long, back array<double>"),
                     spark.createDataFrame([], "w long, p0 array<double>, cw long"), [1.0], 0, 0)

    single = counts.filter("c = 1")
    singles_b = single.groupBy("b").agg(F.count(F.lit(1)).alias("sb"))
    singles_w = single.groupBy("w").agg(F.count(F.lit(1)).alias("sw"))
    totals = stored(counts.groupBy("b").agg(F.sum("c").alias("served")).join(singles_b, "b", "left").fillna(0, ["sb"]))
    multi = stored(counts.filter("c > 1").withColumn("t", F.lit(1).cast("long")).withColumn("hist", F.array().cast("array<long>")))
    root = raw.select("w", "cw").join(counts.groupBy("w").agg(F.count(F.lit(1)).alias("c0")), "w")
    root = stored(root.withColumn("t0", F.lit(1).cast("long")).withColumn("h_c0", F.array().cast("array<long>")).withColumn("h_t0", F.array().cast("array<long>")))

    seat1, seat0 = _seater(d1), _seater(d0)
    for sweep in range(prior.sweeps):
        kept = sweep >= prior.sweeps - prior.keep
        big_t0, big_c0 = root.agg(F.sum("t0"), F.sum("c0")).first()
        p0 = root.select("w", ((F.col("c0") - d0 * F.col("t0") + (s0 + d0 * big_t0) * base) / (s0 + big_c0)).alias("p0"))
        tables = multi.groupBy("b").agg(F.sum("t").alias("mt")).join(totals, "b", "right").select(
            "b", (F.coalesce("mt", F.lit(0)) + F.col("sb")).alias("tables")
        )
        p0 = F.broadcast(p0) if fits_broadcast(p0, "w") else p0
        joined = multi.join(tables, "b").join(p0, "w")
        a = (s1 + d1 * F.col("tables")) * F.col("p0")
        seed = F.xxhash64("b", "w", F.lit(sweep), F.lit(1))
        multi = joined.select("b", "w", "c", seat1("c", a, seed).alias("t"), "hist")
        if kept:
            multi = multi.withColumn("hist", F.concat("hist", F.array("t")))
        multi = stored(multi)

        c0 = (
            multi.groupBy("w").agg(F.sum("t").alias("mt"))
            .join(singles_w, "w", "full")
            .select("w", (F.coalesce("mt", F.lit(0)) + F.coalesce("sw", F.lit(0))).alias("c0"))
        )
        a0 = (s0 + d0 * big_t0) * base
        root = root.drop("c0").join(c0, "w").withColumn("t0", seat0("c0", F.lit(a0), F.xxhash64("w", F.lit(sweep), F.lit(0))))
        if kept:
            root = root.withColumn("h_c0", F.concat("h_c0", F.array("c0"))).withColumn("h_t0", F.concat("h_t0", F.array("t0")))
        root = stored(root)

    return _predictive(counts, multi, totals, root, raw, prior, base, int(n_tokens), int(n_distinct))


def _predictive(counts, multi, totals, root, raw, prior: Prior, base: float, n_tokens: int, n_distinct: int) -> Model:
    d0, d1 = prior.discount
    s0, s1 = prior.strength
    k = prior.keep
    sums = root.agg(*[F.sum(F.col("h_t0")[s]) for s in range(k)], *[F.sum(F.col("h_c0")[s]) for s in range(k)]).first()
    big_t0, big_c0 = sums[:k], sums[k:]
    p0 = F.array(*[(F.col("h_c0")[s] - d0 * F.col("h_t0")[s] + (s0 + d0 * big_t0[s]) * base) / (s0 + big_c0[s]) for s in range(k)])
    words = stored(root.select("w", p0.alias("p0"), "cw"))
    unknown = [(s0 + d0 * big_t0[s]) * base / (s0 + big_c0[s]) for s in range(k)]

    many = multi.groupBy("b").agg(*[F.sum(F.col("hist")[s]).alias(f"m{s}") for s in range(k)])
    contexts = totals.join(many, "b", "left").select(
        "b", "served", F.array(*[F.coalesce(F.col(f"m{s}"), F.lit(0)) + F.col("sb") for s in range(k)]).alias("tables")
    )
    contexts = stored(contexts.select("b", "served", "tables", F.transform("tables", lambda t: (s1 + d1 * t) / (s1 + F.col("served"))).alias("back")))

    tables = counts.join(multi.select("b", "w", "hist"), ["b", "w"], "left").select(
        "b", "w", "c", F.coalesce("hist", F.array_repeat(F.lit(1).cast("long"), k)).alias("hist")
    )
    per = tables.join(contexts.select("b", "served", "tables"), "b").join(words, "w")
    each = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda s: (F.col("c") - d1 * F.col("hist")[s] + (s1 + d1 * F.col("tables")[s]) * F.col("p0")[s]) / (s1 + F.col("served")),
    )
    mean = F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / k
    dishes = stored(per.select("b", "w", F.log10(mean).alias("logp"), "cw"))
    return Model(dishes, contexts.select("b", "back"), words, unknown, n_tokens, n_distinct)


def score(model: Model, pairs: DataFrame) -> DataFrame:
    """Per document: n_tokens, n_known, base_score and score of its tokens ``doc_id, b, w, n``."""
    k = len(model.unknown)
    found = pairs.join(model.dishes, ["b", "w"], "left")
    hit = found.filter(F.col("logp").isNotNull()).select("doc_id", "n", "logp", "cw")
    rest = found.filter(F.col("logp").isNull()).select("doc_id", "n", "b", "w")
    rest = rest.join(model.contexts, "b", "left").join(model.words, "w", "left")
    ones = F.array_repeat(F.lit(1.0), k)
    unknown = F.array(*[F.lit(u) for u in model.unknown])
    back, p0 = F.coalesce("back", ones), F.coalesce("p0", unknown)
    mean = F.aggregate(F.zip_with(back, p0, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x) / k
    missed = rest.select("doc_id", "n", F.log10(mean).alias("logp"), F.coalesce("cw", F.lit(0)).alias("cw"))
    both = hit.unionByName(missed)
    denominator = model.n_tokens + BASE_ADD * (model.n_distinct + 1)
    return both.groupBy("doc_id").agg(
        F.sum("n").alias("n_tokens"),
        F.coalesce(F.sum(F.when(F.col("cw") > 0, F.col("n"))), F.lit(0)).alias("n_known"),
        F.sum(F.col("n") * F.log10((F.col("cw") + BASE_ADD) / F.lit(denominator))).alias("base_score"),
        F.sum(F.col("n") * F.col("logp")).alias("score"),
    )


def lm_scores(docs: DataFrame, train_rows: Column, prior: Prior = Prior()) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every document; the model
    learns from the rows where ``train_rows`` is true."""
    tagged = docs.select("doc_id", F.coalesce(train_rows, F.lit(False)).alias("train"), "text")
    scored = document_scores(tagged, prior, seat, BASE_ADD)
    return scored.groupBy("doc_id").agg(
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known")], F.max("train_tokens").alias("train_tokens"),
        *[F.sum(c).alias(c) for c in ("base_score", "score")],
    )
