"""Gibbs sweeps over packed blocks of bigrams, and the scores of their documents, without moving a pair twice.

The pairs of a partition stay where the blocks went. A sweep exchanges numbers only: each partition sends the tables
of its words to the partitions of the words (by hash), which seat the root and send back what it holds of each word.
Lists of words are sent once; later numbers come in their order. Partitions also exchange the totals of hot contexts,
which are spread over all of them. Every row is ``to, (kind, sender, payload)``.

All of it is one chain of shuffles, of which Spark computes again what an executor loses; nothing is collected. Rows
with the same key meet in the partition of that number, in any order.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from contactloom.llm.packed_bigrams import (
    SEED, Pairs, by_place, document_blocks, hash_int, hash_long, hot_contexts, is_in, merged, pack, places, unpack,
)

#: Tasks that score: each adds up its documents over all of its partitions, so few rows go back to the documents.
SCORING_TASKS = 48
#: Sums of documents that a scoring task holds at most, in bytes.
SUMS_BYTES = 256 << 20
NONE = np.zeros(0, np.int64)


def place(key: int) -> int:
    return key


def _kinds(rows) -> dict:
    """Payloads by kind, and by sender."""
    out = defaultdict(dict)
    for _, (kind, sender, payload) in rows:
        out[kind][sender] = payload
    return out


def _of_hot(replies: dict[int, list[np.ndarray]], size: int, n_parts: int, which: int) -> np.ndarray:
    """Totals of the hot contexts; partition q adds up every n_parts-th from the q-th on."""
    out = np.zeros(size, np.int64)
    for q, arrays in replies.items():
        out[q::n_parts] = arrays[which]
    return out


# ----------------------------------------------------------------------------------- a partition's pairs


def _singles(pairs: Pairs, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Customers, dishes with one and with more customers of each context; place among the hot contexts or -1."""
    size = len(pairs.contexts)
    served = np.bincount(pairs.b, pairs.c, size).astype(np.int64)
    one, more = (np.bincount(pairs.b[x], minlength=size) for x in (pairs.c == 1, pairs.c > 1))
    return served, one, more, is_in(pairs.contexts, hot)


def _register(n_parts: int, hot: np.ndarray):
    """First row to each partition of words: the partition's words, customers, dishes and dishes with one customer,
    whether there are dishes to sample, and its share of the hot contexts. To itself: the dishes to sample."""

    def run(index, rows):
        blocks = [payload for _, (kind, _, payload) in rows if kind == "block"]
        if not blocks:
            return
        pairs = merged(blocks)
        pairs.tokens.clear()
        served, one, more, at_hot = _singles(pairs, hot)
        size = len(pairs.words)
        cw = np.bincount(pairs.w, pairs.c, size).astype(np.int64)
        dishes, single = (np.bincount(pairs.w[x], minlength=size) for x in (pairs.c > 0, pairs.c == 1))
        sampled = np.flatnonzero(pairs.c > 1)
        some, w_at = np.unique(pairs.w[sampled], return_inverse=True)
        is_sampled = np.zeros(size, bool)
        is_sampled[some] = True
        totals = [np.zeros(len(hot), np.int64) for _ in range(3)]
        for total, part in zip(totals, (served, one, more)):
            total[at_hot[at_hot >= 0]] = part[at_hot >= 0]
        rows_of = dict(by_place(places(pairs.words, n_parts), n_parts))
        for q in range(n_parts):
            if q in rows_of or q < len(hot):
                numbers = [v[rows_of.get(q, NONE)] for v in (pairs.words, cw, dishes, single, is_sampled)]
                yield q, ("words", index, pack(*numbers, *(total[q::n_parts] for total in totals)))
        ctx, per = np.unique(pairs.b[sampled], return_counts=True)
        yield index, ("dishes", index, pack(
            pairs.contexts[ctx], one[ctx], at_hot[ctx] + 1, per, pairs.words[some], w_at, pairs.c[sampled],
        ))

    return run


def _reseat(index: int, got: dict, n_parts: int, hot: np.ndarray, seat, prior, sweep: int):
    """Re-seats the dishes with two or more customers and sends their tables; to itself all tables, and of the root the
    sum of tables and number of words."""
    (d0, d1), (s0, s1) = prior.discount, prior.strength
    replies = {q: unpack(x) for q, x in got["root"].items()}
    big_t0, big_c0, n_words, _ = _totals(replies, 0)
    base = 1.0 / (n_words + 1)
    if index not in got["dishes"]:
        yield index, (f"seated{sweep}", index, pack(np.zeros(0), np.array([big_t0, n_words])))
        return
    ctx, one, at_hot, per, words, w_at, c = unpack(got["dishes"][index])
    at_hot, c = at_hot.astype(np.int64) - 1, c.astype(np.int64)
    b_at = np.repeat(np.arange(len(ctx)), per)
    before = unpack(got[f"seated{sweep - 1}"][index])[0] if sweep else np.ones(len(c))
    tables = np.bincount(b_at, before, len(ctx)).astype(np.int64) + one.astype(np.int64)
    in_hot = np.flatnonzero(at_hot >= 0)
    tables[in_hot] = (_of_hot(replies, len(hot), n_parts, 3) + _of_hot(replies, len(hot), n_parts, 4))[at_hot[in_hot]]
    rows_of = dict(by_place(places(words, n_parts), n_parts))
    c0, t0 = (np.zeros(len(words), np.int64) for _ in "ct")
    for q, rows in rows_of.items():
        c0[rows], t0[rows] = replies[q][1], replies[q][2]
    p0 = (c0 - d0 * t0 + (s0 + d0 * big_t0) * base) / (s0 + big_c0)
    a = (s1 + d1 * tables)[b_at] * p0[w_at]
    seed = hash_int(1, hash_int(sweep, hash_long(words[w_at], hash_long(ctx[b_at], np.full(len(c), SEED)))))
    t = seat(c, a, seed, d1)
    of_words = np.bincount(w_at, t, len(words)).astype(np.int64)
    of_hot = np.zeros(len(hot), np.int64)
    np.add.at(of_hot, at_hot[in_hot], np.bincount(b_at, t, len(ctx)).astype(np.int64)[in_hot])
    for q in range(n_parts):
        if q in rows_of or q < len(hot):
            yield q, (f"tables{sweep}", index, pack(of_words[rows_of.get(q, NONE)], of_hot[q::n_parts]))
    yield index, (f"seated{sweep}", index, pack(t, np.array([big_t0, n_words])))


def _totals(replies: dict, at: int) -> np.ndarray:
    """Sums over all partitions of words."""
    return np.sum([x[at].astype(np.int64) for x in replies.values()], axis=0)


def _sampler(n_parts: int, hot: np.ndarray, seat, prior, sweep: int):
    def run(index, rows):
        return _reseat(index, _kinds(r for r in rows if r[1][0] in ("root", "dishes", f"seated{sweep - 1}")), n_parts, hot, seat, prior, sweep)

    return run


# ----------------------------------------------------------------------------------- a partition's words


class _Root:
    """The words of a partition, put together from the lists that the partitions of pairs sent."""

    def __init__(self, got: dict):
        self.senders = sorted(got["words"])
        lists = {p: unpack(got["words"][p]) for p in self.senders}
        self.words, at = np.unique(np.concatenate([NONE.view(np.uint64), *(lists[p][0] for p in self.senders)]), return_inverse=True)
        sums = [np.concatenate([NONE, *(lists[p][k].astype(np.int64) for p in self.senders)]) for k in (1, 2, 3)]
        self.cw, self.dishes, self.single = (np.bincount(at, x, len(self.words)).astype(np.int64) for x in sums)
        self.at, self.sampled, begin = {}, {}, 0
        for p in self.senders:
            self.at[p] = at[begin : begin + len(lists[p][0])]
            self.sampled[p] = self.at[p][lists[p][4].astype(bool)]
            begin += len(lists[p][0])
        self.hot = [sum((lists[p][k].astype(np.int64) for p in self.senders), np.zeros(1, np.int64)) for k in (5, 6, 7)]
        self.hot = self.hot if self.senders else [NONE] * 3

    def seated(self, index: int, got: dict, seat, prior, sweep: int):
        """Customers and tables of each word after a sweep, and tables in hot contexts."""
        c0 = self.single.copy()
        more = np.zeros_like(self.hot[2])
        for p, payload in got[f"tables{sweep}"].items():
            tables, in_hot = unpack(payload)
            c0[self.sampled[p]] += tables.astype(np.int64)
            more += in_hot.astype(np.int64)
        big_t0, n_words = unpack(got[f"seated{sweep}"][index])[1].astype(np.int64)
        a0 = (prior.strength[0] + prior.discount[0] * big_t0) * (1.0 / (n_words + 1))
        seed = hash_int(0, hash_int(sweep, hash_long(self.words, np.full(len(c0), SEED))))
        return c0, seat(c0, np.full(len(c0), a0), seed, prior.discount[0]), more


def _seater(n_parts: int, seat, prior, sweep: int):
    """Root after ``sweep`` (-1: before the first), for the words with dishes to sample. A reply has sums of tables and
    customers, number of words, tokens; customers and tables of the words; of the hot contexts, dishes with one customer
    and tables of the others."""

    def run(index, rows):
        got = _kinds(r for r in rows if r[1][0] in ("words", f"tables{sweep}", f"seated{sweep}"))
        root = _Root(got)
        if sweep < 0:
            c0, t0, more = root.dishes, (root.cw > 0).astype(np.int64), root.hot[2]
        else:
            c0, t0, more = root.seated(index, got, seat, prior, sweep)
        sums = np.array([t0.sum(), c0.sum(), (root.cw > 0).sum(), root.cw.sum()])
        for p in range(n_parts):
            rows = root.sampled.get(p, NONE)
            yield p, ("root", index, pack(sums, c0[rows], t0[rows], root.hot[1], more))

    return run


def _answer(n_parts: int, seat, prior, kept: list[int]):
    """All words for scoring. A reply has number of words, tokens and sums of tables and customers of each kept sweep;
    counts of the words; totals of the hot contexts; then for each kept sweep customers and tables of the words, and
    tables of more than one customer in hot contexts."""

    def run(index, rows):
        got = _kinds(r for r in rows if r[1][0] == "words" or any(r[1][0] == f"{kind}{k}" for kind in ("tables", "seated") for k in kept))
        root = _Root(got)
        sweeps = [root.seated(index, got, seat, prior, k) for k in kept]
        sums = [(root.cw > 0).sum(), root.cw.sum()] + [x.sum() for c0, t0, _ in sweeps for x in (t0, c0)]
        for p in range(n_parts):
            rows = root.at.get(p, NONE)
            each = [x for c0, t0, more in sweeps for x in (c0[rows], t0[rows], more)]
            yield p, ("answer", index, pack(np.array(sums), root.cw[rows], root.hot[0], root.hot[1], *each))

    return run


# ----------------------------------------------------------------------------------- scores


def _log_probabilities(index: int, pairs: Pairs, got: dict, n_parts: int, hot: np.ndarray, prior, kept: list[int], add: float):
    """Of each pair, log10 of its probability, averaged over the kept sweeps; log10 of the base probability of its
    word; whether the word is unknown. And the number of tokens learnt from."""
    (d0, d1), (s0, s1) = prior.discount, prior.strength
    replies = {q: unpack(x) for q, x in got["answer"].items()}
    sums = _totals(replies, 0)
    n_words, n_tokens = int(sums[0]), int(sums[1])
    base = 1.0 / (n_words + 1)
    rows_of = dict(by_place(places(pairs.words, n_parts), n_parts))

    def of_words(which: int) -> np.ndarray:
        out = np.zeros(len(pairs.words), np.int64)
        for q, rows in rows_of.items():
            out[rows] = replies[q][which]
        return out

    served, one, _, at_hot = _singles(pairs, hot)
    in_hot = np.flatnonzero(at_hot >= 0)
    if len(in_hot):
        served[in_hot], one[in_hot] = _of_hot(replies, len(hot), n_parts, 2)[at_hot[in_hot]], _of_hot(replies, len(hot), n_parts, 3)[at_hot[in_hot]]
    cw, c, sampled = of_words(1), pairs.c, pairs.c > 1
    mean = np.zeros(len(c))
    for k, sweep in enumerate(kept):
        t = np.minimum(c, 1)
        if sampled.any():
            t[sampled] = unpack(got[f"seated{sweep}"][index])[0]
        tables = np.bincount(pairs.b[sampled], t[sampled], len(served)).astype(np.int64)
        if len(in_hot):
            tables[in_hot] = _of_hot(replies, len(hot), n_parts, 6 + 3 * k)[at_hot[in_hot]]
        tables += one
        big_t0, big_c0 = sums[2 + 2 * k : 4 + 2 * k]
        p0 = (of_words(4 + 3 * k) - d0 * of_words(5 + 3 * k) + (s0 + d0 * big_t0) * base) / (s0 + big_c0)
        if not n_words:
            p0[:] = 1.0
        weight = s1 + d1 * tables
        with np.errstate(invalid="ignore"):
            back = np.where(served > 0, weight / (s1 + served), 1.0)
        p = p0[pairs.w]
        mean += np.where(c > 0, (c - d1 * t + weight[pairs.b] * p) / np.maximum(s1 + served, 1e-300)[pairs.b], back[pairs.b] * p)
    plain = np.log10((cw + add) / (n_tokens + add * (n_words + 1)))
    return np.log10(mean / len(kept)), plain[pairs.w], (cw == 0)[pairs.w], n_tokens


def _score(n_parts: int, hot: np.ndarray, prior, kept: list[int], add: float):
    """Sums of each chunk's documents over the partitions of a task: score, base score, unknown tokens."""

    def run(rows):
        held, size = {}, 0

        def flush():
            for (split, number), sums in held.items():
                yield (split * 31 + number) % n_parts, ("sums", (split, number), pack(*sums))
            held.clear()

        for index, some in groupby(rows, lambda r: r[0]):
            blocks, docs, got = [], [], defaultdict(dict)
            for _, (kind, sender, payload) in some:
                if kind == "block":
                    blocks.append(payload)
                elif kind == "docs":
                    docs.append(payload)
                elif not kind.startswith("tables"):
                    got[kind][sender] = payload
            pairs = merged(blocks)
            blocks.clear()
            score, base, unknown, n_tokens = _log_probabilities(index, pairs, got, n_parts, hot, prior, kept, add)
            for payload in docs:
                yield index, ("docs", n_tokens, payload)
            while pairs.tokens:
                name, n_docs, pair, n, doc = pairs.tokens.pop()
                if name not in held:
                    held[name] = [np.zeros(n_docs), np.zeros(n_docs), np.zeros(n_docs, np.int64)]
                    size += 24 * n_docs
                sums = held[name]
                for k, values in enumerate((score, base)):
                    sums[k] += np.bincount(doc, np.repeat(values[pair], n), n_docs)
                some_unknown = unknown[pair]
                if some_unknown.any():
                    sums[2] += np.bincount(doc[np.repeat(some_unknown, n)], minlength=n_docs)
            if size > SUMS_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _documents(rows):
    """An Arrow table of each chunk's documents, from its ids and sums."""
    docs, sums = {}, {}
    for _, (kind, what, payload) in rows:
        if kind == "docs":
            name, ids, n = pickle.loads(payload)
            docs[name] = (ids, n, what)
        else:
            parts = unpack(payload)
            if what in sums:
                for whole, part in zip(sums[what], parts):
                    whole += part
            else:
                sums[what] = [parts[0].copy(), parts[1].copy(), parts[2].astype(np.int64)]
    for name, (ids, n, n_tokens) in docs.items():
        score, base, unknown = sums[name]
        ids, n = pa.ipc.open_stream(ids).read_all().column(0).combine_chunks(), unpack(n)[0].astype(np.int64)
        table = pa.table(
            [ids, pa.array(n), pa.array(n - unknown), pa.array(np.full(len(n), n_tokens)), pa.array(base), pa.array(score)],
            ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        yield (out.getvalue().to_pybytes(),)


def _tables(batches):
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            yield from pa.ipc.open_stream(payload)


def document_scores(docs: DataFrame, prior, seat, add: float) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``doc_id, train, text``."""
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_contexts(docs, n_parts)
    kept = list(range(prior.sweeps - prior.keep, prior.sweeps))

    def dealt(rdd):
        return rdd.partitionBy(n_parts, place)

    def together(first, *more):
        for rdd in more:
            first = first.union(rdd)
        if first.getNumPartitions() != n_parts:
            raise RuntimeError("partitions of the same number must meet")
        return first

    blocks = dealt(document_blocks(docs, n_parts, hot).rdd.map(lambda r: (r.to, (r.kind, None, bytes(r.payload)))))
    lists = dealt(blocks.mapPartitionsWithIndex(_register(n_parts, hot)))
    root, tables = dealt(lists.mapPartitionsWithIndex(_seater(n_parts, seat, prior, -1))), []
    for sweep in range(prior.sweeps):
        known = together(lists, root, *tables[-1:])
        tables.append(dealt(known.mapPartitionsWithIndex(_sampler(n_parts, hot, seat, prior, sweep))))
        if sweep + 1 < prior.sweeps:
            root = dealt(together(lists, tables[-1]).mapPartitionsWithIndex(_seater(n_parts, seat, prior, sweep)))
    last = [tables[sweep] for sweep in kept]
    answer = dealt(together(lists, *last).mapPartitionsWithIndex(_answer(n_parts, seat, prior, kept)))
    scored = together(blocks, answer, *last).coalesce(min(n_parts, SCORING_TASKS))
    summed = dealt(scored.mapPartitions(_score(n_parts, hot, prior, kept, add)))
    packed = spark.createDataFrame(summed.mapPartitions(_documents), T.StructType([T.StructField("rows", T.BinaryType())]), verifySchema=False)
    ids = T.StructType([docs.schema["doc_id"]]).simpleString()[7:-1].replace(":", " ", 1)
    return packed.mapInArrow(_tables, f"{ids}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
