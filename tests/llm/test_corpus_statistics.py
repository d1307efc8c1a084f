"""Pitman-Yor scoring, stratified search and the divergence audit against plain loops."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from contactloom.llm.divergence import divergence_audit
from contactloom.llm.lexical_search import ranked_search
from contactloom.llm.pitman_yor import Prior, lm_scores, seat, uniforms
from contactloom.llm.words import held_out

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SEARCH_BREAK = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AUDIT_BREAK = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
#: Columns whose names the operators use inside.
EXTRA = "b long, w long, term string, stem binary, m long, tf long, c long, t long, score long, item string, p long"


def split(pattern, text):
    return [t for t in pattern.split((text or "").translate(LOWERED)) if t]


def with_extras(spark, rows, schema):
    extra = (1, 2, "t", b"s", 3, 4, 5, 6, 7, "i", 8)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{schema}, {EXTRA}")


# ----------------------------------------------------------------------------------- search


def brute_search(docs, items, k):
    terms = {d: split(SEARCH_BREAK, t) for d, t in docs if d is not None}
    full = {d: ts for d, ts in terms.items() if ts}
    n, total = len(full), sum(len(ts) for ts in full.values())
    df = Counter(t for ts in full.values() for t in set(ts))
    out = []
    for item, text in items:
        asked, scores = split(SEARCH_BREAK, text), {}
        for d, ts in full.items():
            tf, m = Counter(ts), 75 + (25 * len(ts) * n) // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
                for t in asked if tf[t]
            )
            if s > 0:
                scores[d] = s
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(item, r + 1, d, s) for r, (d, s) in enumerate(best)]
    return sorted(out)


SEARCH_DOCS = [
    (1, "The cat sat on the mat."), (2, "the the the cat"), (3, None), (4, ""), (5, "Ünïcode wörds and the cat"),
    (6, "cat " * 3000), (7, "a b c d e f g h"), (8, "The cat sat on the mat."), (None, "cat without id"),
    (9, "dog dog DOG"), (10, "mat-cat, 42 cats; 42"), (11, "!!! ??? ..."),
]
ITEMS = [(1, "the cat"), (2, "dog and Ünïcode"), (3, None), (4, "42 mat mat"), (5, "nothing here zzz"), (6, "the")]


@pytest.mark.parametrize("k", [1, 2, 20])
def test_search_equals_brute_force(spark, k):
    docs = with_extras(spark, SEARCH_DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(tuple(r) for r in ranked_search(docs, items, k).collect())
    assert got == brute_search(SEARCH_DOCS, ITEMS, k)


def test_search_over_small_tables(spark, small, texts):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    asked = [(r.item_id, r.text) for r in items.collect()]
    got = sorted(tuple(r) for r in ranked_search(docs, items).collect())
    assert got == brute_search(list(texts.items()), asked, 20)


def test_search_on_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search(none, items).count() == 0
    assert ranked_search(with_extras(spark, SEARCH_DOCS, "doc_id long, text string"), items.limit(0)).count() == 0


# ----------------------------------------------------------------------------------- audit


def brute_audit(rows, min_docs, top=50):
    docs = [(d, lang or "", source or "", split(AUDIT_BREAK, text)) for d, text, lang, source in rows]
    groups = {(lang, source) for _, lang, source, _ in docs}
    holders = defaultdict(set)
    for d, lang, _, ts in docs:
        for t in ts:
            if d is not None:
                holders[lang, t].add(d)
    kept = defaultdict(set)
    for (lang, t), ids in holders.items():
        if len(ids) >= min_docs:
            kept[lang].add(t)
    counts, lang_counts = defaultdict(Counter), defaultdict(Counter)
    for _, lang, source, ts in docs:
        for t in ts:
            if t in kept[lang]:
                counts[lang, source][t] += 1
                lang_counts[lang][t] += 1

    def p(counter, lang):
        v, n = len(kept[lang]), sum(counter.values())
        return {t: 1 + (10**9 * (counter[t] + 5)) // (n + 5 * v) for t in kept[lang]}

    out = []
    for lang, source in groups:
        mine, q = p(counts[lang, source], lang), p(lang_counts[lang], lang)
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                theirs = p(counts[lang, other], lang)
                pairs.append((other, sum(abs(mine[t] - theirs[t]) for t in kept[lang])))
        terms = [(t, mine[t] - q[t]) for t in kept[lang] if counts[lang, source][t] > 0 and mine[t] > q[t]]
        for part, listed, limit in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(listed, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out += [(lang, source, part, item, value, r + 1) for r, (item, value) in enumerate(ranked)]
    return sorted(out)


AUDIT_ROWS = [
    (1, "Der Hund und die Katze", "de", "a"), (2, "der hund bellt", "de", "b"), (3, "DER Hund", "de", "b"),
    (4, "The dog and the cat", "en", "a"), (5, "the dog", "en", "a"), (6, "the cat the cat", "en", "b"),
    (7, None, "en", "c"), (8, "the", None, None), (9, "the the", None, "x"), (10, "éclair éclat écrit", "fr", "a"),
    (11, "éclair éclat", "fr", "b"), (12, "éclair", "fr", "b"), (None, "the dog the dog", "en", "b"),
    (13, "solo", "xx", "only"), (14, "x" * 50_000 + " the", "en", "c"), (4, "the dog again", "en", "a"),
]


@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_audit_equals_brute_force(spark, min_docs):
    docs = with_extras(spark, AUDIT_ROWS, "doc_id long, text string, lang string, source string")
    got = sorted(tuple(r) for r in divergence_audit(docs, min_docs).collect())
    assert got == brute_audit(AUDIT_ROWS, min_docs)


def test_audit_over_small_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(tuple(r) for r in divergence_audit(docs, 5).collect())
    assert got == brute_audit(rows, 5)


def test_audit_of_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence_audit(none).count() == 0


# ----------------------------------------------------------------------------------- language model


def plain_seat(c, a, seed, d):
    t = 1
    for i in range(1, c):
        if uniforms(np.array([seed], dtype=np.uint64), np.array([i]))[0] < a / (i - d * t + a):
            t += 1
    return t


def test_seating_equals_one_customer_at_a_time():
    rng = np.random.default_rng(3)
    c = np.concatenate([rng.integers(0, 70, 300), [200, 1000, 5000]])
    a = np.concatenate([rng.random(300) * 3, [0.01, 5.0, 0.5]])
    seed = rng.integers(0, 2**63, len(c)).astype(np.uint64)
    got = seat(c, a, seed, 0.75)
    assert got.tolist() == [plain_seat(int(x), float(y), s, 0.75) if x else 0 for x, y, s in zip(c, a, seed)]


def lm_tokens(text):
    return [*split(SPACES, text), "\n"]


def brute_base(rows):
    train = Counter(t for d, text in rows if d is None or zlib.crc32(str(d).encode()) % 10 != 0 for t in lm_tokens(text))
    n, v = sum(train.values()), len(train)
    out = {}
    for d, text in rows:
        ts = lm_tokens(text)
        out[d] = (len(ts), sum(train[t] > 0 for t in ts), n, sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
    return out


def test_language_model_counts_equal_brute_force(spark, small, texts):
    rows = list(texts.items())
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = lm_scores(docs, ~held_out("doc_id", 10, 0)).collect()
    want = brute_base(rows)
    assert len(got) == len(want)
    for r in got:
        n, known, train, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score < 0


def test_model_beats_unigram_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_scores(docs, ~held_out("doc_id", 10, 0)).join(docs.select("doc_id", held_out("doc_id", 10, 0).alias("h")), "doc_id")
    held = got.filter("h").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"]


ODD = [(1, None), (2, ""), (3, "x" * 100_000), (4, "ok " * 20_000), (4, "again"), (None, "no id"), (5, "a b a b a b")]


def test_language_model_on_odd_rows(spark):
    docs = with_extras(spark, ODD, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scores(docs, F_true(), Prior(sweeps=2, keep=1)).collect()}
    assert set(got) == {1, 2, 3, 4, None, 5}
    assert got[1].n_tokens == got[2].n_tokens == 1 and got[4].n_tokens == 20_003
    assert all(r.score <= 0 and r.base_score <= 0 for r in got.values())
    none = lm_scores(docs, F_false())
    assert {r.score for r in none.collect()} == {0.0} and {r.base_score for r in none.collect()} == {0.0}
    assert lm_scores(docs.limit(0), F_true()).count() == 0


def F_true():
    from pyspark.sql import functions as F

    return F.lit(True)


def F_false():
    from pyspark.sql import functions as F

    return F.lit(False)


def test_probabilities_of_a_context_sum_to_one(spark):
    from contactloom.llm.pitman_yor import bigrams, tokens, train
    from pyspark.sql import functions as F

    rows = [(i, " ".join(["a b c a", "b b", "c a d"][i % 3] for _ in range(i % 5 + 1))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = bigrams(docs.select("doc_id", F.lit(True).alias("train"), tokens(F.col("text")).alias("_tok")))
    model = train(spark, pairs.select("b", "w", "n"), Prior(sweeps=3, keep=2))
    words = {r.w: r.p0 for r in model.words.collect()}
    for s in range(2):
        assert sum(p[s] for p in words.values()) + model.unknown[s] == pytest.approx(1.0)
    back = {r.b: r.back for r in model.contexts.collect()}
    seen = defaultdict(dict)
    for r in model.dishes.collect():
        seen[r.b][r.w] = 10**r.logp
    for b, dishes in seen.items():
        rest = sum(np.mean([back[b][s] * words[w][s] for s in range(2)]) for w in words if w not in dishes)
        unseen = np.mean([back[b][s] * model.unknown[s] for s in range(2)])
        assert sum(dishes.values()) + rest + unseen == pytest.approx(1.0)


def test_rows_of_one_document_add_up_past_the_floor(spark):
    rows = [(1, "cat"), *[(2, "dog " + "x " * i) for i in range(30)], *[(i, "x y z") for i in range(3, 73)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, "cat dog")], "item_id long, text string")
    best = ranked_search(docs, items, 2).collect()
    assert [(r.rank, r.doc_id) for r in best] == [(1, 2), (2, 1)] and best[0].score > best[1].score


def test_index_has_one_row_per_document(spark):
    from contactloom.llm.lexical_search import build_index

    docs = spark.createDataFrame(SEARCH_DOCS, "doc_id long, text string")
    index = build_index(docs, ["cat", "the"])
    got = {r.doc_id: (r.size, dict(zip(r.terms, r.tfs))) for r in index.rows.collect()}
    assert got[2] == (4, {0: 1, 1: 3}) and got[7] == (8, {}) and not {3, 4, 11} & set(got)
    assert (index.n_docs, index.total_terms) == (len(got), sum(size for size, _ in got.values()))


def test_audit_puts_terms_of_many_documents_together(spark):
    from contactloom.llm.divergence import term_blocks

    rows = [(i // 2 if i > 90 else i + 100, "en", "ab"[i % 2], i > 90, "one two two") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, again boolean, text string").coalesce(1)
    got = term_blocks(docs).collect()
    whole = {r.term: (r.n_docs, {h.source: h.n for h in r.held}) for r in got if r.doc_id is None}
    assert whole == {"one": (91, {"a": 46, "b": 45}), "two": (91, {"a": 92, "b": 90})}
    assert len(got) == 2 + 2 * 9 and all(r.n_docs == 0 for r in got if r.doc_id is not None)


def test_seating_is_done_in_bulk(monkeypatch):
    from contactloom.llm import pitman_yor

    drawn, plain = [], pitman_yor.uniforms
    monkeypatch.setattr(pitman_yor, "uniforms", lambda seed, step: drawn.append(len(step)) or plain(seed, step))
    c, a = np.array([2] * 1000 + [60, 40_000]), np.array([0.5] * 1000 + [0.5, 30.0])
    seed = np.arange(1, 1003, dtype=np.uint64)
    got = seat(c, a, seed, 0.75)
    assert sum(drawn) == (c - 1).sum() and len(drawn) < 70
    monkeypatch.undo()
    assert got.tolist() == [plain_seat(int(x), float(y), s, 0.75) for x, y, s in zip(c, a, seed)]


def test_string_hashes_equal_xxhash64(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from contactloom.llm.packed_bigrams import string_hashes

    texts = ["", *("aé中\x00z" * 60)[:70], *(("xyzé" * 50)[:n] for n in range(140)), "w" * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, s string").select("i", F.xxhash64("s").alias("h"))
    want = [r.h for r in rows.orderBy("i").collect()]
    assert string_hashes(pa.array([None, *texts]).slice(1)).view(np.int64).tolist() == want


def test_packed_numbers_come_back():
    from contactloom.llm.packed_bigrams import pack, unpack

    given = [np.zeros(0, np.int64), np.array([0, 255]), np.array([70_000]), np.array([1.5, -2.0]), np.arange(2000), np.array([2**64 - 1], np.uint64)]
    assert [x.tolist() for x in unpack(pack(*given))] == [x.tolist() for x in given]


def mixed_rows():
    rng = np.random.default_rng(5)
    names = [f"Wört{i}" if i % 3 else f"w{i}" for i in range(60)]
    rows = [(i % 70, " ".join(names[int(k)] for k in rng.zipf(1.4, rng.integers(0, 60)) % 60)) for i in range(90)]
    return [*rows, (None, "w0 w3"), (None, None), (71, "only here"), (72, ""), (73, "w0 " * 500)]


@pytest.mark.parametrize("sweeps, keep, learnt", [(4, 2, True), (1, 1, True), (2, 2, False)])
def test_scores_in_place_equal_the_model_as_tables(spark, monkeypatch, sweeps, keep, learnt):
    from pyspark.sql import functions as F

    from contactloom.llm import packed_bigrams
    from contactloom.llm.pitman_yor import bigrams, score, tokens, train

    monkeypatch.setattr(packed_bigrams, "CHUNK_TOKENS", 300)  # several blocks a partition
    monkeypatch.setattr(packed_bigrams, "PIECE_BYTES", 500)
    docs = spark.createDataFrame(mixed_rows(), "doc_id long, text string").repartition(3)
    prior, learn = Prior(sweeps=sweeps, keep=keep), ~held_out("doc_id", 10, 0) & F.lit(learnt)
    assert len(packed_bigrams.hot_contexts(docs.select("doc_id", learn.alias("train"), "text"), 2)) > 1
    pairs = bigrams(docs.select("doc_id", learn.alias("train"), tokens(F.col("text")).alias("_tok")))
    model = train(spark, pairs.filter("train").select("b", "w", "n"), prior)
    want = {r.doc_id: r for r in score(model, pairs.select("doc_id", "b", "w", "n")).collect()}
    got = {r.doc_id: r for r in lm_scores(docs, learn, prior).collect()}
    assert set(got) == set(want)
    for key, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (want[key].n_tokens, want[key].n_known, model.n_tokens)
        assert (r.score, r.base_score) == pytest.approx((want[key].score, want[key].base_score), rel=1e-9, abs=1e-9)


def test_scoring_stores_no_tables_and_shuffles_few_bytes_a_token(spark, small):
    import os

    from pyspark.sql import functions as F

    from contactloom.llm.packed_bigrams import document_blocks
    from contactloom.operators.shared import shared_folder

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.lit(True).alias("train"), "text")
    before = {f for _, _, names in os.walk(shared_folder(spark)) for f in names}
    assert lm_scores(docs, F_true()).agg({"n_tokens": "sum"}).first()[0] > 0
    assert {f for _, _, names in os.walk(shared_folder(spark)) for f in names} == before
    tokens = lm_scores(docs, F_true()).agg({"n_tokens": "sum"}).first()[0]
    held = document_blocks(docs, 2, np.zeros(0, np.uint64)).agg(F.sum(F.length("payload")), F.count("payload")).first()
    assert held[0] < 9 * tokens and held[1] <= 3 * docs.rdd.getNumPartitions()


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "x"), ("a", "z"), (None, "x")], "doc_id string, text string")
    got = {r.doc_id: r.n_tokens for r in lm_scores(docs, F_true(), Prior(sweeps=1, keep=1)).collect()}
    assert got == {"a": 5, "b": 2, None: 2}
