"""Substring and near duplicates next to brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from contactloom.llm import near_dedup, queries
from contactloom.llm.components import components
from contactloom.llm.near_dedup import NearDup, alike, keep_one_each, near_duplicates, ordered, scatter, shingles
from contactloom.llm.substring_dedup import Repeats, leftmost_minimum, remove_repeats

WORDS = [f"w{k}" for k in range(400)]


def brute_repeats(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((doc_id, len(w), len(gone), kept))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    draw = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared, line = draw(60), draw(20)
    rows = [(k, f"{draw(rng.randint(0, 40))} {shared if k % 3 == 0 else line}\n{draw(rng.randint(0, 90))}") for k in range(60)]
    rows += [(100, rows[1][1]), (101, " ".join(["again"] * 200)), (102, f"{shared} {shared}"), (103, draw(5000))]
    rows += [(104, None), (105, ""), (106, " \t\n"), (None, rows[2][1]), (107, "é ß " * 50), (108, "x" * 200_000)]
    return rows + [rows[3], (3, draw(50))]


@pytest.mark.parametrize("size", [Repeats(), Repeats(hot=1), Repeats(window=8, seed=3), Repeats(window=2, seed=1)])
def test_repeats_equal_brute_force(spark, docs, size):
    rows = passages(5)
    got = sorted((tuple(r) for r in remove_repeats(docs(*rows), size).collect()), key=str)
    assert got == brute_repeats(rows, size.window)


def test_repeats_query(spark, small, texts):
    expected = {k: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, n, gone, kept in brute_repeats(sorted(texts.items()), 35)}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op1_substring_dedup(spark, small).collect()} == expected


def test_leftmost_minimum():
    values = np.array([5, 1, 1, 7, 0, 9, 9], dtype=np.uint64)
    assert leftmost_minimum(values, 3).tolist() == [1, 1, 4, 4, 4]


def brute_near(rows, percent=85):
    sets = {k: shingles(t or "", 5) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if alike(sets[a], sets[b], percent):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


def family(seed, copies, edits):
    rng = random.Random(seed)
    base = [rng.choice(WORDS) for _ in range(150)]
    rows = []
    for k in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((seed * 1000 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates_equal_brute_force(spark, docs, block):
    rows = family(1, 25, 3) + family(2, 25, 6) + family(3, 6, 1)
    rows += [(9000, rows[0][1].upper()), (9001, "a b"), (9002, "A  b"), (9003, None), (9004, ""), (9005, "one"), (9006, "z " * 30_000)]
    got = near_duplicates(docs(*rows), NearDup(block=block)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_near(rows)


def test_near_duplicates_of_odd_rows(spark, docs):
    text = " ".join(WORDS[:40])
    got = near_duplicates(docs((7, text), (7, text), (7, "other words here"), (None, text), (3, "other words here"), (5, text))).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, True), (3, 3, True), (5, 3, False), (7, 3, False), (7, 3, False), (7, 3, False)
    ]
    kept = keep_one_each(docs((7, text), (5, text), (None, text)))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 5] and len(kept.columns) == 7


def test_near_duplicates_query(spark, small, texts):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op4_minhash_near_dedup(spark, small).collect()}
    assert got == brute_near(sorted(texts.items()))


def test_permutations_are_bijective():
    some = np.random.default_rng(1).integers(0, 2**32, 200_000, dtype=np.uint32)
    for permute in (scatter, ordered):
        assert len(np.unique(permute(some.copy()))) == len(np.unique(some))


def test_components_of_chain_star_and_loop(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (201, 200), (200, 201)]
    groups = defaultdict(set)
    for r in components(spark.createDataFrame(links, "node long, other long")).collect():
        groups[r.component].add(r.node)
    assert dict(groups) == {0: set(range(41)), 100: set(range(100, 130)), 200: {200, 201}}


def test_empty_tables(spark, docs):
    none = docs((1, "x")).filter("doc_id < 0")
    assert remove_repeats(none).count() == near_duplicates(none).count() == 0


def test_a_block_counts_shared_shingles_in_small_steps(monkeypatch):
    rng, rule = random.Random(5), NearDup()
    base = [rng.choice(WORDS) for _ in range(200)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 200, 10)]
    found, steps = [], []
    for step in (1, near_dedup.MEETINGS_AT_ONCE):
        monkeypatch.setattr(near_dedup, "MEETINGS_AT_ONCE", step)
        block = near_dedup.Block(rule)
        for words in near_dedup.blocks(pa.array(texts), lower=True):
            values, first = near_dedup.shingle_sets(words, rule.words)
            for k, row in enumerate(words.rows):
                block.add(row, row, texts[row], values[first[k] : first[k + 1]])
        arange = np.arange
        monkeypatch.setattr(np, "arange", lambda *a: (steps.append(a[0]), arange(*a))[1])
        found.append(set(block.inner_links()))
        monkeypatch.setattr(np, "arange", arange)
        if step == 1:
            assert max(steps) <= len(texts)
    assert found[0] == found[1] == {(a, b) for a in range(20) for b in range(20) if a != b}


def test_rounds_over_few_links_leave_few_files(spark, monkeypatch):
    from contactloom.llm import components as module

    parts, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: parts.append(df.rdd.getNumPartitions()) or cut(df))
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        links = spark.range(1, 300).selectExpr("id AS node", "id - if(id % 10 = 0, 0, 1) AS other")
        got = {r.node: r.component for r in module.components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: k // 10 * 10 for k in range(300)}
    assert len(parts) > 2 and max(parts[1:]) <= module.LEAST
