import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from contactloom.functions import similarity as sim
from contactloom.operators import dedupe as dedupe_module
from contactloom.operators import similarity_join as join_module
from contactloom.operators.dedupe import dedupe_businesses
from contactloom.operators.shared import lookup_join
from contactloom.operators.similarity_join import similar_pairs

COLUMNS = "query string, seq bigint, name string, website string, phone_number string, address string"


def matches(new, old, rules):
    def key(row, field):
        value = row[field] or ""
        return value.lower() if field == "website" else value.translate({ord(c): None for c in " -()"})

    if "website" in rules and key(new, "website") and key(new, "website") == key(old, "website"):
        return True
    if "phone" in rules and key(new, "phone_number") and key(new, "phone_number") == key(old, "phone_number"):
        return True
    if "similarity" in rules and new["name"] and old["name"] and new["address"] and old["address"]:
        def likeness(field):
            return SequenceMatcher(None, new[field].lower(), old[field].lower()).ratio()

        return likeness("name") > 0.8 and likeness("address") > 0.7
    return False


def sequential(rows, rules):
    kept = []
    for row in sorted(rows, key=lambda r: (r["query"], r["seq"])):
        if not any(k["query"] == row["query"] and matches(row, k, rules) for k in kept):
            kept.append(row)
    return {(r["query"], r["seq"]) for r in kept}


def table(spark, rows):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COLUMNS)


def row(seq, name="n", website=None, phone=None, address=None, query="q"):
    return {"query": query, "seq": seq, "name": name, "website": website, "phone_number": phone, "address": address}


def kept(df):
    return {(r["query"], r["seq"]) for r in df.collect()}


def test_single_rules(spark):
    rows = [
        row(1, website="http://A.org"), row(2, website="http://a.org"), row(3), row(4), row(5, website=""),
        row(6, website="", phone="(01) 2-3"), row(7, phone="0123"), row(8, website="http://a.org", query="r"),
    ]
    df = table(spark, rows)
    assert kept(dedupe_businesses(df, ("website",))) == {("q", n) for n in (1, 3, 4, 5, 6, 7)} | {("r", 8)}
    assert kept(dedupe_businesses(df, ("phone",))) == {("q", n) for n in (1, 2, 3, 4, 5, 6)} | {("r", 8)}


def test_chain_keeps_both_ends(spark):
    rows = [row(1, website="w1"), row(2, website="w1", phone="1"), row(3, phone="1")]
    assert kept(dedupe_businesses(table(spark, rows), ("website", "phone"))) == {("q", 1), ("q", 3)}


def random_rows(rng, n, names, addresses):
    return [
        row(
            seq,
            rng.choice(names),
            rng.choice([None, "", *(f"W{k}" for k in range(n // 3)), *(f"w{k}" for k in range(n // 3))]),
            rng.choice([None, "", *(f"({k}) 5-5" for k in range(n // 3)), *(f"{k}55" for k in range(n // 3))]),
            rng.choice(addresses),
            rng.choice("qr"),
        )
        for seq in range(n)
    ]


NAMES = ["acme tools", "acme tool", "acmetools", "zeta shop", "zeta shops", "Tide", "Diet", "", None, "abc", "x"]
ADDRESSES = ["1 main street", "1 main st", "99 oak avenue", "99 oak ave", "", None, "12 main street"]


@pytest.mark.parametrize("seed", range(2))
def test_keys_agree_with_the_loop(spark, seed):
    rows = random_rows(random.Random(seed), 60, NAMES, ADDRESSES)
    got = kept(dedupe_businesses(table(spark, rows), ("website", "phone")))
    assert got == sequential(rows, ("website", "phone"))


@pytest.mark.parametrize("seed, batch", [(10, 1_000), (11, 3)])
def test_all_rules_agree_with_the_loop(spark, seed, batch):
    rows = random_rows(random.Random(seed), 50, NAMES, ADDRESSES)
    got = kept(dedupe_businesses(table(spark, rows), first_batch=batch))
    assert got == sequential(rows, ("website", "phone", "similarity"))


def test_equal_rows_are_not_listed_pairwise(spark, monkeypatch):
    listed = []

    def counted(*args, **options):
        pairs = dedupe_pairs(*args, **options)
        listed.append(pairs.count())
        return pairs

    dedupe_pairs = dedupe_module.pairs_between
    monkeypatch.setattr(dedupe_module, "pairs_between", counted)
    rows = [row(n, "Acme Tools", phone=f"{n % 90}" if n % 2 else None, address="1 main street") for n in range(400)]
    rows += [row(400 + n, ("acme tool", "other")[n], address="1 main street") for n in range(2)]
    got = kept(dedupe_businesses(table(spark, rows), first_batch=50))
    assert got == sequential(rows, ("website", "phone", "similarity")) == {("q", 0), ("q", 401)}
    assert sum(listed) < 60


def test_hot_website_is_split(spark, monkeypatch):
    def hot(left, right, keys, how="left", **_):
        return lookup_join(left, right, keys, how, min_rows=0, share=1 / 10)

    monkeypatch.setattr(dedupe_module, "lookup_join", hot)
    rows = [row(n, website="hot" if n % 3 else f"w{n}", phone=f"{n // 2}") for n in range(60)]
    assert kept(dedupe_businesses(table(spark, rows), ("website", "phone"))) == sequential(
        rows, ("website", "phone")
    )


@pytest.mark.parametrize("cell_rows", [4_096, 2])
def test_similar_pairs_are_all_pairs(spark, cell_rows):
    rng = random.Random(5)

    def noisy(text):
        chars = list(text)
        for _ in range(rng.randint(0, 4)):
            chars[rng.randrange(len(chars))] = rng.choice(["", "x", "e", " "])
        return "".join(chars)

    rows = [
        row(
            n,
            noisy(rng.choice(["alpha shop", "beta store", "gamma"])),
            address=noisy(f"{rng.randint(1, 30)} main street"),
            query="qr"[n % 2],
        )
        for n in range(120)
    ]
    got = {(r["query"], r["later"], r["earlier"]) for r in similar_pairs(table(spark, rows), cell_rows=cell_rows).collect()}
    expected = {
        (a["query"], a["seq"], b["seq"])
        for a in rows
        for b in rows
        if a["query"] == b["query"] and b["seq"] < a["seq"] and matches(a, b, ("similarity",))
    }
    assert got == expected and len(expected) > 50


@pytest.mark.parametrize("cell_rows, kind", [(4_096, "bigint"), (3, "int"), (4_096, "string")])
def test_equal_rows_pair_up_like_all_others(spark, monkeypatch, cell_rows, kind):
    monkeypatch.setattr(join_module, "PAIRS_OUT", 7)
    rng = random.Random(7)
    seqs = [rng.choice([n, -n, 3, 70_000 * n]) if kind != "string" else f"{n:04}" for n in range(90)]
    rows = [
        row(seq, rng.choice(["Alpha Shop", "alpha shop", "alpha shp", "beta", None]),
            address=rng.choice(["1 main street", "1 MAIN street", "2 main stret", "far away", ""]), query="qr"[n % 2])
        for n, seq in enumerate(seqs)
    ]
    rows += [row(None, "alpha shop", address="1 main street"), row(seqs[0], "alpha shop", address="1 main street", query=None)]
    if kind == "bigint":
        rows += [row(seq, "alpha shop", address="1 main street") for seq in (2**63 - 1, -(2**63))]
    schema = COLUMNS.replace("seq bigint", "seq string" if kind == "string" else "seq bigint")
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in COLUMNS.split(", ")) for r in rows], schema)
    got = similar_pairs(df.withColumn("seq", df.seq.cast(kind)), cell_rows=cell_rows)
    expected = sorted(
        (a["query"], a["seq"], b["seq"])
        for a in rows for b in rows
        if a["query"] and a["query"] == b["query"] and None not in (a["seq"], b["seq"]) and b["seq"] < a["seq"]
        and matches(a, b, ("similarity",))
    )
    assert sorted(tuple(r) for r in got.collect()) == expected and len(expected) > 200
    assert [f.dataType.simpleString() for f in got.schema] == ["string", kind, kind]


def test_equal_rows_travel_as_one(spark, monkeypatch):
    stored = []

    def counted(df):
        stored.append(df.count())
        return cut(df)

    cut = join_module.cut
    monkeypatch.setattr(join_module, "cut", counted)
    rows = [row(n, ("acme tools", "acme tool")[n % 2], address="1 main street") for n in range(800)]
    assert similar_pairs(table(spark, rows)).count() == 800 * 799 // 2
    assert max(stored) < 40


@pytest.mark.parametrize("copies", [0, 40])
def test_different_rows_travel_alone(spark, monkeypatch, copies):
    stored = []

    def noted(df):
        stored.append(df.columns)
        return cut(df)

    cut = join_module.cut
    monkeypatch.setattr(join_module, "cut", noted)
    rows = [row(n, "acme tools", address=f"1{'ab'[n % 2] * (n // 2)} main street") for n in range(60)]
    rows += [row(100 + n, "acme tools", address="1 main street") for n in range(copies)]
    got = sorted(tuple(r) for r in similar_pairs(table(spark, rows), cell_rows=20).collect())
    assert got == sorted(("q", a["seq"], b["seq"]) for a in rows for b in rows if b["seq"] < a["seq"] and matches(a, b, ("similarity",)))
    assert any("gaps" in c for c in stored) == (copies > 0) and len(got) > 100


def test_packed_numbers_come_back():
    lists = [[5], [1, 1, 2], list(range(-3, 5000, 3)), [-(2**63), 0, 2**63 - 1], [0, 300]]
    packed = join_module.pack_gaps.func(pa.array([[0], *lists]).slice(1)).to_pylist()
    assert packed[0] is None
    assert [join_module.members(x[0], p).tolist() for x, p in zip(lists, packed)] == lists


def test_thresholds_are_strict_and_order_matters(spark):
    assert sim.ratio("tide", "diet") == 0.25 and sim.ratio("diet", "tide") == 0.5
    assert sim.ratio("", "x") == 0.0
    rows = [row(1, "abcde", address="a street"), row(2, "abcdx", address="a street")]  # exactly 0.8
    assert similar_pairs(table(spark, rows)).count() == 0
    with pytest.raises(ValueError):
        similar_pairs(table(spark, rows), name_threshold=0.5).count()


def grams_of(text, common):
    import pyarrow as pa

    return sim.rare_bigrams(common, 0.8).func(pa.array([text])).to_pylist()[0]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_bigram_filter_loses_nothing(data):
    base = data.draw(st.text("abcd 1é", min_size=1, max_size=24))
    other = list(base)
    for _ in range(data.draw(st.integers(0, 4))):
        place = data.draw(st.integers(0, len(other)))
        other[place : place + data.draw(st.integers(0, 1))] = data.draw(st.text("abcd", max_size=2))
    other = "".join(other)
    if sim.ratio(base, other) > 0.8:
        common = {"ab": 5, "bc": 4, "aa": 9}
        assert set(grams_of(base, common)) & set(grams_of(other, common))


def test_common_blocks_settle_alike_addresses_without_the_ratio():
    old = pa.array([f"{k % 50} economy street, block {k * 37 % 1000}" for k in range(500)])
    assert sim.surely_above(old, old.take(pa.array(range(499, -1, -1))), 0.7).all()
    rng = random.Random(3)
    pairs = [(None, "a"), ("", ""), ("a", None), ("é" * 9, "é" * 9), ("x" * 250, "x" * 250)]
    for _ in range(3000):
        new = "".join(rng.choice("abc é") for _ in range(rng.randint(0, 12)))
        pairs.append((new, new[: rng.randint(0, 12)] + rng.choice(("", "a", "bc")) + new[rng.randint(0, 12) :]))
    new, old = (pa.array(side, pa.string()) for side in zip(*pairs))
    for threshold in (0.5, 0.7, 0.8):
        sure = sim.surely_above(new, old, threshold)
        assert all(sim.ratio(*pairs[k]) > threshold for k in range(len(pairs)) if sure[k]) and sure.any()
        assert (sim.surely_above(new.slice(9), old.slice(9), threshold) == sure[9:]).all()
    assert sim.surely_above(new.slice(0, 0), old.slice(0, 0), 0.7).size == 0
