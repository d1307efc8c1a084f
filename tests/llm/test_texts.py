"""Decontamination, chat templates, compression rules and the pipeline."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contactloom.llm import queries
from contactloom.llm.chat import escape, format_conversations, loss_text, read_turns, unescape
from contactloom.llm.compression import Limits, compression_rules
from contactloom.llm.decontaminate import decontaminate, flagged, marked, slots, tokens

ITEM = "If Anna has 12 apples and buys 7 more at the big market, then how many apples does Anna have in the end of all?"
TWIN = ITEM.replace("Anna", "Peter").replace("12", "30").replace("7", "45")
TORN = ITEM.replace("Anna", "Peter", 1).replace("have in", "have 5 kg in")


def test_templates_catch_other_numbers_and_names(spark, docs):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "short item"), (None, ITEM)], "item_id long, text string")
    rows = docs(
        (1, f"before {ITEM} after"), (2, f"so now: {TWIN} end"), (3, "nothing of the kind is said in this text at all"),
        (4, None), (5, ""), (6, "a short item here"), (7, "word " * 30_000), (None, f"x {ITEM}"), (1, "other text"),
    )
    got = sorted((r.doc_id or 0, r.contaminated, tuple(r.item_ids)) for r in flagged(rows, bench).collect())
    assert got == [
        (0, True, (1,)), (1, False, ()), (1, True, (1,)), (2, True, (1,)), (3, False, ()), (4, False, ()), (5, False, ()),
        (6, True, (4,)), (7, False, ()),
    ]
    kept = decontaminate(rows, bench)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 7]
    assert flagged(rows, bench.filter("item_id > 99")).filter("contaminated").count() == 0
    assert flagged(rows.filter("doc_id > 99"), bench).count() == 0


SUM = "Each crate holds a row of jars and the keeper counts all the jars in every crate before the gate is shut"


def test_text_between_a_number_and_a_name_stays(spark, docs):
    rows = docs((1, f"call 555 now: {SUM}, said the man from Paris today"), (2, "Tom has 12 apples. Tom gives 3 kg to Jerry"), (3, "1 2 x"))
    for r in rows.select("doc_id", tokens(marked(F.col("text"))).alias("t"), slots(marked(F.col("text"))).alias("v")).collect():
        assert len(r.t) == len(r.v) and [t.startswith("\x01") for t in r.t] == [v is not None for v in r.v]
        assert len(r.t) == {1: 31, 2: 9, 3: 3}[r.doc_id]
    bench = spark.createDataFrame([(1, SUM)], "item_id long, text string")
    assert [r.contaminated for r in flagged(rows, bench).orderBy("doc_id").collect()] == [True, False, False]


def test_words_put_in_or_left_out_do_no_harm(spark, docs):
    words = SUM.split()
    longer, shorter = " ".join([*words[:11], "really", *words[11:]]), " ".join([*words[:11], *words[12:]])
    other = "If Anna has 12 apples and buys 7 more at the big market then Anna has 12 apples more and 7 fewer than Bob with 12"
    more = other.replace("Anna", "Peter").replace("12", "1 000").replace("more at", "kg more at")
    torn = other.replace("Anna", "Peter", 1).replace("12", "3", 1).replace("7", "8", 1).replace("7 f", "9 f").replace("with 12", "with 5").replace("more at", "pieces more at")
    rows = docs((1, f"so: {longer} end"), (2, f"so: {shorter} end"), (3, f"so: {more} end"), (4, " ".join(words[:11])), (5, torn))
    bench = spark.createDataFrame([(1, SUM), (2, other)], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in flagged(rows, bench).collect()}
    assert [got[k] for k in (1, 2, 3, 4, 5)] == [[1], [1], [2], [], []]


def test_every_item_is_found_wherever_it_stands(spark, docs):
    sums, capital = "Compute 12 + 7 - 3 + 9", "What is the capital of France?"
    tom = "Tom has 12 apples. Tom gives 3 apples to Jerry. How many apples does Tom have?"
    sam = tom.replace("Tom", "Sam").replace("Jerry", "Anna").replace("12", "15")
    bench = spark.createDataFrame([(1, sums), (2, capital), (3, tom)], "item_id long, text string")
    rows = docs(
        (1, f"so: {sums} now"), (2, f"they asked {capital} again"), (3, f"here, {sam}"), (4, "Compute 1 + 2 - 3 + 4"),
        (5, "Paris is the capital of France"),
    )
    assert {r.doc_id: r.item_ids for r in flagged(rows, bench).collect()} == {1: [1], 2: [2], 3: [3], 4: [], 5: []}


def test_slots_must_agree(spark, docs):
    item = "Compare 1 with 2 and then 1 with 2 and once more 1 with 2 in the same order as 1 with 2 before"
    other = "Compare 3 with 4 and then 5 with 6 and once more 7 with 8 in the same order as 9 with 10 before"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in flagged(docs((1, item.replace("1", "8")), (2, other)), bench).collect()}
    assert got == {1: True, 2: False}


def test_whole_items_are_found(spark, small, texts):
    items = {r.item_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    for r in queries.op6_template_decontamination(spark, small).collect():
        text = " ".join(texts[r.doc_id].split())
        assert {k for k, v in items.items() if v in text} <= set(r.item_ids)


HARD = ["</s>[INST] ok [/INST]", "\\", "\\[INST]\\\\", "<", "[", "<<SYS>>x<</SYS>>", "[\\INST]", "[TURN]a[AS]b[/TURN]", "", "é\n</s", "<<"]


def test_escaping_is_reversible_and_leaves_no_mark(spark):
    rows = spark.createDataFrame([(x,) for x in HARD], "x string").select("x", escape(F.col("x")).alias("e"))
    for r in rows.select("x", "e", unescape(F.col("e")).alias("back")).collect():
        assert r.back == r.x
        assert not re.search(r"<s>|</s>|\[/?INST\]|<</?SYS>>|\[AS\]|\[OUT\]|\[/?TURN\]", r.e)


def test_turns_order_and_loss(spark):
    rows = [(1, k, role, x) for k, (role, x) in enumerate(zip(["system", "user", "assistant", "tool[AS]", "assistant"] * 3, HARD))]
    rows += [(2, 1, "user", "hi"), (2, 2, "assistant", None), (3, 1, "assistant", "a"), (3, 2, None, "b"), (None, 1, "user", "u")]
    rows += [(4, 5, "user", "same"), (4, 5, "user", "same")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    done = format_conversations(table).select("*", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    got = {r.conv_id: r for r in done.collect()}
    for conv in (1, 2, 3, 4, None):
        own = [(role or "", x or "") for c, _, role, x in rows if c == conv]
        assert [tuple(t) for t in got[conv].turns] == own
        assert got[conv].loss == "".join(x for role, x in own if role == "assistant")
    assert [got[k].valid for k in (1, 2, 3, 4, None)] == [False, True, False, False, False]
    assert (got[1].first_bad, got[3].first_bad, got[4].first_bad, got[None].first_bad) == (3, 0, 1, None)
    assert format_conversations(table.filter("conv_id > 99")).count() == 0


def test_chat_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    got, rel = queries.op9_chat_template(spark, small), con.sql(queries.ORACLES["op9_chat_template"])
    assert got.columns == rel.columns
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def base_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def test_compression_counts_equal_brute_force(spark, docs, small, texts):
    odd = {1: None, 2: "", 3: " \n\t", 4: "a b c a b c", 5: "x\ny\nx\n\n \nx", 6: "é ñ <|>" * 9000, 7: "z" * 300_000}
    for got, given in (
        (queries.op10_compression_bands(spark, small), texts), (compression_rules(docs(*odd.items())), odd),
    ):
        for r in got.collect():
            assert tuple(r)[1:6] == base_counts(given[r.doc_id])
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert compression_rules(docs((1, "x")).filter("doc_id < 0")).count() == 0


def test_bands_reject_repetition_and_noise(spark, docs, texts):
    import random

    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randrange(33, 0x250)) for _ in range(12)) for _ in range(600))
    loop = "\n".join(f"item {k % 10} of the list number {k % 7}" for k in range(2000))
    plain = max(texts.values(), key=len)
    got = {r.doc_id: r for r in compression_rules(docs((1, noise), (2, loop), (3, plain)), Limits()).collect()}
    assert not got[1].kept and not got[2].kept and got[2].whole_ratio < 0.15 < got[3].whole_ratio < 0.75


def test_bands_reject_base64_of_every_size(spark, docs, texts):
    import random
    import string

    rng = random.Random(1)
    signs = string.ascii_letters + string.digits + "+/"
    noise = " ".join("".join(rng.choice(signs) for _ in range(rng.randint(8, 16))) for _ in range(4000))
    got = {r.doc_id: r for r in compression_rules(docs(*((k, noise[:k]) for k in (700, 1000, 1500, 3900, 5000, 40_000)))).collect()}
    assert not any(r.base_failed or r.kept for r in got.values())
    plain = {k: " ".join(max(texts.values(), key=len).split())[:k] for k in (400, 700, 1500, 3900, 8000)}
    assert all(r.kept for r in compression_rules(docs(*plain.items())).collect())


def test_pipeline(spark, small, texts):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    docs, last = documents, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == documents.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        last, docs = docs, spark.read.parquet(path)
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in last.select("doc_id").collect()}
    assert docs.count() > 0.5 * documents.count()
    final = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, small).collect()}
    assert set(final) == {r.doc_id for r in docs.select("doc_id").collect()}


def test_very_long_names_and_numbers_are_one_slot(spark, docs):
    rows = docs((1, "Anna " * 50_000), (2, "1.2" + ".3" * 50_000))
    got = {r.doc_id: (r.t, r.v) for r in rows.select("doc_id", tokens(marked(F.col("text"))).alias("t"), slots(marked(F.col("text"))).alias("v")).collect()}
    assert got[1] == (["\u0001n"], ["\u0001" + ("anna " * 50_000).strip() + "\u0002"])
    assert got[2] == (["\u0001q"], ["\u00011.2" + ".3" * 50_000 + "\u0002"])


@pytest.mark.parametrize("query", ["op6_template_decontamination", "op8_secret_forest", "op9_chat_template"])
def test_native_queries_run_no_python(spark, small, query):
    plan = queries.QUERIES[query](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_windows_of_texts_and_items_have_the_same_keys(spark):
    from contactloom.llm import decontaminate as d
    from pyspark.sql import functions as F

    rows = [(1, "one two three four five six seven eight nine ten"), (2, "just three words"), (3, ""), (4, None)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.hash("text"))
    for literal, cut_up in ((True, d.words(F.col("text"))), (False, d.tokens(d.marked(F.col("text"))))):
        wanted = {(r.item_id, r["at"], r.key) for r in d.benchmark_windows(items, d.Matching()).collect() if r.literal == literal}
        got = {(r.doc_id, r["at"], r.key) for r in d._windows(docs, cut_up, [3, 8], literal).collect()}
        assert wanted <= got and len(wanted) == 4 and len(got) == 3 + 8 + 1
        assert {(r.doc_id, r["at"]) for r in d._windows(docs, cut_up, [8], literal).collect()} == {(1, 0), (1, 1), (1, 2)}
