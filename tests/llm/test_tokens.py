"""BPE and token files next to the public library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from contactloom.llm import queries
from contactloom.llm.bpe import Vocabulary, bpe_round_trip, merge
from contactloom.llm.token_files import Encoder, Packing, Reader, Writer, bits_for, pack, read_token_files, unpack, write_token_files
from contactloom.llm.word_cache import WordCache
from contactloom.llm.words import word_places
import pyarrow as pa

PATH = public_tokenizers.path(queries.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
OWN = Vocabulary(PATH)
ODD = [None, "", " \n", "it's <|endoftext|>THE é Σς \x01  x", "A" * 3000, "\U0001f600 ᅡᄀ"]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("'stTHEreand \n<|>#1")), max_size=40))
def test_words_encode_as_the_library(text):
    ids = [i for w in text.encode().split() for i in OWN.encode(w.decode())]
    assert ids == library_ids(text)
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_merge_is_lowest_rank_then_leftmost():
    rng = random.Random(3)
    for _ in range(300):
        ranks, new = {}, 10
        for rank in range(rng.randint(1, 20)):
            pair = (rng.randrange(new), rng.randrange(new))
            if pair not in ranks:
                ranks[pair] = rank << 44 | new
                new += 1
        word = [rng.randrange(10) for _ in range(rng.randint(0, 30))]
        plain = list(word)
        while found := [(ranks[p], i) for i, p in enumerate(zip(plain, plain[1:])) if p in ranks]:
            value, i = min(found)
            plain[i : i + 2] = [value & (1 << 20) - 1]
        assert merge(word, ranks) == plain


def test_bpe_query(spark, small, texts):
    for r in queries.op5_bpe_segment_tree(spark, small).collect():
        ids = library_ids(texts[r.doc_id])
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *digests)


def test_bpe_of_odd_texts(spark, docs):
    got = bpe_round_trip(docs(*enumerate(ODD), (0, None)), PATH).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        assert r.ids == " ".join(map(str, library_ids(ODD[r.doc_id])))


@pytest.mark.parametrize("bits", [1, 7, 8, 11, 16, 17, 24, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype("<u4")
    raw = pack(ids, bits)
    assert len(raw) == -(-1000 * bits // 8)
    assert unpack(raw, bits, 0, 1000).tolist() == ids.tolist()
    assert unpack(raw, bits, 333, 21).tolist() == ids[333:354].tolist()


def test_ids_must_fit():
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]
    with pytest.raises(ValueError):
        pack(np.array([8], "<u4"), 3)


@pytest.mark.parametrize("bits", [5, 16])
def test_file_gives_any_document(bits):
    rng = np.random.default_rng(2)
    documents = [rng.integers(0, 32, n).astype("<u4") for n in (0, 1, 99, 100, 101, 0, 1000)]
    sink = pa.BufferOutputStream()
    writer = Writer(sink, Packing(bits, block=100))
    for k, ids in enumerate(documents):
        writer.add(None if k == 1 else k, ids)
    assert writer.close() == sink.tell()
    reader = Reader(pa.BufferReader(sink.getvalue()))
    for k in (6, 2, 0, 4, 1, 3, 5):
        assert reader.document(k).tolist() == documents[k].tolist()
    assert reader.null.tolist() == [0, 1, 0, 0, 0, 0, 0]


def test_token_file_query(spark, small, texts):
    at = 0
    got = {r.doc_id: tuple(r)[1:] for r in queries.op3_packed_token_files(spark, small).collect()}
    for k in sorted(texts):
        ids = [*library_ids(texts[k]), 1]
        assert got[k] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_of_odd_and_no_texts(spark, docs, tmp_path):
    rows = [*enumerate(ODD), (None, "null id"), (2, "again")]
    made = read_token_files(write_token_files(docs(*rows), f"{tmp_path}/a", PATH, Packing(16), 1)).collect()
    assert sorted(len(r.ids) // 4 for r in made) == sorted(len(library_ids(t)) + 1 for _, t in rows)
    assert min(made, key=lambda r: r.start).doc_id is None
    none = docs((1, "x")).filter("doc_id < 0")
    assert read_token_files(write_token_files(none, f"{tmp_path}/b", PATH, Packing(16))).count() == 0


def test_word_cache_is_bounded():
    cache = WordCache(len, limit=10)
    for k in range(100):
        assert cache["x" * k] == k
    assert len(cache) + len(cache.old) <= 20


def test_words_of_a_column_are_looked_up_once_each():
    texts = pa.array(["x", "A b\u00a0c A", None, "", " \tB\x0b\x0ca  <|endoftext|>A \u00c9t\u00e9 \u00c9T\u00c9\x1c", "A"])[1:]
    words, places, first = word_places(texts)
    asked = []
    expected = [(t or "").encode().split() for t in texts.to_pylist()]
    for k, row in enumerate(expected):
        got = [words[p] for p in places[first[k] : first[k + 1]] if words[p]]
        assert got == [w.lower() if w.isascii() and b"<|" not in w else w for w in row]
    own = Encoder(PATH)
    ask, own._ask = own._ask, lambda ws: asked.extend(ws) or ask(ws)
    for _ in range(2):
        assert [list(x) for x in own.encode(texts)] == [library_ids(t) for t in texts.to_pylist()]
    assert len(asked) == len(set(asked)) and word_places(texts[:0])[0] == []


def test_round_trip_does_not_search_its_words_for_cycles():
    import gc

    import public_tokenizers

    from contactloom.llm.bpe import bpe_round_trip

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = bpe_round_trip(Rows(), public_tokenizers.path("word_bpe_49k.json"))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a <|endoftext|> b", None]})
    on = [gc.isenabled() for _ in run(iter([batch, batch]))]
    assert on == [False, False] and gc.isenabled()


def test_pieces_of_a_block_are_merged_together(monkeypatch):
    from contactloom.llm import bpe

    one_by_one = []
    monkeypatch.setattr(bpe, "merge", lambda symbols, ranks: one_by_one.append(symbols) or merge(symbols, ranks))
    words = ["", "a", "it's", "Straße.", "é,", "x" * 65, "ha-ha-ha", "$$$", "123.45", "Ä\u0301é!"]
    for _ in range(2):
        got = Vocabulary(PATH).words([w.encode() for w in words])
        expected = [library_ids(w) for w in words]
        assert got == [(len(x), " ".join(map(str, x)), LIBRARY.decode(x, skip_special_tokens=False)) for x in expected]
        words = [w + v for w in words for v in ("abc", "!", "nous", "9z")]
    assert one_by_one and all(len(x) > bpe.LOCKSTEP for x in one_by_one)
    assert Vocabulary(PATH).words([b"<|endoftext|>a", b"a"])[0][0] == len(library_ids("<|endoftext|>a"))


def test_merging_together_is_merging_one_by_one():
    from contactloom.llm.bpe import PairTable, merge_many

    rng = random.Random(5)
    for _ in range(40):
        ranks, new = {}, 6
        for rank in range(rng.randint(0, 25)):
            pair = (rng.randrange(new), rng.randrange(new))
            if pair not in ranks:
                ranks[pair] = rank << 44 | new
                new += 1
        pieces = [[rng.randrange(6) for _ in range(rng.randint(0, 70))] for _ in range(40)]
        assert merge_many(pieces, ranks, PairTable(ranks)) == [merge(x, ranks) for x in pieces]


def test_library_is_asked_once_for_a_stem_with_other_marks():
    own, asked = Encoder(PATH), []
    ask, own._ask = own._ask, lambda ws: asked.extend(ws) or ask(ws)
    words = ["word$$$", "word.###", "caf\u00e9,", "caf\u00e9", "12.", "\u0130,", "x\u00d7,", "it's.", "<|endoftext|>.", "?!", "e\u0301,", "\u4e2d."]
    texts = pa.array([" ".join(words), None, "\u0130, word$$$"])
    for _ in range(2):
        assert [list(x) for x in own.encode(texts)] == [library_ids(t) for t in texts.to_pylist()]
    assert len(asked) == len(set(asked)) and b"word" in asked and "caf\u00e9".encode() in asked
    assert not {b"word$$$", b"word.###", "caf\u00e9,".encode()} & set(asked)


def test_other_operators_get_the_memory_of_remembered_words():
    from contactloom.llm.bpe import vocabulary
    from contactloom.llm.token_files import encoder
    from contactloom.llm.words import make_room, worker_store

    first = vocabulary(PATH), encoder(PATH)
    assert (vocabulary(PATH), encoder(PATH)) == first
    make_room()
    assert not worker_store("bpe") and not worker_store("encoders")


def test_remembered_words_are_small():
    import tracemalloc

    own, n = Vocabulary(PATH), 20_000
    words = [f"{k:x}q{k * 7919:x}".translate(str.maketrans("0123456789", "ghijklmnop")).encode() for k in range(n)]
    own.words([b"q"])
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    got = own.words(words)
    first, last = got[0], got[-1]
    del got
    used = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert used < 450 * n  # a word and its piece
    assert [first, last] == own.words([words[0], words[-1]])
    assert 2 * (own.known_words.limit + own.spelled.limit) <= 640_000


def test_each_block_gives_back_the_memory_of_its_arrays(monkeypatch):
    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    class Pool:
        released = 0

        def release_unused(self):
            Pool.released += 1

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1025)), "text": ["a b"] * 1025})
    assert sum(x.num_rows for x in bpe_round_trip(Rows(), PATH)(iter([batch]))) == 1025
    assert Pool.released == 3
