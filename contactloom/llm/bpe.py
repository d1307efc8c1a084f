"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

Leaf ``i`` of the tree holds the rank of the pair that starts at symbol ``i``, with ``i`` in the low
digits, so the root is the leftmost pair of lowest rank. A merge changes three leaves, each in
logarithmic time; the word is done when the root holds no rank.

The vocabulary file decides the rest: text between added tokens is composed (NFC) and lower-cased, cut
into pieces by the file's pattern, and each piece is mapped to byte symbols, the last with the
end-of-word mark. Neither step reaches across ASCII white space, and no added token contains any, so
the tokens of a text are those of its words, and each distinct word is encoded once per worker while
it stays in a bounded memory.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from contactloom.llm.word_cache import WordCache
from contactloom.llm.words import word_places, worker_store

#: A leaf is one integer: rank, then place in the piece, then merged symbol.
RANK_AT, PLACE_AT = 44, 20
PLACES, SYMBOLS, NONE = (1 << RANK_AT - PLACE_AT) - 1, (1 << PLACE_AT) - 1, 1 << 62
#: Pieces of up to so many symbols are merged side by side, in arrays of about so many leaves.
LOCKSTEP, TREE_CELLS = 64, 1 << 16
#: Words, and pieces, that a worker remembers in each of two generations: some 0.2 GB in all when full.
WORDS, PIECES = 200_000, 120_000
ENCODED = "doc_id long, n_tokens long, ids string, decoded string"


def pair_ranks(merges, ids: dict[str, int]) -> dict[tuple[int, int], int]:
    """A pair's rank in the high bits, the merged symbol in the low ones."""
    return {(ids[a], ids[b]): rank << RANK_AT | ids[a + b] for rank, (a, b) in enumerate(merges)}


def merge(symbols: list[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """Applies merges, lowest rank first and leftmost first among equals, until none is left."""
    n, rank = len(symbols), ranks.get
    if n < 2:
        return symbols
    if n >> (RANK_AT - PLACE_AT):
        raise ValueError("a piece has more symbols than a leaf can number")
    symbols, leaves = list(symbols), 1 << (n - 1).bit_length()
    tree, at = [NONE] * (2 * leaves), leaves
    for pair in zip(symbols, symbols[1:]):
        if (value := rank(pair)) is not None:
            tree[at] = value + ((at - leaves) << PLACE_AT)
        at += 1
    for at in range(leaves - 1, 0, -1):
        a, b = tree[2 * at], tree[2 * at + 1]
        tree[at] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != NONE:
        i, merged = root >> PLACE_AT & PLACES, root & SYMBOLS
        j, k = after[i], before[i]
        follower = after[i] = after[j]
        symbols[i], symbols[j] = merged, -1
        here = there = None
        if follower < n:
            before[follower] = i
            here = rank((merged, symbols[follower]))
        if k >= 0:
            there = rank((symbols[k], merged))
        for leaf, value in ((j, None), (i, here), (k, there)):
            value = NONE if value is None else value + (leaf << PLACE_AT)
            at = leaves + leaf
            if leaf < 0 or tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                low = a if a < b else b
                if tree[at] == low:
                    break
                tree[at] = low
    return [s for s in symbols if s >= 0]


class PairTable:
    """The ranks of pairs as sorted arrays, looked up for many pairs at once."""

    def __init__(self, ranks: dict[tuple[int, int], int]):
        keys = np.array([a << PLACE_AT | b for a, b in ranks], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(NONE))
        self.values = np.append(np.array(list(ranks.values()), np.int64)[order], np.int64(NONE))

    def leaves(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaves of the pairs ``a, b`` that start at ``place``; a symbol below 0 is in no pair."""
        wanted = a << PLACE_AT | b
        at = np.searchsorted(self.keys, wanted)
        found = (self.keys[at] == wanted) & (a >= 0) & (b >= 0)
        return np.where(found, self.values[at] + (place << PLACE_AT), NONE)


def merge_many(pieces: list[list[int]], ranks: dict[tuple[int, int], int], table: PairTable) -> list[list[int]]:
    """:func:`merge` for each of many pieces: trees of one size stand side by side and take a merge each at a time."""
    out, sizes = list(pieces), {}
    for k, piece in enumerate(pieces):
        if len(piece) > LOCKSTEP:
            out[k] = merge(piece, ranks)
        elif len(piece) > 1:
            sizes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(k)
    for leaves, members in sizes.items():
        step = max(1, TREE_CELLS // leaves)
        for at in range(0, len(members), step):
            some = members[at : at + step]
            for k, merged in zip(some, _merge_together([pieces[k] for k in some], leaves, table)):
                out[k] = merged
    return out


def _merge_together(pieces: list[list[int]], leaves: int, table: PairTable) -> Iterator[list[int]]:
    """Merges of pieces whose trees have ``leaves`` leaves; arrays are flat, a piece after the other."""
    count = len(pieces)
    n = np.fromiter(map(len, pieces), np.int64, count)
    place = np.tile(np.arange(leaves), (count, 1))
    symbols = np.full((count, leaves), -1, np.int64)
    symbols[place < n[:, None]] = np.fromiter((s for piece in pieces for s in piece), np.int64, int(n.sum()))
    follower = np.full((count, leaves), -1, np.int64)
    follower[:, :-1] = symbols[:, 1:]
    tree = np.full((count, 2 * leaves), NONE, np.int64)
    tree[:, leaves:] = table.leaves(symbols, follower, place)
    width = leaves
    while width > 1:
        width //= 2
        below = tree[:, 2 * width : 4 * width]
        tree[:, width : 2 * width] = np.minimum(below[:, ::2], below[:, 1::2])
    after, before = (place + 1).ravel(), (place - 1).ravel()
    symbols, tree, rows = symbols.ravel(), tree.ravel(), np.arange(count)
    while True:
        root = tree[rows * (2 * leaves) + 1]
        live = root != NONE
        rows, root = rows[live], root[live]
        if not len(rows):
            break
        base, trunk = rows * leaves, rows * (2 * leaves)
        i, merged = root >> PLACE_AT & PLACES, root & SYMBOLS
        j, k = after[base + i], before[base + i]
        behind = after[base + j]
        symbols[base + i], symbols[base + j], after[base + i] = merged, -1, behind
        more = behind < n[rows]
        before[(base + behind)[more]] = i[more]
        here = np.where(more, symbols[base + np.where(more, behind, 0)], -1)
        there = np.where(k >= 0, symbols[base + np.maximum(k, 0)], -1)
        tree[trunk + leaves + j] = NONE
        tree[trunk + leaves + i] = table.leaves(merged, here, i)
        first = k >= 0
        tree[(trunk + leaves + k)[first]] = table.leaves(there[first], merged[first], k[first])
        paths = [leaves + j, leaves + i, leaves + np.where(first, k, i)]
        for _ in range(leaves.bit_length() - 1):
            paths = [path >> 1 for path in paths]
            for path in paths:
                at = trunk + 2 * path
                tree[trunk + path] = np.minimum(tree[at], tree[at + 1])
    kept = symbols >= 0
    ends = np.cumsum(kept.reshape(count, leaves).sum(1)).tolist()
    flat, at = symbols[kept].tolist(), 0
    for to in ends:
        yield flat[at:to]
        at = to


def packed(word: tuple[int, str, str]) -> str:
    """Number of ids, ids and decoded text as one string: a third of the memory of a tuple of them."""
    return f"{word[1]}\t{word[2]}"


def unpacked(word: str) -> tuple[int, str, str]:
    ids, _, decoded = word.partition("\t")
    return ids.count(" ") + 1 if ids else 0, ids, decoded


class Vocabulary:
    """A byte-level BPE vocabulary with end-of-word marks, read from its public JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.ranks = pair_ranks(model["merges"], ids)
        self.pairs = PairTable(self.ranks)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.added_begin = regex.compile("|".join(regex.escape(c) for c in sorted({t[0] for t in added})))
        self.added_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        # Beyond ASCII, the library's own tables of letters and cases decide.
        tokenizer = Tokenizer.from_file(path)
        self.normal, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.ids = ids
        self.tokens = {v: k for k, v in (ids | added).items()}
        self.known_pieces = WordCache(self._encode_piece)
        #: What words and their pieces become, packed.
        self.known_words = WordCache(lambda word: packed(self._encode_word(word)), WORDS)
        self.spelled = WordCache(lambda piece: packed(self._spell(self.known_pieces[piece])), PIECES)

    def _symbols(self, piece: str) -> list[int]:
        ids = self.ids
        return [ids[x] for x in piece[:-1]] + [ids[piece[-1] + self.suffix]]

    def _encode_piece(self, piece: str) -> list[int]:
        return merge(self._symbols(piece), self.ranks)

    def _pieces(self, text: str) -> list[str]:
        if text.isascii() and text.isprintable():  # composing and byte symbols leave these as they are
            return self.pieces.findall(text.lower())
        return [x for x, _ in self.split(self.normal(text))]

    def _plain(self, text: str) -> list[int]:
        return [i for piece in self._pieces(text) for i in self.known_pieces[piece]]

    def _has_added(self, text: str) -> bool:
        return bool(self.added_begin.search(text) and self.added_pattern.search(text))

    def encode(self, text: str) -> list[int]:
        if not self._has_added(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.added_pattern.finditer(text):
            out += self._plain(text[at : found.start()])
            out.append(self.added[found[0]])
            at = found.end()
        return out + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """As the file's missing decoder has it: tokens joined by one space."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def _spell(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def _encode_word(self, word: bytes) -> tuple[int, str, str]:
        return self._spell(self.encode(word.decode()))

    def _learn_pieces(self, wanted: set[str], spelled: dict[str, str]) -> None:
        new = []
        for piece in wanted:
            value = self.spelled.get(piece) or self.spelled.old.get(piece)
            if value is None:
                new.append(piece)
            else:
                spelled[piece] = value
        for piece, ids in zip(new, merge_many([self._symbols(x) for x in new], self.ranks, self.pairs)):
            spelled[piece] = packed(self._spell(ids))
            self.spelled.put(piece, spelled[piece])

    def words(self, words: list[bytes]) -> list[tuple[int, str, str]]:
        """Number of ids, ids and decoded text of each word; the new ones are encoded together."""
        known = self.known_words
        found = [known.get(w) or known.old.get(w) for w in words]
        new = [k for k, value in enumerate(found) if value is None]
        texts = [words[k].decode() for k in new]
        cut = [None if self._has_added(text) else self._pieces(text) for text in texts]
        spelled = {}
        self._learn_pieces({piece for pieces in cut if pieces for piece in pieces}, spelled)
        for k, text, pieces in zip(new, texts, cut):
            if pieces is None:
                value = packed(self._spell(self.encode(text)))
            elif len(pieces) == 1:
                value = spelled[pieces[0]]
            else:
                parts = [unpacked(spelled[piece]) for piece in pieces]
                value = packed((sum(x[0] for x in parts), " ".join([x[1] for x in parts]), " ".join([x[2] for x in parts])))
            found[k] = value
        for w, value in zip(words, found):
            if w not in known:
                known.put(w, value)
        return [unpacked(value) for value in found]


def vocabulary(path: str) -> Vocabulary:
    store = worker_store("bpe")
    if path not in store:
        store[path] = Vocabulary(path)
    return store[path]


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every text: ids in decimal, joined by one space, and the
    text that the ids decode to.

    A null text is empty; empty texts have no token and decode to an empty text. Null and repeated
    ids are carried along, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The memory of words holds many tuples and no cycles: searching it for cycles costs a quarter of the time.
        gc.disable()
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                distinct, places, first = word_places(part.column(1))
                sizes, ids, decoded = zip(*known.words(distinct)) if distinct else ((), (), ())
                n = np.array(sizes, np.int64)[places]
                some = np.concatenate(([0], np.cumsum(n > 0)))[first]  # words without tokens leave no gap
                sums = np.concatenate(([0], np.cumsum(n)))[first]
                kept = pa.array(places[n > 0])

                def joined(words) -> pa.Array:
                    lists = pa.ListArray.from_arrays(pa.array(some, pa.int32()), pa.array(words, pa.large_string()).take(kept))
                    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())

                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(sums)), joined(ids), joined(decoded)],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
                pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)
