"""Words of many texts at once: numpy over the byte buffers of Arrow batches.

A word is a run of characters other than space and U+0009 to U+000D. UTF-8 keeps those bytes to
themselves, so words are found on bytes. Hashes are 64 bits wide.
"""

from __future__ import annotations

import gc
import re
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are handled in blocks of about this many bytes, which bounds the memory of a task.
BLOCK_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C15
SEPARATORS = b" \t\n\v\f\r"


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def held_out(column: str, folds: int, fold: int):
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, over all its tasks."""
    holder = sys.modules.setdefault("_contactloom_store", types.ModuleType("_contactloom_store"))
    return holder.__dict__.setdefault(name, {})


#: Stores that grow with the words a worker has seen.
WORD_STORES = ("bpe", "encoders", "restorers")


def make_room() -> None:
    """Forgets the words that other operators left in this Python worker; for operators that need its memory."""
    kept = sys.modules.get("_contactloom_store", types.ModuleType("none")).__dict__
    if [kept.pop(name) for name in WORD_STORES if name in kept]:
        gc.collect()
    pa.default_memory_pool().release_unused()  # else it keeps what earlier batches took


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    if lower:
        values[65:91] = values[97:123]
    return values


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    store = worker_store("powers")
    if len(store.get("up", ())) < n:
        size = max(n, 2 * BLOCK_BYTES)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            store[name] = np.cumprod(steps, dtype=np.uint64)
    return store["up"], store["down"]


def prefix(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(sums: np.ndarray, first, last) -> np.ndarray:
    """Hash of the values at [first, last), from their prefix sums; equal spans have equal hashes."""
    _, down = powers(len(sums))
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


@dataclass
class Words:
    """Words of the texts ``rows`` of a batch: byte ranges, hashes, and each text's first word."""

    rows: range
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), self.counts)


def blocks(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    """Cuts a column of texts into blocks of whole texts; a null is an empty text."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    table, is_word = byte_table(lower), np.ones(256, dtype=bool)
    is_word[list(SEPARATORS)] = False
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_BYTES, side="right")) - 1)
        to = min(to, len(texts))
        bounds = ends[at : to + 1] - ends[at]
        yield _words(range(at, to), data[ends[at] : ends[to]], bounds, table, is_word)
        at = to


def _words(rows, data, bounds, table, is_word) -> Words:
    inside = is_word[data]
    opens, closes = inside.copy(), inside.copy()
    if len(data):
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = span_hash(prefix(table[data]), start, end)
    return Words(rows, data, bounds, start, end, np.searchsorted(start, bounds), hashes)


def word_places(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a column of texts, the place in them of each word of each text, in order,
    and each text's first word; a null is an empty text. There may be an empty word.

    For tokenizers that lower-case text: ASCII words are, except around a possible added token, and may
    stand there more than once.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    words = coded.dictionary
    plain = pc.and_not(pc.equal(pc.utf8_length(words), pc.binary_length(words)), pc.match_substring(words, "<|"))
    words = pc.if_else(plain, pc.ascii_lower(words), words).cast(pa.large_binary())
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(b" ", words.type))
    return joined[0].as_py().split(b" ") if len(words) else [], coded.indices.to_numpy(), first


def break_table(breaks: str) -> bytes:
    """For ``bytes.translate``: a space for each ASCII character of the class ``breaks``, a-z for A-Z."""
    is_break = re.compile(f"[{breaks}]").match
    return bytes(32 if is_break(chr(i)) else ord(chr(i).lower()) for i in range(128)) + bytes(range(128, 256))


def term_places(texts: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of a column of texts (cut and lower-cased by a ``break_table``), the place in
    them of each term of each text, in order, and each text's first term; a null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = raw.slice(ends[0], ends[-1] - ends[0]).to_pybytes().translate(table) if raw is not None else b""
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(data)])
    lists = pc.ascii_split_whitespace(plain)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    every = lists.flatten()
    full = pc.greater(pc.binary_length(every), 0)  # there are empty ones at the ends of a text
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
    first = before[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]
    coded = every.filter(full).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), first


def by_bytes(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose texts have about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, to - at)
        at, before = to, int(ends[to - 1])


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` consecutive words, at every word that has so many from itself on."""
    first = np.arange(max(0, len(hashes) - length + 1))
    return span_hash(prefix(hashes), first, first + length)
