"""Bigrams of many documents in packed blocks: one row for each chunk of documents and partition.

A block holds the distinct (context, word) pairs that a chunk has for one partition, by context, and for each
pair the documents of its tokens. Words are Spark's ``xxhash64`` of their bytes. A pair goes to the partition of
its context; pairs of ``hot`` contexts are dealt out pair by pair, so that no partition gets all of one context.
Numbers are packed as byte planes under zstd.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.words import break_table, by_bytes, make_room, mix, term_places

BREAKS = break_table(r"\x20\x09-\x0D")
#: Tokens of a chunk; texts are cut in pieces of so many bytes.
CHUNK_TOKENS, PIECE_BYTES = 2_000_000, 4 << 20
#: Rows of a chunk are handed on in Arrow batches of about so many bytes.
BATCH_BYTES = 2 << 20
#: A context is hot beyond this share of the tokens, or an eighth of a partition's share if that is more.
HOT_SHARE = 1 / 4096
PLAIN_BYTES = 256
_U = np.uint64
P1, P2, P3, P4, P5 = (_U(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
))
SEED = _U(42)


# ----------------------------------------------------------------------------------- Spark's xxhash64


def _rotate(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << _U(bits)) | (x >> _U(64 - bits))


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * P2
    h = (h ^ (h >> _U(29))) * P3
    return h ^ (h >> _U(32))


def _eight(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _rotate(h ^ (_rotate(value * P2, 31) * P1), 27) * P1 + P4


def hash_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _finish(_eight(seed + P5 + _U(8), value))


def hash_int(value: int, seed: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _finish(_rotate((seed + P5 + _U(4)) ^ (_U(value) * P1), 23) * P2 + P3)


def _reader(data: np.ndarray, kind: str):
    """The numbers of type ``kind`` that start at every byte."""
    size = np.dtype(kind).itemsize
    return np.ndarray((max(0, len(data) - size + 1),), kind, buffer=data.data, strides=(1,))


def string_hashes(texts: pa.Array) -> np.ndarray:
    """``xxhash64`` of each string, as Spark has it."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.concatenate((np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8), np.zeros(8, np.uint8)))
    at, size = ends[:-1] - ends[0], np.diff(ends)
    longs, ints = _reader(data, "<u8"), _reader(data, "<u4")
    with np.errstate(over="ignore"):
        h = np.full(len(texts), SEED + P5)
        rows = np.flatnonzero(size >= 32)
        if len(rows):
            rows = rows[np.argsort(-size[rows], kind="stable")]  # those with stripes left are always the first ones
            stripes = size[rows] // 32
            v = [np.full(len(rows), x) for x in (SEED + P1 + P2, SEED + P2, SEED, SEED - P1)]
            for k in range(int(stripes[0])):
                n = int(np.searchsorted(-stripes, -k))
                for lane in range(4):
                    value = longs[at[rows[:n]] + 32 * k + 8 * lane]
                    v[lane][:n] = _rotate(v[lane][:n] + value * P2, 31) * P1
            full = _rotate(v[0], 1) + _rotate(v[1], 7) + _rotate(v[2], 12) + _rotate(v[3], 18)
            for lane in v:
                full = (full ^ (_rotate(lane * P2, 31) * P1)) * P1 + P4
            h[rows] = full
        h += size.astype(np.uint64)
        at, left = at + size // 32 * 32, size % 32
        for _ in range(3):
            rows = np.flatnonzero(left >= 8)
            h[rows] = _eight(h[rows], longs[at[rows]])
            at[rows] += 8
            left[rows] -= 8
        rows = np.flatnonzero(left >= 4)
        h[rows] = _rotate(h[rows] ^ (ints[at[rows]].astype(np.uint64) * P1), 23) * P2 + P3
        at[rows] += 4
        left[rows] -= 4
        for _ in range(3):
            rows = np.flatnonzero(left >= 1)
            h[rows] = _rotate(h[rows] ^ (data[at[rows]].astype(np.uint64) * P5), 11) * P1
            at[rows] += 1
            left[rows] -= 1
        return _finish(h)


#: Marks that no word can be: words never hold white space.
BEGIN, END = string_hashes(pa.array(["\t", "\n"]))


# ----------------------------------------------------------------------------------- packed numbers


def pack(*arrays) -> bytes:
    """Numbers that are never negative, or floats, in as few bytes as the largest takes."""
    head, body = [], []
    for array in arrays:
        array = np.ascontiguousarray(array)
        real = array.dtype.kind == "f"
        bits = array.astype(np.float64).view(np.uint64) if real else array.astype(np.uint64)
        width = 8 if real else (int(bits.max()).bit_length() + 7) // 8 if len(bits) else 0
        head.append((len(bits), width, real))
        body.append(bits.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    plain = b"".join(body)
    if len(plain) <= PLAIN_BYTES:
        return pickle.dumps((head, 0, plain), 5)
    return pickle.dumps((head, len(plain), pa.compress(plain, codec="zstd", asbytes=True)), 5)


def unpack(packed: bytes) -> list[np.ndarray]:
    head, size, body = pickle.loads(packed)
    body = np.frombuffer(pa.decompress(body, size, codec="zstd", asbytes=True) if size else body, np.uint8)
    out, at = [], 0
    for n, width, real in head:
        wide = next(x for x in (1, 2, 4, 8) if x >= width)
        bits = np.zeros((n, wide), np.uint8)
        bits[:, :width] = body[at : at + n * width].reshape(width, n).T
        out.append(bits.reshape(-1).view(np.float64 if real else f"<u{wide}"))
        at += n * width
    return out


# ----------------------------------------------------------------------------------- chunks of documents


@dataclass
class Chunk:
    """Tokens of some documents: places in ``words`` of each and of the one before it, and their documents."""

    ids: pa.Array
    train: np.ndarray
    words: np.ndarray
    before: np.ndarray
    token: np.ndarray
    doc: np.ndarray


def chunks(batches) -> Iterator[Chunk]:
    """``doc_id, train, text`` in chunks of about CHUNK_TOKENS tokens, always of whole documents."""
    pieces, size = [], 0
    for batch in batches:
        for rows in by_bytes(batch, 2, PIECE_BYTES):
            terms, places, first = term_places(rows.column(2), BREAKS)
            train = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
            pieces.append((rows.column(0), train, string_hashes(terms), places, first))
            size += len(places) + len(train)
            if size >= CHUNK_TOKENS:
                yield _chunk(pieces)
                pieces, size = [], 0
    if pieces:
        yield _chunk(pieces)


def _chunk(pieces: list[tuple]) -> Chunk:
    words, ids = np.unique(np.concatenate([[BEGIN, END], *(p[2] for p in pieces)]), return_inverse=True)
    ids = ids.astype(np.int32)
    sizes = np.concatenate([np.diff(p[4]) + 1 for p in pieces])
    last = np.cumsum(sizes) - 1
    is_end, is_begin = np.zeros((2, int(sizes.sum())), bool)
    is_end[last], is_begin[last - sizes + 1] = True, True
    token, before = (np.empty(len(is_end), np.int32) for _ in "tb")
    at, plain = 2, []
    for _, _, hashes, places, _ in pieces:
        plain.append(ids[at + places])
        at += len(hashes)
    plain = np.concatenate(plain)
    token[is_end], token[~is_end] = ids[1], plain
    before[is_begin], before[~is_begin] = ids[0], plain
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return Chunk(pa.concat_arrays([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]), words, before, token, doc)


def hot_contexts(docs: DataFrame, n_parts: int) -> np.ndarray:
    """Sorted hashes of all contexts with more than the hot share of the tokens, and at most 2 / share in all.

    A context with share s has half of it in chunks where its own share is s / 2 or more.
    """
    share = max(HOT_SHARE, 1 / (8 * n_parts))

    def count(batches):
        make_room()
        for chunk in chunks(batches):
            n = np.bincount(chunk.before, minlength=len(chunk.words))
            often = np.flatnonzero(n >= share / 2 * len(chunk.token))
            hashes = np.concatenate((chunk.words[often].view(np.int64), [0]))
            total = np.concatenate((np.zeros(len(often), bool), [True]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes), pa.array(total), pa.array(np.concatenate((n[often], [len(chunk.token)])))], ["h", "total", "n"]
            )

    found = docs.mapInArrow(count, "h long, total boolean, n long").groupBy("h", "total").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("total"), F.desc("n"), "h").limit(1 + int(2 / share)).collect()
    often = [r.h for r in rows[1:] if r.n >= share / 2 * rows[0].n]
    return np.sort(np.array(often, dtype=np.int64).view(np.uint64))


def places(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    return (hashes % _U(n_parts)).astype(np.int64)


def by_place(place: np.ndarray, n_parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each partition that occurs in ``place``, and where it does, in order."""
    order = np.argsort(place.astype(np.int16) if n_parts < 1 << 15 else place, kind="stable")
    ends = np.cumsum(np.bincount(place, minlength=n_parts))
    for p in np.flatnonzero(np.diff(ends, prepend=0)):
        yield int(p), order[ends[p - 1] if p else 0 : ends[p]]


def is_in(hashes: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted ``some``; -1 if it is not there."""
    if not len(some):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(some, hashes), len(some) - 1)
    return np.where(some[at] == hashes, at, -1)


def _sorted_tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``before, token, doc`` in this order."""
    wide, deep = (max(1, int(n).bit_length()) for n in (len(chunk.words), len(chunk.train)))
    if 2 * wide + deep > 63:
        order = np.lexsort((chunk.doc, chunk.token, chunk.before))
        return chunk.before[order], chunk.token[order], chunk.doc[order]
    key = chunk.before.astype(np.int64)
    key <<= wide
    key |= chunk.token
    key <<= deep
    key |= chunk.doc
    key.sort()
    before = (key >> (wide + deep)).astype(np.int32)
    doc = (key & ((1 << deep) - 1)).astype(np.int32)
    key >>= deep
    key &= (1 << wide) - 1
    return before, key.astype(np.int32), doc


def blocks_of(chunk: Chunk, n_parts: int, hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Partition and block: contexts, pairs of each; words, word of each pair; tokens of each pair, their
    documents; and which documents are learnt from."""
    before, token, doc = _sorted_tokens(chunk)
    new = np.concatenate(([True], (before[1:] != before[:-1]) | (token[1:] != token[:-1])))
    start = np.flatnonzero(new)
    many = np.diff(start, append=len(doc))
    before, token = before[start], token[start]
    place = places(chunk.words, n_parts)[before]
    split = np.flatnonzero((is_in(chunk.words, hot) >= 0)[before])
    with np.errstate(over="ignore"):
        pair = mix(chunk.words[before[split]] + _rotate(chunk.words[token[split]], 21))
    place[split] = places(pair, n_parts)
    train = np.packbits(chunk.train)
    for p, rows in by_place(place, n_parts):
        b, n = before[rows], many[rows]
        first = np.flatnonzero(np.diff(b, prepend=-1))
        w, w_at = np.unique(token[rows], return_inverse=True)
        ends = np.cumsum(n)
        docs = doc[np.repeat(start[rows] - (ends - n), n) + np.arange(ends[-1])]
        yield p, pack(chunk.words[b[first]], np.diff(first, append=len(b)), chunk.words[w], w_at, n, docs, train)


def document_blocks(docs: DataFrame, n_parts: int, hot: np.ndarray) -> DataFrame:
    """``to, kind, payload`` of ``doc_id, train, text``: the blocks, and a row ``docs`` for each chunk with its
    ids (Arrow) and tokens. Chunks are told apart by input partition and number."""

    def run(batches):
        make_room()
        split = TaskContext.get().partitionId()
        for number, chunk in enumerate(chunks(batches)):
            name = (split, number)
            ids = pa.BufferOutputStream()
            with pa.ipc.new_stream(ids, pa.schema([("doc_id", chunk.ids.type)])) as out:
                out.write(pa.RecordBatch.from_arrays([chunk.ids], ["doc_id"]))
            made = [((split * 31 + number) % n_parts, "docs", pickle.dumps((name, ids.getvalue().to_pybytes(), pack(np.bincount(chunk.doc)))))]
            for p, block in blocks_of(chunk, n_parts, hot):
                made.append((p, "block", pickle.dumps((name, len(chunk.train), block))))
                if sum(len(r[2]) for r in made[-64:]) > BATCH_BYTES or len(made) >= 64:
                    yield _batch(made)
                    made = []
            if made:
                yield _batch(made)

    return docs.mapInArrow(run, "to int, kind string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    to, kind, payload = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(kind), pa.array(payload, pa.binary())], ["to", "kind", "payload"])


# ----------------------------------------------------------------------------------- blocks of a partition


@dataclass
class Pairs:
    """The distinct pairs of a partition: sorted contexts and words, the places in them of each pair in order,
    training count of each pair; for each block its chunk, documents, and pair, tokens and documents as they are."""

    contexts: np.ndarray
    words: np.ndarray
    b: np.ndarray
    w: np.ndarray
    c: np.ndarray
    tokens: list[tuple]


def merged(blocks: list[bytes]) -> Pairs:
    parts = sorted(pickle.loads(x) for x in blocks)
    parts = [(name, n_docs, *unpack(block)) for name, n_docs, block in parts]
    none = [np.zeros(0, np.uint64)]
    contexts, b_at = np.unique(np.concatenate([p[2] for p in parts] or none), return_inverse=True)
    words, w_at = np.unique(np.concatenate([p[4] for p in parts] or none), return_inverse=True)
    keys, learnt, b_to, w_to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
    for _, n_docs, ctx, per, some, which, n, doc, train in parts:
        keys.append(np.repeat(b_at[b_to : b_to + len(ctx)] << 32, per) | w_at[w_to : w_to + len(some)][which])
        b_to, w_to = b_to + len(ctx), w_to + len(some)
        train = np.unpackbits(train, count=n_docs)
        starts = np.cumsum(n, dtype=np.int64) - n
        learnt.append(np.add.reduceat(train[doc], starts, dtype=np.int64))
    key, pair = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(pair, np.concatenate(learnt), len(key)).astype(np.int64)
    tokens, at = [], 0
    for name, n_docs, _, _, _, which, n, doc, _ in parts:
        tokens.append((name, n_docs, pair[at : at + len(which)], n, doc))
        at += len(which)
    return Pairs(contexts, words, key >> 32, key & 0xFFFFFFFF, c, tokens)
