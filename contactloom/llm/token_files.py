"""Token ids as binary files of fixed-width packed integers.

File layout, little-endian: packed blocks; then the documents' ids (int64, with a byte each for null),
their first positions (uint64, one more than documents), the blocks' byte offsets (uint64); then a
footer of eight uint64: magic, bits per id, ids per block, ids, documents, blocks, offset of the
index, 0. Every block starts on a byte, so any id or document can be read by itself, and a block is
unpacked by one vectorised shift and mask.

Each task writes one file under a name of its own and reports it; the manifest lists the reported
files only, so a lost or repeated task leaves nothing in the result.
"""

from __future__ import annotations

import gc
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactloom.llm.word_cache import WordCache
from contactloom.llm.words import word_places, worker_store

MAGIC = 0x31534449_4E454B54
FOOTER = 8
MARKS = b".,;:!?#*$%&"
ENDS = frozenset(bytes([c]) for c in MARKS)
MANIFEST = "part int, file string, n_ids long, n_docs long, bytes long"
READ = "doc_id long, start long, ids binary"


@dataclass(frozen=True)
class Packing:
    bits: int
    block: int = 8192

    def __post_init__(self):
        if not 1 <= self.bits <= 32:
            raise ValueError("ids have 1 to 32 bits")


def bits_for(vocabulary_size: int) -> int:
    """Bits that hold every id below ``vocabulary_size``."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    places = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(places.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count, first * bits // 8).astype("<u4")
    padded = np.frombuffer(raw + bytes(8), dtype=np.uint8)
    at = np.arange(first, first + count, dtype=np.int64) * bits
    wide = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))[at >> 3]
    return ((wide >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


class Writer:
    """Writes one file; holds a block of ids and the index of its documents."""

    def __init__(self, stream, packing: Packing):
        self.stream, self.packing = stream, packing
        self.waiting, self.held, self.at, self.ids = [], 0, 0, 0
        self.docs, self.null, self.starts, self.offsets = [], [], [0], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.ids += len(ids)
        self.starts.append(self.ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.packing.block:
            self._flush(self.held // self.packing.block * self.packing.block)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        for a in range(0, upto, self.packing.block):
            raw = pack(ids[a : min(upto, a + self.packing.block)], self.packing.bits)
            self.offsets.append(self.at)
            self.stream.write(raw)
            self.at += len(raw)
        self.waiting, self.held = [ids[upto:]], len(ids) - upto

    def close(self) -> int:
        self._flush(self.held)
        index = [
            np.array(self.docs, "<i8").tobytes(), np.array(self.null, "<u1").tobytes(),
            np.array(self.starts, "<u8").tobytes(), np.array(self.offsets, "<u8").tobytes(),
        ]
        p = self.packing
        footer = np.array([MAGIC, p.bits, p.block, self.ids, len(self.docs), len(self.offsets), self.at, 0], "<u8")
        for raw in (*index, footer.tobytes()):
            self.stream.write(raw)
        return self.at + sum(map(len, index)) + 8 * FOOTER


class Reader:
    """Random access to a file: opens its index, then reads the blocks that a document needs."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        footer = np.frombuffer(self._at(size - 8 * FOOTER, 8 * FOOTER), "<u8")
        if int(footer[0]) != MAGIC:
            raise ValueError("not a token file")
        _, self.bits, self.block, self.n_ids, n, blocks, index, _ = map(int, footer)
        raw = self._at(index, size - 8 * FOOTER - index)
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.null = np.frombuffer(raw, "<u1", n, 8 * n)
        self.starts = np.frombuffer(raw, "<u8", n + 1, 9 * n).astype(np.int64)
        self.offsets = np.append(np.frombuffer(raw, "<u8", blocks, 17 * n + 8), np.uint64(index)).astype(np.int64)
        self.kept = (None, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _block(self, b: int) -> bytes:
        if self.kept[0] != b:
            self.kept = b, self._at(self.offsets[b], self.offsets[b + 1] - self.offsets[b])
        return self.kept[1]

    def ids(self, first: int, last: int) -> np.ndarray:
        parts = []
        for b in range(first // self.block, -(-last // self.block) if last > first else 0):
            a, z = max(first, b * self.block), min(last, (b + 1) * self.block)
            parts.append(unpack(self._block(b), self.bits, a - b * self.block, z - a))
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def ending(word: bytes) -> int:
    """Where the marks at the end of a word begin, if a plain letter or digit is before them, else 0.

    Plain are those of ASCII and the letters U+00C0 to U+00FF: normalising leaves them letters and digits.
    """
    stem = word.rstrip(MARKS)
    if stem[-1:].isalnum() or (stem[-2:-1] == b"\xc3" and stem[-1] not in b"\x97\xb7"):
        return len(stem)
    return 0


class Encoder:
    """The library's tokenizer, asked once for each distinct word that is not remembered.

    For vocabularies that drop white space: normalising, splitting and added tokens then stay within
    ASCII white space, so a text's ids are those of its words in order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = WordCache(lambda word: self._ask([word])[0], limit=500_000)

    def _ask(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _lookup(self, words: set[bytes]) -> dict[bytes, bytes]:
        known, old, found = self.known, self.known.old, {}
        for word in words:
            if word in known:
                found[word] = known[word]
            elif word in old:
                found[word] = old[word]
                known.put(word, old[word])
        new = [w for w in words if w not in found]
        for word, ids in zip(new, self._ask(new) if new else ()):
            found[word] = ids
            known.put(word, ids)
        return found

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Ids of words that are not remembered."""
        # A letter or digit and the marks behind it are separate pieces, so the library is asked for each part once.
        cuts = [ending(w) if w[-1:] in ENDS else 0 for w in new]
        parts = self._lookup({part for w, at in zip(new, cuts) for part in ((w[:at], w[at:]) if at else (w,))})
        out = [parts[w[:at]] + parts[w[at:]] if at else parts[w] for w, at in zip(new, cuts)]
        for w, at, ids in zip(new, cuts, out):
            if at:
                self.known.put(w, ids)
        return out

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; every distinct word of the column is looked up once."""
        words, places, first = word_places(texts)
        found = list(map(self.known.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            for k, ids in zip(new, self._learn([words[k] for k in new])):
                found[k] = ids
        starts = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4, out=starts[1:])
        lists = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(found), "<u4"))).take(pa.array(places))
        ids, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy()[first]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[a:b]


def encoder(path: str) -> Encoder:
    store = worker_store("encoders")
    if path not in store:
        store[path] = Encoder(path)
    return store[path]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, packing: Packing, end_id: int | None = None
) -> DataFrame:
    """Encodes every text, appends ``end_id``, and writes files in ascending id order.

    ``folder`` is a path or address that all executors reach. Returns the manifest, which is also
    written there: ``part, file, n_ids, n_docs, bytes``, files in order of ``part``. A null text is
    empty, a null id comes first, rows with one id are ordered by text. An empty table gives no file.
    """

    folder = re.sub("^file:/(?!/)", "file:///", folder)  # as Spark prints local addresses

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Words and ids hold no cycles: searching them for cycles costs an eighth of the time.
        gc.disable()
        try:
            yield from written(batches)
        finally:
            gc.enable()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        store, path = fs.FileSystem.from_uri(name)
        known, end = encoder(tokenizer), np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                if writer is None:
                    store.create_dir(os.path.dirname(path), recursive=True)
                    stream = store.open_output_stream(path)
                    writer = Writer(stream, packing)
                for doc_id, ids in zip(rows.column(0).to_pylist(), known.encode(rows.column(1))):
                    writer.add(doc_id, np.concatenate((ids, end)))
        if writer is not None:
            size = writer.close()
            stream.close()
            row = (part, name, writer.ids, len(writer.docs), size)
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "file", "n_ids", "n_docs", "bytes"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.mode("error").parquet(f"{folder}/manifest")
    return read_manifest(docs.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document: ``start`` counts the ids of all documents before it,
    ``ids`` are little-endian 32-bit integers. One file is one unit of work."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_file(path) as file:
                    reader = Reader(file)
                    for at in range(0, len(reader.doc_ids), 512):
                        span = range(at, min(at + 512, len(reader.doc_ids)))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([None if reader.null[k] else int(reader.doc_ids[k]) for k in span], pa.int64()),
                                pa.array([offset + int(reader.starts[k]) for k in span], pa.int64()),
                                pa.array([reader.document(k).tobytes() for k in span], pa.binary()),
                            ],
                            names=["doc_id", "start", "ids"],
                        )

    return placed.repartition(max(1, manifest.count())).mapInArrow(run, READ)
