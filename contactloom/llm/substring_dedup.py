"""Removal of word windows that occur more than once, by super-k-mer partitioning.

Every window of ``window`` words has a minimiser: the leftmost smallest hash of its ``seed``-word
pieces. Consecutive windows with the same minimiser form a super-k-mer, a stretch of words. Equal
windows have equal minimisers, so they can only meet in the minimiser's bucket:

1. Tables of minimisers and super-k-mer fingerprints (no text) are counted with map-side sums. Equal
   super-k-mers collapse to one with a count: with two or more, all their windows repeat. A bucket
   with one distinct super-k-mer has no other repeats, so its text never travels.
2. In buckets with several distinct super-k-mers, one packed string per distinct super-k-mer goes to
   the bucket, where its windows are sorted and counted.
3. A bucket with more than ``hot`` distinct super-k-mers is split further: its windows are counted by
   128-bit window hash, summed on the map side first. Every bucket is handled whole.

Super-k-mers count as equal when their 64-bit fingerprint and their 64-bit minimiser agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.words import blocks, mix, prefix, span_hash, window_hashes
from contactloom.operators.shared import cut

#: A super-k-mer's place in one long: first word, number of windows, low bits of its text's hash.
WINDOW_BITS, TAG_BITS = 6, 20
PIECES = "doc_id long, place long, minimiser long, print long"


@dataclass(frozen=True)
class Repeats:
    window: int = 35
    seed: int = 8
    hot: int = 5000

    def __post_init__(self):
        if not 1 <= self.window - self.seed + 1 <= 60 or self.seed < 1:
            raise ValueError("a super-k-mer must have 1 to 60 windows")


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of ``width`` values, at every start."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        span += step
    return at


def super_kmers(words, size: Repeats):
    """Text, first word, number of windows and minimiser of each super-k-mer, and its fingerprint."""
    text_of, n = words.text_of, len(words.start)
    none = np.zeros(0, dtype=np.int64)
    if n < size.window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    seeds = window_hashes(words.hashes, size.seed)
    best = leftmost_minimum(seeds, size.window - size.seed + 1)
    whole = np.flatnonzero(text_of[: n - size.window + 1] == text_of[size.window - 1 :])
    if not len(whole):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = best[whole]
    opens = np.ones(len(whole), dtype=bool)
    opens[1:] = (at[1:] != at[:-1]) | (np.diff(whole) != 1)
    lead = np.flatnonzero(opens)
    first, runs = whole[lead], np.diff(np.append(lead, len(whole)))
    prints = span_hash(prefix(words.hashes), first, first + runs + size.window - 1)
    return text_of[first], first - words.first[text_of[first]], runs, seeds[at[lead]], prints


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _pieces(docs: DataFrame, size: Repeats) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            for words in blocks(batch.column(2)):
                text, first, runs, minimiser, prints = super_kmers(words, size)
                rows = text + words.rows.start
                place = (first << (WINDOW_BITS + TAG_BITS)) | (runs << TAG_BITS) | tags[rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(place), _longs(minimiser), _longs(prints)],
                    names=["doc_id", "place", "minimiser", "print"],
                )

    return docs.select("doc_id", "tag", "text").mapInArrow(run, PIECES)


def _split(place: int) -> tuple[int, int]:
    return place >> (WINDOW_BITS + TAG_BITS), place >> TAG_BITS & (1 << WINDOW_BITS) - 1


def _with_text(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """Documents that hold some of the super-k-mers, with an array of them."""
    per_text = pieces.select(
        F.col("doc_id").alias("_id"), _tag_of("place").alias("_tag"), F.struct("place", "minimiser", "print", "copies").alias("p")
    ).groupBy("_id", "_tag").agg(F.collect_list("p").alias("pieces"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
    # A row that is there twice holds each super-k-mer twice, which its count says already.
    return docs.join(per_text, same).select("doc_id", "tag", "text", "pieces")


def _tag_of(place: str):
    return F.col(place).bitwiseAND((1 << TAG_BITS) - 1)


def _packed(found: DataFrame, size: Repeats) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode().split()
                for p in pieces:
                    first, runs = _split(p["place"])
                    packed = b" ".join(words[first : first + runs + size.window - 1])
                    rows.append((doc_id, p["place"], p["minimiser"], p["print"], p["copies"], packed))
                if len(rows) >= 20_000:
                    yield _rows(rows, PACKED)
                    rows = []
            yield _rows(rows, PACKED)

    return found.select("doc_id", "text", "pieces").mapInArrow(run, PACKED)


PACKED = "doc_id long, place long, minimiser long, print long, copies long, words binary"
MASKS = "doc_id long, place long, mask long"
WINDOWS = "doc_id long, place long, copies long, nth int, one long, two long"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds)], names=list(names))


def _bucket(members: list[tuple], window: int) -> Iterator[tuple]:
    """Sorts the windows of a bucket's distinct super-k-mers and counts equal neighbours."""
    windows = []
    for k, (*_, packed) in enumerate(members):
        edges = [-1, *(i for i, x in enumerate(packed) if x == 32), len(packed)]
        windows += ((packed[edges[i] + 1 : edges[i + window]], k, i) for i in range(len(edges) - window))
    windows.sort()
    masks = [0] * len(members)
    for _, same in groupby(windows, key=lambda x: x[0]):
        same = list(same)
        if len(same) > 1:
            for _, k, i in same:
                masks[k] |= 1 << i
    for (doc_id, place, copies, _), mask in zip(members, masks):
        if mask and copies == 1:
            yield doc_id, place, mask


def _sorted_buckets(packed: DataFrame, size: Repeats) -> DataFrame:
    def run(batches):
        bucket, members, out = None, [], []
        for batch in batches:
            ids, places, buckets, copies, words = (batch.column(k).to_pylist() for k in range(5))
            for doc_id, place, minimiser, n, packed in zip(ids, places, buckets, copies, words):
                if minimiser != bucket:
                    out += _bucket(members, size.window)
                    bucket, members = minimiser, []
                members.append((doc_id, place, n, packed))
            yield _rows(out, MASKS)
            out = []
        yield _rows(list(_bucket(members, size.window)), MASKS)

    dealt = packed.repartition("minimiser").sortWithinPartitions("minimiser")
    return dealt.select("doc_id", "place", "minimiser", "copies", "words").mapInArrow(run, MASKS)


def _hot_windows(found: DataFrame, size: Repeats) -> DataFrame:
    """Masks of hot buckets: every window by its hash, counted with map-side sums."""

    def run(batches):
        for batch in batches:
            pieces = batch.column(2).to_pylist()
            for words in blocks(batch.column(1)):
                one, two = window_hashes(words.hashes, size.window), window_hashes(mix(words.hashes), size.window)
                rows = []
                for k, row in enumerate(words.rows):
                    for p in pieces[row]:
                        first, runs = _split(p["place"])
                        at = int(words.first[k]) + first
                        hashes = zip(one[at : at + runs].view(np.int64).tolist(), two[at : at + runs].view(np.int64).tolist())
                        rows += ((batch.column(0)[row].as_py(), p["place"], p["copies"], i, a, b) for i, (a, b) in enumerate(hashes))
                yield _rows(rows, WINDOWS)

    windows = found.select("doc_id", "text", "pieces").mapInArrow(run, WINDOWS)
    again = windows.groupBy("one", "two").agg(F.sum("copies").alias("n")).filter("n > 1").drop("n")
    bit = F.expr("shiftleft(1L, nth)")
    masks = windows.join(again, ["one", "two"]).groupBy("doc_id", "place", "copies").agg(F.bit_or(bit).alias("mask"))
    return masks.filter("copies = 1").select("doc_id", "place", "mask")


def repeated_windows(docs: DataFrame, size: Repeats = Repeats()) -> DataFrame:
    """``doc_id, place, mask``: super-k-mers with repeated windows; bit ``i`` of the mask is window ``i``."""
    pieces = _pieces(docs, size)
    counted = pieces.groupBy("minimiser", "print").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "place")).alias("at")
    )
    counted = counted.select("minimiser", "print", "copies", "at.doc_id", "at.place")
    buckets = counted.groupBy("minimiser").agg(F.count(F.lit(1)).alias("strings"), F.max("copies").alias("most"))
    busy = buckets.filter("strings > 1 OR most > 1").select(F.col("minimiser").alias("_m"), "strings")
    # Written once: the three uses below need a small part of what it costs to make.
    kept = cut(counted.join(busy, F.col("minimiser") == F.col("_m")).drop("_m"))
    copied = kept.filter("copies > 1").select(F.col("minimiser").alias("_m"), F.col("print").alias("_p"))
    everywhere = pieces.join(copied, (F.col("minimiser") == F.col("_m")) & (F.col("print") == F.col("_p"))).select(
        "doc_id", "place", F.lit(-1).cast("long").alias("mask")
    )
    cold = _sorted_buckets(_packed(_with_text(docs, kept.filter(f"strings BETWEEN 2 AND {size.hot}")), size), size)
    hot = _hot_windows(_with_text(docs, kept.filter(f"strings > {size.hot}")), size)
    return everywhere.unionByName(cold).unionByName(hot)


KEPT = "doc_id long, n_words long, n_removed long, kept_text string"


def remove_repeats(docs: DataFrame, size: Repeats = Repeats()) -> DataFrame:
    """Removes each word that a repeated window covers; windows are judged on the input.

    Returns ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one space) for every row
    of ``docs``. Null and empty texts have no words. A row that is there twice repeats itself. Rows
    that share an id but not a text are separate documents. Other columns are ignored.
    """
    docs = docs.select(
        "doc_id", "text", F.hash("text").cast("long").bitwiseAND((1 << TAG_BITS) - 1).alias("tag")
    )
    masks = repeated_windows(docs, size)
    per_text = (
        masks.select(F.col("doc_id").alias("_id"), _tag_of("place").alias("_tag"), F.struct("place", "mask").alias("m"))
        .groupBy("_id", "_tag")
        .agg(F.collect_list("m").alias("masks"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, masks in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = (text or "").encode().split()
                drop = np.zeros(len(words) + 1, dtype=np.int64)
                for m in masks or ():
                    first, runs = _split(m["place"])
                    for i in range(runs):
                        if m["mask"] >> i & 1:
                            drop[first + i] += 1
                            drop[first + i + size.window] -= 1
                covered = np.cumsum(drop[:-1]) > 0
                kept = [w for w, gone in zip(words, covered.tolist()) if not gone] if masks else words
                rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()))
                if len(rows) >= 1000:
                    yield _rows(rows, KEPT)
                    rows = []
            yield _rows(rows, KEPT)

    return docs.join(per_text, same, "left").select("doc_id", "text", "masks").mapInArrow(run, KEPT)
