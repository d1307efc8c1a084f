"""Near duplicates: circulant MinHash, banding and exact Jaccard verification.

Two fixed permutations of the 32-bit integers serve all signature coordinates: the first scatters the
shingle hashes, the second, shifted circularly by ``k``, orders them for coordinate ``k``.

Documents with equal shingle sets collapse to one class first, so copies cost nothing later. Classes
that share a band are candidates. Within a bucket, classes are first compared with one hub per round,
in two rounds; what still lies in different components of a bucket is then compared block by block, a
block of classes at a time. So each candidate pair is either compared or already connected, without
listing the pairs of a group.
Similarity is always confirmed on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.components import components
from contactloom.llm.lexical_search import stored
from contactloom.llm.words import blocks, make_room, mix, window_hashes
from contactloom.operators.shared import cut

SIGNED = "doc_id long, tag int, n_shingles long, one long, two long, bands array<long>"
LINK = "node long, other long"
#: Pairs of texts turned into Python strings at once, and shared shingles counted at once, in a task.
TEXTS_AT_ONCE, MEETINGS_AT_ONCE = 128, 1 << 18


@dataclass(frozen=True)
class NearDup:
    """A pair links if ``100 * intersection >= percent * union``. With the defaults a linked pair
    shares no band with probability below 1e-7: (1 - 0.85 ** 5) ** 28."""

    words: int = 5
    percent: int = 85
    rows: int = 5
    bands: int = 28
    block: int = 256


def scatter(x: np.ndarray) -> np.ndarray:
    """First permutation."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def ordered(x: np.ndarray) -> np.ndarray:
    """Second permutation, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts of a block, text by text, and each text's first.

    A text with fewer words has its whole sequence as its one shingle.
    """
    text_of, n, counts = words.text_of, len(words.start), words.counts
    inside = np.flatnonzero(text_of[: max(0, n - length + 1)] == text_of[length - 1 :])
    values, owner = window_hashes(words.hashes, length)[inside], text_of[inside]
    short = np.flatnonzero((counts > 0) & (counts < length))
    if len(short):
        whole = [window_hashes(words.hashes[words.first[k] : words.first[k + 1]], int(counts[k]))[0] for k in short]
        values = np.concatenate((values, np.array(whole, dtype=np.uint64)))
        owner = np.concatenate((owner, short))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(len(words.rows) + 1))


def signatures(values: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """One row of ``length`` coordinates per set; all sets must have a value."""
    out = np.empty((len(first), length), dtype=np.uint32)
    spread = scatter((values ^ (values >> np.uint64(32))).astype(np.uint32))
    edges = np.append(first, len(values))
    at = 0
    while at < len(first):  # groups of sets that stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + 16_384, side="right")) - 1)
        part, starts = spread[edges[at] : edges[to]], edges[at:to] - edges[at]
        for k in range(length):
            out[at:to, k] = np.minimum.reduceat(ordered(part + np.uint32(k)), starts)
        at = to
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signature), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, dtype=np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * rows + r].astype(np.uint64))
        keys[:, b] = key
    return keys


def _signed(docs: DataFrame, rule: NearDup) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            for words in blocks(batch.column(2), lower=True):
                values, first = shingle_sets(words, rule.words)
                sizes = np.diff(first)
                full = np.flatnonzero(sizes)
                bands = np.zeros((len(sizes), rule.bands), dtype=np.uint64)
                sums = np.zeros((2, len(sizes)), dtype=np.uint64)
                if len(full):
                    signature = signatures(values, first[:-1][full], rule.bands * rule.rows)
                    bands[full] = band_keys(signature, rule.bands, rule.rows)
                    sums[0, full] = np.add.reduceat(mix(values), first[:-1][full])
                    sums[1, full] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), first[:-1][full])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.where(sizes > 0, rule.bands, 0).cumsum() - np.where(sizes > 0, rule.bands, 0), pa.int32()).to_pylist()
                    + [int((sizes > 0).sum()) * rule.bands],
                    pa.array(bands[full].ravel().view(np.int64)),
                )
                at, n = words.rows.start, len(words.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(sizes.astype(np.int64)),
                     pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists],
                    names=["doc_id", "tag", "n_shingles", "one", "two", "bands"],
                )

    return docs.select("doc_id", "tag", "text").mapInArrow(run, SIGNED)


def lowered_words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # of bytes: A-Z only, and ASCII white space only


def shingles(text: str, length: int) -> set[tuple]:
    words = lowered_words(text)
    if len(words) < length:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(length))))


def alike(a: set, b: set, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame, rule: NearDup) -> DataFrame:
    """Pairs whose whole sets are similar. Only texts that stand in a pair travel."""
    left = texts.select(F.col("node"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("other"), F.col("text").alias("right"))

    def run(batches):
        make_room()
        known = (None, None)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch, good = whole.slice(at, TEXTS_AT_ONCE), []
                rows = zip(*(batch.column(k).to_pylist() for k in range(4)))
                for node, other, a, b in rows:
                    if known[0] != other:
                        known = other, shingles(b, rule.words)
                    if alike(shingles(a, rule.words), known[1], rule.percent):
                        good.append((node, other))
                yield _links(good)

    met = pairs.join(left, "node").join(right, "other")
    return met.select("node", "other", "left", "right").mapInArrow(run, LINK)


def _hub_pairs(members: DataFrame, seed: int, rule: NearDup) -> DataFrame:
    """Each member of a bucket with the bucket's hub, unless sizes rule the pair out or they are linked."""
    order = F.struct(F.xxhash64(F.lit(seed), "node").alias("order"), "node", "size", "component")
    hubs = members.groupBy("key").agg(F.min(order).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (
        members.join(hubs, "key")
        .filter("component != hub.component")
        .filter(f"100 * least(size, hub.size) >= {rule.percent} * greatest(size, hub.size)")
        .select("node", F.col("hub.node").alias("other"))
        .distinct()
    )


class Block:
    """Texts of one part of a bucket: shingle hashes in one sorted table with their owners."""

    def __init__(self, rule: NearDup):
        self.rule, self.nodes, self.components, self.texts, self.sets = rule, [], [], [], []
        self.values = None

    def add(self, node, component, text, values) -> None:
        self.nodes.append(node)
        self.components.append(component)
        self.texts.append(text)
        self.sets.append(values)

    def _index(self) -> None:
        sizes = np.array([len(v) for v in self.sets])
        values, owners = np.concatenate(self.sets), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owners, self.sizes = values[order], owners[order], sizes

    def links(self, node, component, text, values) -> Iterator[tuple[int, int]]:
        """One link of the text to each other component in which the block has a similar text."""
        if self.values is None:
            self._index()
        low, high = (np.searchsorted(self.values, values, side) for side in ("left", "right"))
        n = high - low
        both, chunk = np.zeros(len(self.sizes), np.int64), max(1, MEETINGS_AT_ONCE // len(self.sizes))
        for at in range(0, len(n), chunk):
            some = n[at : at + chunk]
            before = np.cumsum(some) - some
            met = np.arange(some.sum()) + np.repeat(low[at : at + chunk] - before, some)
            both += np.bincount(self.owners[met], minlength=len(self.sizes))
        near = (both > 0) & (100 * both >= self.rule.percent * (len(values) + self.sizes - both))
        linked, own = {component}, None
        for k in np.flatnonzero(near):
            if self.components[k] not in linked:
                own = own or shingles(text, self.rule.words)
                if alike(own, shingles(self.texts[k], self.rule.words), self.rule.percent):
                    linked.add(self.components[k])
                    yield node, self.nodes[k]

    def inner_links(self) -> Iterator[tuple[int, int]]:
        for k, node in enumerate(self.nodes):
            yield from self.links(node, self.components[k], self.texts[k], self.sets[k])


def _rest(members: DataFrame, texts: DataFrame, rule: NearDup) -> DataFrame:
    """Links between components that still share a bucket.

    A bucket is cut into parts of about ``rule.block`` classes. A part is compared with itself, and
    each class with the later parts of its bucket, so a row stands for up to ``rule.block`` pairs.
    """
    buckets = members.groupBy("key").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.ceil(F.count(F.lit(1)) / rule.block).cast("int").alias("parts")
    )
    split = (
        members.join(buckets.filter("a != b").select("key", "parts"), "key")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
        .select("key", "part", "parts", "node", "component")
    )
    later = F.sequence(F.col("part") + 1, F.col("parts") - 1)
    asking = split.filter("part < parts - 1").select("key", F.explode(later).alias("part"), "node", "component", F.lit(1).alias("asks"))
    rows = split.select("key", "part", "node", "component", F.lit(0).alias("asks")).unionByName(asking).join(texts, "node")

    def run(batches):
        make_room()
        group, block = None, Block(rule)
        for batch in batches:
            good = []
            keys, parts, nodes, components, asks = (batch.column(k).to_pylist() for k in range(5))
            for words in blocks(batch.column(5), lower=True):
                values, first = shingle_sets(words, rule.words)
                for k, row in enumerate(words.rows):
                    if group != (keys[row], parts[row]):
                        good += block.inner_links()
                        group, block = (keys[row], parts[row]), Block(rule)
                    own = (nodes[row], components[row], batch.column(5)[row].as_py(), values[first[k] : first[k + 1]])
                    if asks[row]:
                        good += block.links(*own) if block.nodes else ()
                    else:
                        block.add(*own)
            yield _links(good)
        yield _links(list(block.inner_links()))

    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part", "asks")
    return dealt.select("key", "part", "node", "component", "asks", "text").mapInArrow(run, LINK)


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    nodes, others = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(others, pa.int64())], names=["node", "other"])


def near_duplicates(docs: DataFrame, rule: NearDup = NearDup()) -> DataFrame:
    """Components of similar documents: ``doc_id, n_shingles, component_id, kept``, a row per input row.

    ``component_id`` is the smallest id reachable over links, ``kept`` whether it is the row's own.
    Null and empty texts have no shingles and link with nothing. Rows with one id count as one
    document in links, whatever their texts. Rows without an id are linked with nothing, have no
    component and are kept. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("tag"))
    signed = stored(_signed(docs, rule))
    same = ["n_shingles", "one", "two"]
    named = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    first = F.min_by(F.struct("tag", "bands"), "doc_id").alias("first")
    sets = named.groupBy(*same).agg(F.min("doc_id").alias("node"), first)
    node_of = sets.select(*same, "node")
    members = stored(
        sets.select(F.explode("first.bands").alias("key"), "node", F.col("n_shingles").alias("size"), F.col("first.tag").alias("tag"))
    )
    # Only buckets with several classes matter from here on.
    shared = members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a != b").select("key")
    members = stored(members.join(shared, "key"))
    wanted = members.select(F.col("node").alias("doc_id"), "tag").distinct()
    texts = stored(docs.join(wanted, ["doc_id", "tag"]).groupBy(F.col("doc_id").alias("node"), "tag").agg(F.first("text").alias("text")).drop("tag"))

    # Documents that have one id connect the classes they stand in.
    links = named.join(node_of, same).filter("doc_id != node").select(F.col("doc_id").alias("node"), F.col("node").alias("other"))
    ids_twice = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    links = links.join(ids_twice.select(F.col("doc_id").alias("node")), "node").distinct()
    label = None
    for seed in (1, 2):
        members_now = _labelled(members, label)
        links = cut(links.unionByName(_confirmed(_hub_pairs(members_now, seed, rule), texts, rule)))
        label = components(links)
        links = label.select("node", F.col("component").alias("other"))  # all that the next links need of these
    links = cut(links.unionByName(_rest(_labelled(members, label), texts, rule)))
    label = components(links)

    home = signed.join(node_of, same, "left")
    own = label.select(F.col("node"), F.col("component"))
    out = home.join(own, "node", "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    )
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _labelled(members: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return members.withColumn("component", F.col("node"))
    return members.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def keep_one_each(docs: DataFrame, rule: NearDup = NearDup()) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; all columns unchanged.

    Rows that share an id, and rows without one, stay together.
    """
    gone = near_duplicates(docs, rule).filter("NOT kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_id"), "left_anti")
