"""Source divergence audit: how far each source's term distribution lies from its language's and from
the other sources of that language.

Null text, lang and source read as ''. Terms are maximal runs of characters other than ASCII
non-letters; only A-Z are lower-cased. Documents are told apart by doc_id; a row with a null id counts
towards no term's number of documents, but its occurrences count.

Vocabulary (``iceberg_terms``): a language keeps the terms found in at least ``min_docs`` of its
documents. They are found by iceberg prefix refinement: byte prefixes of the UTF-8 terms are
extended level by level, each level's prefixes twice as long as the last (1, 2, 4, ... bytes), so a
long term needs few levels; a prefix whose number of documents falls below the threshold is
dropped with all its extensions (a term can only be as frequent as each of its prefixes); a prefix is
counted as the documents of its terms added up, which is never too low, so nothing is dropped that should
stay and no document travels by itself; a term that ends within a level is complete and is kept if its own number of documents reaches the threshold.
Levels go on until no prefix remains. Every count covers all rows of the level.

Distributions: for every occurring (lang, source) group and for each lang, a kept term with ``count``
occurrences there (zero included) has ``p = 1 + (1e9 * (count + 5)) div (N + 5 V)`` with N the sum of
the counts of kept terms in the group, V the number of the language's kept terms; exact integers.
Terms with count 0 share one ``p`` per group, so they are never listed.

``pair`` rows: per group, every other source of the language, ``value`` = sum over all kept terms of
``|p - q|``, q the other source's (0 if V = 0), all ranks. ``term`` rows: per group, every kept term
with a count above 0 there whose p exceeds the language's, ``value = p - q``, ranks up to 50. Ranks
from 1 per group and part, by value descending, then item ascending in UTF-8. A language without kept
terms gives only ``pair`` rows of value 0; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.llm.lexical_search import LOWER, UPPER, div, stored
from contactloom.llm.words import break_table, by_bytes, term_places
from contactloom.operators.shared import cut, fits_broadcast

# Fixed values of the audit.
BREAKS = r"\x00-\x40\x5B-\x60\x7B-\x7F"
TERM_BREAK = f"[{BREAKS}]+"
MIN_DOCS, SMOOTH, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Ranking of terms in two steps: first within so many parts of a group, then over the parts.
PARTS = 32
#: Bytes of text whose terms are put together before they leave a task.
TEXT_BYTES = 32 << 20
#: Cells of terms and sources compared at once.
BLOCK_CELLS = 1 << 18

RESULT = "lang string, source string, part string, item string, value long, rank int"


def audit_terms(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), TERM_BREAK)
    return F.filter(parts, lambda t: t != "")


def _maybe_broadcast(df: DataFrame, *columns: str) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, *columns) else df


def term_blocks(docs: DataFrame) -> DataFrame:
    """``lang, term, n_docs, doc_id, held (source, n)``: documents that hold each term and its occurrences
    per source, put together for every few MB of text inside the tasks. Rows that are ``again`` (their id
    is on other rows too) stand alone, with their id and no document counted; a null id counts nothing.

    ``docs`` has doc_id, lang, source, again and text.
    """
    held = T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([
        T.StructField("lang", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n_docs", T.LongType()),
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held", held),
    ])
    names, table = schema.names, break_table(BREAKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 4, TEXT_BYTES):
                words, places, first = term_places(part.column(4), table)
                if not len(places):
                    continue
                width, n_rows = len(words), part.num_rows
                found, n = np.unique(np.repeat(np.arange(n_rows), np.diff(first)) * width + places, return_counts=True)
                row, word = np.divmod(found, width)
                # Rows of a language are one owner of terms, those that stand alone are each their own.
                alone = part.column(3).to_numpy(zero_copy_only=False).astype(bool)
                langs, sources = (part.column(i).dictionary_encode() for i in (1, 2))
                owner = np.where(alone, len(langs.dictionary) + np.arange(n_rows), langs.indices.to_numpy())
                source, n_sources = sources.indices.to_numpy().astype(np.int64), len(sources.dictionary)
                keys, at = np.unique((owner[row] * width + word) * n_sources + source[row], return_inverse=True)
                sums = [np.zeros(len(keys), np.int64) for _ in range(2)]
                np.add.at(sums[0], at, n)
                np.add.at(sums[1], at, (part.column(0).is_valid().to_numpy(zero_copy_only=False) & ~alone)[row].astype(np.int64))
                pairs, begin = np.unique(keys // n_sources, return_index=True)
                whose, word = np.divmod(pairs, width)
                _, example = np.unique(owner, return_index=True)
                rows = example[np.searchsorted(owner[example], whose)]
                ids, rows = pa.array(rows, mask=~alone[rows]), pa.array(rows)
                each = pa.StructArray.from_arrays([sources.dictionary.take(pa.array(keys % n_sources)), pa.array(sums[0])], ["source", "n"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).take(rows), words.take(pa.array(word)).cast(pa.string()), pa.array(np.add.reduceat(sums[1], begin)),
                     part.column(0).take(ids), pa.ListArray.from_arrays(pa.array(np.append(begin, len(keys)), pa.int32()), each)], names=names,
                )

    return docs.select("doc_id", "lang", "source", "again", "text").mapInArrow(run, schema)


def iceberg_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term`` held by at least ``min_docs`` distinct documents of the lang.

    ``counts`` has lang, term and n_docs; a term's rows add up to the documents that hold it. It is read
    once a level.
    """
    pairs = counts.filter("n_docs > 0").select("lang", "n_docs", F.encode("term", "UTF-8").alias("b")).withColumn("len", F.length("b"))
    found, alive, reach, before = [], None, 1, 0
    while True:
        here = pairs.filter(F.col("len") > before)
        if alive is not None:
            here = here.withColumn("stem", F.substring("b", 1, before)).join(
                _maybe_broadcast(alive, "stem"), ["lang", "stem"], "left_semi"
            )
        done = F.col("len") <= reach
        keyed = here.select(
            "lang", "n_docs", done.alias("done"), F.when(done, F.col("b")).otherwise(F.substring("b", 1, reach)).alias("stem")
        )
        counted = keyed.groupBy("lang", "stem", "done").agg(F.sum("n_docs").alias("n_docs"))
        kept = cut(counted.filter(F.col("n_docs") >= min_docs))
        found.append(kept.filter("done").select("lang", F.decode("stem", "UTF-8").alias("term")))
        alive = kept.filter(~F.col("done")).select("lang", "stem")
        if alive.isEmpty():
            break
        before, reach = reach, 2 * reach
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return cut(out)


def _p(count: Column, total: Column, v: Column) -> Column:
    """``1 + (1e9 * (count + 5)) div (total + 5 v)`` without overflow."""
    scaled = F.lit(SCALE).cast("decimal(38,0)") * (count + F.lit(SMOOTH)).cast("decimal(38,0)")
    return F.lit(1) + div(scaled, (total + F.lit(SMOOTH) * v).cast("decimal(38,0)"))


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` as the module says."""
    clean = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        "text",
    )
    ids = clean.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    twice = cut(ids.filter("rows > 1").select("doc_id", F.lit(True).alias("again")))
    if twice.isEmpty():
        marked = clean.withColumn("again", F.lit(False))
    else:
        marked = clean.join(_maybe_broadcast(twice, "doc_id"), "doc_id", "left").fillna(False, ["again"])
    tokens = stored(term_blocks(marked))
    groups = cut(clean.select("lang", "source").distinct())
    holders = tokens.select("lang", "term", "n_docs")
    if not twice.isEmpty():
        more = tokens.filter("doc_id IS NOT NULL").select("lang", "term", "doc_id").distinct()
        holders = holders.unionByName(more.select("lang", "term", F.lit(1).cast("long").alias("n_docs")))
    vocabulary = iceberg_terms(holders, min_docs)
    sizes = groups.select("lang").distinct().join(
        vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left"
    ).select("lang", F.coalesce("v", F.lit(0)).cast("long").alias("v"))

    counts = stored(
        tokens.select("lang", "term", "held").join(_maybe_broadcast(vocabulary, "term"), ["lang", "term"], "left_semi")
        .select("lang", "term", F.inline("held"))
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("count"))
    )
    group_n = groups.join(counts.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
    group_n = group_n.join(sizes, "lang").withColumn("n", F.coalesce("n", F.lit(0)))
    group_n = cut(group_n.withColumn("p0", F.when(F.col("v") > 0, _p(F.lit(0), F.col("n"), F.col("v")))))
    lang_counts = counts.groupBy("lang", "term").agg(F.sum("count").alias("count"))
    lang_n = lang_counts.groupBy("lang").agg(F.sum("count").alias("n")).join(sizes, "lang")
    lang_p = lang_counts.join(_maybe_broadcast(lang_n, "lang"), "lang").select("lang", "term", _p(F.col("count"), F.col("n"), F.col("v")).alias("q"))

    small = _maybe_broadcast(group_n.select("lang", "source", "n", "v", "p0"), "lang", "source")
    group_p = stored(counts.join(small, ["lang", "source"]).select("lang", "source", "term", _p(F.col("count"), F.col("n"), F.col("v")).alias("p")))
    return _pairs(group_p, group_n).unionByName(_terms(group_p, lang_p, top))


def _pairs(group_p: DataFrame, group_n: DataFrame) -> DataFrame:
    """Each ordered pair of sources of a lang. A kept term occurs somewhere in its lang, so the terms of
    ``group_p`` are all there are; their differences are added up term by term inside the tasks."""
    spark = group_p.sparkSession
    groups = defaultdict(list)
    for r in group_n.orderBy("lang", "source").collect():  # the result has a row for each two of a lang
        groups[r.lang].append((r.source, r.p0))
    sent = spark.sparkContext.broadcast(dict(groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            langs, held = batch.column(0).dictionary_encode(), batch.column(1)
            for nth, lang in enumerate(langs.dictionary.to_pylist()):
                names, p0 = zip(*sent.value[lang])
                p0 = np.array(p0, np.int64)
                total = sums.setdefault(lang, np.zeros((len(p0), len(p0)), np.int64))
                mine, step = np.flatnonzero(langs.indices.to_numpy() == nth), max(1, BLOCK_CELLS // len(p0))
                for at in range(0, len(mine), step):
                    part = held.take(pa.array(mine[at : at + step]))
                    each, n = pc.list_flatten(part), pc.list_value_length(part).to_numpy(zero_copy_only=False)
                    p = np.tile(p0, (len(part), 1))
                    column = pc.index_in(each.field(0), value_set=pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
                    p[np.repeat(np.arange(len(part)), n), column] = each.field(1).to_numpy(zero_copy_only=False)
                    for i in range(len(p0)):
                        total[i] += np.abs(p - p[:, i : i + 1]).sum(axis=0)
        for lang, total in sums.items():
            names = [name for name, _ in sent.value[lang]]
            for name, row in zip(names, total):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), pa.array([name] * len(names)), pa.array(names), pa.array(row)], names=["lang", "source", "item", "s"])

    held = group_p.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p")).alias("held"))
    sums = held.select("lang", "held").mapInArrow(run, "lang string, source string, item string, s long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("s").alias("value"))
    pairs = group_n.select("lang", "source").join(group_n.select("lang", F.col("source").alias("item")), "lang").filter("source != item")
    joined = pairs.join(sums, ["lang", "source", "item"], "left")
    valued = joined.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order).cast("int"))


def _terms(group_p: DataFrame, lang_p: DataFrame, top: int) -> DataFrame:
    above = group_p.join(lang_p, ["lang", "term"]).filter(F.col("p") > F.col("q"))
    valued = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).cast("long").alias("value"))
    order = [F.desc("value"), F.asc("item")]
    part = F.pmod(F.xxhash64("item"), F.lit(PARTS))
    first = valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", part).orderBy(*order)))
    best = first.filter(F.col("rank") <= top).drop("rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).cast("int"))
    return ranked.filter(F.col("rank") <= top)
