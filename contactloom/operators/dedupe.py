"""Duplicate businesses: a listing stays iff no earlier listing that stays matches it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.functions.text import nonempty
from contactloom.operators.report import number_rows
from contactloom.operators.shared import cut, lookup_join
from contactloom.operators.similarity_join import common_bigrams, comparable, pairs_between

WEBSITE, PHONE, SIMILARITY = "website", "phone", "similarity"


def website_key(col: Column | str = "website") -> Column:
    return nonempty(F.lower(col))


def phone_key(col: Column | str = "phone_number") -> Column:
    return nonempty(F.translate(col, " -()", ""))


_KEYS = {WEBSITE: website_key, PHONE: phone_key}


def dedupe_businesses(
    businesses: DataFrame,
    rules: Sequence[str] | None = None,
    name_threshold: float = 0.8,
    address_threshold: float = 0.7,
    first_batch: int = 1_000,
) -> DataFrame:
    """Keep-first within each query, in ``seq`` order, comparing with kept listings only.

    ``rules`` names any of ``website``, ``phone`` and ``similarity``; the last one needs an
    ``address`` column and is on by default where there is one.
    """
    if rules is None:
        rules = [WEBSITE, PHONE] + ([SIMILARITY] if "address" in businesses.columns else [])
    key_rules = [rule for rule in rules if rule in _KEYS]
    if len(rules) == 1 and key_rules:
        return _first_per_key(businesses, _KEYS[key_rules[0]]())
    keys = [f"k{n}" for n in range(len(key_rules))]
    keyed = {k: _KEYS[rule]() for k, rule in zip(keys, key_rules)}
    if SIMILARITY in rules:
        nodes = businesses.select("query", "seq", "name", "address", *_named(keyed))
        kept = _kept_in_batches(nodes, keys, name_threshold, address_threshold, first_batch)
    else:
        kept = kept_rows(businesses.select("query", "seq", *_named(keyed)), keys)
    return businesses.join(kept, ["query", "seq"], "left_semi")


def _named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def _kept_in_batches(
    nodes: DataFrame,
    keys: Sequence[str],
    name_threshold: float,
    address_threshold: float,
    first_batch: int,
) -> DataFrame:
    """Decide growing batches of ``seq`` order one after the other.

    Rows that agree in name, address and all keys collapse to the first of them, and equal name and
    address are one more key, so pairs are only listed between rows whose name or address differs.
    A batch first loses what matches earlier kept rows, so most copies are compared with few rows;
    only the survivors are compared with each other. Batches grow eightfold: there are few of them.
    """
    keys = [*keys, "same"]
    texts = {c: F.lower(c) for c in ("name", "address")}
    same = F.when((texts["name"] != "") & (texts["address"] != ""), F.struct(*_named(texts)))
    nodes = _collapse(_with_key_count(nodes.withColumn("same", same), keys), keys).select(
        "query", "seq", *keys, "same.name", "same.address"
    )
    place = F.ceil(F.log(8.0, F.col("number") / first_batch)).cast("int")
    ranked = cut(number_rows(nodes).withColumn("batch", F.greatest(F.lit(0), place)))
    common = common_bigrams(comparable(ranked))
    last = ranked.agg(F.max("batch")).first()[0]
    kept: DataFrame | None = None
    for batch in range(0 if last is None else last + 1):
        rows = ranked.filter(F.col("batch") == batch).drop("batch", "number")
        if kept is not None:
            for key in keys:
                taken = kept.filter(F.col(key).isNotNull()).select("query", key).distinct()
                rows = lookup_join(rows, taken, ["query", key], "left_anti")
            rows = cut(rows)
            hits = pairs_between(
                cut(comparable(rows)), cut(comparable(kept)), common, name_threshold, address_threshold,
                equal=False,
            )
            gone = hits.select("query", F.col("later").alias("seq")).distinct()
            rows = cut(rows.join(gone, ["query", "seq"], "left_anti"))
        inside = cut(comparable(rows))
        pairs = pairs_between(inside, inside, common, name_threshold, address_threshold, equal=False)
        stay = rows.join(kept_rows(rows.select("query", "seq", *keys), keys, pairs), ["query", "seq"], "left_semi")
        kept = cut(stay if kept is None else kept.unionByName(stay))
    return nodes.select("query", "seq").limit(0) if kept is None else kept.select("query", "seq")


def _first_per_key(businesses: DataFrame, key: Column) -> DataFrame:
    """One rule only: first row per key. Rows without a key all stay, each in a group of its own."""
    alone = F.when(key.isNull(), F.col("seq"))
    order = Window.partitionBy("query", key, alone).orderBy("seq")
    return (
        businesses.withColumn("_rank", F.row_number().over(order))
        .filter("_rank = 1")
        .drop("_rank")
    )


def kept_rows(nodes: DataFrame, keys: Sequence[str], pairs: DataFrame | None = None) -> DataFrame:
    """``query, seq`` of the rows that stay, for exact keys and extra ``later, earlier`` pairs.

    Works in rounds. A row that comes first in all of its key groups, with no undecided earlier
    partner, stays; whatever it matches goes. Each round decides at least the first undecided row
    of every query, so nothing is left open. Groups are never listed pairwise: a key group only
    contributes its first row, found by a minimum that combines before the shuffle.
    """
    keys = list(keys)
    nodes = _with_key_count(nodes, keys)
    undecided = cut(nodes if pairs is not None or not keys else _collapse(nodes, keys))
    pairs = cut(pairs) if pairs is not None else None
    decided: list[DataFrame] = []
    while not undecided.isEmpty():
        stay = cut(_leaders(undecided, keys, pairs))
        decided.append(stay.select("query", "seq"))
        rest = undecided.join(stay.select("query", "seq"), ["query", "seq"], "left_anti")
        for key in keys:
            taken = stay.filter(F.col(key).isNotNull()).select("query", key)
            rest = lookup_join(rest, taken, ["query", key], "left_anti")
        if pairs is not None:
            gone = pairs.join(
                stay.select("query", F.col("seq").alias("earlier")), ["query", "earlier"], "left_semi"
            ).select("query", F.col("later").alias("seq"))
            rest = rest.join(gone, ["query", "seq"], "left_anti")
        undecided = cut(rest)
        if pairs is not None:
            pairs = cut(_among(pairs, undecided))
    return reduce(DataFrame.unionByName, decided) if decided else nodes.select("query", "seq")


def _with_key_count(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    n_keys = reduce(lambda a, b: a + b, (F.col(k).isNotNull().cast("int") for k in keys), F.lit(0))
    return nodes.withColumn("n_keys", n_keys)


def _collapse(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the first of rows with identical keys can stay; rows without any key all stay."""
    alone = F.when(F.col("n_keys") == 0, F.col("seq")).alias("alone")
    return nodes.groupBy("query", *keys, "n_keys", alone).agg(F.min("seq").alias("seq")).drop("alone")


def _leaders(undecided: DataFrame, keys: Sequence[str], pairs: DataFrame | None) -> DataFrame:
    row = F.struct("seq", "n_keys", *keys)
    wins = [
        undecided.filter(F.col(key).isNotNull())
        .groupBy("query", key)
        .agg(F.min(row).alias("row"))
        .select("query", "row.*")
        for key in keys
    ]
    stay = undecided.filter("n_keys = 0").select("query", "seq", "n_keys", *keys)
    if wins:
        first_everywhere = (
            reduce(DataFrame.unionByName, wins)
            .groupBy("query", "seq", "n_keys", *keys)
            .count()
            .filter("count = n_keys")
            .drop("count")
        )
        stay = stay.unionByName(first_everywhere)
    if pairs is not None:
        waiting = pairs.select("query", F.col("later").alias("seq")).distinct()
        stay = stay.join(waiting, ["query", "seq"], "left_anti")
    return stay


def _among(pairs: DataFrame, undecided: DataFrame) -> DataFrame:
    ids = undecided.select("query", "seq")
    for end in ("later", "earlier"):
        pairs = pairs.join(ids.withColumnRenamed("seq", end), ["query", end], "left_semi")
    return pairs
