"""Caps, numbering, counts and flattening of result lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 100_000


def top_businesses(businesses: DataFrame, n: int | None = 20) -> DataFrame:
    """First ``n`` businesses of every query; ``0`` or ``None`` keeps all. Spark keeps at most ``n``
    rows per query and task before the shuffle."""
    if not n:
        return businesses
    order = Window.partitionBy("query").orderBy("seq")
    return businesses.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def number_rows(businesses: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``number``: 1, 2, 3 ... per query in ``seq`` order.

    Numbers are counted inside blocks of ``seq`` values and shifted by the rows of earlier blocks,
    so a query of any size is numbered by many tasks. Blocks are as wide as it takes to hold about
    ``block`` rows, so there are few of them however far apart the values lie.
    """
    low, high, rows = businesses.agg(F.min("seq"), F.max("seq"), F.count("seq")).first()
    width = -(-(high - low + 1) * block // rows) if rows else 1
    placed = businesses.withColumn("_block", F.expr(f"(seq - {low or 0}) div {width}"))
    before = Window.partitionBy("query").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        placed.groupBy("query", "_block")
        .count()
        .select("query", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy("query", "_block").orderBy("seq")
    return (
        placed.withColumn("_n", F.row_number().over(inside))
        .join(offsets, ["query", "_block"])
        .withColumn("number", F.col("_shift") + F.col("_n"))
        .drop("_block", "_n", "_shift")
    )


def contact_summary(contacts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Numbered summary line per business: name, website and number of e-mails."""
    counted = contacts.select(
        "query",
        "seq",
        "name",
        "website",
        F.size(F.coalesce("email_addresses", F.array().cast("array<string>"))).alias("email_count"),
    )
    return number_rows(counted, block)


def run_counts(contacts: DataFrame) -> DataFrame:
    """Per query: businesses, distinct websites, businesses with e-mails, e-mails."""
    emails = F.size(F.coalesce("email_addresses", F.array().cast("array<string>")))
    return contacts.groupBy("query").agg(
        F.count(F.lit(1)).alias("businesses"),
        F.countDistinct("website").alias("websites"),
        F.sum((emails > 0).cast("long")).alias("with_emails"),
        F.sum(emails.cast("long")).alias("emails"),
    )


def combine_results(*parts: DataFrame) -> DataFrame:
    """Results with different columns as one table; ``skipped`` is false where it is missing."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.withColumn("skipped", F.coalesce("skipped", F.lit(False)))


def flatten_contacts(contacts: DataFrame) -> DataFrame:
    """E-mail list to one comma-separated string, as CSV and Excel need it."""
    return contacts.withColumn("email_addresses", F.array_join("email_addresses", ", "))
