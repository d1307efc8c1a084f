"""Which pages may be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom import fixed_values as fv


def is_html(content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return kind.contains(fv.HTML_TYPES[0]) | kind.contains(fv.HTML_TYPES[1])


def snapshot_order(*last: str) -> Column:
    """Which snapshot of a document counts, as the largest value: the newest, of equal or unknown age
    the one that answered 200, then one that is no error, then a stable choice."""
    answered = F.when(F.col("status") == 200, 2).when(F.col("status") < 400, 1).otherwise(0)
    return F.struct("fetched_at", answered.alias("answered"), F.hash(*last).alias("last"))


def admit_pages(pages: DataFrame) -> DataFrame:
    """Pages with a URL, status 200 and an HTML content type."""
    return pages.filter(
        F.col("url").isNotNull()
        & (F.col("url") != "")
        & (F.col("status") == 200)
        & is_html(F.col("content_type"))
    )


def readable_homepages(pages: DataFrame) -> DataFrame:
    """Pages whose links may be used: any status that is not an error."""
    return pages.filter(F.col("url").isNotNull() & (F.col("url") != "") & (F.col("status") < 400))
