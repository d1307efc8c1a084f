"""Sites handled by earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.functions.urls import normalize_url
from contactloom.operators.shared import lookup_join


def mark_known(businesses: DataFrame, history: DataFrame, normalize: bool = False) -> DataFrame:
    """Add ``skipped``: true where the website, as written, is in the history."""
    site = normalize_url(F.col("website")) if normalize else F.col("website")
    past = normalize_url(F.col("website")) if normalize else F.col("website")
    known = history.select(past.alias("_site")).distinct().withColumn("_known", F.lit(True))
    return (
        lookup_join(businesses.withColumn("_site", site), known, ["_site"])
        .withColumn("skipped", F.coalesce("_known", F.lit(False)) & (F.col("website") != ""))
        .withColumn("skipped", F.coalesce("skipped", F.lit(False)))
        .drop("_site", "_known")
    )


def new_sites(crawled: DataFrame, history: DataFrame) -> DataFrame:
    """Websites of this run that the history lacks; this is all that has to be appended."""
    sites = crawled.filter(F.col("website") != "").select("website").distinct()
    return sites.join(history.select("website"), "website", "left_anti")


def merged_history(crawled: DataFrame, history: DataFrame) -> DataFrame:
    return history.select("website").distinct().unionByName(new_sites(crawled, history))
