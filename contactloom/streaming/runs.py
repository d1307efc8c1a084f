"""Streaming forms of the memory a run keeps: handled sites, visited pages, kept listings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from contactloom.fixed_values import Settings
from contactloom.functions.urls import base_url
from contactloom.operators.admission import is_html
from contactloom.operators.dedupe import website_key
from contactloom.operators.emails import page_emails
from contactloom.operators.shared import lookup_join
from contactloom.sources.tables import with_page_defaults


def first_page_visits(pages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First snapshot per URL; the state of a URL is dropped once the watermark has passed it."""
    return pages.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["url"])


def stream_emails(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``website, url, emails`` of every page, no e-mails where the page is not admitted; stateless,
    so it fits any stream."""
    bodies = with_page_defaults(pages).filter(F.col("url") != "")
    admitted = F.coalesce((F.col("status") == 200) & is_html(F.col("content_type")), F.lit(False))
    gated = bodies.select(
        base_url(F.col("url")).alias("website"), "url", F.when(admitted, F.col("html")).alias("html")
    )
    found = page_emails(gated, settings)
    return found.withColumn("emails", F.coalesce("emails", F.array().cast("array<string>")))


def handled_sites_writer(
    pages: DataFrame,
    emails_path: str,
    history_path: str,
    checkpoint: str,
    settings: Settings = Settings(),
) -> DataStreamWriter:
    """E-mails of sites that no earlier run has handled, and the history of handled sites.

    A run begins when this writer is made; what counts as handled is fixed then, so pages of one site
    may arrive in any number of batches. Both outputs are partitioned by batch and a repeated batch
    overwrites its own partition. Pages are reduced to their e-mails before they meet the history.
    """
    earlier = _batches(pages.sparkSession, history_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        found = stream_emails(batch, settings).persist()
        fresh = found
        if handled := min(earlier, batch_id):
            history = batch.sparkSession.read.parquet(history_path)
            known = history.filter(F.col("batch_id") < handled).select("website").distinct()
            fresh = lookup_join(found, known, ["website"], "left_anti")
        try:
            emails = fresh.filter(F.size("emails") > 0).select("website", "url", "emails")
            _put(emails, emails_path, batch_id)
            _put(fresh.select("website").distinct(), history_path, batch_id)
        finally:
            found.unpersist()

    return pages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def _batches(spark: SparkSession, history_path: str) -> int:
    """Number of the first batch after those in the history."""
    try:
        last = spark.read.parquet(history_path).agg(F.max("batch_id")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0  # no history yet
    return 0 if last is None else int(last) + 1


def first_listings(businesses: DataFrame) -> DataFrame:
    """Earliest ``seq`` per query and website, as a running minimum (update mode).

    The minimum combines before the shuffle, so a website in very many listings stays cheap.
    """
    return (
        businesses.withColumn("site", website_key())
        .filter("site IS NOT NULL")
        .groupBy("query", "site")
        .agg(F.min("seq").alias("seq"))
    )


def first_listings_writer(businesses: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes the changed minima of every batch; ``read_first_listings`` folds them."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        _put(batch, path, batch_id)

    return (
        first_listings(businesses)
        .writeStream.outputMode("update")
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
    )


def read_first_listings(updates: DataFrame) -> DataFrame:
    return updates.groupBy("query", "site").agg(F.min("seq").alias("seq"))


def _put(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
