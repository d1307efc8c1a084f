"""The whole run: listings to saved contacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.fixed_values import Settings
from contactloom.operators.dedupe import dedupe_businesses
from contactloom.operators.history import mark_known
from contactloom.operators.listings import good_rows, listing_fields
from contactloom.operators.report import top_businesses
from contactloom.operators.shared import cut
from contactloom.plans.crawl import replay_crawl


def find_businesses(
    listings: DataFrame,
    run_epoch: int,
    rules: Sequence[str] | None = None,
    settings: Settings = Settings(),
    results: DataFrame | None = None,
) -> DataFrame:
    """Search results of every query: readable listings, duplicates dropped, then capped.

    ``results`` are the results pages (``query, html``); searches that met a challenge yield nothing.
    """
    found = cut(good_rows(cut(listing_fields(listings, run_epoch)), results))
    kept = dedupe_businesses(found, rules, settings.name_threshold, settings.address_threshold)
    return top_businesses(kept, settings.business_cap)


def run_contacts(
    businesses: DataFrame,
    pages: DataFrame,
    robots: DataFrame | None = None,
    history: DataFrame | None = None,
    settings: Settings = Settings(),
    scope: Sequence[str] = ("query",),
) -> DataFrame:
    """Contacts of the given businesses. With a history, known sites are marked and not crawled.

    The sites to add to the history are the websites of rows with ``skipped = false``.
    """
    if history is None:
        marked = businesses.withColumn("skipped", F.lit(False))
    else:
        marked = cut(mark_known(businesses, history))
    emails = replay_crawl(marked.filter(~F.col("skipped")), pages, robots, settings, scope)
    none = F.array().cast("array<string>")
    return marked.join(emails, ["query", "seq"], "left").select(
        "query",
        "seq",
        "name",
        "website",
        "phone_number",
        F.coalesce("email_addresses", none).alias("email_addresses"),
        "skipped",
    )
