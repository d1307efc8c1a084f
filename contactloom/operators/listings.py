"""Listing snapshots to business records: ordered fallbacks over candidates parsed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom import fixed_values as fv
from contactloom.functions.html import listing_parts, result_cards
from contactloom.functions.text import first_match, nonempty, strip
from contactloom.functions.urls import domain_label, place_name, title_case
from contactloom.operators.shared import lookup_join


def is_listing_name(name: Column) -> Column:
    return (name != "") & ~F.lower(name).isin(*fv.NON_NAMES) & (F.length(name) > 3)


def is_prominent_text(text: Column) -> Column:
    return (F.lower(text) != "results") & F.length(text).between(4, 49)


def is_card_text(text: Column) -> Column:
    return is_listing_name(text) & (F.length(text) < 50)


def name_from_place_url(place_url: Column) -> Column:
    """The name segment of a place URL, if it makes a listing name."""
    rest = F.split(place_url, fv.PLACE_MARK, 3)[1]
    name = place_name(F.when(place_url.contains(fv.PLACE_MARK), F.substring_index(rest, "/", 1)))
    return F.when(is_listing_name(name), name)


def name_from_title(
    title: Column, product: str = fv.TITLE_PRODUCT, suffix: str = fv.TITLE_SUFFIX
) -> Column:
    """The page title up to the suffix, if the title mentions the product."""
    name = strip(F.substring_index(title, suffix, 1))
    return F.when(title.contains(product) & is_listing_name(name), name)


def name_from_domain(website: Column) -> Column:
    return title_case(domain_label(website))


def first_phone(text: Column) -> Column:
    return first_match(text, fv.PHONE)


def is_external_link(href: Column, excluded: str = fv.EXCLUDED_LINK_HOST) -> Column:
    return href.startswith("http") & ~href.contains(excluded)


def is_blocked(html: Column) -> Column:
    """Results page that shows a challenge instead of results."""
    return F.coalesce(F.lower(html).contains(fv.BLOCK_WORD), F.lit(False))


def drop_blocked_searches(rows: DataFrame, results: DataFrame) -> DataFrame:
    """A search whose results page (``query, html``) is a challenge yields nothing at all.

    Only results pages are tested: the word on a listing of its own (a protected form) means nothing.
    """
    blocked = results.filter(is_blocked(F.col("html"))).select("query").distinct()
    return lookup_join(rows, blocked, ["query"], "left_anti")


def result_listings(results: DataFrame) -> DataFrame:
    """Listing cards of results pages (``query, html``); the alternative selector counts only where
    the primary one finds nothing."""
    cards = results.select("query", result_cards("html").alias("cards"))
    chosen = F.when(F.size("cards.articles") > 0, F.col("cards.articles")).otherwise(
        F.col("cards.others")
    )
    return cards.select("query", F.posexplode(chosen).alias("pos", "text"))


def listing_fields(listings: DataFrame, run_epoch: int) -> DataFrame:
    """``query, seq, name, website, phone_number, error`` for every snapshot.

    ``run_epoch`` (seconds) names businesses without any name. ``error`` is set where the snapshot
    could not be read.
    """
    parsed = listings.select(
        "query",
        "seq",
        "place_url",
        "title",
        listing_parts("place_url", "html").alias("p"),
    )
    first_of = _first_where
    name = F.coalesce(
        name_from_place_url(F.col("place_url")),
        F.when(is_listing_name(F.col("p.h1")), F.col("p.h1")),
        first_of("p.headings", is_listing_name),
        nonempty(F.col("p.headline")),
        first_of("p.prominent", is_prominent_text),
        name_from_title(F.col("title")),
        first_of("p.cards", is_card_text),
    )
    usable = F.when(~F.lower(name).isin(*fv.NON_NAMES), name)
    from_domain = name_from_domain(F.col("p.authority"))
    domain_usable = F.when(~F.lower(from_domain).isin(*fv.NON_NAMES), nonempty(from_domain))
    website = F.coalesce(
        nonempty(F.col("p.authority")),
        nonempty(F.col("p.website_link")),
        first_of("p.links", is_external_link),
    )
    phone = F.coalesce(
        nonempty(F.col("p.phone_button")),
        nonempty(F.col("p.phone_mention")),
        first_phone(F.col("p.body_text")),
    )
    return parsed.select(
        "query",
        "seq",
        F.coalesce(usable, domain_usable, F.lit(f"Business_{run_epoch}")).alias("name"),
        website.alias("website"),
        phone.alias("phone_number"),
        F.when(F.col("p").isNull(), "unreadable snapshot").alias("error"),
    )


def good_rows(fields: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Readable business records; with results pages, of the searches that were not blocked."""
    good = fields.filter("error IS NULL").drop("error")
    return good if results is None else drop_blocked_searches(good, results)


def failed_rows(fields: DataFrame) -> DataFrame:
    return fields.filter("error IS NOT NULL").select("query", "seq", "error")


def _first_where(column: str, test) -> Column:
    return F.try_element_at(F.filter(column, lambda value: test(value)), F.lit(1))
