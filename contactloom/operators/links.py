"""Links of a page: all of them, or the few a crawl would follow. Ranking is done inside the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom import fixed_values as fv
from contactloom.fixed_values import Settings
from contactloom.functions.emails import mailto_emails
from contactloom.functions.html import has_anchor, page_elements
from contactloom.functions.text import contains_any
from contactloom.functions.urls import normalize_url, page_key
from contactloom.operators.admission import snapshot_order


def html_elements(pages: DataFrame) -> DataFrame:
    """One row per anchor, script and element with contact attributes."""
    parsed = pages.select("url", page_elements(F.col("url"), F.col("html")).alias("elements"))
    return parsed.select(F.col("url").alias("page_url"), F.inline_outer("elements")).filter(
        "pos IS NOT NULL"
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Anchors in document order: ``page_url, pos, href, text`` (lower case) and ``full_url``."""
    exploded = _with_anchors(pages).select(
        F.col("url").alias("page_url"), F.posexplode_outer("anchors").alias("pos", "link")
    )
    return exploded.filter("link IS NOT NULL").select(
        "page_url",
        "pos",
        F.col("link.attrs")["href"].alias("href"),
        F.lower("link.text").alias("text"),
        F.col("link.target").alias("full_url"),
    )


def followed_links(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per homepage: ``contact`` and ``additional`` URLs in visiting order, and ``mailto`` e-mails.

    The contact cap is applied before self links are dropped, the additional cap after.
    """
    home = normalize_url(F.col("url"))

    def is_contact(link):
        return contains_any(F.lower(link["text"]), fv.CONTACT_KEYWORDS) | contains_any(
            F.lower(link["attrs"]["href"]), fv.CONTACT_KEYWORDS
        )

    def is_additional(link):
        return (
            contains_any(F.lower(link["attrs"]["href"]), fv.ADDITIONAL_TERMS)
            & (link["target"] != home)
            & ~F.array_contains(F.col("contact_all"), link["target"])
        )

    def targets(links):
        return F.transform(links, lambda link: link["target"])

    linked = _with_anchors(pages).withColumn(
        "contact_all", targets(F.filter("anchors", is_contact))
    )
    contact = F.filter(F.slice("contact_all", 1, settings.contact_cap), lambda url: url != home)
    additional = F.slice(targets(F.filter("anchors", is_additional)), 1, settings.additional_cap)
    return linked.select(
        "url",
        "status",
        "fetched_at",
        F.coalesce(contact, _none()).alias("contact"),
        F.coalesce(additional, _none()).alias("additional"),
        F.coalesce(mailto_emails(F.col("anchors")), _none()).alias("mailto"),
    )


def links_by_document(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``followed_links`` of the newest snapshot per document, if its status is not an error."""
    bodies = pages.filter(F.col("url") != "").withColumn(
        "html", F.when(F.col("status") < 400, F.col("html"))
    )
    links = F.struct("contact", "additional", "mailto")
    newest = snapshot_order("url", "contact", "additional", "mailto")
    return (
        followed_links(bodies, settings)
        .groupBy(page_key(F.col("url")).alias("page_key"))
        .agg(F.max_by(links, newest).alias("links"))
        .select("page_key", "links.*")
        .filter((F.size("contact") > 0) | (F.size("additional") > 0) | (F.size("mailto") > 0))
    )


def _with_anchors(pages: DataFrame) -> DataFrame:
    gated = F.when(has_anchor(F.col("html")), F.col("html"))
    elements = page_elements(normalize_url(F.col("url")), gated)
    anchors = F.filter(elements, lambda e: (e["tag"] == "a") & e["attrs"]["href"].isNotNull())
    return pages.withColumn("anchors", anchors).drop("html")


def _none():
    return F.array().cast("array<string>")
