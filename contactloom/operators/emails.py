"""E-mail extraction: one narrow pass over page bodies, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.fixed_values import Settings
from contactloom.functions import emails as e
from contactloom.functions.html import needs_attributes, page_elements
from contactloom.functions.urls import page_key
from contactloom.operators.admission import is_html, snapshot_order

HITS = "array<struct<channel int, email string>>"


def text_channels(text: Column, settings: Settings = Settings()) -> Column:
    """Hits of the five text channels, in channel order."""
    channels = F.array(
        e.plain_emails(text),
        e.at_marker_emails(text, settings.strict_words),
        e.dot_marker_emails(text, settings.strict_words),
        e.entity_emails(text, settings.lenient_entities),
        e.escape_emails(text),
    )
    tagged = F.transform(channels, lambda found, n: _tag(found, n + 1))
    return F.filter(F.flatten(tagged), lambda hit: e.has_email_shape(hit["email"]))


def gated_elements(html: Column, settings: Settings = Settings()) -> Column:
    """Parsed elements of the pages whose attributes, or scripts if asked for, may hold e-mails."""
    gate = needs_attributes(html)
    if settings.js_concat:
        gate = gate | html.rlike("<[sS](?i:cript)")
    return page_elements(F.lit(None).cast("string"), F.when(gate, html))


def element_channels(elements: Column, settings: Settings = Settings()) -> Column:
    """Hits of attributes and, if asked for, of scripts."""
    hits = e.attribute_emails(elements)
    if settings.js_concat:
        hits = F.concat(hits, _tag(e.script_emails(elements), F.lit(8)))
    return F.coalesce(hits, F.array().cast(HITS))


def with_hits(
    df: DataFrame, column: str, settings: Settings = Settings(), elements: bool = True
) -> DataFrame:
    """Add ``hits``: every e-mail found in ``column``, in channel order, repeats kept."""
    found = text_channels(F.col(column), settings)
    if not elements:
        return df.withColumn("hits", found)
    parsed = df.withColumn("_elements", gated_elements(F.col(column), settings))
    both = F.concat(found, element_channels(F.col("_elements"), settings))
    return parsed.withColumn("hits", both).drop("_elements")


def extract_emails(
    df: DataFrame,
    column: str = "html",
    keep: tuple[str, ...] = ("url",),
    settings: Settings = Settings(),
    elements: bool = True,
) -> DataFrame:
    """One row per e-mail found: the kept columns, channel, position in the page, e-mail."""
    hits = with_hits(df.select(*keep, column), column, settings, elements)
    # the outer form keeps the optimizer from testing, and so computing, the hits a second time
    exploded = hits.select(*keep, F.posexplode_outer("hits").alias("pos", "hit"))
    return exploded.filter("hit IS NOT NULL").select(
        *keep, F.col("hit.channel").alias("channel_ord"), "pos", F.col("hit.email").alias("email")
    )


def page_emails(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per page: distinct e-mails in first-found order, business ones if there are any."""
    hits = with_hits(pages, "html", settings)
    emails = F.array_distinct(F.transform("hits", lambda hit: hit["email"]))
    return hits.withColumn("emails", emails).withColumn(
        "emails", e.business_or_all(F.col("emails"), settings.business_prefixes)
    ).drop("hits", "html")


def emails_by_document(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``page_key, emails`` for every document whose newest snapshot is admitted and has any."""
    admitted = F.coalesce((F.col("status") == 200) & is_html(F.col("content_type")), F.lit(False))
    bodies = pages.filter(F.col("url") != "").select(
        "url", "fetched_at", "status", F.when(admitted, F.col("html")).alias("html")
    )
    found = page_emails(bodies, settings)
    newest = snapshot_order("url", "emails")
    return (
        found.groupBy(page_key(F.col("url")).alias("page_key"))
        .agg(F.max_by("emails", newest).alias("emails"))
        .filter(F.size("emails") > 0)
    )


def _tag(found: Column, channel: Column) -> Column:
    return F.transform(found, lambda email: F.struct(channel.alias("channel"), email.alias("email")))
