"""Crawl replay: which pages a run would visit for each business, and the e-mails it collects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.fixed_values import Settings
from contactloom.functions.urls import normalize_url, page_key
from contactloom.operators.emails import emails_by_document
from contactloom.operators.links import links_by_document
from contactloom.operators.robots import robots_access
from contactloom.operators.shared import cut, lookup_join, restrict_to

HOME, CONTACT, ADDITIONAL, MAILTO = range(4)


def with_home(businesses: DataFrame) -> DataFrame:
    """``query, seq, home_url, page_key`` of the businesses that have a website."""
    home = normalize_url(F.col("website"))
    return businesses.filter(F.col("website") != "").select(
        "query", "seq", home.alias("home_url"), page_key(home).alias("page_key")
    )


def first_visits(
    businesses: DataFrame, home_links: DataFrame, scope: Sequence[str] = ("query",)
) -> DataFrame:
    """Visits that read a page: per URL in scope only the first one in run order.

    Businesses sharing a homepage have the same links, so only the first of them can read any page;
    the others are dropped before the links are attached. Both steps are minima, which combine
    before the shuffle, so a homepage or target that very many rows share stays cheap.
    """
    scope = list(scope)
    firsts = (
        with_home(businesses)
        .groupBy(*scope, "home_url", "page_key")
        .agg(F.min(F.struct("query", "seq")).alias("owner"))
    )

    def step(phase, urls):
        return F.transform(
            urls,
            lambda url, pos: F.struct(
                F.lit(phase).alias("phase"), pos.alias("pos"), normalize_url(url).alias("url")
            ),
        )

    none = F.array().cast("array<struct<phase int, pos int, url string>>")
    planned = lookup_join(firsts, home_links, ["page_key"], costly=True).select(
        *scope,
        "owner",
        F.explode(
            F.concat(
                step(HOME, F.array("home_url")),
                F.coalesce(step(CONTACT, F.col("contact")), none),
                F.coalesce(step(ADDITIONAL, F.col("additional")), none),
            )
        ).alias("visit"),
    )
    order = F.struct("owner.query", "owner.seq", "visit.phase", "visit.pos")
    keys = dict.fromkeys([*scope, "visit_url"])
    return (
        planned.filter("visit.url IS NOT NULL")
        .withColumn("visit_url", F.col("visit.url"))
        .groupBy(*keys)
        .agg(F.min(order).alias("first"))
        .select("first.query", "first.seq", "first.phase", "first.pos", "visit_url")
    )


def replay_crawl(
    businesses: DataFrame,
    pages: DataFrame,
    robots: DataFrame | None = None,
    settings: Settings = Settings(),
    scope: Sequence[str] = ("query",),
) -> DataFrame:
    """``query, seq, email_addresses`` for every business that has a website.

    Page bodies are read twice, once for links and once for e-mails, and reduced to short arrays
    where they are read; only those arrays are shuffled.
    """
    homes = with_home(businesses)
    wanted = homes.select("page_key").distinct()
    key = page_key(F.col("url"))
    home_links = cut(
        links_by_document(restrict_to(pages, key, wanted, "page_key"), settings)
    )
    visits = cut(
        first_visits(businesses, home_links, scope).withColumn(
            "page_key", page_key(F.col("visit_url"))
        )
    )
    if robots is not None:
        visits = robots_access(visits, robots, settings.robots_agent, "visit_url").filter(
            F.col("access").isin(*settings.keep_access)
        )
    bodies = restrict_to(pages, key, visits.select("page_key").distinct(), "page_key")
    read = lookup_join(
        visits, emails_by_document(bodies, settings), ["page_key"], "inner"
    ).select("query", "seq", "phase", "pos", "emails")
    direct = lookup_join(homes, home_links.filter(F.size("mailto") > 0), ["page_key"], "inner")
    direct = direct.select(
        "query",
        "seq",
        F.lit(MAILTO).alias("phase"),
        F.lit(0).alias("pos"),
        F.col("mailto").alias("emails"),
    )
    parts = F.sort_array(F.collect_list(F.struct("phase", "pos", "emails")))

    def emails_of(keep):
        return F.flatten(F.transform(F.filter("parts", keep), lambda p: p["emails"]))

    from_pages = F.array_distinct(emails_of(lambda p: p["phase"] != MAILTO))
    from_mailto = emails_of(lambda p: p["phase"] == MAILTO)
    together = F.concat(from_pages, from_mailto)
    if settings.distinct_mailto:
        together = F.array_distinct(together)
    # at most nine page visits and one mailto list per business
    collected = (
        read.unionByName(direct)
        .groupBy("query", "seq")
        .agg(parts.alias("parts"))
        .select("query", "seq", together.alias("email_addresses"))
    )
    return homes.select("query", "seq").join(collected, ["query", "seq"], "left").select(
        "query",
        "seq",
        F.coalesce("email_addresses", F.array().cast("array<string>")).alias("email_addresses"),
    )
