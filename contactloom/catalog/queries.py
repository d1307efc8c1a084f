"""Registered queries: one per operator, each over the whole tables of a test-data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom import schemas
from contactloom.catalog import fixtures as fx
from contactloom.fixed_values import Settings
from contactloom.functions import (
    base_url,
    is_business_email,
    normalize_url,
    page_key,
    url_path,
)
from contactloom.functions.emails import mailto_emails
from contactloom.functions.html import page_elements
from contactloom.operators import dedupe, history, listings, report
from contactloom.operators.admission import admit_pages
from contactloom.operators.emails import extract_emails, page_emails
from contactloom.operators.links import followed_links, html_elements, page_links
from contactloom.operators.robots import robots_access, robots_rules
from contactloom.operators.shared import shared_folder
from contactloom.operators.similarity_join import similar_pairs
from contactloom.plans import find_businesses, first_visits, replay_crawl, run_contacts
from contactloom.plans.crawl import links_by_document
from contactloom.sinks import save, update_history, with_output_names, write_csv, write_json
from contactloom.sources import search_plan, spread, with_page_defaults
from contactloom.streaming import (
    first_listings_writer,
    first_page_visits,
    handled_sites_writer,
    read_first_listings,
)

RUN_EPOCH = 1_700_000_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_page_defaults(spread(fx.table(spark, sf_dir, "pages")))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(fx.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _joined(column: str):
    return F.array_join(column, " ")


# --- sources and projections ------------------------------------------------------------------


@register
def site_contacts(spark, sf_dir):
    """Flagship: contacts per site over all pages and channels."""
    emails = page_emails(admit_pages(fx.pages(spark, sf_dir))).select(
        base_url(F.col("url")).alias("site"), F.explode_outer("emails").alias("email"), "url"
    )
    return emails.groupBy("site").agg(
        F.countDistinct("url").alias("pages"),
        F.countDistinct("email").alias("emails"),
        F.countDistinct(F.when(is_business_email(F.col("email")), F.col("email"))).alias("business"),
    )


@register
def page_admission(spark, sf_dir):
    return admit_pages(fx.pages(spark, sf_dir)).select("url", "status", "content_type")


@register
def search_urls(spark, sf_dir):
    texts = fx.table(spark, sf_dir, "conversations").select(F.col("text").alias("query"))
    return search_plan(texts)


@register
def url_parts(spark, sf_dir):
    url = F.col("url")
    return fx.table(spark, sf_dir, "pages").select(
        "page_id",
        base_url(url).alias("base"),
        url_path(url).alias("path"),
        page_key(url).alias("document"),
    )


@register
def website_normalized(spark, sf_dir):
    return fx.derived(spark, sf_dir, "biz").filter("website <> ''").select(
        "seq", normalize_url(F.col("website")).alias("url")
    )


# --- e-mail channels --------------------------------------------------------------------------


@register
def emails_plain_pages(spark, sf_dir):
    found = extract_emails(_raw_pages(spark, sf_dir), keep=("page_id",))
    return found.filter("channel_ord = 1").select("page_id", "pos", "email")


@register
def emails_plain_documents(spark, sf_dir):
    found = extract_emails(_documents(spark, sf_dir), "text", ("doc_id",), elements=False)
    return found.filter("channel_ord = 1").select("doc_id", "pos", "email")


@register
def emails_obfuscated_documents(spark, sf_dir):
    found = extract_emails(_documents(spark, sf_dir), "text", ("doc_id",), elements=False)
    return found.filter("channel_ord > 1").select("doc_id", "channel_ord", "email")


def _channel(number: int) -> Query:
    def query(spark, sf_dir):
        found = extract_emails(fx.pages(spark, sf_dir), keep=("i",))
        return found.filter(F.col("channel_ord") == number).select("i", "email")

    return query


QUERIES["emails_at_marker"] = _channel(2)
QUERIES["emails_dot_marker"] = _channel(3)
QUERIES["emails_entities"] = _channel(4)
QUERIES["emails_escapes"] = _channel(5)
QUERIES["emails_user_domain"] = _channel(6)
QUERIES["emails_masked_attributes"] = _channel(7)


@register
def emails_all_channels(spark, sf_dir):
    return extract_emails(fx.pages(spark, sf_dir), keep=("i",))


@register
def emails_mailto(spark, sf_dir):
    elements = fx.pages(spark, sf_dir).select("i", page_elements("url", "html").alias("elements"))
    return elements.select("i", F.posexplode(mailto_emails(F.col("elements"))).alias("pos", "email"))


@register
def emails_script_concat(spark, sf_dir):
    """Every page gets a script that builds an address from pieces; needs the opt-in channel."""
    pages = fx.pages(spark, sf_dir).withColumn(
        "html",
        F.expr("html || '<script>var e=\\'u' || i || '\\' + \"@\" + \"shop\" + \".org\"</script>'"),
    )
    found = extract_emails(pages, keep=("i",), settings=Settings(js_concat=True))
    return found.filter("channel_ord = 8").select("i", "email")


@register
def business_rule(spark, sf_dir):
    found = extract_emails(fx.pages(spark, sf_dir), keep=("i",)).select("email").distinct()
    return found.select("email", is_business_email(F.col("email")).alias("business"))


@register
def page_fallback(spark, sf_dir):
    return page_emails(fx.pages(spark, sf_dir)).select("i", _joined("emails").alias("emails"))


# --- links ------------------------------------------------------------------------------------


@register
def element_list(spark, sf_dir):
    found = html_elements(_raw_pages(spark, sf_dir))
    return found.select("page_url", "pos", "tag", F.col("attrs")["href"].alias("href"), "text")


@register
def link_list(spark, sf_dir):
    return page_links(_raw_pages(spark, sf_dir))


@register
def contact_links(spark, sf_dir):
    links = followed_links(fx.pages(spark, sf_dir))
    return links.select("url", F.posexplode("contact").alias("pos", "target"))


@register
def additional_links(spark, sf_dir):
    links = followed_links(fx.pages(spark, sf_dir))
    return links.select("url", F.posexplode("additional").alias("pos", "target"))


# --- crawl replay -----------------------------------------------------------------------------


@register
def visits_first(spark, sf_dir):
    links = links_by_document(fx.pages(spark, sf_dir))
    return first_visits(fx.derived(spark, sf_dir, "biz"), links)


@register
def robots_rule_list(spark, sf_dir):
    return robots_rules(fx.derived(spark, sf_dir, "robots"))


@register
def robots_labels(spark, sf_dir):
    urls = fx.derived(spark, sf_dir, "deco").select("url")
    return robots_access(urls, fx.derived(spark, sf_dir, "robots"))


@register
def crawl_emails(spark, sf_dir):
    found = replay_crawl(fx.derived(spark, sf_dir, "biz"), fx.pages(spark, sf_dir))
    return found.select("query", "seq", _joined("email_addresses").alias("emails"))


@register
def crawl_emails_robots(spark, sf_dir):
    found = replay_crawl(
        fx.derived(spark, sf_dir, "biz"),
        fx.pages(spark, sf_dir),
        fx.derived(spark, sf_dir, "robots"),
    )
    return found.select("query", "seq", _joined("email_addresses").alias("emails"))


# --- listings ---------------------------------------------------------------------------------


def _place_listings(spark, sf_dir):
    """Every page as an opened listing; the title suffix and place URL follow the id."""
    return spread(fx.table(spark, sf_dir, "pages")).select(
        F.expr("'q' || CAST(page_id % 25 AS STRING)").alias("query"),
        F.col("page_id").alias("seq"),
        F.expr(
            "CASE page_id % 4 WHEN 0 THEN 'https://maps.example.com/maps/place/shop+no%2E+' "
            "|| page_id || '/@1' WHEN 1 THEN 'https://maps.example.com/maps/place/results/x' "
            "ELSE url END"
        ).alias("place_url"),
        F.concat(
            F.regexp_extract("html", "<title>([^<]*)</title>", 1),
            F.expr("CASE page_id % 3 WHEN 0 THEN ' - Google Maps' ELSE '' END"),
        ).alias("title"),
        "html",
    )


@register
def names_from_url(spark, sf_dir):
    rows = _place_listings(spark, sf_dir)
    return rows.select("seq", listings.name_from_place_url(F.col("place_url")).alias("name"))


@register
def names_from_title(spark, sf_dir):
    rows = _place_listings(spark, sf_dir)
    return rows.select("seq", listings.name_from_title(F.col("title")).alias("name"))


@register
def names_from_domain(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "pages")
    return rows.select("page_id", listings.name_from_domain(F.col("url")).alias("name"))


@register
def external_links(spark, sf_dir):
    rows = page_links(_raw_pages(spark, sf_dir))
    return rows.filter(listings.is_external_link(F.col("full_url"), "example.net")).select(
        "page_url", "pos", "full_url"
    )


@register
def phones_first_match(spark, sf_dir):
    rows = _documents(spark, sf_dir)
    return rows.select("doc_id", listings.first_phone(F.col("text")).alias("phone"))


@register
def blocked_searches(spark, sf_dir):
    """Some listings serve as results pages, and some of those get challenge markup. The same markup
    on all other listings changes nothing."""
    marked = F.concat("html", F.lit('<div class="g-ReCaptcha">'))
    rows = _place_listings(spark, sf_dir)
    results = rows.filter("seq % 10 = 7").select(
        "query", F.when(F.expr("seq % 50 = 7"), marked).otherwise(F.col("html")).alias("html")
    )
    fields = listings.listing_fields(rows.withColumn("html", marked), RUN_EPOCH)
    return listings.drop_blocked_searches(fields, results).select("query", "seq")


@register
def listing_records(spark, sf_dir):
    fields = listings.listing_fields(_place_listings(spark, sf_dir), RUN_EPOCH)
    return fields.filter("error IS NULL").drop("error")


@register
def result_cards(spark, sf_dir):
    """The raw pages with their article elements marked as cards, or given the alternative class."""
    rows = _place_listings(spark, sf_dir).select(
        F.col("seq").cast("string").alias("query"),
        F.expr(
            "CASE WHEN seq % 2 = 0 THEN replace(html, '<div class=\"ad\">', '<div role=\"article\">') "
            "ELSE replace(html, '<div class=\"ad\">', '<div class=\"Nv2PK x\">') END"
        ).alias("html"),
    )
    return listings.result_listings(rows)


# --- duplicates -------------------------------------------------------------------------------


def _dupes(spark, sf_dir):
    return fx.derived(spark, sf_dir, "dupes")


@register
def dedupe_website(spark, sf_dir):
    return dedupe.dedupe_businesses(_dupes(spark, sf_dir), ("website",))


@register
def dedupe_phone(spark, sf_dir):
    return dedupe.dedupe_businesses(_dupes(spark, sf_dir), ("phone",))


@register
def dedupe_greedy(spark, sf_dir):
    return dedupe.dedupe_businesses(_dupes(spark, sf_dir), ("website", "phone"))


def _addressed(spark, sf_dir):
    """Parts as listings of their brand: repeated names, addresses of varying likeness."""
    return fx.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("query"),
        F.col("p_partkey").alias("seq"),
        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"),
        F.lit(None).cast("string").alias("website"),
        F.lit(None).cast("string").alias("phone_number"),
        F.concat(
            F.col("p_size"), F.lit(" "), F.col("p_type"), F.lit(" street, block "),
            (F.col("p_partkey") * 7919) % 1000,
        ).alias("address"),
    )


@register
def similar_businesses(spark, sf_dir):
    return similar_pairs(_addressed(spark, sf_dir))


@register
def dedupe_similarity(spark, sf_dir):
    return dedupe.dedupe_businesses(_addressed(spark, sf_dir)).select("query", "seq", "name", "address")


# --- history, caps and reports ----------------------------------------------------------------


def _known(spark, sf_dir):
    """History: sites that are a help or ticket page."""
    sites = fx.derived(spark, sf_dir, "biz").select("website")
    return sites.filter("website LIKE '%/help' OR website LIKE '%/ticket'")


@register
def skip_known(spark, sf_dir):
    marked = history.mark_known(fx.derived(spark, sf_dir, "biz"), _known(spark, sf_dir))
    return marked.select("query", "seq", "website", "skipped")


@register
def history_merged(spark, sf_dir):
    return history.merged_history(fx.derived(spark, sf_dir, "biz"), _known(spark, sf_dir))


@register
def top_per_query(spark, sf_dir):
    return report.top_businesses(_dupes(spark, sf_dir), 20)


@register
def numbered_results(spark, sf_dir):
    return report.number_rows(_dupes(spark, sf_dir)).select("query", "seq", "number")


def _contacts(spark, sf_dir):
    """Businesses with the e-mails of their own page, without a crawl."""
    found = page_emails(fx.pages(spark, sf_dir)).select(F.col("i").alias("seq"), "emails")
    joined = fx.derived(spark, sf_dir, "biz").join(found, "seq")
    return joined.select(
        "query",
        "seq",
        F.concat("name", F.lit(', "ünï"')).alias("name"),
        "website",
        "phone_number",
        F.col("emails").alias("email_addresses"),
        F.expr("seq % 9 = 0").alias("skipped"),
    )


@register
def summary_lines(spark, sf_dir):
    return report.contact_summary(_contacts(spark, sf_dir)).drop("name")


@register
def query_counts(spark, sf_dir):
    return report.run_counts(_contacts(spark, sf_dir))


@register
def combined_results(spark, sf_dir):
    """Crawled rows lack the flag, skipped rows lack the phone number."""
    rows = _contacts(spark, sf_dir).drop("email_addresses")
    crawled = rows.filter("NOT skipped").drop("skipped")
    skipped = rows.filter("skipped").drop("phone_number")
    return report.combine_results(crawled, skipped)


@register
def flat_contacts(spark, sf_dir):
    return report.flatten_contacts(_contacts(spark, sf_dir))


@register
def output_names(spark, sf_dir):
    texts = fx.table(spark, sf_dir, "conversations").select(F.col("text").alias("query"))
    return with_output_names(texts, "2024-01-01_00-00-00")


@register
def json_read_back(spark, sf_dir):
    folder = _new_folder(spark, "json")
    write_json(_contacts(spark, sf_dir), folder)
    back = spark.read.schema(schemas.CONTACTS).json(folder)
    return back.withColumn("email_addresses", _joined("email_addresses"))


@register
def csv_read_back(spark, sf_dir):
    folder = _new_folder(spark, "csv")
    write_csv(_contacts(spark, sf_dir), folder)
    schema = schemas.CONTACTS.replace("array<string>", "string")
    back = spark.read.schema(schema).option("header", True).option("escape", '"').csv(folder)
    return back.select("query", "seq", "name", "email_addresses", "skipped")


@register
def all_formats(spark, sf_dir):
    """JSON and CSV rows and Excel queries after one fan-out; tests read the workbooks back."""
    paths = save(_contacts(spark, sf_dir), _new_folder(spark, "all"), stamp="2024-01-01_00-00-00")
    json = spark.read.json(paths["json"]).select(F.lit("json").alias("format"))
    csv = spark.read.option("header", True).option("escape", '"').csv(paths["csv"])
    hashes = F.regexp_extract("path", r"([0-9a-f]{8})_[^/]*\.xlsx", 1)
    books = spark.read.format("binaryFile").load(paths["excel"]).select(hashes).distinct()
    together = json.unionAll(csv.select(F.lit("csv"))).unionAll(books.select(F.lit("excel")))
    return together.groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@register
def history_written(spark, sf_dir):
    """Two runs over the same sites: the second adds nothing."""
    folder = _new_folder(spark, "history")
    sites = fx.derived(spark, sf_dir, "biz")
    update_history(sites, folder)
    update_history(sites, folder)
    return spark.read.parquet(folder).groupBy("website").agg(F.count(F.lit(1)).alias("rows"))


# --- whole runs -------------------------------------------------------------------------------


@register
def contact_run(spark, sf_dir):
    contacts = run_contacts(
        fx.derived(spark, sf_dir, "biz"),
        fx.pages(spark, sf_dir),
        fx.derived(spark, sf_dir, "robots"),
        _known(spark, sf_dir),
    )
    return report.flatten_contacts(contacts)


@register
def search_run(spark, sf_dir):
    """Listings to capped, de-duplicated businesses."""
    return find_businesses(
        _place_listings(spark, sf_dir), RUN_EPOCH, ("website", "phone"), Settings(business_cap=8)
    )


# --- streams ----------------------------------------------------------------------------------


def _page_stream(spark, sf_dir):
    folder = _new_folder(spark, "pages-in")
    fx.pages(spark, sf_dir).withColumn(
        "fetched_at", F.timestamp_seconds(F.lit(RUN_EPOCH) + F.col("i"))
    ).select("url", "status", "content_type", "html", "fetched_at").write.parquet(folder)
    return spark.readStream.schema(schemas.PAGES).parquet(folder)


@register
def stream_site_emails(spark, sf_dir):
    out, seen, state = (_new_folder(spark, name) for name in ("emails", "sites", "state"))
    writer = handled_sites_writer(_page_stream(spark, sf_dir), out, seen, state)
    writer.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out)
    return found.select("website", "url", _joined("emails").alias("emails"))


@register
def stream_first_visits(spark, sf_dir):
    """Events as page visits: the first one per user and type within the watermark."""
    folder = _new_folder(spark, "events-in")
    events = fx.table(spark, sf_dir, "events").select(
        F.concat_ws("/", "user_id", "event_type").alias("url"), F.col("ts").alias("fetched_at")
    )
    events.write.parquet(folder)
    stream = spark.readStream.schema("url string, fetched_at timestamp").parquet(folder)
    out, state = _new_folder(spark, "visits"), _new_folder(spark, "state")
    first_page_visits(stream, "3650 days").writeStream.format("parquet").option(
        "checkpointLocation", state
    ).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("url")


@register
def stream_first_listings(spark, sf_dir):
    folder = _new_folder(spark, "listings-in")
    rows = _dupes(spark, sf_dir).select("query", "seq", "website")
    rows.write.parquet(folder)
    stream = spark.readStream.schema("query string, seq bigint, website string").parquet(folder)
    out, state = _new_folder(spark, "first"), _new_folder(spark, "state")
    writer = first_listings_writer(stream, out, state)
    writer.trigger(availableNow=True).start().awaitTermination()
    return read_first_listings(spark.read.parquet(out))
