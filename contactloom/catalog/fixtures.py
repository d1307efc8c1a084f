"""Inputs of the registered queries, derived from whole tables.

The raw pages have plain e-mails and navigation links only, so every page gets a markup suffix that
depends on its id and a place in a small web site. The formulas are SQL that Spark and the checking
engine read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.sources import spread

_HOST = "'site' || CAST(s AS STRING) || '.example.com'"

_URL = """
CASE k
  WHEN 0 THEN 'https://' || h || '/'
  WHEN 1 THEN 'https://' || h || '/contact-us'
  WHEN 2 THEN 'https://' || h || '/about.html'
  WHEN 3 THEN 'https://' || h || '/team/staff'
  WHEN 4 THEN 'https://' || h || '/news/4?mail=1'
  WHEN 5 THEN 'https://' || h || '/help'
  WHEN 6 THEN 'https://' || h || '/support/ticket'
  WHEN 7 THEN 'https://' || h || '/shop/7?email=x'
  WHEN 8 THEN 'https://' || h || '/info'
  ELSE 'https://' || h || '/p/9?enquiry=1'
END"""

_MAIL = """
CASE (i + s) % 10
  WHEN 0 THEN '<p>info@' || h || '</p>'
  WHEN 1 THEN '<p>jane.roe@' || h || '</p>'
  WHEN 2 THEN '<p>jane.roe@' || h || ', sales-eu@' || h || '</p>'
  WHEN 3 THEN '<p>office [at] ' || h || ' or help(at)' || h || ' or hr at ' || h || '</p>'
  WHEN 4 THEN '<p>team@site' || CAST(s AS STRING) || ' [dot] com, jobs@site dot org</p>'
  WHEN 5 THEN '<p>desk&#64;site' || CAST(s AS STRING) || '&#46;com, shop &#064; site &#046; org, '
    || 'none&#00064;site&#00046;org</p>'
  WHEN 6 THEN '<script>var m="hr' || chr(92) || 'u0040site' || CAST(s AS STRING) || chr(92)
    || 'u002Ecom", n="ads' || chr(92) || 'x40site' || chr(92) || 'x2Eorg";</script>'
  WHEN 7 THEN '<b data-user="web" data-domain="' || h || '">x</b>'
    || '<i data-mail="ops [at] ' || h || ' [dot] uk">y</i>'
  WHEN 8 THEN '<a href="mailto:Bob.Stone@' || h || '?subject=x">Bob</a>'
  ELSE ''
END"""

_NAV = """
CASE WHEN k = 0 THEN
  '<a href="/contact-us">Contact us</a>'
  || '<a href="mailto:info@' || h || '?subject=hi">Write</a>'
  || '<a href="/">Company</a>'
  || '<a href="about.html">ABOUT</a>'
  || '<a href="/team/staff#people">Our people</a>'
  || '<a href="/help#faq">Questions</a>'
  || '<a href="/news/4?mail=1">News</a>'
  || '<a href="//' || h || '/support/ticket">Tickets</a>'
  || '<a href="/shop/7?email=x">Shop</a>'
  || '<a href="/p/9?enquiry=1">Ask</a>'
  || '<a href="/p/9?inquiry=2">Ask again</a>'
ELSE '' END"""

_STATUS = "CASE WHEN i % 37 = 5 THEN 404 WHEN i % 41 = 20 THEN 301 ELSE 200 END"
_TYPE = """
CASE WHEN i % 43 = 9 THEN NULL WHEN i % 31 = 7 THEN 'application/pdf'
  WHEN i % 5 = 1 THEN 'TEXT/HTML; charset=utf-8' WHEN i % 5 = 2 THEN 'application/xhtml+xml'
  ELSE 'text/html' END"""

_SITE = """
CASE k
  WHEN 0 THEN h || '/'
  WHEN 1 THEN 'https://' || h || '/'
  WHEN 2 THEN NULL
  WHEN 3 THEN ''
  WHEN 4 THEN 'https://' || h || '/contact-us'
  ELSE u
END"""

_ROBOTS = """
CASE s % 5
  WHEN 2 THEN 'User-agent: *' || chr(10) || 'Disallow: /contact' || chr(10) || 'Disallow: /shop'
  WHEN 3 THEN '# rules' || chr(10) || 'User-agent: OtherBot' || chr(10) || 'Disallow: /' || chr(10)
    || chr(10) || 'User-agent: *' || chr(10) || 'Allow: /shop/7' || chr(10)
    || 'Disallow: /shop # all others' || chr(10) || 'Disallow: /support' || chr(10) || 'Disallow:'
  WHEN 4 THEN 'Disallow: /' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /p/' || chr(10)
    || 'Disallow: /news/4?mail'
  ELSE 'User-agent: *' || chr(10) || 'Disallow: /'
END"""
_ROBOTS_STATUS = "CASE s % 5 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END"

_ROBOTS_SQL = f"""
SELECT 'https://' || h AS base_url, {_ROBOTS_STATUS} AS status, {_ROBOTS} AS body
FROM placed WHERE k = 0"""

_DUPES_SQL = """
SELECT 'q' || CAST(c_nationkey AS STRING) AS query, c_custkey AS seq, c_name AS name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN ''
    WHEN c_custkey % 2 = 0 THEN 'https://WWW.Shop' || CAST(c_custkey * 31 % 211 AS STRING) || '.com'
    ELSE 'https://www.shop' || CAST(c_custkey * 31 % 211 AS STRING) || '.com' END AS website,
  CASE WHEN c_custkey % 5 = 0 THEN NULL
    WHEN c_custkey % 3 = 0 THEN '(0' || CAST(c_custkey * 17 % 173 AS STRING) || ') 555-01'
    WHEN c_custkey % 3 = 1 THEN '0' || CAST(c_custkey * 17 % 173 AS STRING) || ' 555 01'
    ELSE '0' || CAST(c_custkey * 17 % 173 AS STRING) || '55501' END AS phone_number
FROM customer"""


def _steps() -> list[tuple[str, str]]:
    """Named steps from ``pages`` to the decorated tables."""
    return [
        (
            "numbered",
            "SELECT page_id AS i, CAST(FLOOR(page_id / 10) AS BIGINT) AS s, page_id % 10 AS k, "
            "url AS raw_url, html AS raw FROM pages",
        ),
        ("hosted", f"SELECT *, {_HOST} AS h FROM numbered"),
        ("placed", f"SELECT *, {_URL} AS u FROM hosted"),
        (
            "deco",
            f"SELECT i, s, k, h, u AS url, {_STATUS} AS status, {_TYPE} AS content_type, "
            f"raw || {_NAV} || {_MAIL} AS html FROM placed",
        ),
        (
            "biz",
            "SELECT 'q' || CAST(s % 4 AS STRING) AS query, i AS seq, "
            "'Business ' || CAST(i AS STRING) AS name, "
            f"{_SITE} AS website, CAST(NULL AS STRING) AS phone_number FROM placed",
        ),
        ("robots", _ROBOTS_SQL),
        ("dupes", _DUPES_SQL),
    ]


def with_clause(last: str) -> str:
    """The steps up to ``last`` as common table expressions."""
    steps = _steps()
    end = [name for name, _ in steps].index(last) + 1
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({sql})" for name, sql in steps[:end])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the steps as a DataFrame; all of them are projections of a single table."""
    source = "customer" if name == "dupes" else "pages"
    steps = ", ".join(f"{step} AS ({sql})" for step, sql in _steps()
                      if (step == "dupes") == (name == "dupes"))
    return spark.sql(
        f"WITH {source} AS (SELECT * FROM {{src}}), {steps} SELECT * FROM {name}",
        src=table(spark, sf_dir, source),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(derived(spark, sf_dir, "deco")).withColumn("fetched_at", F.lit(None).cast("timestamp"))
