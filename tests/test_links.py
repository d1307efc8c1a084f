from contactloom.operators.admission import admit_pages
from contactloom.operators.links import followed_links, html_elements, page_links
from contactloom.functions.emails import mailto_emails
from contactloom.functions.html import page_elements
from contactloom.functions.urls import page_key
from pyspark.sql import functions as F


def test_page_identity(spark):
    documents = {
        "https://B.org": "https://b.org/", "HTTPS://b.org:443/?#x": "https://b.org/",
        "http://b.org:80/A?": "http://b.org/A", "http://b.org:443/A?Q=/": "http://b.org:443/A?Q=/",
        "https://b.org?q": "https://b.org/?q", "https://Me:x@B.org/": "https://Me:x@B.org/",
        "mailto:A@b.org": "mailto:A@b.org", "": "", None: None,
    }
    rows = spark.createDataFrame([(u,) for u in documents], "url string").select("url", page_key(F.col("url")).alias("key"))
    assert {r["url"]: r["key"] for r in rows.collect()} == documents


def test_elements_and_tolerance(pages):
    html = (
        "<p><A HREF='/a'>One <b>two</a> three<script>if (a</p>) x</script>"
        "<a name=x>no href</a><a href>empty</a><i data-mail=m/><br><a href='/b'>open <a href='/c'>in"
    )
    rows = html_elements(pages(("https://h.org/d/", html))).orderBy("pos").collect()
    got = [(r["tag"], r["attrs"].get("href"), r["text"], r["target"]) for r in rows]
    assert got == [
        ("a", "/a", "One two", "https://h.org/a"),
        ("script", None, "if (a</p>) x", None),
        ("a", "", "empty", "https://h.org/d/"),
        ("i", None, "open in", None),
        ("a", "/b", "open in", "https://h.org/b"),
        ("a", "/c", "in", "https://h.org/c"),
    ]


def test_links_resolve(pages):
    html = "".join(f'<a href="{h}">T&amp;T</a>' for h in ("x", "//o.org/y", "#f", "?q", "mailto:a@b.c", "http://[bad"))
    rows = page_links(pages(("h.org/d/p", html))).orderBy("pos").collect()
    assert [r["full_url"] for r in rows] == [
        "https://h.org/d/x",
        "https://o.org/y",
        "https://h.org/d/p#f",
        "https://h.org/d/p?q",
        "mailto:a@b.c",
        None,
    ]
    assert {r["text"] for r in rows} == {"t&t"}


def follow(pages, html, url="https://h.org/"):
    return followed_links(pages((url, html))).first()


def test_contact_slots_are_taken_before_filtering(pages):
    html = (
        '<a href="/">About</a><a href="mailto:info@h.org">x</a><a href="/contact">c</a>'
        '<a href="/contact">c again</a><a href="/x">Our TEAM</a><a href="/late">help</a>'
    )
    got = follow(pages, html)
    assert got["contact"] == [
        "mailto:info@h.org",
        "https://h.org/contact",
        "https://h.org/contact",
        "https://h.org/x",
    ]
    assert got["mailto"] == ["info@h.org"]


def test_additional_cap_comes_last_and_repeats_count(pages):
    html = (
        '<a href="/?support">home</a><a href="/e1?mail">a</a><a href="/e1?mail">b</a>'
        '<a href="/e2?enquiry">c</a><a href="/e3?email">d</a><a href="/s">help</a>'
        '<a href="/MAIL">e</a>'
    )
    got = follow(pages, html)
    assert got["contact"] == ["https://h.org/?support", "https://h.org/s"]
    assert got["additional"] == ["https://h.org/e1?mail", "https://h.org/e1?mail", "https://h.org/e2?enquiry"]


def test_mailto(spark, pages):
    html = (
        '<a href="mailto: Bob.Stone@h.org ?subject=x">a</a><a href="MAILTO:x@y.org">b</a>'
        '<a href="mailto:nodot@host">c</a><a href="mailto:a@b.org">d</a><a href="mailto:a@b.org">e</a>'
    )
    elements = pages(("u", html)).select(page_elements("url", "html").alias("e"))
    assert elements.select(mailto_emails(F.col("e"))).first()[0] == ["Bob.Stone@h.org", "a@b.org", "a@b.org"]


def test_admission(pages):
    table = pages(
        ("ok", "", 200, "text/html"),
        ("upper", "", 200, "TEXT/HTML; charset=x"),
        ("xhtml", "", 200, "application/xhtml+xml"),
        ("pdf", "", 200, "application/pdf"),
        ("none", "", 200, None),
        ("moved", "", 301, "text/html"),
        ("gone", "", 404, "text/html"),
        ("", "", 200, "text/html"),
        (None, "", 200, "text/html"),
    )
    assert {r["url"] for r in admit_pages(table).collect()} == {"ok", "upper", "xhtml"}
