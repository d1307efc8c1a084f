"""The crawl plan against a plain sequential walk over small random sites."""

import random
from urllib.parse import urldefrag

import pytest

import contactloom.plans.crawl as crawl_module
from contactloom import Settings
from contactloom.operators import shared
from contactloom.operators.emails import page_emails
from contactloom.operators.links import followed_links
from contactloom.plans import replay_crawl, run_contacts

BIZ = "query string, seq bigint, name string, website string, phone_number string"


def normal(url):
    return url if not url or url.startswith(("http://", "https://")) else "https://" + url


def walk(businesses, page_rows, per_page, links, denied=()):
    """One crawl per query, businesses in order, every URL read at most once."""
    key = lambda url: urldefrag(url)[0]
    result, visited = {}, {}
    for query, seq, _, website, _ in sorted(businesses):
        if not website:
            continue
        seen = visited.setdefault(query, set())
        home = normal(website)

        def read(url):
            url = normal(url)
            if url in seen:
                return []
            seen.add(url)
            if url in denied:
                return []
            return per_page.get(key(url), [])

        emails = list(read(home))
        contact, additional, mailto = links.get(key(home), ([], [], []))
        for url in [*contact, *additional]:
            emails += [e for e in read(url) if e not in emails]
        result[(query, seq)] = emails + mailto
    return result


def random_site(rng, pages):
    urls = [f"https://s{n}.org/{p}" for n in range(4) for p in ("", "contact", "about", "x?mail", "z")]
    rows = []
    for url in urls:
        hrefs = rng.choices(
            [*urls, "contact#f", "/about", "mailto:info@m.org", "/gone/help", "#contact"], k=rng.randint(0, 9)
        )
        html = "".join(f'<a href="{h}">{rng.choice(["team", "news"])}</a>' for h in hrefs)
        html += " ".join(rng.choices(["a.bc@x.org", "info@x.org", "b@y.org", "jo.doe@z.org", "-"], k=3))
        rows.append((url, html, rng.choice([200, 200, 200, 301, 404])))
    return pages(*rows)


def facts(table):
    from contactloom.operators.admission import admit_pages, readable_homepages

    per_page = {r["url"]: r["emails"] for r in page_emails(admit_pages(table)).collect()}
    links = {
        r["url"]: (r["contact"], r["additional"], r["mailto"])
        for r in followed_links(readable_homepages(table)).collect()
    }
    return per_page, links


def businesses_for(rng, n=16):
    sites = [f"https://s{k}.org/" for k in range(4)] + ["s1.org/", "https://s2.org/contact", None, "", "https://no.org/"]
    return [(rng.choice("qr"), seq, f"b{seq}", rng.choice(sites), None) for seq in range(n)]


@pytest.mark.parametrize("seed, mode", [(0, "small"), (1, "small"), (2, "large and hot")])
def test_replay_agrees_with_the_walk(spark, pages, monkeypatch, seed, mode):
    rng = random.Random(seed)
    table, rows = random_site(rng, pages), businesses_for(rng)
    if mode != "small":
        monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)

        def hot(left, right, keys, how="left", **_):
            return shared.lookup_join(left, right, keys, how, min_rows=0, share=1 / 8)

        monkeypatch.setattr(crawl_module, "lookup_join", hot)
    got = {
        (r["query"], r["seq"]): r["email_addresses"]
        for r in replay_crawl(spark.createDataFrame(rows, BIZ), table).collect()
    }
    assert got == walk(rows, table, *facts(table))


def test_second_business_on_a_site_gets_only_mailto(spark, pages):
    table = pages(("https://h.org/", 'info@h.org <a href="mailto:Bob.Stone@h.org">m</a>'))
    rows = [("q", n, "n", "https://h.org", None) for n in (1, 2)]
    df = spark.createDataFrame(rows, BIZ)
    got = {r["seq"]: r["email_addresses"] for r in replay_crawl(df, table).collect()}
    # the mailto address is plain text of the page as well, but not a business one
    assert got == {1: ["info@h.org", "Bob.Stone@h.org"], 2: ["Bob.Stone@h.org"]}
    other = spark.createDataFrame([("q", 1, "n", "h.org/", None), ("r", 2, "n", "h.org/", None)], BIZ)
    per_query = {r["seq"]: len(r["email_addresses"]) for r in replay_crawl(other, table).collect()}
    shared_run = {r["seq"]: len(r["email_addresses"]) for r in replay_crawl(other, table, scope=()).collect()}
    assert per_query == {1: 2, 2: 2} and shared_run == {1: 2, 2: 1}


def test_robots_and_history(spark, pages):
    table = pages(
        ("https://h.org/", '<a href="/contact">c</a><a href="/help">h</a>a@h.org'),
        ("https://h.org/contact", "c@h.org"),
        ("https://h.org/help", "d@h.org"),
    )
    robots = spark.createDataFrame(
        [("https://h.org", 200, "User-agent: *\nDisallow: /contact\nDisallow: /help")],
        "base_url string, status int, body string",
    )
    df = spark.createDataFrame(
        [("q", 1, "n", "https://h.org/", None), ("q", 2, "k", "https://known.org", None), ("q", 3, "w", None, None)],
        BIZ,
    )
    history = spark.createDataFrame([("https://known.org",), ("https://h.org",)], "website string")

    def emails(**options):
        rows = run_contacts(df, table, robots, history, Settings(**options)).collect()
        return {r["seq"]: (r["email_addresses"], r["skipped"]) for r in rows}

    assert emails() == {1: (["a@h.org"], False), 2: ([], True), 3: ([], False)}
    loose = emails(keep_access=("allowed", "contact_exception"))
    assert loose[1] == (["a@h.org", "c@h.org"], False)


def test_newest_snapshot_counts(spark):
    import datetime as dt

    rows = [
        ("https://h.org/", 200, "text/html", "old@h.org", dt.datetime(2024, 1, 1)),
        ("https://h.org/", 200, "text/html", "new@h.org", dt.datetime(2024, 1, 2)),
        ("https://g.org/", 200, "text/html", "old@g.org", dt.datetime(2024, 1, 1)),
        ("https://g.org/", 404, "text/html", "none@g.org", dt.datetime(2024, 1, 2)),
    ]
    table = spark.createDataFrame(
        rows, "url string, status int, content_type string, html string, fetched_at timestamp"
    )
    df = spark.createDataFrame([("q", 1, "n", "https://h.org/", None), ("q", 2, "n", "https://g.org/", None)], BIZ)
    got = {r["seq"]: r["email_addresses"] for r in replay_crawl(df, table).collect()}
    assert got == {1: ["new@h.org"], 2: []}


def test_page_bodies_are_not_shuffled(spark, pages, tmp_path):
    table = pages(("https://h.org/", "a@h.org"))
    table.write.parquet(str(tmp_path / "pages"))
    df = spark.createDataFrame([("q", 1, "n", "https://h.org/", None)], BIZ)
    plan = replay_crawl(df, spark.read.parquet(str(tmp_path / "pages")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in text.splitlines() if "Exchange" in line]
    assert exchanges and not any("html" in line for line in exchanges)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_an_answer_hides_an_error_of_equal_age(spark, pages):
    from contactloom.operators.emails import emails_by_document
    from contactloom.operators.links import links_by_document

    html = '<p>info@a.org</p><a href="mailto:bob@a.org">Bob</a>'
    both = pages(("https://a.org/", html, 200), ("https://a.org/", "gone", 404))
    assert [r["emails"] for r in emails_by_document(both).collect()] == [["info@a.org", "bob@a.org"]]
    assert [r["mailto"] for r in links_by_document(both).collect()] == [["bob@a.org"]]


def test_pages_are_pruned_at_any_size(spark, pages, tmp_path, monkeypatch):
    """Past the broadcast bound a fixed-size Bloom filter of page keys prunes pages before parsing."""
    table = pages(("https://h.org/", "a@h.org"), ("https://other.org/", "b@other.org"))
    table.write.parquet(str(tmp_path / "pages"))
    df = spark.createDataFrame([("q", 1, "n", "https://h.org/", None)], BIZ)
    exact = replay_crawl(df, spark.read.parquet(str(tmp_path / "pages"))).collect()
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    plan = replay_crawl(df, spark.read.parquet(str(tmp_path / "pages")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in text
    assert not any("html" in line for line in text.splitlines() if "Exchange" in line)
    assert plan.collect() == exact == [(("q", 1, ["a@h.org"]))]


def test_key_filter_passes_every_wanted_key(spark):
    from pyspark.sql import functions as F

    keys = spark.range(0, 20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    probe = spark.range(0, 60_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    passed = {r.k for r in shared.might_be_wanted(probe, F.col("k"), shared.key_filter(keys, "k")).collect()}
    assert {f"k{i}" for i in range(20_000)} <= passed
    assert len(passed) - 20_000 < 400  # a fixed 32 Mbit filter holding 60,000 bits lets few others through
