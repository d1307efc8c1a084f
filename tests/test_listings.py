import pytest
from pyspark.sql import functions as F

from contactloom.functions import quote_plus
from contactloom.operators.listings import (
    drop_blocked_searches,
    failed_rows,
    first_phone,
    good_rows,
    is_blocked,
    listing_fields,
    name_from_domain,
    result_listings,
)
from contactloom.sources import search_plan

SCHEMA = "query string, seq bigint, place_url string, title string, html string"
PLACE = "https://www.google.com/maps/place/{}/@1,2"

# place URL, title, html -> name, website, phone
CASES = {
    "escapes and pluses": (PLACE.format("o%27brien+a-b%2BC"), "", "", "O'Brien A-B C", None, None),
    "bad escapes": (PLACE.format("100%+zz%2"), "", "", "100% Zz%2", None, None),
    "results is no name": (PLACE.format("Results"), "", "<h1> Cafe  Uno </h1>", "Cafe Uno", None, None),
    "short is no name": (PLACE.format("abc"), "", "<h1>abc</h1><h3>Longer</h3>", "Longer", None, None),
    "headline has no test": ("x", "", '<div class="a fontTitleLarge">abc</div>', "abc", None, None),
    "prominent text": (
        "x",
        "",
        '<div class="font1">abc</div><div class="font2">Results here</div><div class="font3">Corner shop</div>',
        "Corner shop",
        None,
        None,
    ),
    "title": ("x", "Blue Door - Google Maps", "", "Blue Door", None, None),
    "title of another product": ("x", "Blue Door - Elsewhere", "", "Business_99", None, None),
    "card": ("x", "", '<div class="card x"><p><span>Tea House</span></p></div><span>Other</span>', "Tea House", None, None),
    "domain after www": (
        "x",
        "",
        '<a data-item-id="authority" href="http://www.blue-door.com/x">w</a>',
        "Blue-Door",
        "http://www.blue-door.com/x",
        None,
    ),
    "domain": ("x", "", '<a data-item-id="authority" href="http://bluedoor.org">w</a>', "Bluedoor", "http://bluedoor.org", None),
    "headline Results goes on to the domain": (
        "x",
        "",
        '<div class="fontHeadlineLarge">Results</div><a data-item-id="authority" href="http://door.org">w</a>',
        "Door",
        "http://door.org",
        None,
    ),
    "website by text": (PLACE.format("Shop+A"), "", '<a href="/q">x</a><a href="http://s.org">Our website</a>', "Shop A", "http://s.org", None),
    "first external link": (
        PLACE.format("Shop+A"),
        "",
        '<a href="/maps">m</a><a href="https://www.google.com/y">g</a><a href="http://ext.org">e</a>',
        "Shop A",
        "http://ext.org",
        None,
    ),
    "phone button": (
        PLACE.format("Shop+A"),
        "",
        '<button data-item-id="phone:tel:1"> 01 23 </button><button>Phone 9</button>',
        "Shop A",
        None,
        "01 23",
    ),
    "phone by text": (PLACE.format("Shop+A"), "", "<button>Copy phone number</button>", "Shop A", None, "Copy phone number"),
    "phone by pattern": (
        PLACE.format("Shop+A"),
        "",
        "<body><p>Since 12</p><p>call +92 (300) 555-0001 now</p></body>",
        "Shop A",
        None,
        "+92 (300) 555-0001",
    ),
    "nothing at all": ("x", None, "", "Business_99", None, None),
}


def test_cascades(spark):
    rows = [("q", n, case[0], case[1], case[2]) for n, case in enumerate(CASES.values())]
    fields = listing_fields(spark.createDataFrame(rows, SCHEMA), 99)
    got = {r["seq"]: (r["name"], r["website"], r["phone_number"]) for r in good_rows(fields).collect()}
    for n, (name, case) in enumerate(CASES.items()):
        assert got[n] == case[3:], name


def test_unreadable_rows_are_set_aside(spark):
    rows = [("q", 1, PLACE.format("Good+Shop"), "", "<h1>x</h1>"), ("q", 2, "x", "", None), ("q", 3, "x", "", "<![bad")]
    fields = listing_fields(spark.createDataFrame(rows, SCHEMA), 1)
    good = {r["seq"] for r in good_rows(fields).collect()}
    failed = {r["seq"] for r in failed_rows(fields).collect()}
    assert 1 in good and 2 in failed and good | failed == {1, 2, 3} and not good & failed


def test_a_challenge_on_the_results_page_empties_its_search(spark):
    form = "<h1>Good Shop</h1><p>protected by reCAPTCHA</p>"
    rows = [(q, n, "", "", form) for q in "qr" for n in range(3)] + [("s", 1, "", "", None)]
    fields = listing_fields(spark.createDataFrame(rows, SCHEMA), 1)
    pages = [("q", "<p>results</p>"), ("q", "<div id=g-reCAPTCHA>"), ("r", "<p>results</p>"), ("s", None)]
    results = spark.createDataFrame(pages, "query string, html string")
    assert [r["flag"] for r in results.select(is_blocked(F.col("html")).alias("flag")).collect()] == [False, True, False, False]
    left = drop_blocked_searches(fields, results).collect()
    assert sorted((r["query"], r["seq"]) for r in left) == [("r", 0), ("r", 1), ("r", 2), ("s", 1)]
    assert good_rows(fields, results).count() == 3 and good_rows(fields).count() == 6
    assert failed_rows(fields).count() == 1


def test_result_cards_fall_back(spark):
    rows = [
        ("q", '<div role="article">A <b>one</b></div><div class="Nv2PK">B</div><div role=article>C</div>'),
        ("r", '<div class="x Nv2PK">D</div><div class="THOPZb">E</div>'),
        ("s", "<p>none</p>"),
    ]
    got = result_listings(spark.createDataFrame(rows, "query string, html string")).collect()
    assert sorted((r["query"], r["pos"], r["text"]) for r in got) == [
        ("q", 0, "A one"), ("q", 1, "C"), ("r", 0, "D"), ("r", 1, "E"),
    ]


@pytest.mark.parametrize(
    "text, phone",
    [
        ("tel 0049-30 1234567 or 555 55 55", "0049-30 1234567"),
        ("in 2024", "2024"),
        ("12", None),
        ("a 1.2.3 b", None),
        ("(030) 12 34", "030) 12 34"),
    ],
)
def test_phone_pattern(spark, text, phone):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(first_phone(F.col("t"))).first()[0] == phone


def test_domain_names(spark):
    urls = ["http://localhost/x", "https://WWW.Shop.org", "http://a-b.c", "nothing"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(name_from_domain(F.col("u"))).collect()] == [None, "Shop", "A-B", None]


def test_search_plan(spark):
    from hashlib import md5
    from urllib.parse import quote_plus as standard

    texts = ["software houses in Pakistan", "a*b~c&d=é/ü?#%+", "", "日本 料理-_."]
    df = spark.createDataFrame([(t,) for t in texts], "query string")
    for row in search_plan(df).collect():
        assert row["search_url"] == f"https://www.google.com/maps/search/{standard(row['query'])}/"
        assert row["query_hash"] == md5(row["query"].encode()).hexdigest()[:8]
    assert df.select(quote_plus(F.lit("x y"))).first()[0] == "x+y"
