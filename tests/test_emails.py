import pytest
from pyspark.sql import functions as F

from contactloom import Settings
from contactloom.functions import is_business_email
from contactloom.operators.emails import extract_emails, page_emails

BACKSLASH = chr(92)


@pytest.fixture
def found(spark, pages):
    def run(html, **options):
        rows = extract_emails(pages(("https://h.org/", html)), settings=Settings(**options))
        return [(r["channel_ord"], r["email"]) for r in rows.orderBy("pos").collect()]

    return run


CASES = {
    "plain": ("mail info@shop.org now", [(1, "info@shop.org")]),
    "plain in attributes and comments": (
        '<a title="a@b.org"><!-- c@d.org -->',
        [(1, "a@b.org"), (1, "c@d.org")],
    ),
    "letters before the address": ("éinfo@shop.org", []),
    "dot after a foreign letter": ("é.x@shop.org", [(1, ".x@shop.org")]),
    "letter after the address": ("x@shop.orgé", []),
    "bar in the top level": ("x@shop.o|g y", [(1, "x@shop.o|g")]),
    "bar at the end": ("x@shop.org| y", [(1, "x@shop.org")]),
    "accents in plain locals": ("josé@shop.org", []),
    "at marker": ("office [at] shop.org", [(2, "office@shop.org")]),
    "at marker without blanks": ("help(at)shop.co.uk", [(2, "help@shop.co.uk")]),
    "braces": ("x {at} shop.org", [(2, "x@shop.org")]),
    "bare word": ("look at example.com", [(2, "look@example.com")]),
    "bare letter": ("once a week.end", [(2, "once@week.end")]),
    "upper case word": ("x AT shop.org", []),
    "word glued to a dot": ("x.at.shop.org", []),
    "accented token": ("é.x at é.fr", [(2, "é.x@é.fr")]),
    "dot marker": ("team@shop [dot] com", [(3, "team@shop.com")]),
    "bare dot": ("team@shop dot com", [(3, "team@shop.com")]),
    "any bracketed character": ("team@shop.eu[x]com", [(1, "team@shop.eu"), (3, "team@shop.eu[x]com")]),
    "entities": ("a&#64;b&#46;org", [(4, "a@b.org")]),
    "entities with a zero and blanks": ("a &#064; b &#046; org", [(4, "a@b.org")]),
    "entities with three zeros": ("a&#00064;b&#00046;org", []),
    "escapes": (
        "aQu0040bQu002Eorg cQx40dQx2Enet".replace("Q", BACKSLASH),
        [(5, "a@b.org"), (5, "c@d.net")],
    ),
    "lower case escape of the dot": ("aQu0040bQu002eorg".replace("Q", BACKSLASH), []),
    "pair is not checked": ('<i data-user="u" data-domain="nodot">', [(6, "u@nodot")]),
    "half a pair": ('<i data-user="u">', []),
    "first masked attribute": (
        '<i data-mail="" data-contact="a at b dot org" data-address="x@y.zz">',
        [(1, "x@y.zz"), (7, "a@b.org")],
    ),
    "pair before masked": (
        '<i DATA-EMAIL="a[at]b(dot)org" data-user="u" data-domain="d.org">',
        [(6, "u@d.org"), (7, "a@b.org")],
    ),
    "script pieces are off": ("<script>m='a'+'@'+'b'+'.org'+x</script>", []),
    "repeats stay in hits": ("a@b.org a@b.org", [(1, "a@b.org"), (1, "a@b.org")]),
    "nothing": ("no address here", []),
}


@pytest.mark.parametrize("name", CASES)
def test_channels(found, name):
    html, expected = CASES[name]
    assert found(html) == expected


def test_options(found):
    assert found("<script>m='a'+'@'+'b'+'.org'+x</script>", js_concat=True) == [(8, "a@b.org")]
    assert found("<script>v='a'+'b'</script>", js_concat=True) == []
    assert found("a&#00064;b&#00046;org", lenient_entities=True) == [(4, "a@b.org")]
    assert found("once a week.end", strict_words=True) == []
    assert found("look at example.com", strict_words=True) == [(2, "look@example.com")]


def test_long_token_run_is_linear(found):
    assert found("x" * 300_000 + " [at] shop.org")[0][1].endswith("@shop.org")


def test_business_rule(spark):
    expected = {
        "info@x.org": True,
        "INFO.de@x.org": True,
        "info-x@x.org": True,
        "info_x@x.org": True,
        "information@x.org": True,
        "hr.lead@x.org": True,
        "john.doe@x.org": False,
        "j.doe@x.org": True,
        "john.q.doe@x.org": True,
        "john.doe7@x.org": True,
        "plain": True,
        "": False,
        None: False,
    }
    rows = spark.createDataFrame([(e,) for e in expected], "email string")
    got = {r[0]: r[1] for r in rows.select("email", is_business_email(F.col("email"))).collect()}
    assert got == expected


def test_page_fallback_and_order(pages):
    table = pages(
        ("u1", "jane.roe@x.org"),
        ("u2", "jane.roe@x.org sales@x.org jane.roe@x.org b@x.org sales@x.org"),
        ("u3", "none"),
    )
    got = {r["url"]: r["emails"] for r in page_emails(table).collect()}
    assert got == {"u1": ["jane.roe@x.org"], "u2": ["sales@x.org", "b@x.org"], "u3": []}
