from urllib.robotparser import RobotFileParser

from contactloom.operators.robots import robots_access, robots_rules
from contactloom.operators.shared import lookup_join
import contactloom.operators.robots as robots_module

BODIES = {
    "https://a.org": (200, "User-agent: *\nDisallow: /shop\nAllow: /shop/ok\nDisallow:\n"),
    "https://b.org": (200, "User-agent: *\nAllow: /shop/ok\nDisallow: /shop # all\n\nDisallow: /x\n"),
    "https://c.org": (200, "User-agent: BadBot\nUser-agent: Other\nDisallow: /\n\nUser-agent: *\nDisallow: /contact\nDisallow: /a%20b\nDisallow: /q?x=1"),
    "https://d.org": (404, "User-agent: *\nDisallow: /"),
    "https://e.org": (500, "User-agent: *\nDisallow: /"),
    "https://f.org": (200, "User-agent: *\nDisallow: *\nUser-agent: *\nAllow: /"),
    "https://g.org": (200, None),
    "https://h.org": (200, "User-agent: badbot\nCrawl-delay: 5\n\nUser-agent: *\nDisallow: /\n"),
}
PATHS = ["", "/", "/shop", "/shop/ok", "/shop/no", "/contact/us", "/a b", "/a%20b/c", "/q?x=1&y", "/x"]


def expected(base, url, agent):
    status, body = BODIES.get(base, (None, None))
    if status != 200:
        return True
    parser = RobotFileParser()
    parser.parse((body or "").splitlines())
    return parser.can_fetch(agent, url)


def tables(spark):
    robots = spark.createDataFrame(
        [(b, s, t) for b, (s, t) in BODIES.items()], "base_url string, status int, body string"
    )
    urls = [(b, b + p) for b in [*BODIES, "https://unknown.org"] for p in PATHS]
    return robots, spark.createDataFrame(urls, "base string, url string")


def test_access_agrees_with_the_standard_parser(spark):
    robots, urls = tables(spark)
    for agent in ("*", "BadBot/1.0", "Other"):
        for row in robots_access(urls, robots, agent).collect():
            allowed = row["access"] == "allowed"
            assert allowed == expected(row["base"], row["url"], agent), (agent, row)


def test_labels(spark):
    robots, urls = tables(spark)
    got = {r["url"]: r["access"] for r in robots_access(urls, robots).collect()}
    assert got["https://c.org/contact/us"] == "contact_exception"
    assert got["https://a.org/shop/no"] == "denied"
    assert got["https://d.org/shop"] == got["https://unknown.org/"] == "allowed"


def test_hot_sites_are_split(spark, monkeypatch):
    robots, urls = tables(spark)
    plain = {(r["url"], r["access"]) for r in robots_access(urls, robots).collect()}

    def hot(left, right, keys, how="left", **_):
        return lookup_join(left, right, keys, how, min_rows=0, share=1 / 20)

    monkeypatch.setattr(robots_module, "lookup_join", hot)
    assert {(r["url"], r["access"]) for r in robots_access(urls, robots).collect()} == plain


def test_rule_list(spark):
    robots, _ = tables(spark)
    rows = robots_rules(robots).filter("base_url = 'https://c.org'").orderBy("rule_idx", "agent")
    assert [(r["agent"], r["allow"], r["path_prefix"]) for r in rows.collect()] == [
        ("BadBot", False, "/"),
        ("Other", False, "/"),
        ("*", False, "/contact"),
        ("*", False, "/a%20b"),
        ("*", False, "/q%3Fx%3D1"),
    ]
