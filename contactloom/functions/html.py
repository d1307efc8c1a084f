"""HTML to elements: one Arrow pass per page, for the pages that need it."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from contactloom import fixed_values as fv

# --- fixed values: elements without an end tag, and elements whose text is not page text ----------
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
OPAQUE = frozenset(("script", "style", "template"))
BLOCKS = frozenset(
    "address article aside blockquote body br button dd div dl dt fieldset footer form h1 h2 h3 h4 "
    "h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
)

_KEPT_ATTRS = ("href", *fv.PAIR_ATTRS, *fv.MASKED_ATTRS)

_ELEMENTS = pa.list_(
    pa.struct(
        [
            ("pos", pa.int32()),
            ("tag", pa.string()),
            ("attrs", pa.map_(pa.string(), pa.string())),
            ("text", pa.string()),
            ("target", pa.string()),
        ]
    )
)


class _Walker(HTMLParser):
    """Keeps picked elements in document order. Text is stored once; elements hold its span."""

    def __init__(self, by_line: bool = False):
        super().__init__(convert_charrefs=True)
        self.by_line = by_line
        self.stack: list[tuple[str, dict]] = []
        self.depth: Counter = Counter()
        self.picked: list[dict] = []
        self.text: list[str] = []

    def pick(self, tag: str, attrs: dict) -> bool:
        raise NotImplementedError

    def handle_starttag(self, tag, attrs):
        if self.by_line and tag in BLOCKS:
            self.text.append("\n")
        attrs = {name: value or "" for name, value in attrs}
        node = {"tag": tag, "attrs": attrs, "start": len(self.text), "end": None, "own": []}
        if self.pick(tag, attrs):
            self.picked.append(node)
        if tag in VOID:
            node["end"] = node["start"]
        else:
            self.stack.append((tag, node))
            self.depth[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID or not self.depth[tag]:
            return
        name = None
        while name != tag:
            name, node = self.stack.pop()
            self.depth[name] -= 1
            node["end"] = len(self.text)
        if self.by_line and tag in BLOCKS:
            self.text.append("\n")

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in OPAQUE:
            self.stack[-1][1]["own"].append(data)
        elif not any(self.depth[tag] for tag in OPAQUE):
            self.text.append(data)

    def run(self, html: str):
        self.feed(html)
        self.close()
        return self

    def text_of(self, node: dict) -> str:
        if node["own"]:
            return "".join(node["own"])
        text = "".join(self.text[node["start"] : node["end"]])
        if not self.by_line:
            return text
        lines = (" ".join(line.split()) for line in text.split("\n"))
        return "\n".join(line for line in lines if line)


class _PageWalker(_Walker):
    def pick(self, tag, attrs):
        return (
            tag == "script"
            or (tag == "a" and "href" in attrs)
            or any(name in attrs for name in (*fv.PAIR_ATTRS, *fv.MASKED_ATTRS))
        )


class _ListingWalker(_Walker):
    """Also notes whether an element lies inside a card or section block."""

    def __init__(self):
        super().__init__(by_line=True)

    def pick(self, tag, attrs):
        kind = attrs.get("class", "")
        if tag == "span":
            return any(
                name == "div" and ("card" in node["kind"] or "section" in node["kind"])
                for name, node in self.stack
            )
        return tag in ("h1", "h2", "h3", "a", "button", "body") or (tag == "div" and "font" in kind)

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        if tag not in VOID:
            node = self.stack[-1][1]
            node["kind"] = node["attrs"].get("class", "")


def _page_elements(url: str | None, html: str | None):
    if html is None:
        return None
    try:
        page = _PageWalker().run(html)
    except AssertionError:  # markup the parser refuses
        return None
    return [
        {
            "pos": pos,
            "tag": node["tag"],
            "attrs": [(k, node["attrs"][k]) for k in _KEPT_ATTRS if k in node["attrs"]],
            "text": page.text_of(node),
            "target": _resolved(url, node["attrs"].get("href")),
        }
        for pos, node in enumerate(page.picked)
    ]


def _resolved(url: str | None, href: str | None) -> str | None:
    if url is None or href is None:
        return None
    try:
        return urljoin(url, href)
    except ValueError:  # not a URL in any reading
        return None


def _listing_parts(url: str | None, html: str | None):
    if html is None:
        return None
    try:
        page = _ListingWalker().run(html)
    except AssertionError:
        return None
    nodes = [(n["tag"], n["attrs"], page.text_of(n)) for n in page.picked]

    def first(values):
        return next(iter(values), None)

    def texts(*tags):
        return [text for tag, _, text in nodes if tag in tags]

    anchors = [
        ({**attrs, "href": _resolved(url or "", attrs.get("href"))}, text)
        for tag, attrs, text in nodes
        if tag == "a"
    ]
    buttons = [(attrs, text) for tag, attrs, text in nodes if tag == "button"]
    fonts = [(attrs["class"], text) for tag, attrs, text in nodes if tag == "div"]
    large = ("fontHeadlineLarge", "fontTitleLarge")
    return {
        "h1": first(texts("h1")),
        "headings": texts("h1", "h2", "h3"),
        "headline": first(text for kind, text in fonts if any(name in kind for name in large)),
        "prominent": [text for _, text in fonts if "Results" not in text],
        "cards": texts("span"),
        "authority": first(
            attrs["href"] for attrs, _ in anchors if attrs.get("data-item-id") == "authority"
        ),
        "website_link": first(
            attrs["href"] for attrs, text in anchors if "Website" in text or "website" in text
        ),
        "links": [attrs["href"] for attrs, _ in anchors if attrs["href"]],
        "phone_button": first(
            text for attrs, text in buttons if "phone:" in attrs.get("data-item-id", "")
        ),
        "phone_mention": first(text for _, text in buttons if "phone" in text or "Phone" in text),
        "body_text": first(texts("body")),
    }


# Marked as non-deterministic below: the optimizer then never copies a parse into a filter, which
# would run it twice.
@F.arrow_udf(from_arrow_type(_ELEMENTS))
def _parse_page(url: pa.Array, html: pa.Array) -> pa.Array:
    """Anchors, scripts and elements with contact attributes, in document order.

    ``target`` is the link resolved against the page URL; a null URL skips that."""
    pairs = zip(url.to_pylist(), html.to_pylist())
    return pa.array([_page_elements(u, h) for u, h in pairs], _ELEMENTS)


_LISTING = pa.struct(
    [
        ("h1", pa.string()),
        ("headings", pa.list_(pa.string())),
        ("headline", pa.string()),
        ("prominent", pa.list_(pa.string())),
        ("cards", pa.list_(pa.string())),
        ("authority", pa.string()),
        ("website_link", pa.string()),
        ("links", pa.list_(pa.string())),
        ("phone_button", pa.string()),
        ("phone_mention", pa.string()),
        ("body_text", pa.string()),
    ]
)


@F.arrow_udf(from_arrow_type(_LISTING))
def _parse_listing(url: pa.Array, html: pa.Array) -> pa.Array:
    """Candidate texts and absolute links of a listing snapshot; null where it cannot be parsed."""
    pairs = zip(url.to_pylist(), html.to_pylist())
    return pa.array([_listing_parts(u, h) for u, h in pairs], _LISTING)


class _ResultsWalker(_Walker):
    def __init__(self):
        super().__init__(by_line=True)

    def pick(self, tag, attrs):
        kind = attrs.get("class", "")
        return tag == "div" and (
            attrs.get("role") == "article" or "Nv2PK" in kind or "THOPZb" in kind
        )


def _result_cards(html: str | None):
    if html is None:
        return None
    try:
        page = _ResultsWalker().run(html)
    except AssertionError:
        return None
    cards = [(n["attrs"].get("role") == "article", n["attrs"].get("class", ""), page.text_of(n))
             for n in page.picked]
    return {
        "articles": [text for article, _, text in cards if article],
        "others": [text for _, kind, text in cards if "Nv2PK" in kind or "THOPZb" in kind],
    }


_CARDS = pa.struct([("articles", pa.list_(pa.string())), ("others", pa.list_(pa.string()))])


@F.arrow_udf(from_arrow_type(_CARDS))
def _parse_results(html: pa.Array) -> pa.Array:
    """Texts of the listing cards of a results page, by primary and by alternative selector."""
    return pa.array([_result_cards(h) for h in html.to_pylist()], _CARDS)


page_elements = _parse_page.asNondeterministic()
listing_parts = _parse_listing.asNondeterministic()
result_cards = _parse_results.asNondeterministic()

_ATTR_HINT = r"[dD][aA][tT][aA]-(?i:email|mail|user|domain|contact|address)"


def needs_attributes(html: Column) -> Column:
    """Cheap test that pages with contact attributes always pass."""
    return html.rlike(_ATTR_HINT)


def has_anchor(html: Column) -> Column:
    return html.rlike(r"<[aA][\s/]")
