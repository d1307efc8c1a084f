"""Word lists, formats and patterns that results depend on.

Patterns are written for the JVM regex engine with explicit Unicode classes, so they do not change
meaning with the JDK version (``\\w``, ``\\s`` and ``\\b`` do).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: word lists -----------------------------------------------------------------
BUSINESS_PREFIXES = (
    "info", "contact", "hello", "support", "sales", "business",
    "admin", "office", "help", "service", "inquiry", "team",
    "marketing", "hr", "jobs", "careers", "feedback", "webmaster",
)
CONTACT_KEYWORDS = (
    "contact", "contact-us", "contact us", "about", "about-us", "about us", "team", "company",
    "support", "help", "info", "reach-us", "reach us", "get-in-touch", "get in touch",
)
ADDITIONAL_TERMS = ("email", "mail", "contact", "enquiry", "inquiry", "support")
CONTACT_PATHS = ("/contact", "/about", "/team", "/people", "/staff")
HTML_TYPES = ("text/html", "application/xhtml+xml")
NON_NAMES = ("results", "sponsored")
BLOCK_WORD = "captcha"
SCRIPT_HINTS = ("mail", "email", "@")

# --- fixed values: attribute names, in the order they are consulted -----------------------------
MASKED_ATTRS = ("data-email", "data-mail", "data-contact", "data-address")
PAIR_ATTRS = ("data-user", "data-domain")

# --- fixed values: formats --------------------------------------------------------------------
SEARCH_URL_PREFIX = "https://www.google.com/maps/search/"
PLACE_MARK = "maps/place/"
TITLE_PRODUCT = "Google Maps"
TITLE_SUFFIX = " - Google Maps"
EXCLUDED_LINK_HOST = "google.com"
RUN_STAMP = "yyyy-MM-dd_HH-mm-ss"
EMPTY_MARKER = "No data found"

# --- fixed values: character classes ------------------------------------------------------------
WORD = r"[\p{L}\p{N}_]"
TOKEN_CHAR = r"[\p{L}\p{N}_.\-]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# --- fixed values: extraction patterns ------------------------------------------------------------
# the left edge looks at the next character first, the cheaper test
PLAIN_EMAIL = (
    rf"(?:(?=[A-Za-z0-9_])(?<!{WORD})|(?=[.%+-])(?<={WORD}))"
    rf"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{EDGE}"
)
AT_MARK = (
    rf"(?:\[at\]|\(at\)|\[@\]|\{{at\}}|(?<!{WORD})at(?!{WORD})|\[a\]|\(a\)|(?<!{WORD})a(?!{WORD}))"
)
AT_MARK_STRICT = rf"(?:\[at\]|\(at\)|\[@\]|\{{at\}}|(?<!{WORD})at(?!{WORD})|\[a\]|\(a\))"
# implied by every marker above; tests plain characters first
AT_HINT = rf"(?:[\[({{](?:at?|@)[\])}}]|a(?<!{WORD}a)t?(?!{WORD}))"
DOT_MARK = (
    rf"(?:\[dot\]|\(dot\)|\[[^\n]\]|\{{dot\}}|(?<!{WORD})dot(?!{WORD})|\[d\]|\(d\)|(?<!{WORD})d(?!{WORD}))"
)
DOT_MARK_STRICT = (
    rf"(?:\[dot\]|\(dot\)|\[[^\n]\]|\{{dot\}}|(?<!{WORD})dot(?!{WORD})|\[d\]|\(d\))"
)
AT_ENTITY = "&#0*64;"
DOT_ENTITY = "&#0*46;"
AT_ESCAPE = r"(?:\\u0040|\\x40)"
DOT_ESCAPE = r"(?:\\u002E|\\x2E)"
PHONE = (
    rf"\+?\p{{Nd}}{{1,4}}(?:[-.]|{SPACE})?\(?\p{{Nd}}{{1,4}}\)?(?:[-.]|{SPACE})?"
    rf"\p{{Nd}}{{1,4}}(?:[-.]|{SPACE})?\p{{Nd}}{{1,9}}"
)
JS_CONCAT = (
    rf"""['"]({WORD}+)['"]{SPACE}*\+{SPACE}*['"]@['"]{SPACE}*\+{SPACE}*['"]([\p{{L}}\p{{N}}_.]+)['"]"""
    rf"""(?:{SPACE}*\+{SPACE}*['"]([\p{{L}}\p{{N}}_.]+)['"])?"""
)

# --- fixed values: literal clean-ups, applied in this order ---------------------------------------
AT_LITERALS = ("[at]", "(at)", "[@]", "{at}", "[a]", "(a)")
AT_WORDS = ("at", "a")
DOT_LITERALS = ("[dot]", "(dot)", "[.]", "{dot}", "[d]", "(d)")
DOT_WORDS = ("dot", "d")
ATTR_AT_LITERALS = ("[at]", "(at)", " at ", " AT ")
ATTR_DOT_LITERALS = ("[dot]", "(dot)", " dot ", " DOT ")


@dataclass(frozen=True)
class Settings:
    """Tunables of a run."""

    contact_cap: int = 5
    additional_cap: int = 3
    business_cap: int = 20
    name_threshold: float = 0.8
    address_threshold: float = 0.7
    keep_access: tuple[str, ...] = ("allowed",)
    robots_agent: str = "*"
    lenient_entities: bool = False
    strict_words: bool = False
    js_concat: bool = False
    distinct_mailto: bool = False
    business_prefixes: tuple[str, ...] = field(default=BUSINESS_PREFIXES)
