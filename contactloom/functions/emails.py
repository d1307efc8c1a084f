"""E-mail predicates and the channels of a page, as column expressions.

The text channels return candidates; callers keep those that pass ``has_email_shape``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom import fixed_values as fv
from contactloom.functions.text import (
    drop_spaces,
    find_all,
    nonempty,
    replace_literals,
    replace_spaced_words,
    strip,
)

_DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"


def has_email_shape(email: Column) -> Column:
    """Has an ``@``, and a dot between the first and the second one."""
    return email.rlike(r"^[^@]*@[^@]*\.")


def is_business_email(email: Column, prefixes: tuple[str, ...] = fv.BUSINESS_PREFIXES) -> Column:
    """Business unless the local part looks like ``first.last``; known prefixes always are."""
    local = F.lower(F.substring_index(email, "@", 1))
    known = local.rlike(rf"^(?:{'|'.join(prefixes)})(?:[._\-]|\z)")
    personal = local.rlike(r"^[^.]{2,}\.[^.]{2,}\z") & ~local.rlike(_DIGIT)
    return F.coalesce((email != "") & (known | ~personal), F.lit(False))


def plain_emails(text: Column) -> Column:
    likely = text.contains("@") & text.rlike(r"@[A-Za-z0-9.-]+\.[A-Z|a-z]{2}")
    return find_all(text, fv.PLAIN_EMAIL, likely)


def at_marker_emails(text: Column, strict: bool = False) -> Column:
    """``name [at] host.tld`` and its variants."""
    mark = fv.AT_MARK_STRICT if strict else fv.AT_MARK
    tail = rf"{fv.SPACE}*{fv.TOKEN_CHAR}+\.{fv.TOKEN_CHAR}+"
    found = find_all(text, _run(rf"{mark}{tail}"), text.rlike(rf"{fv.AT_HINT}{tail}"))

    def clean(match: Column) -> Column:
        out = replace_literals(match, fv.AT_LITERALS, "@")
        return drop_spaces(replace_spaced_words(out, fv.AT_WORDS, "@"))

    return F.transform(found, clean)


def dot_marker_emails(text: Column, strict: bool = False) -> Column:
    """``name@host [dot] tld`` and its variants."""
    mark = fv.DOT_MARK_STRICT if strict else fv.DOT_MARK
    rest = rf"@{fv.TOKEN_CHAR}+{fv.SPACE}*{mark}{fv.SPACE}*{fv.TOKEN_CHAR}+"
    found = find_all(text, rf"(?<!{fv.TOKEN_CHAR}){fv.TOKEN_CHAR}+{rest}", text.rlike(rest))

    def clean(match: Column) -> Column:
        out = replace_literals(match, fv.DOT_LITERALS, ".")
        return drop_spaces(replace_spaced_words(out, fv.DOT_WORDS, "."))

    return F.transform(found, clean)


def entity_emails(text: Column, lenient: bool = False) -> Column:
    """Numeric HTML entities for the at sign and the dot."""
    rest = _two_marks(fv.AT_ENTITY, fv.DOT_ENTITY)
    found = find_all(text, _run(rest), text.contains("&#"))

    def clean(match: Column) -> Column:
        if lenient:
            out = F.regexp_replace(match, fv.AT_ENTITY, "@")
            return drop_spaces(F.regexp_replace(out, fv.DOT_ENTITY, "."))
        out = replace_literals(match, ("&#64;", "&#064;"), "@")
        return drop_spaces(replace_literals(out, ("&#46;", "&#046;"), "."))

    return F.transform(found, clean)


def escape_emails(text: Column) -> Column:
    """Literal backslash escapes for the at sign and the dot."""
    rest = _two_marks(fv.AT_ESCAPE, fv.DOT_ESCAPE)
    found = find_all(text, _run(rest), text.contains("\\u0040") | text.contains("\\x40"))

    def clean(match: Column) -> Column:
        out = replace_literals(match, ("\\u0040", "\\x40"), "@")
        return drop_spaces(replace_literals(out, ("\\u002E", "\\x2E"), "."))

    return F.transform(found, clean)


def attribute_emails(elements: Column) -> Column:
    """Per element in document order: the user/domain pair, then the first masked attribute."""

    def of_element(element: Column) -> Column:
        attrs = element["attrs"]
        user, domain = (nonempty(attrs[name]) for name in fv.PAIR_ATTRS)
        pair = F.concat(user, F.lit("@"), domain)
        masked = F.coalesce(*(nonempty(attrs[name]) for name in fv.MASKED_ATTRS))
        masked = replace_literals(masked, fv.ATTR_AT_LITERALS, "@")
        masked = drop_spaces(replace_literals(masked, fv.ATTR_DOT_LITERALS, "."))
        return F.array(
            F.struct(F.lit(6).alias("channel"), pair.alias("email")),
            F.struct(
                F.lit(7).alias("channel"), F.when(has_email_shape(masked), masked).alias("email")
            ),
        )

    return F.filter(
        F.flatten(F.transform(elements, of_element)), lambda hit: hit["email"].isNotNull()
    )


def script_emails(elements: Column) -> Column:
    """Quoted pieces joined by plus signs inside scripts that mention mail."""
    scripts = F.filter(
        F.transform(elements, lambda e: F.when(e["tag"] == "script", e["text"])),
        lambda text: text.isNotNull()
        & F.lower(text).rlike("|".join(fv.SCRIPT_HINTS)),
    )
    pieces = F.flatten(
        F.transform(scripts, lambda text: F.regexp_extract_all(text, F.lit(fv.JS_CONCAT), F.lit(0)))
    )
    joined = F.transform(
        pieces, lambda match: F.regexp_replace(match, rf"""['"+]|{fv.SPACE}""", "")
    )
    return F.filter(joined, has_email_shape)


def mailto_emails(elements: Column) -> Column:
    """Addresses of mailto anchors, repeats kept."""
    links = F.filter(
        elements, lambda e: (e["tag"] == "a") & e["attrs"]["href"].startswith("mailto:")
    )
    emails = F.transform(
        links,
        lambda e: strip(F.substring_index(F.substring(e["attrs"]["href"], 8, 2**31 - 1), "?", 1)),
    )
    return F.filter(emails, has_email_shape)


def business_or_all(emails: Column, prefixes: tuple[str, ...] = fv.BUSINESS_PREFIXES) -> Column:
    """The business e-mails of a page, or all of them when there is none."""
    business = F.filter(emails, lambda e: is_business_email(e, prefixes))
    return F.when(F.size(business) > 0, business).otherwise(emails)


def _run(rest: str) -> str:
    """A token run followed by ``rest``. Anchoring at the start of the run finds the same matches
    as trying every position in it, without going quadratic on very long runs."""
    return rf"(?<!{fv.TOKEN_CHAR}){fv.TOKEN_CHAR}+{fv.SPACE}*{rest}"


def _two_marks(at: str, dot: str) -> str:
    token = rf"{fv.SPACE}*{fv.TOKEN_CHAR}+"
    return rf"{at}{token}{fv.SPACE}*{dot}{token}"
