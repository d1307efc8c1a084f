"""Text expressions: all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom import fixed_values as fv


def nonempty(col: Column) -> Column:
    """The value, or null where it is the empty string."""
    return F.when(col != "", col)


def strip(col: Column) -> Column:
    """Cut white space of any kind from both ends."""
    return F.regexp_replace(col, rf"^{fv.SPACE}+|{fv.SPACE}+\z", "")


def drop_spaces(col: Column) -> Column:
    return F.regexp_replace(col, rf"{fv.SPACE}+", "")


def replace_literals(col: Column, literals: Iterable[str], to: str) -> Column:
    return reduce(lambda c, word: F.replace(c, F.lit(word), F.lit(to)), literals, col)


def replace_spaced_words(col: Column, words: Iterable[str], to: str) -> Column:
    """Replace bare words that have white space on both sides."""
    return reduce(
        lambda c, word: F.regexp_replace(c, rf"{fv.SPACE}+{word}{fv.SPACE}+", to), words, col
    )


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """True where any of the plain words occurs; one regex pass for all words."""
    return col.rlike("|".join(_literal(word) for word in words))


def find_all(text: Column, pattern: str, needs: Column | None = None) -> Column:
    """All matches in order. ``needs`` is a cheap test that any match implies."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needs is None:
        return found
    return F.when(needs, found).otherwise(F.array().cast("array<string>"))


def first_match(text: Column, pattern: str) -> Column:
    """First match, or null."""
    return nonempty(F.regexp_extract(text, pattern, 0))


def md5_prefix(col: Column) -> Column:
    return F.substring(F.md5(col), 1, 8)


def _literal(word: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}/" else ch for ch in word)
