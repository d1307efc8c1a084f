"""URL expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom import fixed_values as fv


def normalize_url(url: Column) -> Column:
    """Add ``https://`` unless a web scheme is there; the empty string stays as it is."""
    bare = (url != "") & ~url.startswith("http://") & ~url.startswith("https://")
    return F.when(bare, F.concat(F.lit("https://"), url)).otherwise(url)


def page_key(url: Column) -> Column:
    """Identity of the served document: scheme and host in lower case, no default port, no fragment,
    no bare ``?``, and ``/`` for an empty path. An authority with user data stays as written."""
    bare = F.substring_index(url, "#", 1)
    head = F.regexp_extract(bare, r"^(?i:https?)://[^/?]+", 0)
    site = F.regexp_replace(F.lower(head), r"^(?:(http://.*):80|(https://.*):443)\z", "$1$2")
    rest = F.regexp_replace(F.substr(bare, F.length(head) + 1), r"^([^?]*)\?\z", "$1")
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(head == "", bare).otherwise(F.concat(F.when(head.contains("@"), head).otherwise(site), path))


def base_url(url: Column) -> Column:
    """Scheme and authority."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def quote_plus(text: Column) -> Column:
    """Form encoding; the JVM encoder differs in ``*`` and ``~``."""
    return F.replace(
        F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def search_url(query: Column) -> Column:
    return F.concat(F.lit(fv.SEARCH_URL_PREFIX), quote_plus(query), F.lit("/"))


def domain_label(url: Column) -> Column:
    """Second host label after ``www``, else the first; null for one-label hosts."""
    labels = F.split(host(url), r"\.")
    label = F.when(F.lower(labels[0]) == "www", labels[1]).otherwise(labels[0])
    return F.when(F.size(labels) > 1, label)


@F.arrow_udf(T.StringType())
def place_name(segment: pa.Array) -> pa.Array:
    """Name written in a place URL: unescaped, pluses to blanks, every word capitalised."""
    from urllib.parse import unquote

    return pa.array(
        [None if s is None else unquote(s).replace("+", " ").title() for s in segment.to_pylist()],
        pa.string(),
    )


@F.arrow_udf(T.StringType())
def title_case(text: pa.Array) -> pa.Array:
    """Capital after every non-letter (``initcap`` only looks at white space)."""
    return pa.array([None if s is None else s.title() for s in text.to_pylist()], pa.string())
