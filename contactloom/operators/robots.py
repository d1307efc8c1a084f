"""robots.txt: bodies to ordered rules, and the access label of a URL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from contactloom import fixed_values as fv
from contactloom.functions.text import contains_any
from contactloom.functions.urls import base_url, url_path
from contactloom.operators.shared import lookup_join

_RULES = pa.list_(pa.struct([("agent", pa.string()), ("allow", pa.bool_()), ("path", pa.string())]))
_RULES_TYPE = from_arrow_type(_RULES)


def _groups(body: str | None):
    """Named groups as written, then the first catch-all group."""
    from urllib.robotparser import RobotFileParser

    parser = RobotFileParser()
    parser.parse((body or "").splitlines())
    return parser.entries + ([parser.default_entry] if parser.default_entry else [])


def _rows(groups):
    return [
        {"agent": agent, "allow": rule.allowance, "path": rule.path}
        for group in groups
        for agent in group.useragents
        for rule in group.rulelines
    ]


@F.arrow_udf(_RULES_TYPE)
def _all_rules(bodies: pa.Array) -> pa.Array:
    return pa.array([_rows(_groups(body)) for body in bodies.to_pylist()], _RULES)


@F.arrow_udf(_RULES_TYPE)
def _agent_rules(bodies: pa.Array, agents: pa.Array) -> pa.Array:
    """Rules of the first group that speaks to the agent."""
    pairs = zip(bodies.to_pylist(), agents.to_pylist())
    mine = [[g for g in _groups(body) if g.applies_to(agent)][:1] for body, agent in pairs]
    return pa.array([_rows(groups) for groups in mine], _RULES)


@F.arrow_udf(T.StringType())
def _match_target(urls: pa.Array) -> pa.Array:
    """The part of a URL that rules are compared with, quoted the way rule paths are."""
    from urllib.parse import quote, unquote, urlparse, urlunparse

    def target(url):
        try:
            parts = urlparse(unquote(url))
        except (TypeError, ValueError):
            return None
        rest = (parts.path, parts.params, parts.query, parts.fragment)
        return quote(urlunparse(("", "", *rest))) or "/"

    return pa.array([target(url) for url in urls.to_pylist()], pa.string())


def robots_rules(robots: DataFrame) -> DataFrame:
    """``base_url, agent, rule_idx, allow, path_prefix``; only bodies served with 200 give rules."""
    parsed = robots.filter("status = 200").select("base_url", _all_rules("body").alias("rules"))
    exploded = parsed.select("base_url", F.posexplode_outer("rules").alias("rule_idx", "rule"))
    return exploded.filter("rule IS NOT NULL").select(
        "base_url",
        F.col("rule.agent").alias("agent"),
        "rule_idx",
        F.col("rule.allow").alias("allow"),
        F.col("rule.path").alias("path_prefix"),
    )


def robots_access(
    visits: DataFrame, robots: DataFrame, agent: str = "*", column: str = "url"
) -> DataFrame:
    """Add ``access``: ``allowed``, ``contact_exception`` or ``denied``.

    A site's rules travel as one ordered array, so a URL meets its site once however many rules
    there are; the first rule whose prefix fits decides.
    """
    rules = (
        robots.filter("status = 200")
        .groupBy("base_url")
        .agg(F.max("body").alias("body"))
        .select(F.col("base_url").alias("_base"), _agent_rules("body", F.lit(agent)).alias("rules"))
    )
    joined = lookup_join(
        visits.withColumn("_base", base_url(F.col(column))), rules, ["_base"]
    ).withColumn("_target", _match_target(F.when(F.col("rules").isNotNull(), F.col(column))))
    fitting = F.filter(
        "rules", lambda r: (r["path"] == "*") | F.col("_target").startswith(r["path"])
    )
    allow = F.coalesce(F.try_element_at(fitting, F.lit(1))["allow"], F.lit(True))
    contact = contains_any(F.lower(url_path(F.col(column))), fv.CONTACT_PATHS)
    return joined.withColumn(
        "access",
        F.when(allow, "allowed").when(contact, "contact_exception").otherwise("denied"),
    ).drop("_base", "_target", "rules")
