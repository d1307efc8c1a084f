"""The registered queries once more, as plain SQL over the same tables.

Regular expressions here are written for an engine without look-around and with ASCII ``\\b``: word
edges are spelled out and a guard character is cut off the match.
"""

from __future__ import annotations

from contactloom.catalog.fixtures import with_clause

W = r"\p{L}\p{N}_"
T = r"[\p{L}\p{N}_.\-]"
S = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
HOST_TAIL = r"@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PLAIN = rf"(?:[^{W}][A-Za-z0-9_]|[{W}][.%+-])[A-Za-z0-9._%+-]*{HOST_TAIL}"
AT = (
    rf"(?:{T}+{S}*(?:\[at\]|\(at\)|\[@\]|\{{at\}}|\[a\]|\(a\)){S}*{T}+"
    rf"|(?:{T}+{S}+|{T}*[.\-])(?:at|a)(?:{S}+{T}+|[.\-]{T}*))\.{T}+"
)
DOT = (
    rf"{T}+@(?:{T}+{S}*(?:\[dot\]|\(dot\)|\[[^\n]\]|\{{dot\}}|\[d\]|\(d\)){S}*{T}+"
    rf"|(?:{T}+{S}+|{T}*[.\-])(?:dot|d)(?:{S}+{T}+|[.\-]{T}*))"
)
ENTITY = rf"{T}+{S}*&#0*64;{S}*{T}+{S}*&#0*46;{S}*{T}+"
ESCAPE = rf"{T}+{S}*(?:\\u0040|\\x40){S}*{T}+{S}*(?:\\u002E|\\x2E){S}*{T}+"
PHONE = rf"\+?\p{{Nd}}{{1,4}}(?:[-.]|{S})?\(?\p{{Nd}}{{1,4}}\)?(?:[-.]|{S})?\p{{Nd}}{{1,4}}(?:[-.]|{S})?\p{{Nd}}{{1,9}}"
SHAPE = "contains(split_part(email, '@', 2), '.')"
PREFIXES = (
    "info|contact|hello|support|sales|business|admin|office|help|service|inquiry|team|marketing|hr|"
    "jobs|careers|feedback|webmaster"
)
CONTACT_WORDS = "contact|about|team|company|support|help|info|reach-us|reach us|get-in-touch|get in touch"
ADDITIONAL_WORDS = "mail|contact|enquiry|inquiry|support"


def _replaced(expr: str, words: list[str], to: str) -> str:
    for word in words:
        expr = f"replace({expr}, '{word}', '{to}')"
    return expr


def _regex_replaced(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"


def _clean_at(m: str) -> str:
    out = _replaced(m, ["[at]", "(at)", "[@]", "{at}", "[a]", "(a)"], "@")
    out = _regex_replaced(_regex_replaced(out, f"{S}+at{S}+", "@"), f"{S}+a{S}+", "@")
    return _regex_replaced(out, f"{S}+", "")


def _clean_dot(m: str) -> str:
    out = _replaced(m, ["[dot]", "(dot)", "[.]", "{dot}", "[d]", "(d)"], ".")
    out = _regex_replaced(_regex_replaced(out, f"{S}+dot{S}+", "."), f"{S}+d{S}+", ".")
    return _regex_replaced(out, f"{S}+", "")


def _clean_entity(m: str) -> str:
    out = _replaced(_replaced(m, ["&#64;", "&#064;"], "@"), ["&#46;", "&#046;"], ".")
    return _regex_replaced(out, f"{S}+", "")


def _clean_escape(m: str) -> str:
    out = _replaced(_replaced(m, ["\\u0040", "\\x40"], "@"), ["\\u002E", "\\x2E"], ".")
    return _regex_replaced(out, f"{S}+", "")


def _text_hits(table: str, key: str, text: str) -> str:
    """``key, channel, idx, email`` of the text channels."""
    channels = [
        (1, f"regexp_extract_all(' ' || {text}, '{PLAIN}')", "substr(m, 2)"),
        (2, f"regexp_extract_all({text}, '{AT}')", _clean_at("m")),
        (3, f"regexp_extract_all({text}, '{DOT}')", _clean_dot("m")),
        (4, f"regexp_extract_all({text}, '{ENTITY}')", _clean_entity("m")),
        (5, f"regexp_extract_all({text}, '{ESCAPE}')", _clean_escape("m")),
    ]
    parts = [
        f"SELECT {key}, {n} AS channel, idx, {clean} AS email FROM "
        f"(SELECT {key}, unnest(ms) AS m, generate_subscripts(ms, 1) AS idx FROM "
        f"(SELECT {key}, {found} AS ms FROM {table}))"
        for n, found, clean in channels
    ]
    union = " UNION ALL ".join(parts)
    return f"SELECT * FROM ({union}) WHERE channel = 1 OR {SHAPE}"


_PAIRS = """
SELECT i, 6 AS channel, 1 AS idx, regexp_extract(html, 'data-user="([^"]+)"', 1) || '@'
  || regexp_extract(html, 'data-domain="([^"]+)"', 1) AS email
FROM deco WHERE html LIKE '%data-user%'"""
_MASKED = f"""
SELECT * FROM (SELECT i, 7 AS channel, 1 AS idx, {_regex_replaced(
    _replaced(
        _replaced(
            '''regexp_extract(html, 'data-mail="([^"]+)"', 1)''',
            ['[at]', '(at)', ' at ', ' AT '], '@',
        ),
        ['[dot]', '(dot)', ' dot ', ' DOT '], '.',
    ), S + '+', '',
)} AS email FROM deco WHERE html LIKE '%data-mail=%') WHERE {SHAPE}"""

_LOCAL = "lower(split_part(email, '@', 1))"
BUSINESS = (
    rf"(regexp_matches({_LOCAL}, '^(?:{PREFIXES})(?:[._\-]|$)') OR NOT "
    rf"(regexp_matches({_LOCAL}, '^[^.]{{2,}}\.[^.]{{2,}}$') AND NOT regexp_matches({_LOCAL}, '\p{{Nd}}')))"
)
_HTML_TYPE = (
    "(contains(lower(coalesce(content_type, '')), 'text/html') OR "
    "contains(lower(coalesce(content_type, '')), 'application/xhtml+xml'))"
)
ADMITTED = f"(status = 200 AND {_HTML_TYPE})"

DECO_HITS = f"hits AS ({_text_hits('deco', 'i', 'html')} UNION ALL {_PAIRS} UNION ALL {_MASKED})"
# distinct e-mails of a page, first-found order, business ones if there are any
PAGE_EMAILS = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY channel, idx) - 1 AS pos FROM hits),
firsts AS (SELECT i, email, min(pos) AS pos, {BUSINESS} AS business FROM ranked GROUP BY i, email),
page_mail AS (SELECT i, email, pos FROM (
  SELECT *, bool_or(business) OVER (PARTITION BY i) AS any_business FROM firsts)
  WHERE business OR NOT any_business)"""

_DECO = with_clause("deco")
_PAGES = f"{_DECO}, {DECO_HITS}, {PAGE_EMAILS}"


def _channel(number: int) -> str:
    return f"{_DECO}, {DECO_HITS} SELECT i, email FROM hits WHERE channel = {number}"


_RAW_BASE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


def _links(table: str, key: str) -> str:
    """Anchors as written: ``key, idx, href, text``."""
    anchor = '<a href="([^"]*)">([^<]*)</a>'
    return (
        f"SELECT {key}, unnest(regexp_extract_all(html, '{anchor}', 1)) AS href, "
        f"lower(unnest(regexp_extract_all(html, '{anchor}', 2))) AS text, "
        f"generate_subscripts(regexp_extract_all(html, '{anchor}', 1), 1) AS idx FROM {table}"
    )


def _resolved(home: str) -> str:
    return (
        "CASE WHEN href LIKE 'mailto:%' THEN href WHEN href LIKE '//%' THEN 'https:' || href "
        f"WHEN href LIKE '/%' THEN regexp_extract({home}, '^([a-z]+://[^/?#]*)', 1) || href "
        f"ELSE regexp_extract({home}, '^([a-z]+://.*/)[^/]*$', 1) || href END"
    )


_FOLLOWED = f"""
anchors AS ({_links('deco', 'i, url, status')}),
linked AS (SELECT *, {_resolved('url')} AS target,
  regexp_matches(text, '{CONTACT_WORDS}') OR regexp_matches(lower(href), '{CONTACT_WORDS}') AS is_contact,
  regexp_matches(lower(href), '{ADDITIONAL_WORDS}') AS is_additional FROM anchors),
contact_ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY idx) AS slot
  FROM linked WHERE is_contact),
contact AS (SELECT i, url, status, target,
  row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS pos
  FROM contact_ranked WHERE slot <= 5 AND target <> url),
additional_ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY idx) - 1 AS pos
  FROM linked WHERE is_additional AND NOT is_contact AND target <> url AND NOT EXISTS (
    SELECT 1 FROM contact_ranked c WHERE c.i = linked.i AND c.target = linked.target)),
additional AS (SELECT i, url, status, target, pos FROM additional_ranked WHERE pos < 3)"""

_MAILTO = f"""
SELECT i, row_number() OVER (PARTITION BY i ORDER BY idx) - 1 AS pos, email FROM (
  SELECT i, idx, trim(split_part(substr(href, 8), '?', 1)) AS email
  FROM anchors WHERE starts_with(href, 'mailto:')) WHERE {SHAPE}"""

_BIZ = with_clause("biz")
_ROBOTS_BASE = with_clause("robots")
_NORMAL = "CASE WHEN {0} LIKE 'http://%' OR {0} LIKE 'https://%' THEN {0} ELSE 'https://' || {0} END"


def _crawl(keep: str, seen: str = "FALSE", last: str = "robots") -> str:
    """CTEs of a crawl replay up to ``crawled (query, seq, emails)``."""
    return f"""
{with_clause(last)}, {DECO_HITS}, {PAGE_EMAILS}, {_FOLLOWED},
homes AS (SELECT query, seq, {_NORMAL.format('website')} AS home FROM biz
  WHERE website <> '' AND NOT {seen}),
planned AS (
  SELECT query, seq, 0 AS phase, 0 AS pos, home AS visit FROM homes
  UNION ALL SELECT query, seq, 1, pos, {_NORMAL.format('target')} FROM homes
    JOIN contact ON url = home WHERE status < 400
  UNION ALL SELECT query, seq, 2, pos, {_NORMAL.format('target')} FROM homes
    JOIN additional ON url = home WHERE status < 400),
visits AS (SELECT query, visit, min(struct_pack(seq := seq, phase := phase, pos := pos)) AS f
  FROM planned GROUP BY query, visit),
{_LABELS},
reading AS (SELECT v.query, v.f.seq AS seq, v.f.phase AS phase, v.f.pos AS pos, d.i
  FROM visits v JOIN deco d ON d.url = split_part(v.visit, '#', 1) LEFT JOIN labels l ON l.url = v.visit
  WHERE {ADMITTED} AND {keep}),
collected AS (SELECT query, seq, email, min(struct_pack(phase := phase, pos := r.pos, at := m.pos)) AS o
  FROM reading r JOIN page_mail m ON m.i = r.i GROUP BY query, seq, email),
direct AS (SELECT query, seq, email, struct_pack(phase := 3, pos := 0, at := pos) AS o
  FROM homes JOIN deco d ON d.url = home JOIN ({_MAILTO}) t ON t.i = d.i WHERE status < 400),
crawled AS (SELECT query, seq, list(email ORDER BY o) AS emails
  FROM (SELECT * FROM collected UNION ALL SELECT * FROM direct) GROUP BY query, seq)"""


# rules of the catch-all group in file order, as the robots bodies of the fixture state them
_RULE_VALUES = """
rule_values(kind, rule_idx, allow, path_prefix) AS (VALUES
  (2, 0, FALSE, '/contact'), (2, 1, FALSE, '/shop'),
  (3, 1, TRUE, '/shop/7'), (3, 2, FALSE, '/shop'), (3, 3, FALSE, '/support'), (3, 4, TRUE, ''),
  (4, 0, FALSE, '/p/'), (4, 1, FALSE, '/news/4%3Fmail'))"""
_LABELS = f"""
{_RULE_VALUES},
targets AS (SELECT DISTINCT visit AS url FROM visits),
labels AS (SELECT t.url, CASE WHEN coalesce(arg_min(r.allow, r.rule_idx), TRUE) THEN 'allowed'
  WHEN regexp_matches(lower(regexp_extract(t.url, '^[a-z]+://[^/?#]*([^?#]*)', 1)),
    '/contact|/about|/team|/people|/staff') THEN 'contact_exception' ELSE 'denied' END AS access
  FROM targets t LEFT JOIN robots b ON b.base_url = regexp_extract(t.url, '^([a-z]+://[^/?#]*)', 1)
    AND b.status = 200
  LEFT JOIN rule_values r ON r.kind =
      CAST(regexp_extract(b.base_url, 'site([0-9]+)', 1) AS BIGINT) % 5
    AND starts_with(
      replace(regexp_extract(t.url, '^[a-z]+://[^/?#]*(.*)$', 1), '?', '%3F'), r.path_prefix)
  GROUP BY t.url)"""

_LISTED = """
listed AS (SELECT 'q' || CAST(page_id % 25 AS VARCHAR) AS query, page_id AS seq,
  CASE page_id % 4 WHEN 0 THEN 'Shop No. ' || CAST(page_id AS VARCHAR) END AS url_name,
  CASE WHEN page_id % 4 < 2 THEN 'https://maps.example.com' ELSE
    regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) END AS place_base,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title_text, html FROM pages)"""


def _decoded(expr: str) -> str:
    """Character references of the raw pages, decoded."""
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("amp", "&")):
        expr = f"regexp_replace({expr}, '&{entity};?', '{char}', 'g')"
    return expr


def _lines(expr: str) -> str:
    """Visible text: block tags end lines, other tags vanish, white space collapses per line."""
    blocks = "article|blockquote|body|br|button|div|h[1-6]|header|hr|li|main|nav|ol|p|section|table|td|th|tr|ul"
    out = f"regexp_replace({expr}, '<!--.*?-->', '', 'gs')"
    out = f"regexp_replace({out}, '</?(?:{blocks})(?:\\s[^>]*)?>', chr(10), 'g')"
    out = _decoded(f"regexp_replace({out}, '</?[a-z][^>]*>', '', 'g')")
    out = f"regexp_replace({out}, '[ \\t\\r\\f]+', ' ', 'g')"
    return f"trim(regexp_replace({out}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


_RECORDS = f"""
{_LISTED},
texts AS (SELECT *, {_lines("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS h1,
  regexp_extract(html, '<a href="([^"]*)">', 1) AS href,
  {_lines("regexp_extract(html, '<body>(.*)$', 1, 's')")} AS body FROM listed),
records AS (SELECT query, seq, coalesce(url_name, h1) AS name, place_base || href AS website,
  nullif(regexp_extract(body, '{PHONE}'), '') AS phone_number FROM texts)"""


def _greedy(source: str) -> str:
    """Sequential keep-first over ``source``: one step per row of a query, all queries at once."""
    return f"""
keyed AS (SELECT query, seq, nullif(lower(website), '') AS site,
  nullif(translate(phone_number, ' -()', ''), '') AS phone,
  row_number() OVER (PARTITION BY query ORDER BY seq) AS n FROM {source}),
walk AS (
  SELECT DISTINCT query, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, FALSE AS keep,
    CAST([] AS VARCHAR[]) AS sites, CAST([] AS VARCHAR[]) AS phones FROM keyed
  UNION ALL
  SELECT query, n, seq, NOT dup,
    CASE WHEN dup OR site IS NULL THEN sites ELSE list_append(sites, site) END,
    CASE WHEN dup OR phone IS NULL THEN phones ELSE list_append(phones, phone) END
  FROM (SELECT w.query, k.n, k.seq, k.site, k.phone, w.sites, w.phones,
      coalesce(list_contains(w.sites, k.site), FALSE)
        OR coalesce(list_contains(w.phones, k.phone), FALSE) AS dup
    FROM walk w JOIN keyed k ON k.query = w.query AND k.n = w.n + 1))"""


def _ratio(texts: str) -> str:
    """CTEs ending in ``ratios(id, ratio)``: the Ratcliff-Obershelp ratio of ``x`` to ``y`` for each
    row of ``texts(id, x, y)``, as a recursive query over longest common blocks.

    Common characters on one diagonal form maximal runs; in an open range the longest block is the
    longest run clipped to it, earliest in x, then earliest in y. Its two sides are the next ranges.
    """
    return f"""
ch AS (
  SELECT id, 'a' AS side, p AS pos, substr(x, p + 1, 1) AS c FROM (SELECT id, x, unnest(generate_series(0, length(x) - 1)) AS p FROM {texts})
  UNION ALL
  SELECT id, 'b', p, substr(y, p + 1, 1) FROM (SELECT id, y, unnest(generate_series(0, length(y) - 1)) AS p FROM {texts})
), hit AS (
  SELECT a.id, a.pos AS i, a.pos - b.pos AS d FROM ch a JOIN ch b ON a.id = b.id AND a.c = b.c AND a.side = 'a' AND b.side = 'b'
), runs AS (
  SELECT id, d, min(i) AS s, max(i) + 1 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY id, d ORDER BY i) AS island FROM hit)
  GROUP BY id, d, island
), st(id, alo, ahi, blo, bhi, k) AS (
  SELECT id, 0, length(x), 0, length(y), 0 FROM {texts}
  UNION ALL
  SELECT b.id, v.alo, v.ahi, v.blo, v.bhi, v.k FROM (
    SELECT st.id, st.alo, st.ahi, st.blo, st.bhi,
      arg_max({{'i': greatest(r.s, st.alo, st.blo + r.d), 'j': greatest(r.s, st.alo, st.blo + r.d) - r.d,
               'k': least(r.e, st.ahi, st.bhi + r.d) - greatest(r.s, st.alo, st.blo + r.d)}},
              [least(r.e, st.ahi, st.bhi + r.d) - greatest(r.s, st.alo, st.blo + r.d), -greatest(r.s, st.alo, st.blo + r.d), r.d]) AS m
    FROM st JOIN runs r ON r.id = st.id
    WHERE least(r.e, st.ahi, st.bhi + r.d) > greatest(r.s, st.alo, st.blo + r.d)
    GROUP BY st.id, st.alo, st.ahi, st.blo, st.bhi
  ) b, LATERAL (VALUES (0, 0, 0, 0, b.m.k), (b.alo, b.m.i, b.blo, b.m.j, 0), (b.m.i + b.m.k, b.ahi, b.m.j + b.m.k, b.bhi, 0)) v(alo, ahi, blo, bhi, k)
), ratios AS (
  SELECT t.id, CASE WHEN length(t.x) = 0 OR length(t.y) = 0 THEN 0.0
    ELSE 2.0 * coalesce(m.matched, 0) / (length(t.x) + length(t.y)) END AS ratio
  FROM {texts} t LEFT JOIN (SELECT id, sum(k) AS matched FROM st GROUP BY id) m USING (id)
)"""


#: Listings of the similarity rule: parts as listings of their brand, and all pairs of a brand above
#: both thresholds (name 0.8, address 0.7; equal strings always pass).
_SIMILAR = f"""
WITH RECURSIVE src AS (
  SELECT p_brand AS query, p_partkey AS seq, concat_ws(' ', p_name, lower(p_type)) AS name,
    concat(CAST(p_size AS VARCHAR), ' ', p_type, ' street, block ', CAST((p_partkey * 7919) % 1000 AS VARCHAR)) AS address
  FROM part
), r AS (SELECT query, seq, lower(name) AS name, lower(address) AS address FROM src WHERE lower(name) <> '' AND lower(address) <> ''),
pairs AS (
  SELECT row_number() OVER () AS pid, a.query, a.seq AS later, b.seq AS earlier, a.name AS na, b.name AS nb, a.address AS aa, b.address AS ab
  FROM r a JOIN r b ON a.query = b.query AND b.seq < a.seq
), texts AS (SELECT 2 * pid AS id, na AS x, nb AS y FROM pairs UNION ALL SELECT 2 * pid + 1, aa, ab FROM pairs),
{_ratio('texts')},
sim AS (
  SELECT p.query, p.later, p.earlier FROM pairs p JOIN ratios n ON n.id = 2 * p.pid JOIN ratios a ON a.id = 2 * p.pid + 1
  WHERE (p.na = p.nb OR n.ratio > 0.8) AND (p.aa = p.ab OR a.ratio > 0.7)
)"""


def _keep_first(key: str) -> str:
    return f"""
{with_clause('dupes')},
keyed AS (SELECT *, {key} AS key FROM dupes)
SELECT query, seq, name, website, phone_number FROM (
  SELECT *, row_number() OVER (PARTITION BY query, key ORDER BY seq) AS n FROM keyed)
WHERE n = 1 OR key IS NULL"""


_KNOWN = (
    "known AS (SELECT DISTINCT website FROM biz WHERE website LIKE '%/help' OR website LIKE '%/ticket')"
)
_CONTACTS = f"""
{with_clause('biz')}, {DECO_HITS}, {PAGE_EMAILS},
mail AS (SELECT i, list(email ORDER BY pos) AS emails FROM page_mail GROUP BY i),
contacts AS (SELECT b.query, b.seq, b.name || ', "ünï"' AS name, b.website, b.phone_number,
  coalesce(m.emails, []) AS emails, b.seq % 9 = 0 AS skipped
  FROM biz b LEFT JOIN mail m ON m.i = b.seq)"""
_FLAT_LIST = "coalesce(array_to_string(emails, ', '), '')"

ORACLES: dict[str, str] = {
    "site_contacts": f"""
{_PAGES}
SELECT regexp_extract(d.url, '^([a-z]+://[^/?#]*)', 1) AS site, count(DISTINCT d.url) AS pages,
  count(DISTINCT m.email) AS emails,
  count(DISTINCT CASE WHEN {BUSINESS} THEN m.email END) AS business
FROM deco d LEFT JOIN page_mail m ON m.i = d.i WHERE {ADMITTED} GROUP BY 1""",
    "page_admission": f"{_DECO} SELECT url, status, content_type FROM deco WHERE {ADMITTED}",
    "search_urls": """
SELECT text AS query, 'https://www.google.com/maps/search/' || replace(url_encode(text), '%20', '+')
  || '/' AS search_url, substr(md5(text), 1, 8) AS query_hash FROM conversations""",
    "url_parts": f"""
SELECT page_id, {_RAW_BASE} AS base, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
  split_part(url, '#', 1) AS document FROM pages""",
    "website_normalized": f"""
{_BIZ} SELECT seq, {_NORMAL.format('website')} AS url FROM biz WHERE website <> ''""",
    "emails_plain_pages": f"""
WITH hits AS ({_text_hits('pages', 'page_id', 'html')})
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS pos, email
FROM hits WHERE channel = 1""",
    "emails_plain_documents": f"""
WITH hits AS ({_text_hits('documents', 'doc_id', 'text')})
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS pos, email
FROM hits WHERE channel = 1""",
    "emails_obfuscated_documents": f"""
WITH hits AS ({_text_hits('documents', 'doc_id', 'text')})
SELECT doc_id, channel AS channel_ord, email FROM hits WHERE channel > 1""",
    "emails_at_marker": _channel(2),
    "emails_dot_marker": _channel(3),
    "emails_entities": _channel(4),
    "emails_escapes": _channel(5),
    "emails_user_domain": _channel(6),
    "emails_masked_attributes": _channel(7),
    "emails_all_channels": f"""
{_DECO}, {DECO_HITS} SELECT i, channel AS channel_ord,
  row_number() OVER (PARTITION BY i ORDER BY channel, idx) - 1 AS pos, email FROM hits""",
    "emails_mailto": f"{_DECO}, anchors AS ({_links('deco', 'i')}) {_MAILTO}",
    "emails_script_concat": f"""
{_DECO} SELECT i, 'u' || CAST(i AS VARCHAR) || '@shop.org' AS email FROM deco""",
    "business_rule": f"""
{_DECO}, {DECO_HITS} SELECT DISTINCT email, {BUSINESS} AS business FROM hits""",
    "page_fallback": f"""
{_PAGES}
SELECT d.i, coalesce(string_agg(m.email, ' ' ORDER BY m.pos), '') AS emails
FROM deco d LEFT JOIN page_mail m ON m.i = d.i GROUP BY d.i""",
    "element_list": f"""
WITH found AS (SELECT url, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS pos FROM (
  SELECT url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>|<script>.*?</script>', 0, 's') AS ms
  FROM pages))
SELECT url AS page_url, pos, CASE WHEN m LIKE '<a%' THEN 'a' ELSE 'script' END AS tag,
  CASE WHEN m LIKE '<a%' THEN regexp_extract(m, '"([^"]*)"', 1) END AS href,
  CASE WHEN m LIKE '<a%' THEN {_decoded("regexp_extract(m, '>([^<]*)<', 1)")}
    ELSE regexp_extract(m, '<script>(.*)</script>', 1, 's') END AS text FROM found""",
    "link_list": f"""
WITH anchors AS ({_links('pages', 'url')})
SELECT url AS page_url, idx - 1 AS pos, href, text, {_resolved('url')} AS full_url FROM anchors""",
    "contact_links": f"{_DECO}, {_FOLLOWED} SELECT url, pos, target FROM contact",
    "additional_links": f"{_DECO}, {_FOLLOWED} SELECT url, pos, target FROM additional",
    "visits_first": f"""
{_crawl('TRUE')}
SELECT query, f.seq AS seq, f.phase AS phase, f.pos AS pos, visit AS visit_url FROM visits""",
    "robots_rule_list": f"""
{_ROBOTS_BASE}, {_RULE_VALUES},
every AS (SELECT kind, '*' AS agent, rule_idx, allow, path_prefix FROM rule_values
  UNION ALL SELECT 3, 'OtherBot', 0, FALSE, '/')
SELECT base_url, agent, rule_idx, allow, path_prefix FROM robots JOIN every
  ON kind = CAST(regexp_extract(base_url, 'site([0-9]+)', 1) AS BIGINT) % 5 WHERE status = 200""",
    "robots_labels": f"""
{_ROBOTS_BASE}, visits AS (SELECT url AS visit FROM deco), {_LABELS}
SELECT url, access FROM labels""",
    "crawl_emails": f"""
{_crawl('TRUE')}
SELECT h.query, h.seq, coalesce(array_to_string(c.emails, ' '), '') AS emails
FROM homes h LEFT JOIN crawled c ON c.query = h.query AND c.seq = h.seq""",
    "crawl_emails_robots": f"""
{_crawl("l.access = 'allowed'")}
SELECT h.query, h.seq, coalesce(array_to_string(c.emails, ' '), '') AS emails
FROM homes h LEFT JOIN crawled c ON c.query = h.query AND c.seq = h.seq""",
    "contact_run": f"""
{_crawl("l.access = 'allowed'", "(website LIKE '%/help' OR website LIKE '%/ticket')")}
SELECT b.query, b.seq, b.name, b.website, b.phone_number, {_FLAT_LIST} AS email_addresses,
  coalesce(b.website LIKE '%/help' OR b.website LIKE '%/ticket', FALSE) AS skipped
FROM biz b LEFT JOIN crawled c ON c.query = b.query AND c.seq = b.seq""",
    "names_from_url": f"WITH {_LISTED} SELECT seq, url_name AS name FROM listed",
    "names_from_domain": """
WITH hosts AS (SELECT page_id, string_split(split_part(url, '/', 3), '.') AS labels FROM pages),
named AS (SELECT page_id, CASE WHEN labels[1] = 'www' THEN labels[2] ELSE labels[1] END AS label FROM hosts),
words AS (SELECT page_id, string_split(label, '-') AS parts FROM named)
SELECT page_id, array_to_string([upper(p[1]) || lower(p[2:]) FOR p IN parts], '-') AS name FROM words""",
    "names_from_title": f"""
WITH {_LISTED}
SELECT seq, CASE WHEN seq % 3 = 0 AND length(trim(title_text)) > 3 THEN trim(title_text) END AS name FROM listed""",
    "external_links": f"""
WITH anchors AS ({_links('pages', 'url')})
SELECT url AS page_url, idx - 1 AS pos, {_resolved('url')} AS full_url FROM anchors
WHERE NOT contains(url, 'example.net')""",
    "phones_first_match": f"""
SELECT doc_id, nullif(regexp_extract(text, '{PHONE}'), '') AS phone FROM documents""",
    "blocked_searches": f"""
WITH {_LISTED}
SELECT query, seq FROM listed WHERE query NOT IN (SELECT query FROM listed
  WHERE seq % 10 = 7 AND (seq % 50 = 7 OR contains(lower(html), 'captcha')))""",
    "listing_records": f"WITH {_RECORDS} SELECT query, seq, name, website, phone_number FROM records",
    "search_run": f"""
WITH RECURSIVE {_RECORDS}, {_greedy('records')}
SELECT query, seq, name, website, phone_number FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.query ORDER BY r.seq) AS n
  FROM records r JOIN walk w ON w.query = r.query AND w.seq = r.seq WHERE w.keep) WHERE n <= 8""",
    "result_cards": f"""
SELECT CAST(page_id AS VARCHAR) AS query, generate_subscripts(ms, 1) - 1 AS pos, {_lines('unnest(ms)')} AS text
FROM (SELECT page_id, regexp_extract_all(html, '<div class="ad">(.*?)</div>', 1, 's') AS ms FROM pages)""",
    "dedupe_website": _keep_first("nullif(lower(website), '')"),
    "dedupe_phone": _keep_first("nullif(translate(phone_number, ' -()', ''), '')"),
    "similar_businesses": f"{_SIMILAR} SELECT query, later, earlier FROM sim",
    "dedupe_similarity": f"""{_SIMILAR},
ear AS (SELECT query, later AS seq, list(earlier) AS earlier FROM sim GROUP BY ALL),
keyed AS (
  SELECT s.query, s.seq, coalesce(e.earlier, CAST([] AS BIGINT[])) AS earlier, row_number() OVER (PARTITION BY s.query ORDER BY s.seq) AS n
  FROM src s LEFT JOIN ear e ON e.query = s.query AND e.seq = s.seq
), walk AS (
  SELECT DISTINCT query, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, FALSE AS keep, CAST([] AS BIGINT[]) AS kept FROM keyed
  UNION ALL
  SELECT w.query, k.n, k.seq, NOT list_has_any(w.kept, k.earlier),
    CASE WHEN list_has_any(w.kept, k.earlier) THEN w.kept ELSE list_append(w.kept, k.seq) END
  FROM walk w JOIN keyed k ON k.query = w.query AND k.n = w.n + 1
)
SELECT s.query, s.seq, s.name, s.address FROM src s JOIN walk w ON w.query = s.query AND w.seq = s.seq WHERE w.keep""",
    "dedupe_greedy": f"""
{with_clause('dupes')}, {_greedy('dupes')} SELECT d.query, d.seq, d.name, d.website, d.phone_number
FROM dupes d JOIN walk w ON w.query = d.query AND w.seq = d.seq WHERE w.keep""",
    "skip_known": f"""
{_BIZ}, {_KNOWN} SELECT query, seq, website,
  coalesce(website IN (SELECT website FROM known), FALSE) AS skipped FROM biz""",
    "history_merged": f"""
{_BIZ} SELECT DISTINCT website FROM biz WHERE website <> ''""",
    "top_per_query": f"""
{with_clause('dupes')} SELECT query, seq, name, website, phone_number FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY seq) AS n FROM dupes) WHERE n <= 20""",
    "numbered_results": f"""
{with_clause('dupes')} SELECT query, seq, row_number() OVER (PARTITION BY query ORDER BY seq) AS number
FROM dupes""",
    "summary_lines": f"""
{_CONTACTS} SELECT query, seq, website, len(emails) AS email_count,
  row_number() OVER (PARTITION BY query ORDER BY seq) AS number FROM contacts""",
    "query_counts": f"""
{_CONTACTS} SELECT query, count(*) AS businesses, count(DISTINCT website) AS websites,
  count(CASE WHEN len(emails) > 0 THEN 1 END) AS with_emails, CAST(sum(len(emails)) AS BIGINT) AS emails
FROM contacts GROUP BY query""",
    "combined_results": f"""
{_CONTACTS} SELECT query, seq, name, website, CASE WHEN NOT skipped THEN phone_number END AS phone_number,
  skipped FROM contacts""",
    "flat_contacts": f"""
{_CONTACTS} SELECT query, seq, name, website, phone_number, {_FLAT_LIST} AS email_addresses, skipped
FROM contacts""",
    "output_names": """
SELECT text AS query, substr(md5(text), 1, 8) AS query_hash, '2024-01-01_00-00-00' AS run_ts
FROM conversations""",
    "json_read_back": f"""
{_CONTACTS} SELECT query, seq, name, website, phone_number,
  coalesce(array_to_string(emails, ' '), '') AS email_addresses, skipped FROM contacts""",
    "csv_read_back": f"""
{_CONTACTS} SELECT query, seq, name, nullif({_FLAT_LIST}, '') AS email_addresses, skipped FROM contacts""",
    "all_formats": f"""
{_CONTACTS} SELECT 'json' AS format, count(*) AS n FROM contacts
UNION ALL SELECT 'csv', count(*) FROM contacts
UNION ALL SELECT 'excel', count(DISTINCT query) FROM contacts""",
    "history_written": f"""
{_BIZ} SELECT website, CAST(1 AS BIGINT) AS rows FROM biz WHERE website <> '' GROUP BY website""",
    "stream_site_emails": f"""
{_PAGES}
SELECT regexp_extract(d.url, '^([a-z]+://[^/?#]*)', 1) AS website, d.url,
  string_agg(m.email, ' ' ORDER BY m.pos) AS emails
FROM deco d JOIN page_mail m ON m.i = d.i WHERE {ADMITTED} GROUP BY d.url""",
    "stream_first_visits": """
SELECT DISTINCT CAST(user_id AS VARCHAR) || '/' || event_type AS url FROM events""",
    "stream_first_listings": f"""
{with_clause('dupes')} SELECT query, lower(website) AS site, min(seq) AS seq FROM dupes
WHERE website <> '' GROUP BY 1, 2""",
}

# positions and list sizes are 32-bit integers on the other side
_SMALL_INTEGERS = {
    "pos": (
        "emails_plain_pages", "emails_plain_documents", "emails_all_channels", "emails_mailto",
        "element_list", "link_list", "contact_links", "additional_links", "visits_first",
        "external_links", "result_cards",
    ),
    "email_count": ("summary_lines",),
}
for _column, _names in _SMALL_INTEGERS.items():
    for _name in _names:
        ORACLES[_name] = (
            f"SELECT * REPLACE (CAST({_column} AS INTEGER) AS {_column}) FROM ({ORACLES[_name]})"
        )
