"""URL normalisation, origin and path template as Spark SQL expressions.

A URL is split once into a struct and put together again from its parts. Host names outside ASCII are
encoded. Schemes other than http and https are kept untouched.
"""

from __future__ import annotations

from pagecensus.functions.hostnames import ascii_host
from pagecensus.functions.text import bind, pattern, quoted

_SCHEME = pattern(r"^([A-Za-z][A-Za-z0-9+.\-]*):")
_WEB_URL = pattern(r"^[A-Za-z]+:[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#[\s\S]*)?$")
_HOST = pattern(r"^(?:\[[0-9a-f:.]+\]|[^\x00-\x20\x22#%/:<>?@\[\\\]\^`{|}\x7f]+)$")

# Characters a URL carries percent-encoded, per part.
_ENCODE_PATH = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "`": "%60", "{": "%7B", "}": "%7D", "^": "%5E"}
_ENCODE_QUERY = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "'": "%27"}
_ENCODE_FRAGMENT = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "`": "%60"}


def _percent_encode(text: str, table: dict[str, str]) -> str:
    ascii_done = text
    for char, code in table.items():
        ascii_done = f"replace({ascii_done}, {quoted(char)}, {quoted(code)})"
    special = pattern(r"[^\x00-\x7F]")
    return (
        f"CASE WHEN {text} RLIKE {special} THEN array_join(transform(split({ascii_done}, ''), "
        f"c -> CASE WHEN c RLIKE {special} THEN regexp_replace(hex(c), '(..)', '%$1') ELSE c END), '') "
        f"ELSE {ascii_done} END"
    )


def _plain_dots(path: str) -> str:
    """Write the dots of ``.`` and ``..`` segments plainly; they may be percent-encoded."""
    two = f"regexp_replace({path}, {pattern(r'(?i)/(?:[.]|%2e){2}(?=/|$)')}, '/..')"
    one = f"regexp_replace({two}, {pattern(r'(?i)/(?:[.]|%2e)(?=/|$)')}, '/.')"
    return f"CASE WHEN {path} RLIKE '(?i)/[.]?%2e' THEN {one} ELSE {path} END"


def _without_dots(path: str) -> str:
    """Resolve ``.`` and ``..`` path segments."""
    walked = (
        f"reduce(slice(split({path}, '/'), 2, size(split({path}, '/'))), CAST(array() AS ARRAY<STRING>), "
        "(acc, part) -> CASE WHEN part = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) "
        "WHEN part = '.' THEN acc ELSE array_append(acc, part) END)"
    )
    ends_open = pattern(r"/\.\.?$")
    end = f"CASE WHEN {path} RLIKE {ends_open} THEN '/' ELSE '' END"
    resolved = f"regexp_replace(concat('/', array_join({walked}, '/'), {end}), r'^/+(?=/$)', '')"
    has_dots = pattern(r"/\.\.?(/|$)")
    return f"CASE WHEN {path} RLIKE {has_dots} THEN {resolved} ELSE {path} END"


def _split(url: str) -> str:
    ends = pattern(r"^[\x00-\x20]+|[\x00-\x20]+$")
    breaks = pattern(r"[\t\n\r]")
    text = f"regexp_replace(regexp_replace({url}, {ends}, ''), {breaks}, '')"
    fields = [f"'text', t, 'scheme', lower(regexp_extract(t, {_SCHEME}, 1))"]
    for n, name in enumerate(("authority", "path", "query", "fragment"), start=1):
        fields.append(f"'{name}', regexp_extract(t, {_WEB_URL}, {n})")
    return bind(text, "t", f"named_struct({', '.join(fields)})")


_HOST_PORT = "regexp_extract(u.authority, '([^@]*)$', 1)"
_USER_INFO = "regexp_replace(u.authority, '[^@]*$', '')"
_BACKSLASH = quoted("\\")
_PIECES = f"""named_struct(
  'text', u.text,
  'scheme', u.scheme,
  'host', {bind(f"lower(regexp_replace({_HOST_PORT}, ':[0-9]*$', ''))", "name", ascii_host)},
  'port', regexp_extract({_HOST_PORT}, ':([0-9]+)$', 1),
  'userinfo', CASE WHEN {_USER_INFO} IN ('@', ':@') THEN '' ELSE {_USER_INFO} END,
  'path', replace(u.path, {_BACKSLASH}, '/'),
  'query', CASE WHEN u.query = '?' THEN '' ELSE u.query END,
  'fragment', CASE WHEN u.fragment = '#' THEN '' ELSE u.fragment END)"""
_PORT_NUMBER = "try_cast(p.port AS INT)"
# Default ports.
_PORT = f"""CASE WHEN p.port = '' OR (p.scheme = 'http' AND {_PORT_NUMBER} = 80) OR (p.scheme = 'https' AND {_PORT_NUMBER} = 443)
  THEN '' ELSE concat(':', {_PORT_NUMBER}) END"""
_ORIGIN = f"concat(p.scheme, '://', p.host, {_PORT})"
_PATH = f"CASE WHEN p.path = '' THEN '/' ELSE {bind(_percent_encode('p.path', _ENCODE_PATH), 'e', lambda e: bind(_plain_dots(e), 'd', _without_dots))} END"
_URL = f"""concat(p.scheme, '://', p.userinfo, p.host, {_PORT}, {_PATH},
  {_percent_encode('p.query', _ENCODE_QUERY)}, {_percent_encode('p.fragment', _ENCODE_FRAGMENT)})"""
_ASSEMBLED = f"""CASE
  WHEN p.scheme IN ('http', 'https') AND p.host RLIKE {_HOST} AND (p.port = '' OR coalesce({_PORT_NUMBER}, 65536) <= 65535)
    THEN named_struct('url', {_URL}, 'origin', {_ORIGIN}, 'path', {_PATH})
  WHEN p.scheme NOT IN ('', 'http', 'https') THEN named_struct('url', p.text, 'origin', 'null', 'path', '') END"""


# Addresses that are in normal form already: plain host, no port, no query, no dot segments.
_NORMAL = pattern(r"^https?://[a-z0-9][a-z0-9.-]*/(?!.*/(?:[.]|%2[eE]))(?![.]|%2[eE])[A-Za-z0-9._~!$&\x27()*+,;=:@/%-]*\z")


def parse_url(url: str) -> str:
    """``struct<url, origin, path>`` of an absolute URL, null when it is not one."""
    origin = f"substring_index({url}, '/', 3)"
    as_it_is = f"named_struct('url', {url}, 'origin', {origin}, 'path', substring({url}, length({origin}) + 1))"
    parsed = bind(_split(url), "u", bind(_PIECES, "p", _ASSEMBLED))
    return f"CASE WHEN {url} RLIKE {_NORMAL} THEN {as_it_is} ELSE {parsed} END"


def parse_or_assume_https(url: str) -> str:
    """``parse_url``, with an ``https://`` prefix where the text alone is no URL."""
    prefixed = f"concat('https://', {url})"
    return f"coalesce({parse_url(url)}, {parse_url(prefixed)})"


def template_of(path: str) -> str:
    """Coarse page template of a URL path."""
    return bind(
        f"filter(split({path}, '/'), part -> part <> '')",
        "parts",
        "CASE WHEN size(parts) = 0 THEN 'home' "
        "WHEN exists(parts, part -> part RLIKE '^[0-9]{4}$') THEN 'article/date' "
        "WHEN size(parts) = 1 THEN concat(parts[0], ' index') "
        "WHEN size(parts) >= 3 THEN concat(parts[0], ' detail') "
        "ELSE concat(parts[0], ' page') END",
    )
