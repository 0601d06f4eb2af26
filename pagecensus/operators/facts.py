"""Page facts: one narrow row per page, extracted next to the scan.

The first projection reads the document, each kind of tag in one pass. The next ones work on the
short pieces only. Everything the rules and reports need ends up as small columns, so no later
stage sees the document, its scripts or its links.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.functions import jsonld
from pagecensus.functions.rows import rows_of
from pagecensus.functions.text import (
    NO_QUOTE,
    QUOTE,
    WORD_END,
    WORD_START,
    WS_SET,
    attribute,
    meta_content,
    pattern,
    strip_document,
    strip_tags,
    up_to_last,
    utf16_length,
)

# What counts as a title, heading, script, link, image and so on.
TITLE = pattern(r"(?i)<title[^>]*>([\s\S]*?)</title>")
H1 = pattern(rf"(?i)<h1{WORD_END}[^>]*>([\s\S]*?)</h1>")
SCRIPT = pattern(rf"(?i)<script{WORD_END}[^>]*>[\s\S]*?</script>")
LINK = pattern(rf"(?i)<link{WORD_END}([^>]*)>")
META = pattern(rf"(?i)<meta{WORD_END}([^>]+)>")
CANONICAL = pattern(
    rf"(?i)<link{WORD_END}(?=[^>]*{WORD_START}rel={QUOTE}{NO_QUOTE}*canonical{NO_QUOTE}*{QUOTE})([^>]+)>"
)
HTML_TAG = pattern(r"(?i)<html([^>]+)")
# The tags whose facts lie between ``<`` and ``>``. Their texts put together answer like the document.
SHORT_TAG = pattern(rf"(?i)<(?:(?:meta|link|img){WORD_END}|html)[^>]*>?")
# A relation with an open quote: then the search for a canonical link goes on behind the tag.
OPEN_REL = pattern(rf"(?i){WORD_START}rel={QUOTE}[^\x22\x27>]*>")
IMAGE = pattern(rf"(?i)<img{WORD_END}")
LAZY_IMAGE = pattern(rf"(?i)<img{WORD_END}[^>]*loading={QUOTE}lazy{QUOTE}")
JSON_LD_TYPE = pattern(rf"(?i)type={QUOTE}application/ld\+json{QUOTE}")
DIR_RTL = pattern(rf"(?i)dir={QUOTE}rtl{QUOTE}")
STYLESHEET = pattern(rf"(?i){WORD_START}stylesheet{WORD_END}")
EXTERNAL = pattern(r"(?i)^https?://")
GTM = pattern(r"(?i)googletagmanager\.com/gtm\.js|GTM-[A-Z0-9]")
GA4 = pattern(r"(?i)googletagmanager\.com/gtag/js|G-[A-Z0-9]|gtag\(")
RISKY_CALLS = ("eval(", "document.write(", "atob(", "fromcharcode", "unescape(")
FRAMEWORKS = {
    "next": ("__next_data__", "/_next/"),
    "nuxt": ("__nuxt__", "/_nuxt/"),
    "react": ("react",),
    "vue": ("data-v-", "vue"),
}
ROBOTS_NOT_FOUND = pattern(rf"(?i)^404{WORD_END}")
SITEMAP_BODY = pattern(r"(?i)<urlset|<sitemapindex")

# Columns of ``crawl_pages`` that go along with the facts.
PAGE_COLUMNS = ("page_id", "origin", "url", "template", "status", "error", "csp")


def _contains_any(text: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{needle}')" for needle in needles) + ")"


# Attributes, body and source of ``s``, one whole ``<script ...>...</script>`` text.
_OPENING = "substring_index(s, '>', 1)"
_ATTRS = f"substring({_OPENING}, {len('<script') + 1})"
_BODY = f"substring(s, length({_OPENING}) + 2, length(s) - length({_OPENING}) - {len('>') + len('</script>')})"


def _script_structs(texts: str) -> str:
    return (
        f"transform({texts}, s -> named_struct('attrs', {_ATTRS}, "
        f"'src', {attribute(_ATTRS, 'src')}, 'body', {_BODY}))"
    )


def script_texts(html: str) -> str:
    return f"regexp_extract_all({up_to_last('</script>', html)}, {SCRIPT}, 0)"


def scripts(html: str) -> str:
    """``array<struct<attrs, src, body>>``."""
    return _script_structs(script_texts(html))


def links(html: str) -> str:
    """``array<struct<attrs, rel, href, hreflang>>``."""
    values = ", ".join(f"'{name}', {attribute('l', name)}" for name in ("rel", "href", "hreflang"))
    return f"transform(regexp_extract_all({html}, {LINK}, 1), l -> named_struct('attrs', l, {values}))"


def h1s(html: str) -> str:
    """Headings with their tags stripped. Empty ones stay and count."""
    return f"transform(regexp_extract_all({up_to_last('</h1>', html)}, {H1}, 1), h -> {strip_tags('h')})"


def json_ld_bodies(page_scripts: str) -> str:
    marked = f"filter({page_scripts}, s -> s.attrs RLIKE {JSON_LD_TYPE})"
    return f"transform({marked}, s -> s.body)"


def _html_attribute(name: str) -> str:
    """The last ``name=`` of the first html tag that has one; quotes are optional."""
    value = pattern(rf"(?i)^[\s\S]+{name}={QUOTE}?([^\x22\x27{WS_SET}]+)")
    having = f"get(filter(_html_tags, tag -> tag RLIKE {value}), 0)"
    return strip_tags(f"coalesce(regexp_extract({having}, {value}, 1), '')")


# What one pass over the document each yields. No lambda functions here, so that this projection
# compiles together with the scan.
_FROM_DOCUMENT = {
    "title": strip_tags(f"regexp_extract({up_to_last('</title>', 'html')}, {TITLE}, 1)"),
    "visible_text_length": utf16_length(strip_document("html")),
    "framework": "named_struct("
    + ", ".join(f"'{name}', {_contains_any('lower(html)', words)}" for name, words in FRAMEWORKS.items())
    + ")",
    "_h1s": f"regexp_extract_all({up_to_last('</h1>', 'html')}, {H1}, 1)",
    "_script_texts": script_texts("html"),
    "_tags": f"array_join(regexp_extract_all(html, {SHORT_TAG}, 0), '')",
}

_CANONICAL_TAG = f"regexp_extract({{}}, {CANONICAL}, 1)"


def _from_tags(html: str) -> dict[str, str]:
    """Facts from the short tags. ``html`` is only looked at for a link with an open quote."""
    canonical = (
        f"CASE WHEN _tags RLIKE {OPEN_REL} THEN {_CANONICAL_TAG.format(html)} "
        f"ELSE {_CANONICAL_TAG.format('_tags')} END"
    )
    return {
        "canonical": attribute(canonical, "href"),
        "image_count": f"regexp_count(_tags, {IMAGE})",
        "lazy_images": f"regexp_count(_tags, {LAZY_IMAGE})",
        "_html_tags": f"regexp_extract_all(_tags, {HTML_TAG}, 1)",
        "_metas": f"regexp_extract_all(_tags, {META}, 1)",
        "_link_texts": f"regexp_extract_all(_tags, {LINK}, 1)",
    }


# Then, from the pieces. Each layer uses the one before.
_PIECES = {
    "h1s": f"transform(_h1s, h -> {strip_tags('h')})",
    "_scripts": _script_structs("_script_texts"),
    "_rels": f"transform(_link_texts, l -> {attribute('l', 'rel')})",
}
_SCRIPT_PIECES = {
    "_script_text": "array_join(transform(_scripts, s -> concat(s.src, ' ', s.body)), '\\n')",
    "_json_bodies": json_ld_bodies("_scripts"),
    "third_party_scripts": f"size(filter(_scripts, s -> s.src RLIKE {EXTERNAL}))",
}
_FROM_PIECES = {
    "description": strip_tags(meta_content("_metas", "description")),
    "robots_meta": strip_tags(meta_content("_metas", "robots")),
    "viewport": meta_content("_metas", "viewport"),
    "lang": _html_attribute("lang"),
    "dir": _html_attribute("dir"),
    "script_count": "size(_script_texts)",
    "link_count": "size(_link_texts)",
    "stylesheet_count": f"size(filter(_rels, rel -> rel RLIKE {STYLESHEET}))",
    "link_dir_rtl": f"exists(_link_texts, l -> l RLIKE {DIR_RTL})",
    "has_gtm": f"_script_text RLIKE {GTM}",
    "has_ga4": f"_script_text RLIKE {GA4}",
    "has_data_layer": "contains(lower(_script_text), 'datalayer')",
    "has_risky_script": _contains_any("lower(_script_text)", RISKY_CALLS),
    "json_ld_count": "size(_blocks)",
    "schema_types": jsonld.type_names("_blocks", "_json_bodies"),
    "has_author_schema": jsonld.mentions_author("_blocks"),
}
_KEPT_PIECES = (
    "title", "canonical", "h1s", "visible_text_length", "image_count", "lazy_images", "framework",
    "third_party_scripts",
)


def _aliased(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def page_facts(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per page: what ``crawl_pages`` says about it and the facts, without the document.

    A failed page (``error`` set) has no document to look at: its facts are those of an empty one.
    """
    source = pages.withColumns(
        {
            "html": F.expr("CASE WHEN error IS NULL THEN html ELSE '' END"),
            "status": F.expr("CASE WHEN error IS NULL THEN status ELSE 0 END"),
        }
    )
    return (
        source.selectExpr(*PAGE_COLUMNS, *keep, "html", *_aliased(_FROM_DOCUMENT))
        .selectExpr("*", *_aliased(_from_tags("html")))
        .drop("html")
        .selectExpr("*", *_aliased(_PIECES))
        .selectExpr("*", *_aliased(_SCRIPT_PIECES))
        .selectExpr("*", f"{jsonld.kept_blocks('_json_bodies')} AS _blocks")
        .selectExpr(*PAGE_COLUMNS, *keep, *_KEPT_PIECES, *_aliased(_FROM_PIECES))
    )


def rendered_facts(rendered: DataFrame) -> DataFrame:
    """The three facts the render comparison needs, from rendered documents."""
    state = ("page_id", "ok", "skipped", "render_error")
    ok = rendered.withColumn("html", F.expr("CASE WHEN ok THEN html ELSE '' END"))
    pieces = ok.selectExpr(
        *state,
        f"{utf16_length(strip_document('html'))} AS rendered_text_length",
        f"regexp_extract_all({up_to_last('</h1>', 'html')}, {H1}, 1) AS _h1s",
        f"{script_texts('html')} AS _script_texts",
    ).selectExpr(
        *state,
        "rendered_text_length",
        f"{_PIECES['h1s']} AS rendered_h1s",
        f"{json_ld_bodies(_script_structs('_script_texts'))} AS _json_bodies",
    )
    return pieces.selectExpr(
        *state,
        "rendered_text_length",
        "rendered_h1s",
        f"size({jsonld.kept_blocks('_json_bodies')}) AS rendered_json_ld_count",
    )


# Whether an origin has a robots file and a sitemap, judged by their bodies alone.
RESOURCE_FLAGS = {
    "has_robots_txt": f"robots_body <> '' AND NOT robots_body RLIKE {ROBOTS_NOT_FOUND}",
    "has_sitemap": f"sitemap_body RLIKE {SITEMAP_BODY}",
}


def resource_flags(resources: DataFrame) -> DataFrame:
    """The flags of each origin."""
    return resources.selectExpr("origin", *_aliased(RESOURCE_FLAGS))


def h1_rows(pages: DataFrame) -> DataFrame:
    """Long form of the headings."""
    return rows_of(pages, ["page_id"], h1s("html"), "h1")


def script_rows(pages: DataFrame) -> DataFrame:
    """Long form of the scripts."""
    return rows_of(pages, ["page_id"], scripts("html"), "s").select("page_id", "pos", "s.*")


def link_rows(pages: DataFrame) -> DataFrame:
    """Long form of the links."""
    return rows_of(pages, ["page_id"], links("html"), "l").select("page_id", "pos", "l.*")


def json_ld_rows(pages: DataFrame) -> DataFrame:
    """Long form of the kept JSON-LD blocks, as compact JSON text."""
    blocks = jsonld.kept_blocks(json_ld_bodies(scripts("html")))
    return rows_of(pages, ["page_id"], blocks, "block").selectExpr(
        "page_id", "pos", "to_json(block) AS block"
    )


def json_ld_rejected(pages: DataFrame) -> DataFrame:
    """The JSON-LD blocks that are not kept: ``page_id, pos, reason, body``.

    ``pos`` is the place among the page's scripts, as in ``script_rows``. The reason is ``empty``,
    ``says nothing`` (null, false, zero or an empty string) or ``not one JSON value``.
    """
    marked = rows_of(pages, ["page_id"], scripts("html"), "s").where(f"s.attrs RLIKE {JSON_LD_TYPE}")
    judged = marked.selectExpr("page_id", "pos", f"{jsonld.rejection('s.body')} AS reason", "s.body AS body")
    return judged.where("reason IS NOT NULL")
