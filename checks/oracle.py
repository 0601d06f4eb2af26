"""DuckDB SQL for every registered query, as chains of common table expressions.

The SQL takes its own way to each result (tag lists instead of look-arounds, recursive queries,
joins and windows where Spark uses array functions). Only wording is shared with the library.
"""

from __future__ import annotations

import re

from checks.fixtures import VIEWS, duckdb_view
from pagecensus.operators import audit as A
from pagecensus.operators import discovery as D
from pagecensus.operators import notes as N
from pagecensus.operators import report as R
from pagecensus.operators.rules import (
    EFFORTS,
    FAILURE_RULE,
    NO_EVIDENCE,
    RULES,
    SEVERITIES,
)

RUN_TS = "2024-05-01 12:30:00"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


def attr(x: str, name: str) -> str:
    return rf"trim(regexp_extract({x}, '(?i){name}\s*=\s*[\"'']([^\"'']+)[\"'']', 1), E' \t\r\n\f')".replace('\\"', '"')


def utf16(x: str) -> str:
    return rf"CAST(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS INTEGER)"


def first_of(tags: str, pattern: str) -> str:
    return f"list_filter({tags}, lambda t: regexp_matches(t, '{pattern}'))[1]"


CANONICAL = r"""(?i)\brel=["''][^"'']*canonical[^"'']*["'']"""


def meta(name: str) -> str:
    by = [first_of("metas", rf"""(?i)\b{key}=["'']{name}["'']""") for key in ("name", "property")]
    return attr(f"coalesce({by[0]}, {by[1]}, '')", "content")


def html_attr(name: str) -> str:
    pattern = rf"""(?i)^[\s\S]+{name}=["'']?([^"''\s]+)"""
    return strip(f"coalesce(regexp_extract({first_of('html_tags', pattern)}, '{pattern}', 1), '')")


def cell(x: str) -> str:
    return f"replace(replace({x}, '|', '\\|'), chr(10), ' ')"


def urls(n: str) -> str:
    return f"(CAST({n} AS VARCHAR) || CASE WHEN {n} = 1 THEN ' URL' ELSE ' URLs' END)"


def template(url: str) -> str:
    path = rf"regexp_extract({url}, '^https?://[^/?#]*([^?#]*)', 1)"
    parts = f"list_filter(string_split({path}, '/'), lambda p: p <> '')"
    return (
        f"CASE WHEN len({parts}) = 0 THEN 'home' "
        f"WHEN len(list_filter({parts}, lambda p: regexp_full_match(p, '[0-9]{{4}}'))) > 0 THEN 'article/date' "
        f"WHEN len({parts}) = 1 THEN {parts}[1] || ' index' "
        f"WHEN len({parts}) >= 3 THEN {parts}[1] || ' detail' ELSE {parts}[1] || ' page' END"
    )


CTES: dict[str, str] = {name: duckdb_view(name) for name in VIEWS}


def _docs(source: str) -> str:
    return rf"""
SELECT page_id, origin, url, {template('url')} AS template,
  CASE WHEN error IS NULL THEN status ELSE 0 END AS status, error, coalesce(csp, '') AS csp, html
FROM (SELECT * REPLACE (CASE WHEN error IS NULL THEN coalesce(html, '') ELSE '' END AS html) FROM {source}) AS d
"""


def _facts(docs: str, prefix: str) -> dict[str, str]:
    """Facts of the documents in ``docs``; CTE names start with ``prefix``."""
    script = r"(?i)<script\b([^>]*)>([\s\S]*?)</script>"
    return {
        f"{prefix}script_rows": rf"""
SELECT page_id, CAST(pos AS INTEGER) AS pos, attrs, {attr('attrs', 'src')} AS src, body
FROM (SELECT page_id, unnest(a) AS attrs, unnest(b) AS body, unnest(range(len(a))) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '{script}', 1) AS a, regexp_extract_all(html, '{script}', 2) AS b FROM {docs}) AS x) AS y
""",
        f"{prefix}link_rows": rf"""
SELECT page_id, CAST(pos AS INTEGER) AS pos, attrs, {attr('attrs', 'rel')} AS rel, {attr('attrs', 'href')} AS href, {attr('attrs', 'hreflang')} AS hreflang
FROM (SELECT page_id, unnest(a) AS attrs, unnest(range(len(a))) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '(?i)<link\b([^>]*)>', 1) AS a FROM {docs}) AS x) AS y
""",
        f"{prefix}h1_rows": rf"""
SELECT page_id, CAST(pos AS INTEGER) AS pos, {strip('h1')} AS h1
FROM (SELECT page_id, unnest(a) AS h1, unnest(range(len(a))) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '(?i)<h1\b[^>]*>([\s\S]*?)</h1>', 1) AS a FROM {docs}) AS x) AS y
""",
        f"{prefix}jsonld": rf"""
SELECT page_id, pos, json(body) AS block FROM (
  SELECT page_id, pos, trim(body, E' \t\r\n') AS body FROM {prefix}script_rows
  WHERE regexp_matches(attrs, '(?i)type=["'']application/ld\+json["'']')) AS x
WHERE json_valid(body) AND body NOT IN ('null', 'false', '""', '0')
""",
        f"{prefix}nodes": rf"""
SELECT page_id, block AS node FROM {prefix}jsonld
UNION ALL
SELECT page_id, unnest(CASE WHEN json_type(node) = 'ARRAY' THEN json_extract(node, '$[*]')
    WHEN json_type(node) = 'OBJECT' AND json_extract(node, '$."@graph"') IS NOT NULL THEN [json_extract(node, '$."@graph"')]
    ELSE [] END) AS node
FROM {prefix}nodes
""",
        f"{prefix}types": rf"""
SELECT DISTINCT page_id, name FROM (
  SELECT page_id, json_extract_string(node, '$."@type"') AS name FROM {prefix}nodes
  WHERE json_type(node) = 'OBJECT' AND json_type(json_extract(node, '$."@type"')) = 'VARCHAR'
  UNION ALL
  SELECT page_id, unnest(json_extract_string(node, '$."@type"[*]')) AS name FROM {prefix}nodes
  WHERE json_type(node) = 'OBJECT' AND json_type(json_extract(node, '$."@type"')) = 'ARRAY') AS t
WHERE name <> ''
""",
        f"{prefix}facts": rf"""
SELECT d.page_id, d.origin, d.url, d.template, d.status, d.error, d.csp,
  {strip(r"regexp_extract(d.html, '(?i)<title[^>]*>([\s\S]*?)</title>', 1)")} AS title,
  {strip(meta('description'))} AS description, {strip(meta('robots'))} AS robots_meta,
  {attr(f"coalesce({first_of('links', CANONICAL)}, '')", 'href')} AS canonical,
  {meta('viewport')} AS viewport, {html_attr('lang')} AS lang, {html_attr('dir')} AS dir,
  coalesce(h.h1s, '') AS h1s, CAST(coalesce(h.n, 0) AS INTEGER) AS h1_count,
  {utf16(strip('d.html'))} AS visible_text_length,
  CAST(len(regexp_extract_all(d.html, '(?i)<img\b')) AS INTEGER) AS image_count,
  CAST(len(regexp_extract_all(d.html, '(?i)<img\b[^>]*loading=["'']lazy["'']')) AS INTEGER) AS lazy_images,
  regexp_matches(d.html, '(?i)__NEXT_DATA__|/_next/') AS fw_next, regexp_matches(d.html, '(?i)__NUXT__|/_nuxt/') AS fw_nuxt,
  regexp_matches(d.html, '(?i)data-reactroot|react') AS fw_react, regexp_matches(d.html, '(?i)data-v-|vue') AS fw_vue,
  CAST(coalesce(s.n, 0) AS INTEGER) AS script_count, CAST(coalesce(l.n, 0) AS INTEGER) AS link_count,
  CAST(coalesce(l.sheets, 0) AS INTEGER) AS stylesheet_count, coalesce(l.rtl, false) AS link_dir_rtl,
  CAST(coalesce(s.external, 0) AS INTEGER) AS third_party_scripts,
  regexp_matches(coalesce(s.text, ''), '(?i)googletagmanager\.com/gtm\.js|GTM-[A-Z0-9]+') AS has_gtm,
  regexp_matches(coalesce(s.text, ''), '(?i)googletagmanager\.com/gtag/js|G-[A-Z0-9]+|gtag\(') AS has_ga4,
  regexp_matches(coalesce(s.text, ''), '(?i)dataLayer') AS has_data_layer,
  regexp_matches(coalesce(s.text, ''), '(?i)eval\(|document\.write\(|atob\(|fromCharCode|unescape\(') AS has_risky_script,
  CAST(coalesce(j.n, 0) AS INTEGER) AS json_ld_count, coalesce(t.names, '') AS schema_types,
  coalesce(j.author, false) AS has_author_schema
FROM (SELECT *, regexp_extract_all(html, '(?i)<meta\b([^>]+)>', 1) AS metas, regexp_extract_all(html, '(?i)<link\b([^>]+)>', 1) AS links,
        regexp_extract_all(html, '(?i)<html([^>]+)', 1) AS html_tags FROM {docs}) AS d
LEFT JOIN (SELECT page_id, count(*) AS n, string_agg(h1, ' | ' ORDER BY pos) AS h1s FROM {prefix}h1_rows GROUP BY page_id) AS h ON h.page_id = d.page_id
LEFT JOIN (SELECT page_id, count(*) AS n, count(*) FILTER (regexp_matches(src, '(?i)^https?://')) AS external,
             string_agg(src || ' ' || body, chr(10) ORDER BY pos) AS text FROM {prefix}script_rows GROUP BY page_id) AS s ON s.page_id = d.page_id
LEFT JOIN (SELECT page_id, count(*) AS n, count(*) FILTER (regexp_matches(rel, '(?i)\bstylesheet\b')) AS sheets,
             bool_or(regexp_matches(attrs, '(?i)dir=["'']rtl["'']')) AS rtl FROM {prefix}link_rows GROUP BY page_id) AS l ON l.page_id = d.page_id
LEFT JOIN (SELECT page_id, count(*) AS n, bool_or(lower(CAST(block AS VARCHAR)) LIKE '%"author"%') AS author FROM {prefix}jsonld GROUP BY page_id) AS j ON j.page_id = d.page_id
LEFT JOIN (SELECT page_id, string_agg(name, ',' ORDER BY name) AS names FROM {prefix}types GROUP BY page_id) AS t ON t.page_id = d.page_id
""",
    }


def _audit(prefix: str) -> dict[str, str]:
    ok = "(d.error IS NULL AND coalesce(r.ok, false))"
    return {
        f"{prefix}audit": rf"""
SELECT d.*, d.error IS NULL AND coalesce(f.has_robots_txt, false) AS has_robots_txt,
  d.error IS NULL AND coalesce(f.has_sitemap, false) AS has_sitemap,
  {ok} AS render_ok, d.error IS NOT NULL OR coalesce(r.skipped, true) AS render_skipped,
  CASE WHEN d.error IS NOT NULL THEN {lit(A.FAILED_RENDER)} WHEN r.ok IS NULL THEN {lit(A.SKIPPED_NOTE)} ELSE r.error END AS render_error,
  CASE WHEN {ok} THEN greatest(0, r.text_length - d.visible_text_length) ELSE 0 END AS text_growth,
  CASE WHEN {ok} THEN r.h1s <> d.h1s ELSE false END AS h1_changed,
  CASE WHEN {ok} THEN greatest(0, r.json_ld_count - d.json_ld_count) ELSE 0 END AS schema_blocks_added
FROM {prefix}facts AS d
LEFT JOIN rendered_facts AS r ON r.page_id = d.page_id
LEFT JOIN resource_flags AS f ON f.origin = d.origin
""",
        **_findings(f"{prefix}audit", prefix),
    }


PREDICATES = {
    "analytics_missing": ("NOT has_gtm AND NOT has_ga4", None),
    "datalayer_missing": ("(has_gtm OR has_ga4) AND NOT has_data_layer", None),
    "render_text_growth": ("render_ok AND text_growth > 1500", "text_growth"),
    "render_h1_changed": ("render_ok AND h1_changed", None),
    "render_schema_added": ("render_ok AND schema_blocks_added > 0", "schema_blocks_added"),
    "framework_thin_static": ("render_ok AND (fw_next OR fw_nuxt OR fw_react OR fw_vue) AND visible_text_length < 800", None),
    "http_error": ("status >= 400", "status"),
    "noindex": ("robots_meta ILIKE '%noindex%'", None),
    "canonical_missing": ("canonical = ''", None),
    "robots_missing": ("NOT has_robots_txt", None),
    "sitemap_missing": ("NOT has_sitemap", None),
    "title_missing": ("title = ''", None),
    "title_length": (f"title <> '' AND {utf16('title')} NOT BETWEEN 20 AND 65", utf16("title")),
    "description_missing": ("description = ''", None),
    "h1_missing": ("h1_count = 0", None),
    "h1_multiple": ("h1_count > 1", "h1_count"),
    "lang_missing": ("lang = ''", None),
    "schema_missing": ("json_ld_count = 0", None),
    "news_no_breadcrumb": (
        "list_contains(string_split(schema_types, ','), 'NewsArticle') AND NOT list_contains(string_split(schema_types, ','), 'BreadcrumbList')", None,
    ),
    "article_no_author": (
        "(list_contains(string_split(schema_types, ','), 'NewsArticle') OR list_contains(string_split(schema_types, ','), 'Article')) AND NOT has_author_schema", None,
    ),
    "viewport_missing": ("viewport = ''", None),
    "viewport_not_device": (r"viewport <> '' AND NOT regexp_matches(viewport, '(?i)width\s*=\s*device-width')", None),
    "rtl_review": ("dir = 'rtl' AND NOT link_dir_rtl", None),
    "stylesheets_many": ("stylesheet_count > 6", "stylesheet_count"),
    "images_not_lazy": ("image_count > 5 AND lazy_images = 0", "image_count"),
    "third_party_heavy": ("third_party_scripts > 8", "third_party_scripts"),
    "author_signal_missing": (
        "NOT has_author_schema AND NOT regexp_matches(title || ' ' || description || ' ' || h1s, '(?i)author|byline|editor|editorial|reviewed by|escrito por|autor')", None,
    ),
    "not_https": ("url NOT LIKE 'https:%'", None),
    "csp_missing": ("csp = ''", None),
    "risky_script": ("has_risky_script", None),
    FAILURE_RULE: ("true", None),
}


def _catalogue() -> str:
    rows = ", ".join(
        "("
        + ", ".join(
            [
                str(n), lit(r.rule_id), lit(r.area), lit(r.severity), str(SEVERITIES.index(r.severity)), lit(r.effort),
                str(EFFORTS.index(r.effort)), lit(r.title), lit(r.evidence), lit(r.fix), lit(r.validation),
                lit(r.tools),
            ]
        )
        + ")"
        for n, r in enumerate(RULES, start=1)
    )
    return (
        f"SELECT * FROM (VALUES {rows}) AS v(seq, rule_id, area, severity, severity_rank, effort, effort_rank, "
        "title_text, evidence_text, fix, validation, tools)"
    )


def _findings(source: str, prefix: str, pos: str = "page_id") -> dict[str, str]:
    arms = " UNION ALL ".join(
        f"SELECT page_id, {pos} AS page_pos, origin, url, template, error, '{rule}' AS rule_id, "
        f"CAST({measure or 'NULL'} AS BIGINT) AS n FROM {source} "
        f"WHERE {'error IS NOT NULL' if rule == FAILURE_RULE else 'error IS NULL AND (' + predicate + ')'}"
        for rule, (predicate, measure) in PREDICATES.items()
    )
    return {
        f"{prefix}findings": f"""
SELECT h.page_id, h.page_pos, h.origin, h.url, h.template, CAST(row_number() OVER (PARTITION BY h.origin, h.page_pos ORDER BY severity_rank, effort_rank, area, seq) AS INTEGER) AS rank,
  c.seq, c.rule_id, c.area, c.severity, c.severity_rank, c.effort, c.effort_rank,
  replace(title_text, '{{n}}', coalesce(CAST(n AS VARCHAR), '')) AS title,
  CASE WHEN c.rule_id = '{FAILURE_RULE}' THEN h.error ELSE replace(evidence_text, '{{n}}', coalesce(CAST(n AS VARCHAR), '')) END AS evidence,
  c.fix, c.validation, c.tools
FROM ({arms}) AS h JOIN catalogue AS c ON c.rule_id = h.rule_id
"""
    }


def _patterns(findings: str, prefix: str) -> dict[str, str]:
    return {
        f"{prefix}patterns": f"""
SELECT *, shown || ' Found on ' || {urls('affected')} || '.' AS evidence,
  CAST(row_number() OVER (PARTITION BY origin ORDER BY severity_rank, affected DESC, effort_rank, area, first_pos, first_rank) AS INTEGER) AS rank
FROM (
  SELECT origin, rule_id, title, any_value(area) AS area, any_value(severity) AS severity, any_value(severity_rank) AS severity_rank,
    any_value(effort) AS effort, any_value(effort_rank) AS effort_rank, any_value(fix) AS fix, any_value(validation) AS validation,
    any_value(tools) AS tools, count(*) AS affected, count(DISTINCT template) AS template_count, min(page_pos) AS first_pos,
    arg_min(rank, page_pos) AS first_rank,
    coalesce(arg_min(evidence, page_pos) FILTER (evidence <> ''), {lit(NO_EVIDENCE)}) AS shown
  FROM {findings} GROUP BY origin, rule_id, title) AS g
""",
        f"{prefix}pattern_templates": f"""
SELECT origin, rule_id, title, string_agg(template, ', ' ORDER BY first_pos) AS templates
FROM (SELECT origin, rule_id, title, template, min(page_pos) AS first_pos FROM {findings} GROUP BY origin, rule_id, title, template) AS t
GROUP BY origin, rule_id, title
""",
    }


def _loc_rows(source: str, columns: str, body: str) -> str:
    decoded = r"trim(regexp_replace(l, '^\s+|\s+$', '', 'g'))"
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        decoded = f"replace({decoded}, '{entity}', '{char}')"
    return rf"""
SELECT {columns}, url, CAST(row_number() OVER (PARTITION BY {columns} ORDER BY i) - 1 AS INTEGER) AS pos
FROM (SELECT {columns}, {decoded} AS url, i
      FROM (SELECT {columns}, unnest(locs) AS l, unnest(range(len(locs))) AS i
            FROM (SELECT {columns}, regexp_extract_all({body}, '(?i)<loc>([\s\S]*?)</loc>', 1) AS locs FROM {source}) AS a) AS b) AS c
WHERE regexp_extract(url, '^https?://[^/?#]+') = origin
"""


CTES |= {
    "catalogue": _catalogue(),
    "docs": _docs("crawl_pages"),
    "site_docs": _docs("site_snapshots"),
    "rendered_docs": "SELECT page_id, '' AS origin, url, '' AS template, 200 AS status, NULL AS error, '' AS csp, html FROM rendered_pages WHERE ok",
    **_facts("docs", ""),
    **_facts("site_docs", "site_"),
    **_facts("rendered_docs", "rendered_x_"),
    "rendered_facts": """
SELECT r.page_id, r.ok, r.skipped, r.error, f.visible_text_length AS text_length, f.h1s, f.json_ld_count
FROM rendered_pages AS r LEFT JOIN rendered_x_facts AS f ON f.page_id = r.page_id
""",
    "resource_flags": r"""
SELECT origin, robots_body <> '' AND NOT regexp_matches(robots_body, '(?i)^404\b') AS has_robots_txt,
  regexp_matches(sitemap_body, '(?i)<urlset|<sitemapindex') AS has_sitemap FROM site_resources
""",
    **_audit(""),
    **_audit("site_"),
    **_patterns("site_findings", "all_"),
    "locs": _loc_rows("site_resources", "origin", "sitemap_body"),
    "index_locs": _loc_rows("index_resources", "origin", "sitemap_body"),
    "child_locs": _loc_rows(
        "(SELECT i.origin, i.pos AS child, f.body FROM index_locs AS i JOIN index_files AS f ON f.url = i.url WHERE i.pos < 5 AND f.status = 200)",
        "origin, child", "body",
    ),
    "site_child_locs": _loc_rows(
        "(SELECT i.origin, i.pos AS child, f.body FROM locs AS i JOIN site_resources AS r ON r.origin = i.origin JOIN sitemap_files AS f ON f.url = i.url "
        r"WHERE i.pos < 5 AND f.status = 200 AND regexp_matches(r.sitemap_body, '(?i)<sitemapindex\b'))",
        "origin, child", "body",
    ),
    "found_locs": r"""
SELECT l.origin, l.pos, l.url FROM locs AS l JOIN site_resources AS r ON r.origin = l.origin
WHERE NOT regexp_matches(r.sitemap_body, '(?i)<sitemapindex\b')
UNION ALL SELECT origin, child * 10000000 + pos AS pos, url FROM site_child_locs
""",
    "sites": f"""
SELECT s.origin, s.start_url, s.max_pages, s.origin || '/sitemap.xml' AS sitemap_url,
  CASE WHEN coalesce(l.n, 0) > 0 THEN 'sitemap.xml' ELSE 'fallback' END AS method, CAST(coalesce(l.n, 0) AS INTEGER) AS total_discovered,
  CASE WHEN r.sitemap_status BETWEEN 200 AND 299 THEN NULL WHEN coalesce(r.sitemap_status, 0) = 0 THEN {lit(D.NOT_FETCHED)}
    ELSE 'HTTP ' || CAST(r.sitemap_status AS VARCHAR) END AS error
FROM seeds AS s LEFT JOIN site_resources AS r ON r.origin = s.origin
LEFT JOIN (SELECT f.origin, count(*) AS n FROM found_locs AS f JOIN site_resources AS q ON q.origin = f.origin AND q.sitemap_status = 200 GROUP BY f.origin) AS l ON l.origin = s.origin
""",
    "discovered": f"""
SELECT origin, CAST(page_pos AS INTEGER) AS page_pos, url, {template('url')} AS template FROM (
  SELECT u.origin, u.url, row_number() OVER (PARTITION BY u.origin ORDER BY min(u.pos)) AS page_pos, any_value(s.max_pages) AS max_pages
  FROM (SELECT origin, start_url AS url, -1 AS pos FROM sites
        UNION ALL SELECT l.origin, l.url, l.pos FROM found_locs AS l JOIN sites AS s ON s.origin = l.origin WHERE s.method = 'sitemap.xml') AS u
  JOIN sites AS s ON s.origin = u.origin GROUP BY u.origin, u.url) AS g
WHERE page_pos <= max_pages
""",
    "site_pages": """
SELECT d.origin, d.page_pos, d.url, d.template, a.page_id, coalesce(a.status, 0) AS status,
  CASE WHEN a.page_id IS NULL THEN 'there is no snapshot of this page' ELSE a.error END AS error, coalesce(a.title, '') AS title,
  coalesce(a.render_ok, false) AS render_ok, coalesce(a.render_skipped, true) AS render_skipped,
  a.* EXCLUDE (page_id, origin, url, template, status, error, title, render_ok, render_skipped)
FROM discovered AS d LEFT JOIN (SELECT url, min(page_id) AS page_id FROM site_audit GROUP BY url) AS s ON s.url = d.url
LEFT JOIN site_audit AS a ON a.page_id = s.page_id
""",
    **_findings("site_pages", "found_", "page_pos"),
    **_patterns("found_findings", "found_"),
    "site_totals": """
SELECT s.*, coalesce(p.pages, 0) AS pages, coalesce(i.page_findings, 0) AS page_findings, coalesce(i.total, 0) AS total,
  coalesce(i.critical, 0) AS critical, coalesce(i.high, 0) AS high, coalesce(i.medium, 0) AS medium, coalesce(i.low, 0) AS low
FROM sites AS s LEFT JOIN (SELECT origin, count(*) AS pages FROM discovered GROUP BY origin) AS p ON p.origin = s.origin
LEFT JOIN (SELECT origin, count(*) AS total, sum(affected) AS page_findings, count(*) FILTER (severity = 'Critical') AS critical,
    count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low
  FROM found_patterns GROUP BY origin) AS i ON i.origin = s.origin
""",
    "page_totals": """
SELECT a.page_id, a.url, count(f.rule_id) AS total, count(*) FILTER (severity = 'Critical') AS critical,
  count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low
FROM audit AS a LEFT JOIN findings AS f ON f.page_id = a.page_id GROUP BY a.page_id, a.url
""",
}

_RECURSIVE = {"nodes", "site_nodes", "rendered_x_nodes"}


def with_ctes(final: str) -> str:
    """``final`` behind the CTEs it names, directly or through others, each after what it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        tables = re.findall(r"\b(?:FROM|JOIN)\s+\(*([a-z_0-9]+)", CTES[name])
        for need in tables:
            if need in CTES and need != name:
                visit(need)
        order.append(name)

    for need in re.findall(r"\b(?:FROM|JOIN)\s+\(*([a-z_0-9]+)", final):
        if need in CTES:
            visit(need)
    body = ",\n".join(f"{name} AS {'' if name in _RECURSIVE else 'MATERIALIZED '}({CTES[name].strip()})" for name in order)
    return f"WITH RECURSIVE {body}\n{final}" if order else final


_FACT_COLUMNS = (
    "page_id, origin, url, template, status, error, csp, title, description, robots_meta, canonical, viewport, lang, dir, h1s, "
    "h1_count, visible_text_length, image_count, lazy_images, fw_next, fw_nuxt, fw_react, fw_vue, script_count, link_count, "
    "stylesheet_count, link_dir_rtl, third_party_scripts, has_gtm, has_ga4, has_data_layer, has_risky_script, json_ld_count, "
    "schema_types, has_author_schema"
)
_FINDING = "page_id, origin, url, rank, rule_id, area, severity, effort, title, evidence"
_STATUS = (
    "CASE WHEN render_ok THEN 'completed' WHEN render_skipped THEN 'skipped' "
    "ELSE 'not available: ' || coalesce(render_error, 'unknown error') END"
)
_PAGE_NOTE = (
    f"CASE WHEN error IS NOT NULL THEN 'Audit of the page failed: ' || error WHEN render_skipped THEN {lit(N.SKIPPED)} "
    "WHEN NOT render_ok THEN 'The rendered page was not available: ' || coalesce(render_error, 'unknown error') END"
)
_DESCRIPTION = (
    "CASE WHEN method = 'sitemap.xml' THEN 'sitemap.xml, ' || total_discovered || ' listed, ' || {n} || ' audited' "
    "WHEN error IS NOT NULL THEN 'start URL only (' || error || ')' ELSE 'start URL only' END"
)
_SITE_NOTES = f"""
SELECT origin, note_kind, note, min(page_pos) AS first_pos FROM (
  SELECT origin, page_pos, 0 AS note_kind, 'Could not audit ' || url || ': ' || error AS note FROM site_pages
  UNION ALL SELECT origin, page_pos, 1 AS note_kind, {lit(N.PAGE_NOTE)} || {_PAGE_NOTE} AS note FROM site_pages) AS n
WHERE note IS NOT NULL GROUP BY origin, note_kind, note
"""
CTES["site_note_rows"] = _SITE_NOTES


def _counts(source: str, key: str) -> str:
    columns = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ("total", "critical", "high", "medium", "low"))
    return f"SELECT {key}, {columns} FROM {source}"


def _top(source: str, key: str, item: str) -> str:
    """First titles among the blockers of each page or site."""
    return (
        f"(SELECT {key}, string_agg({item}, '; ' ORDER BY rank) AS top FROM {source} "
        f"WHERE severity IN ('Critical', 'High') AND rank <= {R.TOP_TITLES} GROUP BY {key})"
    )


def _nth(source: str, key: str, where: str, k: int, columns: str) -> str:
    """First ``k`` rows per key that satisfy ``where``, renumbered."""
    return (
        f"(SELECT {columns}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY rank) AS INTEGER) AS pos FROM {source} "
        f"WHERE {where} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY rank) <= {k})"
    )


def _areas(names: tuple[str, ...]) -> str:
    return "area IN (" + ", ".join(map(lit, names)) + ")"


def _plan(base: str, base_key: str, source: str, key: str, form: R.Form, scope: str) -> str:
    """Weeks 1 to 3 from the ranked findings, placeholders for empty ones, fixed items for week 4."""
    repeated = " AND affected > 1" if form.is_site else ""
    conditions = ["severity IN ('Critical', 'High')", _areas(R.WEEK_2_AREAS) + repeated, _areas(R.WEEK_3_AREAS)]
    arms = []
    for week, condition in enumerate(conditions, start=1):
        rows = _nth(source, key, condition, form.week_items, f"{key}, title || {scope} || ': ' || fix AS item")
        arms.append(f"SELECT {key}, {week} AS week, pos, item FROM {rows} AS w")
    plan = " UNION ALL ".join(arms)
    keys = key.split(", ")
    on = " AND ".join(f"p.{k} = b.{k}" for k in keys)
    listed = ", ".join(f"b.{k}" for k in keys)
    fixed = ", ".join(f"({n}, {lit(t)})" for n, t in enumerate(form.week_4, start=1))
    return (
        f"SELECT {listed}, w.week, coalesce(p.pos, 1) AS pos, coalesce(p.item, {lit(R.EMPTY_WEEK)}) AS item "
        f"FROM (SELECT {base_key} FROM {base}) AS b CROSS JOIN (VALUES (1), (2), (3)) AS w(week) "
        f"LEFT JOIN ({plan}) AS p ON {on} AND p.week = w.week "
        f"UNION ALL SELECT {listed}, 4 AS week, f.pos, f.item FROM (SELECT {base_key} FROM {base}) AS b CROSS JOIN (VALUES {fixed}) AS f(pos, item)"
    )


def _signals() -> str:
    def absent(name: str) -> str:
        return cell(f"CASE WHEN {name} = '' THEN {lit(R.ABSENT)} ELSE {name} END")

    def found(name: str) -> str:
        return f"CASE WHEN {name} THEN 'found' ELSE {lit(R.ABSENT)} END"

    values = [
        ("Title", absent("title")), ("Description", absent("description")), ("Canonical", absent("canonical")),
        ("Viewport", absent("viewport")), ("Language", absent("lang")), ("H1", "CAST(h1_count AS VARCHAR)"),
        ("JSON-LD blocks", "CAST(json_ld_count AS VARCHAR)"), ("robots.txt", found("has_robots_txt")),
        ("Sitemap", found("has_sitemap")), ("Text before rendering", "visible_text_length || ' characters'"),
        ("Rendered page", _STATUS),
        ("Text added by rendering", f"CASE WHEN render_ok THEN text_growth || ' characters' ELSE {lit(R.NOT_COMPARED)} END"),
    ]
    return " UNION ALL ".join(
        f"SELECT page_id, url, {n} AS pos, {lit(name)} AS signal, {value} AS value FROM audit"
        for n, (name, value) in enumerate(values, start=1)
    )


_SITE_SCOPE = f"(' (' || {urls('affected')} || ')')"
_BY_SEVERITY = "'Critical ' || critical || ', High ' || high || ', Medium ' || medium || ', Low ' || low"
_FIRST = f"CASE WHEN top IS NULL THEN {lit(R.ONLY_LOWER)} ELSE 'Ranked first: ' || top || '.' END"
_PAGE_SUMMARY = f"""
SELECT t.page_id, t.url, CASE WHEN total = 0 THEN {lit(R.NOTHING_FOUND)}
  ELSE 'Findings: ' || total || ' (' || {_BY_SEVERITY} || '). ' || {_FIRST} END AS summary
FROM page_totals AS t LEFT JOIN {_top('findings', 'page_id', "'**' || title || '**'")} AS b ON b.page_id = t.page_id
"""
_SITE_SUMMARY = f"""
SELECT t.origin, CASE WHEN total = 0 THEN {lit(R.NOTHING_FOUND)}
  ELSE 'Pages audited: ' || pages || '. Findings: ' || page_findings || ', which are ' || total || ' different ones (' || {_BY_SEVERITY} || '). ' || {_FIRST} END AS summary
FROM site_totals AS t LEFT JOIN {_top('found_patterns', 'origin', "'**' || title || '** on ' || " + urls('affected'))} AS b ON b.origin = t.origin
"""


def _encoded_hosts(sql: str) -> str:
    """DuckDB cannot encode host names, so the labels of the views are encoded by Python's codec."""
    host = "replace(lower(regexp_extract(auth, '^(?:.*@)?([^:@]*)', 1)), '。', '.')"
    for label in ("bücher", "москва", "例え", "テスト", "a-ñandú-z", "über"):
        host = f"replace({host}, '{label}', 'xn--{label.encode('punycode').decode()}')"
    return sql.replace("HOST AS host", f"{host} AS host")


def _by_area(area: str) -> str:
    return f"SELECT {_FINDING} FROM findings WHERE area = {lit(area)}"


FINAL: dict[str, str] = {
    "page_facts": f"SELECT {_FACT_COLUMNS} FROM facts",
    "h1_rows": "SELECT page_id, pos, h1 FROM h1_rows",
    "script_rows": "SELECT page_id, pos, attrs, src, body FROM script_rows",
    "link_rows": "SELECT page_id, pos, attrs, rel, href, hreflang FROM link_rows",
    "jsonld_rows": "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, CAST(block AS VARCHAR) AS block FROM jsonld",
    "jsonld_types": "SELECT page_id, name AS type FROM types",
    "json_ld_rejected": r"""
SELECT page_id, pos, CASE WHEN trimmed = '' THEN 'empty' WHEN trimmed IN ('null', 'false', '""', '0') THEN 'says nothing' ELSE 'not one JSON value' END AS reason, body
FROM (SELECT page_id, pos, body, trim(body, E' \t\r\n') AS trimmed FROM script_rows WHERE regexp_matches(attrs, '(?i)type=["'']application/ld\+json["'']')) AS s
WHERE NOT json_valid(trimmed) OR trimmed IN ('null', 'false', '""', '0')
""",
    "site_resource_join": "SELECT page_id, origin, url, has_robots_txt, has_sitemap FROM audit",
    "render_diff": "SELECT page_id, url, render_ok, text_growth, h1_changed, schema_blocks_added FROM audit",
    "url_normalize": _encoded_hosts(r"""
SELECT page_id, raw_url, CASE WHEN scheme IN ('http', 'https') THEN scheme || '://' || userinfo || host || port || CASE WHEN rest = '' THEN '/' ELSE rest END ELSE text END AS url,
  CASE WHEN scheme IN ('http', 'https') THEN scheme || '://' || host || port ELSE 'null' END AS origin
FROM (SELECT page_id, raw_url, text, scheme, regexp_extract(auth, '^(.*@)', 1) AS userinfo, HOST AS host,
        CASE WHEN regexp_extract(auth, '(:[0-9]+)$', 1) = CASE scheme WHEN 'http' THEN ':80' ELSE ':443' END THEN '' ELSE regexp_extract(auth, '(:[0-9]+)$', 1) END AS port, rest
      FROM (SELECT page_id, raw_url, text, lower(regexp_extract(text, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
              regexp_extract(text, '^[A-Za-z]+://([^/?#]*)', 1) AS auth, regexp_extract(text, '^[A-Za-z]+://[^/?#]*(.*)$', 1) AS rest
            FROM (SELECT page_id, raw_url, CASE WHEN regexp_matches(trim(raw_url), '^[A-Za-z][A-Za-z0-9+.-]*:') THEN trim(raw_url) ELSE 'https://' || trim(raw_url) END AS text
                  FROM url_spellings) AS a) AS b) AS c
"""),
    "url_templates": "SELECT page_id, origin, url, template FROM site_docs",
    "run_comparison": """
SELECT coalesce(a.url, b.url) AS url, coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(a.area, b.area) AS area,
  coalesce(a.severity, b.severity) AS severity,
  CASE WHEN a.url IS NOT NULL AND b.url IS NOT NULL THEN 'open'
       WHEN a.url IS NOT NULL THEN CASE WHEN a.url IN (SELECT url FROM site_audit) THEN 'resolved' ELSE 'not_audited' END
       ELSE CASE WHEN b.url IN (SELECT url FROM audit) THEN 'new' ELSE 'first_audit' END END AS status
FROM (SELECT DISTINCT url, rule_id, area, severity FROM findings) AS a
FULL JOIN (SELECT DISTINCT url, rule_id, area, severity FROM site_findings) AS b ON a.url = b.url AND a.rule_id = b.rule_id
""",
    "findings_all": f"SELECT page_id, origin, url, rule_id, area, severity, effort, title, evidence FROM findings",
    "findings_ranked": f"SELECT {_FINDING} FROM findings",
    **{f"findings_{area.replace('-', '_')}": _by_area(area) for area in dict.fromkeys(r.area for r in RULES)},
    "run_comparison_counts": """
SELECT origin, severity, status, CAST(sum(n) AS BIGINT) AS findings,
  CAST(coalesce(sum(n) FILTER (status IN ('open', 'resolved', 'not_audited')), 0) AS BIGINT) AS findings_before,
  CAST(coalesce(sum(n) FILTER (status IN ('open', 'new', 'first_audit')), 0) AS BIGINT) AS findings_after
FROM (
  SELECT coalesce(a.origin, b.origin) AS origin, coalesce(a.severity, b.severity) AS severity, 1 AS n,
    CASE WHEN a.url IS NOT NULL AND b.url IS NOT NULL THEN 'open'
         WHEN a.url IS NOT NULL THEN CASE WHEN a.url IN (SELECT url FROM site_audit) THEN 'resolved' ELSE 'not_audited' END
         ELSE CASE WHEN b.url IN (SELECT url FROM audit) THEN 'new' ELSE 'first_audit' END END AS status
  FROM (SELECT DISTINCT origin, url, rule_id, severity FROM findings) AS a
  FULL JOIN (SELECT DISTINCT origin, url, rule_id, severity FROM site_findings) AS b ON a.url = b.url AND a.rule_id = b.rule_id) AS c
GROUP BY CUBE (origin, severity, status)
""",
    "arrival_counts": """
SELECT a.origin, CAST(hour AS BIGINT) AS window_start, CAST(hour + 3600 AS BIGINT) AS window_end, count(DISTINCT a.page_id) AS pages, count(f.rule_id) AS findings,
  count(*) FILTER (f.severity = 'Critical') AS critical, count(*) FILTER (f.severity = 'High') AS high,
  count(*) FILTER (f.severity = 'Medium') AS medium, count(*) FILTER (f.severity = 'Low') AS low
FROM (SELECT DISTINCT page_id, origin, CAST(epoch(fetched_at) AS BIGINT) // 3600 * 3600 AS hour FROM arrivals) AS a
LEFT JOIN findings AS f ON f.page_id = a.page_id
WHERE hour + 3600 <= (SELECT max(CAST(epoch(fetched_at) AS BIGINT)) FROM arrivals) - 7200
GROUP BY a.origin, hour
""",
    "run_summary": "SELECT (SELECT count(DISTINCT origin) FROM audit) AS sites, (SELECT count(*) FROM audit) AS pages, (SELECT count(*) FROM findings) AS findings",
    "sitemap_urls": "SELECT origin, pos, url FROM locs",
    "sitemap_index_urls": "SELECT origin, child, pos, url FROM child_locs",
    "discovered_urls": "SELECT origin, page_pos, url, template FROM discovered",
    "discovery_summary": f"""
SELECT s.origin, start_url, sitemap_url, method, total_discovered, CAST(p.n AS INTEGER) AS audited, error, {_DESCRIPTION.replace('{n}', 'p.n')} AS description
FROM sites AS s JOIN (SELECT origin, count(*) AS n FROM discovered GROUP BY origin) AS p ON p.origin = s.origin
""",
    "site_pages": "SELECT origin, page_pos, url, template, page_id, status, error, title, render_ok, render_skipped FROM site_pages",
    "site_patterns": "SELECT origin, rule_id, area, severity, effort, title, evidence, affected, template_count, first_pos FROM all_patterns",
    "site_patterns_ranked": "SELECT origin, rank, rule_id, area, severity, effort, title, evidence, affected, template_count FROM all_patterns",
    "pattern_urls": "SELECT origin, rule_id, title, page_pos, url FROM site_findings",
    "audit_notes": f"SELECT page_id, origin, url, note FROM (SELECT page_id, origin, url, {_PAGE_NOTE} AS note FROM audit) AS n WHERE note IS NOT NULL",
    "site_audit_notes": "SELECT origin, note_kind, note, first_pos FROM site_note_rows",
    "page_severity_counts": _counts("page_totals", "page_id, url"),
    "severity_counts": _counts("site_totals", "origin, CAST(pages AS INTEGER) AS pages, CAST(page_findings AS BIGINT) AS page_findings"),
    "page_executive_summary": _PAGE_SUMMARY,
    "executive_summary": _SITE_SUMMARY,
    "page_priority_matrix": f"SELECT page_id, url, rank, severity, {cell('title')} AS title, area, effort, {cell('evidence')} AS evidence FROM findings",
    "priority_matrix": f"""
SELECT p.origin, p.rank, p.severity, {cell('p.title')} AS title, p.area, p.effort, p.affected, {cell('t.templates')} AS templates, {cell('p.evidence')} AS evidence
FROM found_patterns AS p JOIN found_pattern_templates AS t ON t.origin = p.origin AND t.rule_id = p.rule_id AND t.title = p.title
""",
    "page_fix_plan": f"SELECT page_id, url, rank, {cell('title')} AS title, {cell('fix')} AS fix, {cell('validation')} AS validation, tools FROM findings",
    "fix_plan": f"SELECT origin, rank, {cell('title')} AS title, {cell('fix')} AS fix, {cell('validation')} AS validation, tools FROM found_patterns",
    "page_quick_wins": "SELECT page_id, url, pos, rule_id, item FROM "
    + _nth("findings", "page_id", "effort = 'Low'", R.PAGE.quick_wins, "page_id, url, rule_id, '**' || title || ':** ' || fix AS item") + " AS q",
    "quick_wins": "SELECT origin, pos, rule_id, item FROM "
    + _nth("found_patterns", "origin", "effort = 'Low'", R.SITE.quick_wins, f"origin, rule_id, '**' || title || ':** ' || fix || {_SITE_SCOPE} AS item") + " AS q",
    "page_action_plan": _plan("audit", "page_id, url", "findings", "page_id, url", R.PAGE, "''"),
    "action_plan": _plan("sites", "origin", "found_patterns", "origin", R.SITE, _SITE_SCOPE),
    "affected_examples": f"""
SELECT p.origin, p.rank, p.rule_id, p.title, f.pos, f.url, greatest(p.affected - {R.EXAMPLE_URLS}, 0) AS others
FROM found_patterns AS p JOIN (SELECT origin, rule_id, title, url, CAST(row_number() OVER (PARTITION BY origin, rule_id, title ORDER BY page_pos) AS INTEGER) AS pos FROM found_findings) AS f
  ON f.origin = p.origin AND f.rule_id = p.rule_id AND f.title = p.title
WHERE p.rank <= {R.EXAMPLE_PATTERNS} AND f.pos <= {R.EXAMPLE_URLS}
""",
    "observed_signals": _signals(),
    "pages_audited": f"""
SELECT s.origin, s.page_pos, {cell('s.url')} AS url, s.status, CAST(f.n AS INTEGER) AS findings,
  {cell(f"CASE WHEN title = '' THEN {lit(R.ABSENT)} ELSE title END")} AS title, {_STATUS} AS rendered
FROM site_pages AS s JOIN (SELECT p.origin, p.page_pos, count(r.rule_id) AS n FROM site_pages AS p
    LEFT JOIN found_findings AS r ON r.origin = p.origin AND r.page_pos = p.page_pos GROUP BY p.origin, p.page_pos) AS f
  ON f.origin = s.origin AND f.page_pos = s.page_pos
""",
}


def _md_rows(source: str, key: str, line: str, order: str) -> str:
    """Lines of one section per page or site."""
    return f"(SELECT {key}, string_agg({line}, chr(10) ORDER BY {order}) AS md FROM {source} GROUP BY {key})"


def _md_cells(*cells: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(cells) + " || ' |'"


def _md_head(columns: str) -> str:
    n = columns.count("|") - 1
    return lit(columns) + " || chr(10) || " + lit("|" + " --- |" * n) + " || chr(10) || "


def _md_plan(plan: str, key: str, form: R.Form) -> str:
    """The four weeks with their headings."""
    titles = "CASE week " + " ".join(
        f"WHEN {n} THEN {lit(f'### Week {n}: {title}')}" for n, title in enumerate(form.week_titles, start=1)
    ) + " END"
    weeks = _md_rows(f"({plan}) AS p", f"{key}, week", "'- ' || item", "pos")
    return (
        f"(SELECT {key}, string_agg({titles} || chr(10) || chr(10) || md, chr(10) || chr(10) ORDER BY week) AS md "
        f"FROM {weeks} AS w GROUP BY {key})"
    )


def _md_join(base: str, key: str, sections: dict[str, tuple[str, str]], heading: str) -> str:
    """``heading`` and the sections one after the other; a section is (text around ``md``, table)."""
    nl2 = "chr(10) || chr(10)"
    parts, joins = [heading], []
    for n, (title, (text, table)) in enumerate(sections.items()):
        parts.append(f"{lit('## ' + title)} || {nl2} || " + text.replace("md", f"s{n}.md"))
        joins.append(f"LEFT JOIN {table} AS s{n} ON s{n}.{key} = b.{key}")
    document = f" || {nl2} || ".join(f"({part})" for part in parts)
    return f"SELECT {document} AS markdown, b.* FROM {base} AS b " + " ".join(joins)


_STAMP = "'2024-05-01T12:30:00.000Z'"
_QUICK = f"coalesce(md, {lit('- ' + R.NO_QUICK_WINS)})"


def _md_common(key: str, findings: str, matrix: tuple[str, ...], extra_head: str, names: tuple[str, str, str]) -> dict[str, tuple[str, str]]:
    summary, quick, plan = names
    form = R.PAGE if key == "page_id" else R.SITE
    return {
        "Summary": ("md", f"(SELECT {key}, summary AS md FROM ({FINAL[summary]}) AS x)"),
        "Priorities": (
            _md_head(f"| Severity | Finding | Area | Effort |{extra_head} Evidence |") + "coalesce(md, '')",
            _md_rows(findings, key, _md_cells(*matrix), "rank"),
        ),
        "How to fix and verify": (
            _md_head("| Finding | Fix | Verify | Tools |") + "coalesce(md, '')",
            _md_rows(findings, key, _md_cells(cell("title"), cell("fix"), cell("validation"), "tools"), "rank"),
        ),
        "Quick wins": (_QUICK, _md_rows(f"({FINAL[quick]}) AS x", key, "'- ' || item", "pos")),
        "Plan for 30 days": ("md", _md_plan(FINAL[plan], key, form)),
    }


def _page_markdown() -> str:
    matrix = ("severity", cell("title"), "area", "effort", cell("evidence"))
    sections = _md_common("page_id", "findings", matrix, "", ("page_executive_summary", "page_quick_wins", "page_action_plan"))
    sections["What was seen"] = (
        _md_head("| Signal | Value |") + "md",
        _md_rows(f"({FINAL['observed_signals']}) AS x", "page_id", _md_cells("signal", "value"), "pos"),
    )
    sections["Notes"] = (
        f"'- ' || coalesce(md, {lit(R.CLEAN_NOTES)}) || chr(10)",
        f"(SELECT page_id, note AS md FROM ({FINAL['audit_notes']}) AS x)",
    )
    heading = (
        "'# Page audit' || chr(10) || chr(10) || '**Page:** ' || b.url || '  ' || chr(10) || '**Audited:** ' || "
        f"{_STAMP} || '  ' || chr(10) || '**HTTP status:** ' || b.status"
    )
    document = _md_join("(SELECT page_id, url, status FROM audit)", "page_id", sections, heading)
    return f"SELECT page_id, url, markdown FROM ({document}) AS d"


def _site_markdown() -> str:
    matrix = (
        "severity", cell("title"), "area", "effort", "CAST(affected AS VARCHAR)", cell("templates"), cell("evidence"),
    )
    with_templates = (
        "(SELECT p.*, t.templates FROM found_patterns AS p JOIN found_pattern_templates AS t "
        "ON t.origin = p.origin AND t.rule_id = p.rule_id AND t.title = p.title) AS f"
    )
    common = _md_common(
        "origin", with_templates, matrix, " Pages | Templates |", ("executive_summary", "quick_wins", "action_plan")
    )
    block = (
        f"(SELECT e.origin, e.rank, '### ' || any_value(p.severity) || ': ' || any_value(e.title) || chr(10) || chr(10) || "
        "string_agg('- ' || e.url, chr(10) ORDER BY e.pos) || CASE WHEN any_value(e.others) > 0 "
        "THEN chr(10) || '- and ' || any_value(e.others) || ' more' ELSE '' END AS block "
        f"FROM ({FINAL['affected_examples']}) AS e JOIN found_patterns AS p ON p.origin = e.origin AND p.rank = e.rank "
        "GROUP BY e.origin, e.rank) AS x"
    )
    examples = f"(SELECT origin, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS md FROM {block} GROUP BY origin)"
    sections = {}
    for title, section in common.items():
        if title == "Quick wins":
            sections["Pages concerned"] = ("coalesce(md, '')", examples)
        sections[title] = section
    heading = (
        "'# Site audit' || chr(10) || chr(10) || '**Site:** ' || b.start_url || '  ' || chr(10) || '**Audited:** ' || "
        f"{_STAMP} || '  ' || chr(10) || '**Pages:** ' || b.pages || '  ' || chr(10) || '**Found by:** ' || "
        + _DESCRIPTION.replace("{n}", "b.pages")
    )
    head = _md_join("site_totals", "origin", sections, heading)
    page_head = "## Pages\n\n| Page | Status | Findings | Title | Rendered page |\n| --- | --- | --- | --- | --- |\n"
    lines = _md_cells("url", "CAST(status AS VARCHAR)", "CAST(findings AS VARCHAR)", "title", "rendered")
    block_of = f"CAST(({{}} - 1) // {R.LINES_PER_PART} AS BIGINT)"
    pages = _md_rows(f"(SELECT *, 1 + {block_of.format('page_pos')} AS part FROM ({FINAL['pages_audited']}) AS y) AS x", "origin, part", lines, "page_pos")
    first_note = f"{R.NOTES_PART} + 1 + CAST(note_kind AS BIGINT) * {R.NOTES_PART} + {block_of.format('first_pos')}"
    notes = _md_rows(f"(SELECT *, {first_note} AS part FROM site_note_rows) AS x", "origin, part", "'- ' || note", "first_pos")
    clean = lit(f"- {R.CLEAN_NOTES}\n")
    return f"""
SELECT origin, CAST(0 AS BIGINT) AS part, markdown || chr(10) || chr(10) || {lit(page_head)} AS markdown FROM ({head}) AS d
UNION ALL SELECT origin, part, md || chr(10) AS markdown FROM {pages} AS p
UNION ALL SELECT s.origin, CAST({R.NOTES_PART} AS BIGINT) AS part, chr(10) || '## Notes' || chr(10) || chr(10) || CASE WHEN n.n IS NULL THEN {clean} ELSE '' END AS markdown
FROM sites AS s LEFT JOIN (SELECT origin, count(*) AS n FROM site_note_rows GROUP BY origin) AS n ON n.origin = s.origin
UNION ALL SELECT origin, part, md || chr(10) AS markdown FROM {notes} AS q
"""


FINAL["page_report_markdown"] = _page_markdown()
FINAL["report_markdown"] = _site_markdown()


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(sql.strip()) for name, sql in FINAL.items()}
