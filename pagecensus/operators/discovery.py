"""Which pages of a site get audited: sitemap reading, index expansion, duplicates, page cap.

A sitemap file is reduced where it is read to what can be merged: its first distinct addresses, as many as the
largest page cap of the run, and its number of entries. A site's files, a few at most, are merged in their order. No row
grows with a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecensus.functions.keyfilter import key_filter, passing
from pagecensus.functions.rows import rows_of
from pagecensus.functions.text import WORD_END, WS, bind, decode_entities, pattern, quoted, trim_space
from pagecensus.functions.urls import parse_url, template_of
from pagecensus.operators.facts import RESOURCE_FLAGS

# What a sitemap entry and a sitemap index look like, and how many children count.
LOC = pattern(rf"(?i)<loc>{WS}*([\s\S]*?){WS}*</loc>")
SITEMAP_INDEX = pattern(rf"(?i)<sitemapindex{WORD_END}")
MAX_CHILD_SITEMAPS = 5

NOT_FETCHED = "sitemap was not fetched"

def entries(body: str) -> str:
    """``array<struct<url, origin, path>>`` of a sitemap's valid entries, in file order."""
    decoded = decode_entities(trim_space("l"))
    texts = f"transform(regexp_extract_all({body}, {LOC}, 1), l -> {decoded})"
    parsed = f"transform(filter({texts}, l -> l <> ''), l -> {parse_url('l')})"
    return f"filter({parsed}, e -> e IS NOT NULL)"


def own_urls(listed: str) -> str:
    """URLs of those entries that belong to the row's ``origin``."""
    return f"transform(filter({listed}, e -> e.origin = origin), e -> e.url)"


def sitemap_urls(resources: DataFrame) -> DataFrame:
    """Entries of each origin's own sitemap body, in order."""
    return rows_of(resources, ["origin"], own_urls(entries("sitemap_body")), "url")


def _first_of(listed: str, most: str) -> str:
    """``struct<urls, listed>``: the first distinct of the addresses, at most ``most``, and how many there are in all."""
    return bind(listed, "all", f"named_struct('urls', slice(array_distinct(all), 1, {most}), 'listed', size(all))")


def _merged(first: str, then: str) -> str:
    """The state of two files, the second after the first."""
    urls = f"array_distinct(concat({first}.urls, {then}.urls))"
    return f"named_struct('urls', {urls}, 'listed', {first}.listed + {then}.listed)"


_NONE_FOUND = "named_struct('urls', CAST(array() AS ARRAY<STRING>), 'listed', 0)"


def _children(resources: DataFrame) -> DataFrame:
    """The files a sitemap index names: the first few of the same origin, with their place."""
    first = f"slice({own_urls(entries('sitemap_body'))}, 1, {MAX_CHILD_SITEMAPS})"
    indexes = resources.where(f"sitemap_body RLIKE {SITEMAP_INDEX}")
    return rows_of(indexes, ["origin"], first, "url", "child")


def _named_files(files: DataFrame, resources: DataFrame) -> DataFrame:
    """The readable files that some index names. Their bodies are parsed after this and not moved."""
    readable = files.where("status BETWEEN 200 AND 299")
    return passing(readable, "url", key_filter(_children(resources), "url"))


def sitemap_index_urls(resources: DataFrame, files: DataFrame) -> DataFrame:
    """Pages listed by the children of sitemap indexes, all of them. Only one level deep."""
    read = _named_files(files, resources).selectExpr("url", f"{entries('body')} AS listed")
    joined = _children(resources).join(read, "url").selectExpr("origin", "child", f"{own_urls('listed')} AS urls")
    return rows_of(joined, ["origin", "child"], "urls", "url")


def _sitemaps(resources: DataFrame, most: Column) -> DataFrame:
    """One row per origin: its answer, its own entries and, of an index, the files it names."""
    is_index = f"sitemap_body RLIKE {SITEMAP_INDEX}"
    found = bind(
        own_urls(entries("sitemap_body")), "own",
        f"named_struct('own', {_first_of('own', 'most')}, 'children', CASE WHEN is_index THEN slice(own, 1, {MAX_CHILD_SITEMAPS}) END)",
    )
    flags = [f"{sql} AS {name}" for name, sql in RESOURCE_FLAGS.items()]
    return (
        resources.withColumns({"most": most, "is_index": F.expr(is_index)})
        .selectExpr("origin", "sitemap_status", "is_index", *flags, f"{found} AS found")
        .selectExpr("* EXCEPT (found)", "found.own", "found.children")
    )


def _with_children(sitemaps: DataFrame, resources: DataFrame, files: DataFrame, most: Column) -> DataFrame:
    """The sitemaps with what the files of an index list, merged in the order of the index."""
    own_of_file = own_urls(entries("body")).replace("e.origin = origin", "e.origin = own_origin")
    read = (
        _named_files(files, resources)
        .withColumns({"most": most, "own_origin": F.expr(f"{parse_url('url')}.origin")})
        .selectExpr("url", f"{_first_of(own_of_file, 'most')} AS state")
    )
    keep = ["origin", "sitemap_status", "is_index", *RESOURCE_FLAGS, "own"]
    named = sitemaps.selectExpr(*keep, "posexplode_outer(children) AS (child, url)").join(read, "url", "left")
    # At most MAX_CHILD_SITEMAPS rows per origin come together here.
    together = named.groupBy(*keep).agg(
        F.expr("array_sort(collect_list(CASE WHEN state IS NOT NULL THEN struct(child, state) END)) AS states")
    )
    merged = f"reduce(states, {_NONE_FOUND}, (all, next) -> {_merged('all', 'next.state')})"
    return together.selectExpr(*keep, f"{merged} AS expanded")


def discover(
    seeds: DataFrame, resources: DataFrame, files: DataFrame | None = None, most_pages: int | None = None
) -> DataFrame:
    """One row per site: how its pages were found, how many, and the capped list of them.

    The start URL comes first, then the sitemap in order; of equal URLs the first one stays. A
    sitemap that was not answered with a 2xx status leaves the start URL alone. Whether the site has
    a robots file and a sitemap comes along. A site is an origin: two seeds of one origin fail the query.
    ``most_pages`` bounds the page caps of the seeds; without
    it, the largest of them is looked up.
    """
    most = seeds.agg(F.max("max_pages")).scalar() if most_pages is None else F.lit(most_pages)
    cap = "max_pages" if most_pages is None else f"least(max_pages, {most_pages})"
    one = "if(n = 1, start_url, raise_error(concat('several seeds for ', origin, '; give one per site')))"
    seeds = (
        seeds.groupBy("origin")
        .agg(F.min("start_url").alias("start_url"), F.max("max_pages").alias("max_pages"), F.count(F.lit(1)).alias("n"))
        .selectExpr("origin", f"{one} AS start_url", f"{cap} AS max_pages")
    )
    sitemaps = _sitemaps(resources, most)
    if files is None:
        sitemaps = sitemaps.withColumn("expanded", F.expr(_NONE_FOUND))
    else:
        sitemaps = _with_children(sitemaps, resources, files, most)
    answered = "coalesce(sitemap_status BETWEEN 200 AND 299, false)"
    return (
        seeds.join(sitemaps, "origin", "left")
        .withColumn("answered", F.expr(answered))
        .withColumn("found", F.expr(f"CASE WHEN answered THEN IF(is_index, expanded, own) ELSE {_NONE_FOUND} END"))
        .selectExpr(
            "origin",
            "start_url",
            "max_pages",
            "concat(origin, '/sitemap.xml') AS sitemap_url",
            "CASE WHEN found.listed > 0 THEN 'sitemap.xml' ELSE 'fallback' END AS method",
            "found.listed AS total_discovered",
            f"CASE WHEN answered THEN NULL WHEN coalesce(sitemap_status, 0) = 0 THEN {quoted(NOT_FETCHED)} "
            "ELSE concat('HTTP ', sitemap_status) END AS error",
            "slice(array_distinct(concat(array(start_url), found.urls)), 1, max_pages) AS urls",
            *[f"coalesce({name}, false) AS {name}" for name in RESOURCE_FLAGS],
        )
    )


def discovered_urls(sites: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The pages to audit, numbered from 1 in discovery order; ``keep`` names columns of the site to take along."""
    path = f"coalesce({parse_url('url')}.path, '')"
    return rows_of(sites, ["origin", *keep], "urls", "url").selectExpr(
        "origin", "pos + 1 AS page_pos", "url", f"{template_of(path)} AS template", *keep
    )


def discovery_text(audited: str) -> str:
    """How the pages of a site were found, in words."""
    return (
        f"CASE WHEN method = 'sitemap.xml' THEN concat('sitemap.xml, ', total_discovered, ' listed, ', {audited}, ' audited') "
        "WHEN error IS NOT NULL THEN concat('start URL only (', error, ')') ELSE 'start URL only' END"
    )


def discovery_summary(sites: DataFrame) -> DataFrame:
    return sites.selectExpr(
        "origin", "start_url", "sitemap_url", "method", "total_discovered", "size(urls) AS audited",
        "error", f"{discovery_text('size(urls)')} AS description",
    )


def snapshot_index(pages: DataFrame) -> DataFrame:
    """The page number that stands for each address: the lowest, if several snapshots share it.

    Reads two columns, and copies of one address combine before the shuffle.
    """
    return pages.groupBy("url").agg(F.min("page_id").alias("page_id"))


# What the report shows of a page without a snapshot.
_MISSING = {
    "status": 0,
    "error": "there is no snapshot of this page",
    "csp": "",
    "title": "",
    "visible_text_length": 0,
    "json_ld_count": 0,
    "has_robots_txt": False,
    "has_sitemap": False,
    "render_ok": False,
    "render_skipped": True,
    "text_growth": 0,
    "h1_changed": False,
    "schema_blocks_added": 0,
}

# What the report says about a site.
SITE_COLUMNS = ("start_url", "method", "total_discovered", "discovery_error", "pages")


def chosen_pages(sites: DataFrame, addresses: DataFrame) -> DataFrame:
    """The discovered pages with the ``page_id`` of their snapshot, null if there is none.

    ``addresses`` has ``page_id, url`` of all snapshots. ``SITE_COLUMNS`` and the flags of the site come along.
    """
    described = sites.withColumnRenamed("error", "discovery_error").withColumn("pages", F.expr("size(urls)"))
    discovered = discovered_urls(described, [*SITE_COLUMNS, *RESOURCE_FLAGS])
    return discovered.join(snapshot_index(addresses), "url", "left")


def chosen_only(chosen: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """``tables`` without the rows whose ``page_id`` no site has chosen.

    The filter is applied in the scans and lets a few others pass; ``site_pages`` joins the chosen ones.
    """
    keys = key_filter(chosen.where("page_id IS NOT NULL"), "page_id")
    return [passing(table, "page_id", keys) for table in tables]


def site_pages(chosen: DataFrame, audits: DataFrame) -> DataFrame:
    """The audit of every chosen page, with what is known of its site. A page without a snapshot is a failed page."""
    found = audits.drop("origin", "url", "template", *RESOURCE_FLAGS)
    rows = chosen.join(found, "page_id", "left")
    missing = F.col("page_id").isNull()
    return rows.withColumns(
        {name: F.expr(f"{name} AND page_id IS NOT NULL AND error IS NULL") for name in RESOURCE_FLAGS}
    ).withColumns(
        {
            name: F.when(missing, F.lit(value)).otherwise(F.col(name))
            for name, value in _MISSING.items()
        }
    )
