"""Input tables: page snapshots, site resources, sitemap files, rendered snapshots, seeds.

Fetching and rendering happen upstream. The functions here bring what they left behind into one
shape: no null text, lower-case header names, an origin per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecensus.functions.urls import parse_or_assume_https, parse_url, template_of

# Fixed value: pages audited per site unless the seed says otherwise.
DEFAULT_MAX_PAGES = 10

CRAWL_PAGES = (
    "page_id bigint, url string, status int, headers map<string,string>, html string, error string"
)
SITE_RESOURCES = "origin string, robots_body string, sitemap_status int, sitemap_body string"
SITEMAP_FILES = "url string, status int, body string"
RENDERED_PAGES = "page_id bigint, url string, ok boolean, skipped boolean, error string, html string"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crawl_pages(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Page snapshots with normalised address, origin and path template; ``keep`` names columns to take along.

    ``csp`` is the one response header the rules read, empty when absent. A text that is no URL
    keeps its spelling and belongs to the origin ``null``.
    """
    csp = "csp"
    if "csp" not in df.columns:
        csp = "try_element_at(transform_keys(headers, (k, v) -> lower(k)), 'content-security-policy')"
    template = template_of("coalesce(parsed.path, '')")
    return df.selectExpr("*", f"{parse_or_assume_https('url')} AS parsed").selectExpr(
        "page_id",
        "coalesce(parsed.origin, 'null') AS origin",
        "coalesce(parsed.url, url) AS url",
        f"{template} AS template",
        "CAST(coalesce(status, 0) AS INT) AS status",
        "error",
        f"coalesce({csp}, '') AS csp",
        "coalesce(html, '') AS html",
        *keep,
    )


def addressed(df: DataFrame) -> DataFrame:
    """The raw ``crawl_pages`` with normalised addresses, for looking up pages before they are read."""
    return df.withColumn("url", F.expr(f"coalesce({parse_or_assume_https('url')}.url, url)"))


def site_resources(df: DataFrame) -> DataFrame:
    """One row per origin; a body that could not be fetched is empty."""
    return df.selectExpr(
        "origin",
        "coalesce(robots_body, '') AS robots_body",
        "CAST(coalesce(sitemap_status, 0) AS INT) AS sitemap_status",
        "coalesce(sitemap_body, '') AS sitemap_body",
    )


def sitemap_files(df: DataFrame) -> DataFrame:
    """Child sitemaps, one row per URL."""
    return df.selectExpr(
        f"coalesce({parse_url('url')}.url, url) AS url",
        "CAST(coalesce(status, 0) AS INT) AS status",
        "coalesce(body, '') AS body",
    )


def rendered_pages(df: DataFrame) -> DataFrame:
    """Rendered snapshots, one row per page."""
    return df.selectExpr(
        "page_id",
        "coalesce(ok, false) AS ok",
        "coalesce(skipped, false) AS skipped",
        "error AS render_error",
        "coalesce(html, '') AS html",
    )


def seeds(df: DataFrame) -> DataFrame:
    """Sites to audit: normalised start URL, origin, and a positive page cap (else the default).

    Rows whose start URL is no URL, even with ``https://`` in front, are dropped: there is no site.
    """
    parsed = df.selectExpr(f"{parse_or_assume_https('start_url')} AS p", "max_pages")
    return parsed.where("p IS NOT NULL").selectExpr(
        "p.origin AS origin",
        "p.url AS start_url",
        f"CAST(CASE WHEN max_pages > 0 THEN max_pages ELSE {DEFAULT_MAX_PAGES} END AS INT) AS max_pages",
    )
