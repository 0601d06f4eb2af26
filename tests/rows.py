"""Small literal inputs."""

from __future__ import annotations

from pagecensus.operators import facts
from pagecensus.sources import snapshots


def crawl(spark, rows):
    """Rows of (page_id, url, html) with a plain 200 answer, or dicts for the other columns."""
    full = []
    for row in rows:
        if not isinstance(row, dict):
            row = dict(zip(("page_id", "url", "html"), row))
        full.append(
            (
                row["page_id"], row.get("url", "https://a.example/p"), row.get("status", 200),
                row.get("headers", {}), row.get("html"), row.get("error"),
            )
        )
    return spark.createDataFrame(full, snapshots.CRAWL_PAGES)


def resources(spark, rows=()):
    return spark.createDataFrame(list(rows), snapshots.SITE_RESOURCES)


def rendered(spark, rows):
    return spark.createDataFrame(list(rows), snapshots.RENDERED_PAGES)


def facts_of(spark, *documents):
    """Facts of the given documents, in order."""
    pages = crawl(spark, [(n, f"https://a.example/{n}", html) for n, html in enumerate(documents)])
    return facts.page_facts(snapshots.crawl_pages(pages)).orderBy("page_id").collect()
