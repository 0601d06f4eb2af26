"""The pipeline as lazy DataFrames: snapshots, audit rows, findings, patterns, report tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.operators import audit, discovery, facts, findings, notes, patterns, report
from pagecensus.operators.rules import RULES, Rule
from pagecensus.session import stage
from pagecensus.sources import snapshots


def audit_rows(
    crawl: DataFrame,
    resources: DataFrame | None,
    rendered: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per snapshot with facts, comparison, flags and ranked findings.

    Takes the raw input tables. Documents are read in the scan stage and go no further. ``keep`` names
    columns of ``crawl`` to take along.
    """
    pages = snapshots.crawl_pages(crawl, keep)
    page_facts = facts.page_facts(pages, keep)
    rendered_facts = (
        None if rendered is None else facts.rendered_facts(snapshots.rendered_pages(rendered))
    )
    rows = audit.with_render(page_facts, rendered_facts)
    if resources is None:
        # Pages of a site take over the flags of the site.
        rows = rows.withColumns({name: F.lit(False) for name in facts.RESOURCE_FLAGS})
    else:
        rows = audit.with_resource_flags(rows, facts.resource_flags(snapshots.site_resources(resources)), pages)
    return findings.with_findings(rows, rules)


def discovered_sites(
    seeds: DataFrame, resources: DataFrame, files: DataFrame | None = None
) -> DataFrame:
    """One row per site with its capped list of pages. Takes the raw input tables."""
    return discovery.discover(
        snapshots.seeds(seeds),
        snapshots.site_resources(resources),
        None if files is None else snapshots.sitemap_files(files),
    )


def site_pages(
    chosen: DataFrame, crawl: DataFrame, rendered: DataFrame | None = None, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Audit rows of the ``chosen`` pages (``discovery.chosen_pages``), from the raw input tables.

    Facts are extracted from chosen pages only. Flags of the origin are those of the site.
    """
    tables = discovery.chosen_only(chosen, crawl, *([] if rendered is None else [rendered]))
    audits = audit_rows(tables[0], None, *tables[1:], rules=rules)
    return findings.with_findings(discovery.site_pages(chosen, audits.drop("findings")), rules)


def site_report(
    sites: DataFrame,
    crawl: DataFrame,
    rendered: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    staged: bool = False,
) -> SiteReport:
    """Report tables over what the ``sites`` have chosen, without writing anything unless ``staged``.

    The table of chosen pages is used three times and kept by Spark when it is first computed, some hundred
    bytes a page; ``release`` gives it back. ``staged`` writes the audited pages to the shared folder. Stage them
    when several tables, or a document made of several, are asked for.
    """
    chosen = discovery.chosen_pages(sites, snapshots.addressed(crawl).select("page_id", "url")).persist()
    pages = site_pages(chosen, crawl, rendered, rules)
    return SiteReport(stage(pages, "site_pages") if staged else pages, rules, chosen)


@dataclass(frozen=True)
class SiteAudit:
    """The sites of a run over finished audits.

    ``sites`` has one row per site, ``audits`` one audit row per snapshot.
    """

    sites: DataFrame
    audits: DataFrame
    rules: Sequence[Rule] = RULES

    def pages(self) -> DataFrame:
        """Audit rows of the discovered pages. Findings are taken anew: a missing page has one."""
        chosen = discovery.chosen_pages(self.sites, self.audits.select("page_id", "url"))
        return findings.with_findings(discovery.site_pages(chosen, self.audits.drop("findings")), self.rules)

    def report(self, staged: bool = False) -> SiteReport:
        """Report tables over the pages; ``staged`` writes the pages to the shared folder first."""
        pages = self.pages()
        return SiteReport(stage(pages, "site_pages") if staged else pages, self.rules)


@dataclass(frozen=True)
class SiteReport:
    """Report tables over ``pages``, the audit rows of the discovered pages.

    A page row carries what is known of its site, and a page without findings goes along with the findings of
    the others, so every table comes out of one pass over the pages.
    """

    pages: DataFrame
    rules: Sequence[Rule] = RULES
    kept: DataFrame | None = None

    def release(self) -> None:
        """Give back the table of chosen pages. Tables made from it are computed anew if asked for again."""
        if self.kept is not None:
            self.kept.unpersist()

    def finding_rows(self) -> DataFrame:
        return findings.finding_rows(self.pages, "page_pos")

    def rows(self) -> DataFrame:
        """One row per site: discovery, counts and its ranked patterns as ``issues``.

        The page cap of the seeds bounds the list of templates.
        """
        rows = findings.finding_rows(self.pages, "page_pos", discovery.SITE_COLUMNS, clean_pages=True)
        per_template = patterns.pattern_templates(rows, discovery.SITE_COLUMNS)
        found = patterns.patterns(per_template, list_templates=True, keep=discovery.SITE_COLUMNS)
        return report.site_rows(patterns.site_issues(found, self.rules, discovery.SITE_COLUMNS))

    def examples(self, rows: DataFrame | None = None) -> DataFrame:
        first = patterns.first_urls(self.finding_rows(), report.EXAMPLE_URLS)
        return report.affected_examples(self.rows() if rows is None else rows, first)

    def notes(self) -> DataFrame:
        return notes.site_notes(self.pages)

    def markdown(self, run_ts: str, rows: DataFrame | None = None) -> DataFrame:
        """The site documents in parts. Pass the staged ``rows``: three sections read them."""
        rows = stage(self.rows(), "site_rows") if rows is None else rows
        return report.site_markdown(rows, self.examples(rows), self.pages, self.notes(), run_ts)
