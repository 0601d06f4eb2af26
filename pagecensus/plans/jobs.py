"""Batch jobs: read input tables, write result tables.

Each job writes its expensive stage once and derives the rest from the written table. A lost
executor therefore costs a re-read, and no report table extracts facts again. The tables of a job become
the current ones together, when all are written (``sinks.Run``, ``sinks.read_table``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecensus.operators import findings, notes, patterns, report
from pagecensus.operators.discovery import chosen_pages, discovery_summary
from pagecensus.operators.rules import RULES, Rule
from pagecensus.plans.pipeline import SiteReport, audit_rows, discovered_sites, site_pages
from pagecensus.session import prepare
from pagecensus.sources import snapshots
from pagecensus.sources.sinks import Run, in_site_order, write_page_markdown, write_site_files


def audit_pages(
    spark: SparkSession,
    crawl: DataFrame,
    resources: DataFrame,
    out: str,
    run_ts: str,
    rendered: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    markdown: bool = False,
) -> DataFrame:
    """Audit every snapshot and write tables of findings, patterns, notes and page reports.

    Returns the run summary.
    """
    prepare(spark)
    run = Run(spark, out, run_ts)
    audited = run.write(audit_rows(crawl, resources, rendered, rules), "page_audits")
    rows = findings.finding_rows(audited)
    with_issues = report.page_issues(audited, rules)
    table = patterns.patterns(patterns.pattern_templates(rows))
    results = {
        "findings": findings.described_rows(rows, rules),
        "site_patterns": patterns.site_patterns(table, rules),
        "pattern_urls": patterns.pattern_urls(rows, rules),
        "notes": notes.page_notes(audited),
        "signals": report.observed_signals(audited),
        "summaries": report.executive_summary(with_issues, report.PAGE),
        "action_plans": report.action_plan(with_issues, report.PAGE),
        "severity_counts": report.severity_counts(with_issues, report.PAGE),
        "priorities": report.priority_matrix(with_issues, report.PAGE),
        "fix_plans": report.fix_plan(with_issues, report.PAGE),
        "quick_wins": report.quick_wins(with_issues, report.PAGE),
    }
    for name, result in results.items():
        run.write(result, name)
    summary = run.write(report.run_summary(audited), "run_summary")
    run.finish()
    if markdown:
        documents = report.page_markdown(with_issues, run_ts)
        write_page_markdown(documents, f"{out}/page_markdown/run_date={run.run_date}")
    return summary


def _check_one_seed_per_site(seeds: DataFrame) -> None:
    repeated = snapshots.seeds(seeds).groupBy("origin").count().where("count > 1").select("origin").head()
    if repeated:
        raise ValueError(f"several seeds for {repeated.origin}; give one per site")


def audit_sites(
    spark: SparkSession,
    seeds: DataFrame,
    crawl: DataFrame,
    resources: DataFrame,
    out: str,
    run_ts: str,
    files: DataFrame | None = None,
    rendered: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    files_for: Sequence[str] = (),
) -> DataFrame:
    """Audit the discovered pages of every seed and write the site reports.

    A site is an origin, so there is one seed per origin. The origins in ``files_for`` get their
    document as text files too. Returns the run summary.
    """
    prepare(spark)
    run = Run(spark, out, run_ts)
    _check_one_seed_per_site(seeds)
    sites = run.write(discovered_sites(seeds, resources, files), "sites")
    addresses = snapshots.addressed(crawl).select("page_id", "url")
    chosen = run.stage(chosen_pages(sites, addresses), "chosen_pages")
    pages = run.write(site_pages(chosen, crawl, rendered, rules), "site_pages")

    site_report = SiteReport(pages, rules)
    rows = run.stage(site_report.rows(), "site_reports")
    results = {
        "discovery": discovery_summary(sites),
        "site_patterns_ranked": patterns.site_patterns_ranked(rows),
        "pattern_urls": patterns.pattern_urls(site_report.finding_rows(), rules),
        "severity_counts": report.severity_counts(rows, report.SITE),
        "summaries": report.executive_summary(rows, report.SITE),
        "priorities": report.priority_matrix(rows, report.SITE),
        "fix_plans": report.fix_plan(rows, report.SITE),
        "quick_wins": report.quick_wins(rows, report.SITE),
        "action_plans": report.action_plan(rows, report.SITE),
        "affected_examples": report.affected_example_rows(site_report.examples(rows)),
        "pages_audited": report.pages_audited(pages),
        "notes": site_report.notes(),
    }
    for name, result in results.items():
        run.write(result, name)
    documents = run.write(in_site_order(site_report.markdown(run_ts, rows)), "site_markdown")
    summary = run.write(report.run_summary(pages), "run_summary")
    run.finish()
    if files_for:
        write_site_files(documents, f"{out}/site_files/run_date={run.run_date}", files_for)
    return summary
