"""Findings: the rules evaluated over audit rows, as an array per page or one row each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.functions.text import bind
from pagecensus.operators.rules import FAILURE_RULE, RULES, Rule, by_priority, guidance


def _finding(priority: int, rule: Rule) -> str:
    """Numbers and the error text only. The wording is added where it is shown."""
    measure = f"CAST({rule.measure or 'NULL'} AS BIGINT)"
    title_n = measure if rule.titled_by_measure else "0L"
    detail = "error" if rule.rule_id == FAILURE_RULE else "''"
    return f"named_struct('priority', {priority}, 'title_n', {title_n}, 'measure', {measure}, 'detail', {detail})"


def with_findings(audits: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``findings``, the ranked array of what each page fails.

    The rules are listed in priority order, so no page has to sort anything. A failed page has
    exactly one finding.
    """
    ordered = list(enumerate(by_priority(rules), start=1))
    checks = [
        f"CASE WHEN {r.when} THEN {_finding(p, r)} END" for p, r in ordered if r.rule_id != FAILURE_RULE
    ]
    found = f"array_compact(array({', '.join(checks)}))"
    for p, r in ordered:
        if r.rule_id == FAILURE_RULE:
            found = f"CASE WHEN error IS NOT NULL THEN array({_finding(p, r)}) ELSE {found} END"
    return audits.withColumn("findings", F.expr(found))


def finding_rows(
    audited: DataFrame, page_pos: str = "page_id", keep: Sequence[str] = (), clean_pages: bool = False
) -> DataFrame:
    """One narrow row per page and finding, with its rank on the page; ``keep`` names columns to take along.

    With ``clean_pages``, a page without findings has one row whose finding is null.
    """
    columns = ["page_id", f"{page_pos} AS page_pos", "origin", "url", "template", *keep]
    rows = audited.selectExpr(*columns, "posexplode_outer(findings) AS (pos, finding)")
    if not clean_pages:
        rows = rows.where("pos IS NOT NULL")
    return rows.selectExpr("page_id", "page_pos", "origin", "url", "template", *keep, "pos + 1 AS rank", "finding.*")


def fill(text: str, n: str) -> str:
    return f"replace({text}, '{{n}}', coalesce(CAST({n} AS STRING), ''))"


def describe(
    priority: str, title_n: str, measure: str, detail: str, rules: Sequence[Rule] = RULES
) -> str:
    """A finding in words: a struct with all the catalogue says about it."""
    words = f"""named_struct(
      'rule_id', g.rule_id, 'area', g.area, 'severity', g.severity, 'effort', g.effort,
      'title', {fill('g.title_text', title_n)},
      'evidence', CASE WHEN {detail} <> '' THEN {detail} ELSE {fill('g.evidence_text', measure)} END,
      'fix', g.fix, 'validation', g.validation, 'tools', g.tools)"""
    return bind(guidance(priority, rules), "g", words)


def described_rows(rows: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Finding rows in words, for output."""
    words = describe("priority", "title_n", "measure", "detail", rules)
    return rows.withColumn("w", F.expr(words)).select(
        "page_id", "origin", "url", "rank",
        "w.rule_id", "w.area", "w.severity", "w.effort", "w.title", "w.evidence",
    )
