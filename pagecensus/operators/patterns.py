"""Patterns: equal findings of one site put together.

The pages of one origin can be a large share of all rows, so grouping goes in steps that each
combine before the shuffle. The first step keeps numbers only besides its keys, which keeps it a
hash aggregation; texts and order statistics work on its small result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagecensus.functions.rows import rows_of
from pagecensus.functions.text import bind, quoted, url_count
from pagecensus.operators.findings import describe, fill
from pagecensus.operators.rules import NO_EVIDENCE, RULES, Rule, guidance

PATTERN_KEY = ["origin", "priority", "title_n"]


def pattern_templates(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Per pattern and page template: how many pages, and where it was first seen.

    ``keep`` names columns that are the same for all rows of an origin.
    """
    cells = rows.groupBy(*PATTERN_KEY, *keep, "template", "detail").agg(
        F.count(F.lit(1)).alias("affected"),
        F.min("page_pos").alias("first_pos"),
        F.min_by("measure", "page_pos").alias("measure"),
    )
    # Positions do not repeat within a site, so the smallest one picks a single page.
    detail_pos = F.when(F.col("detail") != "", F.col("first_pos"))
    return cells.groupBy(*PATTERN_KEY, *keep, "template").agg(
        F.sum("affected").alias("affected"),
        F.min("first_pos").alias("first_pos"),
        F.min_by("measure", "first_pos").alias("measure"),
        F.min(detail_pos).alias("detail_pos"),
        F.min_by("detail", detail_pos).alias("detail"),
    )


def patterns(templates: DataFrame, list_templates: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One row per origin, rule and title.

    ``list_templates`` adds the templates as one text, in order of appearance. Only audits with a
    page cap should ask for it: the cap bounds the text.
    """
    aggregates = [
        F.sum("affected").alias("affected"),
        F.count(F.lit(1)).alias("template_count"),
        F.min("first_pos").alias("first_pos"),
        F.min_by("measure", "first_pos").alias("measure"),
        F.min_by("detail", "detail_pos").alias("detail"),
    ]
    if list_templates:
        aggregates.append(
            F.expr("listagg(template, ', ') WITHIN GROUP (ORDER BY first_pos)").alias("templates")
        )
    return templates.groupBy(*PATTERN_KEY, *keep).agg(*aggregates)


# First evidence that says something, and how many pages share the finding.
_EVIDENCE = (
    f"concat(CASE WHEN w.evidence <> '' THEN w.evidence ELSE {quoted(NO_EVIDENCE)} END, "
    f"' Found on ', {url_count('affected')}, '.')"
)


def _described(table: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Patterns in words, with the ranks they are sorted by."""
    words = describe("priority", "title_n", "measure", "coalesce(detail, '')", rules)
    ranks = bind(
        guidance("priority", rules), "g",
        "named_struct('severity_rank', g.severity_rank, 'effort_rank', g.effort_rank)",
    )
    return table.selectExpr("*", f"{words} AS w", f"{ranks} AS r").selectExpr("*", f"{_EVIDENCE} AS evidence")


def site_patterns(table: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    return _described(table, rules).select(
        "origin", "w.rule_id", "w.area", "w.severity", "w.effort", "w.title", "evidence",
        "affected", "template_count", "first_pos",
    )


def site_issues(table: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = ()) -> DataFrame:
    """One row per origin with its ranked patterns as the array ``issues``. Rows without a rule give no pattern.

    An origin has at most one pattern per rule, and per HTTP status for the rule titled by it, so
    the array stays small however many pages there are.
    """
    templates = "templates" if "templates" in table.columns else "''"
    entry = f"""named_struct(
      'severity_rank', r.severity_rank, 'fewer', -affected, 'effort_rank', r.effort_rank, 'by_area', w.area,
      'first_pos', first_pos, 'priority', priority, 'issue', named_struct(
        'rule_id', w.rule_id, 'area', w.area, 'severity', w.severity, 'effort', w.effort, 'title', w.title,
        'evidence', evidence, 'fix', w.fix, 'validation', w.validation, 'tools', w.tools,
        'affected', affected, 'templates', {templates}, 'template_count', template_count,
        'title_n', title_n, 'priority', priority))"""
    return (
        _described(table, rules)
        .groupBy("origin", *keep)
        .agg(F.expr(f"array_sort(collect_list(CASE WHEN priority IS NOT NULL THEN {entry} END)) AS sorted"))
        .selectExpr("origin", *keep, "transform(sorted, e -> e.issue) AS issues")
    )


def site_patterns_ranked(issues: DataFrame) -> DataFrame:
    """Ranked patterns, one row each."""
    return rows_of(issues, ["origin"], "issues", "i").selectExpr(
        "origin", "pos + 1 AS rank", "i.rule_id", "i.area", "i.severity", "i.effort", "i.title",
        "i.evidence", "i.affected", "i.template_count",
    )


def pattern_urls(rows: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """All pages of every pattern. A projection: the order within a pattern is ``page_pos``."""
    return rows.selectExpr("*", f"{guidance('priority', rules)} AS g").selectExpr(
        "origin", "g.rule_id", f"{fill('g.title_text', 'title_n')} AS title", "page_pos", "url"
    )


def first_urls(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` pages of each pattern, as an array of at most ``k``.

    The rank filter is pushed below the shuffle, so each task sends at most ``k`` rows per pattern.
    """
    order = Window.partitionBy(*PATTERN_KEY).orderBy("page_pos")
    return (
        rows.select(*PATTERN_KEY, "page_pos", "url")
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= k)
        .groupBy(*PATTERN_KEY)
        .agg(F.array_sort(F.collect_list(F.struct("page_pos", "url"))).alias("first"))
        .select(*PATTERN_KEY, F.transform("first", lambda e: e["url"]).alias("first_urls"))
    )
