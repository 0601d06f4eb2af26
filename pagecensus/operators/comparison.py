"""What changed between two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("url", "rule_id")

_STATUS = (
    "CASE WHEN was AND is THEN 'open' WHEN was THEN IF(coalesce(seen_again, false), 'resolved', 'not_audited') "
    "ELSE IF(coalesce(seen, false), 'new', 'first_audit') END AS status"
)


def _compared(before: DataFrame, after: DataFrame, pages_before: DataFrame, pages_after: DataFrame) -> DataFrame:
    described = ("origin", "area", "severity")

    def side(rows: DataFrame, name: str) -> DataFrame:
        found = rows.groupBy(*KEY).agg(*[F.min(c).alias(c) for c in described])
        return found.withColumn(name, F.lit(True))

    def pages(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("url").distinct().withColumn(name, F.lit(True))

    second = side(after, "is").withColumnsRenamed({c: f"{c}_2" for c in described})
    return (
        side(before, "was").join(second, list(KEY), "full")
        .join(pages(pages_before, "seen"), "url", "left")
        .join(pages(pages_after, "seen_again"), "url", "left")
        .selectExpr(*KEY, *[f"coalesce({c}, {c}_2) AS {c}" for c in described], _STATUS)
    )


def compare_runs(before: DataFrame, after: DataFrame, pages_before: DataFrame, pages_after: DataFrame) -> DataFrame:
    """``url, rule_id, area, severity, status`` of every finding of two runs (described finding rows).

    A finding of both runs is ``open``. One that is gone is ``resolved`` if its page was audited again,
    else ``not_audited``; one that appeared is ``new`` if its page was audited before, else
    ``first_audit``. ``pages_before`` and ``pages_after`` hold the audited addresses as ``url``. Snapshots
    of one address count as one page.
    """
    return _compared(before, after, pages_before, pages_after).drop("origin")


# Totals over all origins, all severities and all states, and the counts before and after.
_LEVELS = ("origin, severity, status", "origin, severity", "origin, status", "origin", "severity, status", "severity", "status", "")


def comparison_counts(
    before: DataFrame, after: DataFrame, pages_before: DataFrame, pages_after: DataFrame
) -> DataFrame:
    """``origin, severity, status, findings, findings_before, findings_after`` of two runs, with all totals.

    Arguments and states are those of ``compare_runs``. In a total, the column summed over is null; the row
    with three nulls is the whole run. Findings are first counted per origin, severity and status, combined
    before the shuffle; the totals are grouping sets over that small table.
    """
    cells = _compared(before, after, pages_before, pages_after).groupBy("origin", "severity", "status").agg(
        F.count(F.lit(1)).alias("n")
    )
    sets = ", ".join(f"({level})" for level in _LEVELS)
    return cells.sparkSession.sql(
        f"""SELECT origin, severity, status, sum(n) AS findings,
          coalesce(sum(n) FILTER (WHERE status IN ('open', 'resolved', 'not_audited')), 0) AS findings_before,
          coalesce(sum(n) FILTER (WHERE status IN ('open', 'new', 'first_audit')), 0) AS findings_after
        FROM {{cells}} GROUP BY GROUPING SETS ({sets})""",
        cells=cells,
    )
