"""The page audit over snapshots as they arrive.

Facts and rules look at one row at a time, so the batch operators run unchanged on a stream. Counts over time
keep state: which snapshots were counted, and the open windows. Both are forgotten behind the watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagecensus.operators import findings
from pagecensus.operators.rules import RULES, SEVERITIES, Rule, by_priority
from pagecensus.plans.pipeline import audit_rows
from pagecensus.session import prepare, shared_folder
from pagecensus.sources.snapshots import CRAWL_PAGES

ARRIVALS = f"{CRAWL_PAGES}, fetched_at timestamp"

# How long a window is, and how much older than the newest snapshot one may be to be counted.
WINDOW = "1 hour"
LATENESS = "1 day"


def read_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots written to ``folder`` as Parquet, in the shape of the ``crawl_pages`` table with their time."""
    return spark.readStream.schema(ARRIVALS).parquet(folder)


def page_counts(audited: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Number of findings by severity of each audited snapshot, as a narrow row."""
    ordered = by_priority(rules)
    counts = []
    for severity in SEVERITIES:
        own = [str(p) for p, r in enumerate(ordered, start=1) if r.severity == severity]
        found = f"size(filter(findings, f -> f.priority IN ({', '.join(own)})))" if own else "0"
        counts.append(f"CAST({found} AS LONG) AS {severity.lower()}")
    return audited.selectExpr("page_id", "origin", "fetched_at", *counts)


def finding_counts(
    arrivals: DataFrame,
    resources: DataFrame,
    window: str = WINDOW,
    lateness: str = LATENESS,
    rendered: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """``origin, window_start, window_end, pages, findings`` and findings by severity, per window of ``fetched_at``.

    A snapshot that arrives again (``page_id`` and ``fetched_at`` equal) counts once. On a stream, snapshots older
    than the newest by more than ``lateness`` are left out, of these counts only; those without a time always are.
    The same call on a table counts all of its rows. Documents are read before anything is shuffled; what is kept
    as state is a key per snapshot and a row per window and origin.
    """
    timed = arrivals.where("fetched_at IS NOT NULL")
    counted = page_counts(audit_rows(timed, resources, rendered, rules, keep=("fetched_at",)), rules)
    once = counted.withWatermark("fetched_at", lateness).dropDuplicates(["page_id", "fetched_at"])
    names = [severity.lower() for severity in SEVERITIES]
    sums = [F.sum(name).alias(name) for name in names]
    return (
        once.groupBy(F.window("fetched_at", window), "origin")
        .agg(F.count(F.lit(1)).alias("pages"), *sums)
        .selectExpr(
            "origin", "window.start AS window_start", "window.end AS window_end", "pages",
            f"{' + '.join(names)} AS findings", *names,
        )
    )


def _written(spark: SparkSession, rows: DataFrame, out: str, name: str) -> StreamingQuery:
    """Append to ``out`` what there is and stop; progress and state are in the shared folder under ``name``."""
    return (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{shared_folder(spark)}/{name}")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_findings(
    spark: SparkSession, arrivals: DataFrame, resources: DataFrame, out: str, name: str
) -> StreamingQuery:
    """Append the findings of all snapshots that have arrived to ``out`` and stop.

    Progress is kept in the shared folder under ``name``, so each file is audited once. Late snapshots have
    findings like all others.
    """
    prepare(spark)
    return _written(spark, findings.described_rows(findings.finding_rows(audit_rows(arrivals, resources))), out, name)


def write_counts(
    spark: SparkSession,
    arrivals: DataFrame,
    resources: DataFrame,
    out: str,
    name: str,
    window: str = WINDOW,
    lateness: str = LATENESS,
    rendered: DataFrame | None = None,
) -> StreamingQuery:
    """Append the counts of all windows that are over to ``out`` and stop.

    A window is over when the newest snapshot is ``lateness`` ahead of its end; it is written once and never
    changes. Calls under the same ``name`` go on from each other.
    """
    prepare(spark)
    return _written(spark, finding_counts(arrivals, resources, window, lateness, rendered), out, name)
