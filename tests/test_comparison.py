"""Counts of two runs by origin, severity and state."""

from collections import Counter

from pagecensus.operators import comparison, findings
from pagecensus.plans.pipeline import audit_rows
from tests.rows import crawl, resources


def run(spark, pages):
    audits = audit_rows(crawl(spark, pages), resources(spark))
    return findings.described_rows(findings.finding_rows(audits)), audits


def test_counts_and_totals(spark):
    title = "<title>A title that is long enough</title>"
    before = [(1, "https://a.example/1", ""), (2, "https://a.example/2", title), (3, "https://b.example/", "")]
    after = [(1, "https://a.example/1", title), (2, "https://a.example/2", ""), (4, "https://c.example/", "")]
    (rows_1, pages_1), (rows_2, pages_2) = run(spark, before), run(spark, after)
    arguments = rows_1, rows_2, pages_1, pages_2
    listed = comparison.compare_runs(*arguments).collect()
    want = Counter()
    for r in listed:
        origin = r.url.rpartition("/")[0]
        for key in ((o, s, t) for o in (origin, None) for s in (r.severity, None) for t in (r.status, None)):
            want[key] += 1
    got = comparison.comparison_counts(*arguments).collect()
    assert {(r.origin, r.severity, r.status): r.findings for r in got} == want
    assert len(got) == len(want)
    whole = next(r for r in got if (r.origin, r.severity, r.status) == (None, None, None))
    assert (whole.findings_before, whole.findings_after) == (rows_1.count(), rows_2.count())
    states = {r.status for r in listed}
    assert states == {"open", "new", "resolved", "not_audited", "first_audit"}


def test_equal_and_empty_runs(spark):
    rows, pages = run(spark, [(1, "https://a.example/1", "")])
    assert {r.status for r in comparison.comparison_counts(rows, rows, pages, pages).collect()} == {"open", None}
    nothing = rows.limit(0)
    assert {r.status for r in comparison.comparison_counts(nothing, rows, pages, pages).collect()} == {"new", None}
