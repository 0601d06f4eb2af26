"""Patterns against plain Python over the same findings, with one origin holding most pages."""

from collections import defaultdict

from pyspark.sql import functions as F

from pagecensus.operators import findings, patterns
from pagecensus.operators.rules import NO_EVIDENCE, RULES
from pagecensus.plans.pipeline import audit_rows
from tests.rows import crawl, resources

HOT = "https://hot.example"


def table(spark):
    pages = []
    for n in range(300):
        origin = f"https://s{n % 7}.example" if n % 3 else HOT
        page = {
            "page_id": n,
            "url": f"{origin}/{'abc'[n % 3]}/{n if n % 5 else 2024}",
            "status": 500 + n % 4 if n % 11 == 0 else 200,
            "html": f"<title>{'t' * (n % 90)}</title>" + "<h1>x</h1>" * (n % 4),
        }
        if n % 13 == 0:
            page["error"] = ["", "timeout", "refused"][n % 3]
        pages.append(page)
    return audit_rows(crawl(spark, pages), resources(spark, [(HOT, "User-agent: *", 200, "<urlset>")]))


def test_patterns_and_their_rank(spark):
    rows = findings.finding_rows(table(spark))
    described = {
        (r.page_id, r.rule_id): r for r in findings.described_rows(rows).collect()
    }
    templates = {(r.page_id): r.template for r in rows.collect()}
    rule = {r.rule_id: r for r in RULES}

    groups = defaultdict(list)
    for row in sorted(described.values(), key=lambda r: (r.page_id, r.rank)):
        groups[row.origin, row.rule_id, row.title].append(row)
    first_seen = {key: n for n, key in enumerate(groups)}

    severity, effort = ("Critical", "High", "Medium", "Low"), ("Low", "Medium", "High")
    want = {}
    for origin in {key[0] for key in groups}:
        own = [key for key in groups if key[0] == origin]
        own.sort(
            key=lambda key: (
                severity.index(rule[key[1]].severity), -len(groups[key]), effort.index(rule[key[1]].effort),
                rule[key[1]].area, first_seen[key],
            )
        )
        for rank, key in enumerate(own, start=1):
            evidence = next((r.evidence for r in groups[key] if r.evidence), NO_EVIDENCE)
            n = len(groups[key])
            text = f"{evidence} Found on {n} URL{'' if n == 1 else 's'}."
            want[key] = (rank, n, len({templates[r.page_id] for r in groups[key]}), text)

    grouped = patterns.patterns(patterns.pattern_templates(rows))
    got = {
        (r.origin, r.rule_id, r.title): (r["rank"], r.affected, r.template_count, r.evidence)
        for r in patterns.site_patterns_ranked(patterns.site_issues(grouped)).collect()
    }
    assert got == want
    assert sum(v[1] for v in got.values()) == len(described)


def test_template_list_is_in_order_of_appearance(spark):
    rows = findings.finding_rows(table(spark))
    listed = patterns.patterns(patterns.pattern_templates(rows), list_templates=True)
    row = listed.where((F.col("origin") == HOT)).orderBy(F.desc("affected")).first()
    seen = []
    for r in rows.where((F.col("origin") == HOT) & (F.col("priority") == row.priority)).orderBy("page_pos").collect():
        if r.template not in seen:
            seen.append(r.template)
    assert row.templates == ", ".join(seen)


def test_first_urls(spark):
    rows = findings.finding_rows(table(spark))
    want = defaultdict(list)
    for r in rows.orderBy("page_pos").collect():
        want[r.origin, r.priority, r.title_n].append(r.url)
    got = patterns.first_urls(rows, 5).collect()
    assert {(r.origin, r.priority, r.title_n): r.first_urls for r in got} == {k: v[:5] for k, v in want.items()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_hold_at_scale(spark):
    """No document behind an exchange, no cross join, hash aggregation first, top-k below the shuffle."""
    audited = table(spark)
    rows = findings.finding_rows(audited)
    for line in plan_of(audited).splitlines():
        if "Exchange" in line:
            assert "html" not in line
    cells = plan_of(rows.groupBy("origin", "priority", "title_n", "template", "detail").agg(
        F.count(F.lit(1)), F.min("page_pos"), F.min_by("measure", "page_pos")
    ))
    assert "SortAggregate" not in cells and "HashAggregate" in cells
    assert "CartesianProduct" not in cells and "NestedLoop" not in cells
    assert "WindowGroupLimit" in plan_of(patterns.first_urls(rows, 5))
