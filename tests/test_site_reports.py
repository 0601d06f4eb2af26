"""A small site from seed to document, and the jobs that write everything."""

from pyspark.sql import functions as F

from pagecensus.operators import report
from pagecensus.plans import jobs
from pagecensus.plans.pipeline import SiteAudit, audit_rows, discovered_sites
from pagecensus.sources.sinks import write_site_files, write_site_markdown
from tests.rows import crawl, rendered, resources

SITE = "http://garden.example:8080"
RUN_TS = "2024-05-01 12:30:00"


def page(heading):
    """No analytics, no policy header, no HTTPS; otherwise nothing to complain about."""
    return (
        f'<html lang="sv"><head><title>Growing beans on a balcony</title><link rel="canonical" href="{SITE}/beans">'
        "<meta content='width=device-width' name='viewport'><meta content='What beans need.' name='description'>"
        f"<script type='application/ld+json'>[{{\"@type\":\"Article\",\"author\":\"Bo\"}}]</script></head>"
        f"<body><h1>{heading}</h1>Water them.</body></html>"
    )


def inputs(spark):
    paths = ("/", "/beans/climbing", "/beans/dwarf")
    entries = "".join(f"<url><loc>{SITE}{p}</loc></url>" for p in paths)
    return (
        spark.createDataFrame([(f"{SITE}/", 3)], "start_url string, max_pages int"),
        crawl(spark, [(n, SITE + p, page(p.rpartition("/")[2] or "Beans")) for n, p in enumerate(paths)]),
        resources(spark, [(SITE, "User-agent: *\nDisallow:", 200, f"<urlset>{entries}</urlset>")]),
    )


def site_report(spark, staged=False):
    seeds, pages, site = inputs(spark)
    return SiteAudit(discovered_sites(seeds, site), audit_rows(pages, site)).report(staged)


def document(parts):
    return "".join(r.markdown for r in sorted(parts.collect(), key=lambda r: r.part))


def test_three_pages(spark):
    _, pages, site = inputs(spark)
    audited = report.page_issues(audit_rows(pages, site))
    assert report.page_markdown(audited, RUN_TS).first().markdown.startswith("# Page audit\n")
    site = site_report(spark, staged=True)
    text = document(site.markdown(RUN_TS))
    assert text.startswith("# Site audit\n")
    assert report.pages_audited(site.pages).count() == 3
    affected = {i.rule_id: i.affected for i in site.rows().first().issues}
    assert affected["analytics_missing"] == affected["csp_missing"] == affected["not_https"] == 3


def test_site_document(spark):
    text = document(site_report(spark).markdown(RUN_TS))
    lines = text.splitlines()
    assert f"**Site:** {SITE}/  " in lines
    assert "**Audited:** 2024-05-01T12:30:00.000Z  " in lines
    assert "**Found by:** sitemap.xml, 3 listed, 3 audited" in lines
    order = [line for line in lines if line.startswith("## ")]
    assert order == [
        "## Summary", "## Priorities", "## How to fix and verify", "## Pages concerned", "## Quick wins",
        "## Plan for 30 days", "## Pages", "## Notes",
    ]
    start = lines.index("## Pages") + 4
    assert [line.split(" | ")[0] for line in lines[start:start + 3]] == [
        f"| {SITE}/", f"| {SITE}/beans/climbing", f"| {SITE}/beans/dwarf"
    ]
    assert lines[-1] == "- On a page: The rendered page was not looked at in this run."
    tables = [line for line in lines if line.startswith("|")]
    assert all(line.endswith("|") for line in tables)


def test_long_lists_go_into_numbered_parts(spark, monkeypatch):
    monkeypatch.setattr(report, "LINES_PER_PART", 2)
    site = site_report(spark)
    parts = sorted((r.part, r.markdown) for r in site.markdown(RUN_TS).collect())
    assert [part for part, _ in parts][:3] == [0, 1, 2]
    assert parts[1][1].count("\n") == 2 and parts[2][1].count("\n") == 1
    monkeypatch.undo()
    assert "".join(text for _, text in parts) == document(site.markdown(RUN_TS))


def test_a_clean_page_gets_the_other_texts(spark):
    df = spark.createDataFrame([(1, "u")], "page_id int, url string").withColumn(
        "issues",
        F.expr("CAST(array() AS ARRAY<STRUCT<rule_id:STRING,area:STRING,severity:STRING,effort:STRING,title:STRING,evidence:STRING,fix:STRING,validation:STRING,tools:STRING>>)"),
    )
    assert report.executive_summary(df, report.PAGE).first().summary.startswith("No findings.")
    assert {r.item for r in report.action_plan(df, report.PAGE).where("week < 4").collect()} == {report.EMPTY_WEEK}
    assert report.quick_wins(df, report.PAGE).count() == 0


def test_page_job_writes_its_tables(spark, tmp_path):
    _, pages, site = inputs(spark)
    renders = rendered(spark, [(0, "", True, False, None, page("Changed")), (1, "", False, False, "crash", "")])
    summary = jobs.audit_pages(spark, pages, site, str(tmp_path), RUN_TS, renders, markdown=True).first()
    assert (summary.sites, summary.pages) == (1, 3)
    found = spark.read.parquet(f"{tmp_path}/findings")
    assert found.count() == summary.findings and "run_date" in found.columns
    notes = {r.page_id: r.note for r in spark.read.parquet(f"{tmp_path}/notes").collect()}
    assert set(notes) == {1, 2} and "crash" in notes[1]
    assert spark.read.text(f"{tmp_path}/page_markdown").where("value = '# Page audit'").count() == 3


def test_site_job_agrees_with_the_lazy_pipeline(spark, tmp_path):
    seeds, pages, site = inputs(spark)
    want = document(site_report(spark).markdown(RUN_TS))
    out = str(tmp_path)
    summary = jobs.audit_sites(spark, seeds, pages, site, out, RUN_TS, files_for=[SITE]).first()
    assert (summary.sites, summary.pages) == (1, 3)
    assert document(spark.read.parquet(f"{out}/site_markdown")) == want
    written = sorted(tmp_path.glob("site_files/*/site=*/*.txt"))
    assert "".join(f.read_text() for f in written) == want
    ranked = spark.read.parquet(f"{out}/site_patterns_ranked")
    assert ranked.agg(F.sum("affected")).first()[0] == summary.findings
    for table in ("summaries", "priorities", "fix_plans", "affected_examples", "pages_audited"):
        assert spark.read.parquet(f"{out}/{table}").count() > 0, table


def test_site_markdown_keeps_parts_in_order(spark, tmp_path):
    """Two origins that read the same without their signs, and parts in several tasks."""
    origins = ("https://a.b:8080", "https://a.b_8080")
    rows = [(o, n, f"{o} line {n}\n") for n in (3, 0, 2, 1) for o in origins]
    parts = spark.createDataFrame(rows, "origin string, part bigint, markdown string").repartition(3)
    write_site_markdown(parts, f"{tmp_path}/md")
    back = spark.read.parquet(f"{tmp_path}/md")
    for origin in origins:
        assert document(back.where(F.col("origin") == origin)) == "".join(f"{origin} line {n}\n" for n in range(4))
    write_site_files(back, f"{tmp_path}/files", origins)
    folders = sorted(tmp_path.glob("files/site=*"))
    texts = {"".join(f.read_text() for f in sorted(folder.glob("*.txt"))) for folder in folders}
    assert texts == {"".join(f"{origin} line {n}\n" for n in range(4)) for origin in origins}
