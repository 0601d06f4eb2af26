import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import compare
from pagecensus.operators import discovery
from pagecensus.plans import jobs
from pagecensus.plans.pipeline import SiteAudit, audit_rows, discovered_sites
from pagecensus.sources import snapshots
from tests.rows import crawl, resources

A = "https://a.example"


def seeds(spark, *rows):
    return spark.createDataFrame(list(rows), "start_url string, max_pages int")


def files(spark, *rows):
    return spark.createDataFrame(list(rows), snapshots.SITEMAP_FILES)


def locs(*urls):
    return "".join(f"<url><LOC>\n {url} </loc></url>" for url in urls)


def listed(sites):
    rows = discovery.discovered_urls(sites).orderBy("origin", "page_pos").collect()
    return [(r.page_pos, r.url) for r in rows]


def test_entries_are_decoded_filtered_and_numbered(spark):
    body = locs(
        f"{A}/1?x&amp;amp;y", "", "not a url", "https://b.example/2", f"{A}:443/3", f"http://a.example/4", f"{A}/1?x&amp;amp;y"
    )
    rows = discovery.sitemap_urls(snapshots.site_resources(resources(spark, [(A, "", 200, body)]))).collect()
    assert [(r.pos, r.url) for r in rows] == [(0, f"{A}/1?x&amp;y"), (1, f"{A}/3"), (2, f"{A}/1?x&amp;y")]


def test_start_first_duplicates_dropped_then_capped(spark):
    body = locs(f"{A}/b", f"{A}/", f"{A}/b", f"{A}", f"{A}/c", f"{A}/d")
    sites = discovered_sites(seeds(spark, ("a.example/start", 3)), resources(spark, [(A, "", 200, body)]))
    assert listed(sites) == [(1, f"{A}/start"), (2, f"{A}/b"), (3, f"{A}/")]
    summary = discovery.discovery_summary(sites).first()
    assert (summary.method, summary.total_discovered, summary.audited) == ("sitemap.xml", 6, 3)
    assert summary.description == "sitemap.xml, 6 listed, 3 audited"


def test_cap_must_be_positive(spark):
    body = locs(*[f"{A}/{n}" for n in range(20)])
    for cap in (0, -1, None):
        sites = discovered_sites(seeds(spark, (A, cap)), resources(spark, [(A, "", 200, body)]))
        assert len(listed(sites)) == snapshots.DEFAULT_MAX_PAGES


def test_fallbacks(spark):
    sites = discovered_sites(
        seeds(spark, (A, 5), ("https://b.example/x", 5), ("https://c.example", 5)),
        resources(spark, [(A, "", 404, locs(f"{A}/1")), ("https://c.example", "", 200, "<urlset>")]),
    )
    rows = discovery.discovery_summary(sites).orderBy("origin").collect()
    assert [(r.method, r.total_discovered, r.error, r.description) for r in rows] == [
        ("fallback", 0, "HTTP 404", "start URL only (HTTP 404)"),
        ("fallback", 0, discovery.NOT_FETCHED, f"start URL only ({discovery.NOT_FETCHED})"),
        ("fallback", 0, None, "start URL only"),
    ]
    assert [url for _, url in listed(sites)] == [f"{A}/", "https://b.example/x", "https://c.example/"]


def test_sitemap_index_reads_five_own_children_one_level_deep(spark):
    index = "<sitemapindex>" + locs(
        "https://b.example/s.xml", *[f"{A}/s{n}.xml" for n in range(1, 7)]
    )
    children = files(
        spark,
        (f"{A}/s1.xml", 200, locs(f"{A}/1a", f"{A}/1b", "https://b.example/no")),
        (f"{A}/s2.xml", 500, locs(f"{A}/2")),
        # s3 was never fetched; s4 is an index itself, its entries count as pages.
        (f"{A}/s4.xml", 200, "<sitemapindex>" + locs(f"{A}/s9.xml")),
        (f"{A}/s5.xml", 200, locs(f"{A}/1a", f"{A}/5")),
        (f"{A}/s6.xml", 200, locs(f"{A}/6")),
        (f"{A}/s9.xml", 200, locs(f"{A}/9")),
        ("https://b.example/s.xml", 200, locs(f"{A}/foreign")),
    )
    sites = discovered_sites(seeds(spark, (A, 50)), resources(spark, [(A, "", 200, index)]), children)
    assert [url for _, url in listed(sites)] == [f"{A}/", f"{A}/1a", f"{A}/1b", f"{A}/s9.xml", f"{A}/5"]
    assert sites.first().total_discovered == 5
    unread = discovered_sites(seeds(spark, (A, 50)), resources(spark, [(A, "", 200, index)]))
    assert unread.first().method == "fallback"


def test_site_pages_take_the_first_snapshot_and_report_missing_ones(spark):
    body = locs(f"{A}/x", f"{A}/gone", f"{A}/failed")
    pages = crawl(
        spark,
        [
            (7, f"{A}/x", "<title>later</title>"), (3, "HTTPS://A.example/x", "<title>first</title>"),
            (1, f"{A}/", "<title>home</title>"), (9, f"{A}/other", ""),
            {"page_id": 4, "url": f"{A}/failed", "status": 200, "error": "timeout"},
        ],
    )
    site = resources(spark, [(A, "", 200, body)])
    sites = discovered_sites(seeds(spark, (A, 10)), site)
    rows = SiteAudit(sites, audit_rows(pages, site)).pages().orderBy("page_pos").collect()
    assert [(r.page_pos, r.page_id, r.title, r.status, r.error) for r in rows] == [
        (1, 1, "home", 200, None),
        (2, 3, "first", 200, None),
        (3, None, "", 0, "there is no snapshot of this page"),
        (4, 4, "", 0, "timeout"),
    ]
    assert [len(r.findings) for r in rows[2:]] == [1, 1]


@pytest.mark.parametrize("name", ["discovered_urls", "discovery_summary"])
def test_sites_with_several_sitemap_files(spark, tmp_path, name):
    """Page numbers in two ranges make the sitemap an index of files."""
    pages = spark.read.parquet(f"{entry.SMALLEST}/pages.parquet")
    both = pages.union(pages.selectExpr("page_id + 50000 AS page_id", "concat(url, '-2') AS url", "html"))
    both.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert compare(spark, con, str(tmp_path), name, entry.oracle_sql()[name]) == ""
    summary = entry.queries()["discovery_summary"](spark, str(tmp_path))
    assert summary.agg(F.sum("total_discovered")).first()[0] > pages.count()


def test_large_sitemaps_are_cut_where_they_are_read(spark):
    """200,000 entries, half of them repeated, in one sitemap and in the files of an index."""
    lines = [f"<loc>{A}/{n // 2}</loc>" for n in range(200_000)]
    index = "<sitemapindex>" + locs(f"{A}/s1.xml", f"{A}/s2.xml", f"{A}/unread.xml")
    children = files(spark, (f"{A}/s1.xml", 200, "".join(lines[:100_000])), (f"{A}/s2.xml", 200, "".join(lines[100_000:])))
    for body in ("<urlset>" + "".join(lines), index):
        sites = discovered_sites(seeds(spark, (A, 10)), resources(spark, [(A, "", 200, body)]), children)
        row = sites.first()
        assert row.total_discovered == 200_000
        assert row.urls == [f"{A}/"] + [f"{A}/{n}" for n in range(9)]
    state = discovery._first_of(discovery.own_urls(discovery.entries("body")), "10")
    held = spark.createDataFrame([(A, "".join(lines))], "origin string, body string").selectExpr(f"{state} AS s").first().s
    assert (len(held.urls), held.listed) == (10, 200_000)


def test_page_caps_of_several_sites(spark):
    """The largest cap decides what is kept of a file, each seed's own what is audited; a bound lowers them."""
    b = "https://b.example"
    site = resources(spark, [(o, "", 200, locs(*[f"{o}/{n}" for n in range(40)])) for o in (A, b)])
    both = seeds(spark, (A, 3), (b, 25))
    counts = {r.origin: r.audited for r in discovery.discovery_summary(discovered_sites(both, site)).collect()}
    assert counts == {A: 3, b: 25}
    bounded = discovery.discover(snapshots.seeds(both), snapshots.site_resources(site), most_pages=7)
    assert {r.origin: len(r.urls) for r in bounded.collect()} == {A: 3, b: 7}


def test_only_named_files_are_parsed(spark):
    """Files that no index names are gone before their bodies are looked at."""
    index = "<sitemapindex>" + locs(f"{A}/s1.xml")
    many = files(spark, *[(f"{A}/s{n}.xml", 200, locs(f"{A}/{n}")) for n in range(500)])
    site = snapshots.site_resources(resources(spark, [(A, "", 200, index)]))
    assert [r.url for r in discovery._named_files(snapshots.sitemap_files(many), site).collect()] == [f"{A}/s1.xml"]


def test_two_seeds_of_one_site_fail(spark):
    both = seeds(spark, (A, 3), (f"{A}/other", 5))
    with pytest.raises(Exception, match="several seeds"):
        discovered_sites(both, resources(spark)).collect()
    with pytest.raises(ValueError, match="several seeds"):
        jobs.audit_sites(spark, both, crawl(spark, []), resources(spark), "/nowhere", "2024-05-01 00:00:00")
