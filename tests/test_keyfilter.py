"""The filter of keys in the scan."""

from pagecensus.functions.keyfilter import key_filter, passing
from pagecensus.operators import discovery
from pagecensus.plans import pipeline
from pagecensus.sources import snapshots
from tests.rows import crawl, rendered, resources


def test_keys_pass_and_most_others_do_not(spark):
    table = spark.range(20000).union(spark.sql("SELECT CAST(NULL AS LONG)"))
    keys = spark.range(0, 20000, 40)
    kept = {r.id for r in passing(table, "id", key_filter(keys, "id")).collect()}
    assert {r.id for r in keys.collect()} <= kept
    assert len(kept) < 1000 and None not in kept


def test_full_and_empty_lists(spark):
    table = spark.range(500)
    assert passing(table, "id", key_filter(table.where("id < 0"), "id", 64), 64).count() == 0
    assert passing(table, "id", key_filter(table, "id", 64), 64).count() == 500


def test_texts_as_keys(spark):
    table = spark.range(1000).selectExpr("concat('u', id) AS url")
    keys = table.where("url = 'u7'")
    assert [r.url for r in passing(table, "url", key_filter(keys, "url")).collect()] == ["u7"]


def test_facts_come_from_chosen_pages_only(spark):
    """Pages and rendered pages that no site has chosen are gone before facts are extracted."""
    site = "https://a.example"
    pages = crawl(spark, [(n, f"{site}/{n}", f"<title>{n}</title>") for n in range(300)])
    renders = rendered(spark, [(n, "", True, False, None, "") for n in range(300)])
    body = "".join(f"<loc>{site}/{n}</loc>" for n in (7, 400, 9))
    seeds = spark.createDataFrame([(f"{site}/5", 10)], "start_url string, max_pages int")
    sites = pipeline.discovered_sites(seeds, resources(spark, [(site, "", 200, f"<urlset>{body}")]))
    chosen = discovery.chosen_pages(sites, snapshots.addressed(pages).select("page_id", "url"))
    kept = [t.count() for t in discovery.chosen_only(chosen, pages, renders)]
    assert kept[0] == kept[1] < 10
    report = pipeline.site_report(sites, pages, renders)
    rows = report.pages.orderBy("page_pos").collect()
    assert [(r.page_pos, r.page_id, r.title) for r in rows] == [(1, 5, "5"), (2, 7, "7"), (3, None, ""), (4, 9, "9")]
    assert [r.has_sitemap for r in rows] == [True, True, False, True]
    report.release()
