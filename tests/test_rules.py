"""Thresholds and preconditions of the rules."""

from pagecensus.operators import audit, findings
from pagecensus.operators.rules import RULES, Rule, by_priority, rule_catalogue
from pagecensus.plans.pipeline import audit_rows
from tests.rows import crawl, rendered, resources

GOOD = (
    '<html lang="en"><head><title>A title of a fitting length</title>'
    '<meta name="description" content="d by the editor"><meta name="viewport" content="width=device-width">'
    '<link rel="canonical" href="/"><script>dataLayer=[];gtag(1)</script>'
    '<script type="application/ld+json">{"@type":"Thing"}</script></head><body><h1>H</h1></body></html>'
)
SITE = ("https://a.example", "User-agent: *", 200, "<urlset></urlset>")
CSP = {"Content-Security-Policy": "default-src"}


def rules_of(spark, pages, renders=None):
    """Rule names per page, in rank order."""
    rows = [{"url": "https://a.example/p", "headers": CSP, "page_id": n, **page} for n, page in enumerate(pages)]
    audited = audit_rows(
        crawl(spark, rows), resources(spark, [SITE]), None if renders is None else rendered(spark, renders)
    )
    got = {n: [] for n in range(len(pages))}
    for row in sorted(findings.described_rows(findings.finding_rows(audited)).collect(), key=lambda r: r.rank):
        got[row.page_id].append(row.rule_id)
    return [got[n] for n in range(len(pages))]


def test_a_good_page_has_no_findings(spark):
    assert rules_of(spark, [{"html": GOOD}]) == [[]]


def test_title_length_limits(spark):
    titles = ["t" * 19, "t" * 20, "t" * 65, "t" * 66, "t" * 63 + "\U0001f600", "t" * 64 + "\U0001f600"]
    pages = [{"html": GOOD.replace("A title of a fitting length", t)} for t in titles]
    long = ["title_length"]
    assert rules_of(spark, pages) == [long, [], [], long, [], long]


def test_counts_above_limits(spark):
    def with_head(extra):
        return {"html": GOOD.replace("</head>", extra + "</head>")}

    css, js, img = '<link rel="stylesheet">', '<script src="https://x/y"></script>', "<img src=a>"
    pages = [with_head(css * 6), with_head(css * 7), with_head(js * 8), with_head(js * 9), with_head(img * 5), with_head(img * 6)]
    assert rules_of(spark, pages) == [[], ["stylesheets_many"], [], ["third_party_heavy"], [], ["images_not_lazy"]]


def test_status_and_failure(spark):
    pages = [
        {"html": GOOD, "status": 399}, {"html": GOOD, "status": 400},
        {"html": GOOD, "error": "timeout"}, {"html": None, "error": ""},
    ]
    assert rules_of(spark, pages) == [[], ["http_error"], ["page_unauditable"], ["page_unauditable"]]


def test_render_rules_need_a_rendered_page(spark):
    grown = GOOD.replace("<h1>H</h1>", "<h1>H</h1>" + "x" * 1499)
    more = GOOD.replace("<h1>H</h1>", "<h1>H</h1>" + "x" * 1500)
    changed = GOOD.replace("<h1>H</h1>", "<h1>H</h1><h1></h1>").replace(
        "</head>", '<script type="application/ld+json">[1]</script></head>'
    )
    # One space separates the added text, so the growth is one more than its length.
    renders = [
        (0, "", True, False, None, grown), (1, "", True, False, None, more), (2, "", False, True, None, more),
        (3, "", False, False, "browser", more), (5, "", True, False, None, changed),
    ]
    got = rules_of(spark, [{"html": GOOD}] * 6, renders)
    assert got == [[], ["render_text_growth"], [], [], [], ["render_h1_changed", "render_schema_added"]]


def test_thin_framework_page(spark):
    def page(n):
        text = GOOD.replace("</body>", "<p>react " + "x" * n + "</p></body>")
        return {"html": text}, (0, "", True, False, None, text)

    base = 800 - 6
    for filler, want in ((500, ["framework_thin_static"]), (base, [])):
        document, render = page(filler)
        assert rules_of(spark, [document], [render]) == [want]


def test_the_bare_page_is_ranked(spark):
    (got,) = rules_of(spark, [{"html": "", "url": "http://b.example/", "headers": {}}])
    order = [rule.rule_id for rule in by_priority()]
    assert got == sorted(got, key=order.index)
    assert got[:3] == ["analytics_missing", "not_https", "canonical_missing"]
    assert {"robots_missing", "sitemap_missing", "csp_missing", "author_signal_missing"} <= set(got)


def test_resources_are_judged_by_their_bodies(spark):
    sites = [
        ("https://a.example", "404 not here", 404, "<html>"), ("https://b.example", "4040", 200, "x<URLSET"),
        ("https://c.example", "<html>error</html>", 500, "<sitemapindex>"),
    ]
    pages = [{"page_id": n, "url": f"https://{s}.example/", "html": GOOD} for n, s in enumerate("abcd")]
    rows = audit_rows(crawl(spark, pages), resources(spark, sites)).orderBy("page_id").collect()
    assert [(r.has_robots_txt, r.has_sitemap) for r in rows] == [
        (False, False), (True, True), (True, True), (False, False)
    ]


def test_users_add_rules(spark):
    mine = Rule("short", "on-page", "Critical", "Low", "length(title) < 5", "Short {n}", "", "f", "v", "length(title)")
    audited = audit_rows(
        crawl(spark, [(1, "https://a.example/", "<title>abc</title>")]), resources(spark, [SITE]), None, [*RULES, mine]
    )
    rows = findings.described_rows(findings.finding_rows(audited), [*RULES, mine]).collect()
    assert [r.title for r in rows if r.rule_id == "short"] == ["Short 3"]


def test_catalogue(spark):
    rows = rule_catalogue(spark).collect()
    assert len(rows) == 31 and {r.seq for r in rows} == {r.priority for r in rows} == set(range(1, 32))


def test_large_origins_are_split_by_their_size(spark, monkeypatch):
    """An origin with nine tenths of the pages gets pieces, the others are neither split nor repeated."""
    monkeypatch.setattr(audit, "PIECE_PAGES", 100)
    pages = spark.range(1000).selectExpr(
        "id AS page_id", "if(id % 10 > 0, 'https://big.example', concat('https://s', id, '.example')) AS origin",
        "CAST(NULL AS STRING) AS error",
    )
    heavy = {r.origin: r.pieces for r in audit.heavy_origins(pages).collect()}
    assert heavy == {"https://big.example": 9}
    flags = pages.select("origin").distinct().selectExpr(
        "origin", "true AS has_robots_txt", "origin <> 'https://s0.example' AS has_sitemap"
    )
    rows = audit.with_resource_flags(pages, flags).collect()
    assert len(rows) == 1000 and all(r.has_robots_txt for r in rows)
    assert [r.page_id for r in rows if not r.has_sitemap] == [0]
    assert audit.with_resource_flags(pages, flags.limit(0)).where("has_robots_txt").count() == 0


def test_even_origins_are_not_split(spark, monkeypatch):
    monkeypatch.setattr(audit, "PIECE_PAGES", 100)
    pages = spark.range(900).selectExpr("concat('https://', id % 9, '.example') AS origin")
    assert audit.heavy_origins(pages).count() == 0
