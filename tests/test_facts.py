"""Edge cases of fact extraction, one tiny document each."""

import json
import time

from pyspark.sql import functions as F

from pagecensus.functions import jsonld
from pagecensus.functions.text import decode_entities, quoted, strip_document, strip_tags
from pagecensus.operators import facts
from pagecensus.sources import snapshots
from tests.rows import crawl, facts_of


def test_title_spans_lines_and_loses_tags(spark):
    first, second, third, fourth = facts_of(
        spark,
        "<TITLE class=x>One\n <b>two</b></title><title>Other</title>",
        "<title>\u00a0No\u00a0\u2003break space\ufeff</title>",
        "<title>open",
        None,
    )
    assert first.title == "One two"
    assert second.title == "No break space"
    assert third.title == "" and fourth.title == ""
    assert fourth.visible_text_length == 0


def test_meta_name_wins_over_earlier_property(spark):
    by_name, no_content, by_property, single, similar = facts_of(
        spark,
        '<meta property="description" content="P"><meta content="N" NAME=\'description\'>',
        '<meta name="description"><meta property="description" content="P">',
        '<meta property="description" content=" P ">',
        '<meta name="robots" content="a\'b">',
        '<meta data-name="description" content="D"><meta name="robotsx" content="x">',
    )
    assert by_name.description == "N"
    assert no_content.description == ""
    assert by_property.description == "P"
    # A value ends at either quote sign.
    assert single.robots_meta == "a"
    # A hyphen is a word boundary, so data-name counts as name.
    assert similar.description == "D" and similar.robots_meta == ""


def test_canonical_takes_first_link_with_the_word_in_rel(spark):
    exact, inside, none, bounded = facts_of(
        spark,
        '<link rel="stylesheet" href="/s"><link href="/c" rel="canonical">',
        "<link rel='shortlink canonical-x' href='/i'>",
        "<link rel=canonical href='/n'>",
        "<linkrel='canonical' href='/n'>",
    )
    assert (exact.canonical, inside.canonical, none.canonical, bounded.canonical) == ("/c", "/i", "", "")


def test_html_attributes(spark):
    rows = facts_of(
        spark,
        '<html lang="en">',
        "<html lang=de dir=rtl>",
        '<html lang="">',
        '<html lang="en" xml:lang="fr">',
        '<html><html data-x="1" dir="RTL" lang="es">',
        "<htmllang=en>",
    )
    assert [r.lang for r in rows] == ["en", "de", "", "fr", "es", ""]
    assert [r.dir for r in rows] == ["", "rtl", "", "", "RTL", ""]


def test_headings_keep_empty_ones_and_ascii_boundaries(spark):
    (row,) = facts_of(spark, "<h1></h1><H1 class=a>A <i>b</i>\n</h1><h1é>C</h1><h10>no</h10><h1>open")
    assert row.h1s == ["", "A b", "C"]


def test_scripts(spark):
    documents = [
        '<script data-src="/lazy.js">1</script><script src=bare.js></script>',
        "<SCRIPT src='http://a/x.js' >a\n>b</SCRIPT><script>c</script ><script>d</script>",
        "<script>never closed",
    ]
    pages = crawl(spark, [(n, "https://a.example/", html) for n, html in enumerate(documents)])
    rows = facts.script_rows(snapshots.crawl_pages(pages)).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.attrs, r.src, r.body) for r in rows] == [
        (0, 0, ' data-src="/lazy.js"', "/lazy.js", "1"),
        (0, 1, " src=bare.js", "", ""),
        (1, 0, " src='http://a/x.js' ", "http://a/x.js", "a\n>b"),
        # The end tag with a blank does not end the script.
        (1, 1, "", "", "c</script ><script>d"),
    ]


def test_external_scripts_need_a_scheme(spark):
    (row,) = facts_of(
        spark,
        '<script src="HTTPS://a/x"></script><script src="//cdn/x"></script><script src="/own"></script>',
    )
    assert row.third_party_scripts == 1 and row.script_count == 3


def test_json_ld_keeps_whole_truthy_values(spark):
    bodies = [
        '{"a":1}', '{"a":1,"a":2}', '{"a":1} x', "0", "0.0", "-0", "null", "false", '""', "[1,2]", "",
        "  7 ", "1,2", "1],[2", '1},{"v":2', '"text"', "{'a':1}", "[1,]", "true", "NaN",
    ]
    df = spark.createDataFrame([(bodies,)], "bodies array<string>")
    kept = df.selectExpr(
        f"transform({jsonld.kept_blocks('bodies')}, b -> to_json(b)) AS kept"
    ).first().kept
    assert kept == ['{"a":1}', '{"a":2}', "[1,2]", "7", '"text"', "true"]


def test_json_ld_type_needs_quotes(spark):
    block = '{"@type":"A"}'
    quoted_type, bare, charset = facts_of(
        spark,
        f"<script TYPE='application/LD+json'>{block}</script>",
        f"<script type=application/ld+json>{block}</script>",
        f'<script type="application/ld+json; charset=utf-8">{block}</script>',
    )
    assert [r.json_ld_count for r in (quoted_type, bare, charset)] == [1, 0, 0]


def test_type_walk_follows_lists_and_graph_only(spark):
    deep = {"@type": "Deep"}
    for level in range(40):
        deep = {"@graph": [deep]} if level % 2 else [deep]
    document = [
        {"@type": ["A", "B"], "author": {"@type": "Hidden"}},
        [[{"@type": "C"}]],
        {"@type": "D", "@graph": {"@type": "E", "@graph": [{"@type": "A"}]}},
        {"@type": ""},
        "text",
        deep,
    ]
    (row,) = facts_of(spark, f'<script type="application/ld+json">{json.dumps(document)}</script>')
    assert sorted(row.schema_types) == ["A", "B", "C", "D", "Deep", "E"]
    assert row.has_author_schema


def test_author_is_a_quoted_word_in_kept_blocks(spark):
    def page(block):
        return f'<script type="application/ld+json">{block}</script>'

    rows = facts_of(
        spark,
        page('{"AUTHOR":1}'),
        page('{"x":"Author"}'),
        page('{"x":"the author"}'),
        page('{"author":1} x'),
        page('{"\\u0061uthor":1}'),
        page('{"x":"say \\"author\\""}'),
    )
    assert [r.has_author_schema for r in rows] == [True, True, False, False, True, False]


def test_tracking_signals(spark):
    rows = facts_of(
        spark,
        "<script>big-image</script>",
        '<script src="https://www.googletagmanager.com/gtm.js"></script>',
        "<script>x=gtag(1); DATALAYER.push(String.fromCharCode(1))</script>",
        "<p>gtag( GTM-ABC</p>",
    )
    assert [(r.has_gtm, r.has_ga4, r.has_data_layer, r.has_risky_script) for r in rows] == [
        (False, True, False, False),
        (True, False, False, False),
        (False, True, True, True),
        (False, False, False, False),
    ]


def test_images_links_and_frameworks(spark):
    (row,) = facts_of(
        spark,
        "<img src=a><IMG loading='lazy'><image><img loading=lazy><link rel='Stylesheet x'>"
        "<link rel='stylesheets'><link dir=\"rtl\"><p>reVUE</p>",
    )
    assert (row.image_count, row.lazy_images) == (3, 1)
    assert (row.stylesheet_count, row.link_count, row.link_dir_rtl) == (1, 3, True)
    assert row.framework.asDict() == {"next": False, "nuxt": False, "react": False, "vue": True}


def test_text_length_counts_utf16_units_and_script_text(spark):
    astral, script = facts_of(spark, "<p>a\U0001f600</p>", "<script>var x</script><!-- c > d -->")
    assert astral.visible_text_length == 3
    assert script.visible_text_length == len("var x d -->")


def test_documents_with_an_open_tail_strip_like_any_other(spark):
    texts = ["a < b", "<p>a</p> < b <", "x > y <p", "> <", "<b>x</b>\n<i", "<" * 50_000, "<p>t</p>" + "< " * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = df.selectExpr(f"{strip_document('t')} AS guarded", "t").collect()
    plain = df.where("length(t) < 100").selectExpr(f"{strip_tags('t')} AS plain", "t").collect()
    want = {r.t: r.plain for r in plain}
    assert all(r.guarded == want[r.t] for r in same if r.t in want)
    assert same[5].guarded == "<" * 50_000 and same[6].guarded == "t " + "< " * 49_999 + "<"


def test_long_tag_runs_do_not_exhaust_the_stack(spark):
    (row,) = facts_of(spark, "<i></i> \n" * 100_000 + "x" + "<script>y</script>" * 2)
    assert row.visible_text_length == len("x y y") and row.script_count == 2


def test_entities_decode_in_order(spark):
    got = spark.range(1).select(
        F.expr(decode_entities(quoted("&amp;lt;a&gt; &quot;&#39; &amp;amp;"))).alias("x")
    ).first().x
    assert got == "<a> \"' &amp;"


def test_row_order_and_partitions_do_not_matter(spark):
    documents = [f"<title>T{n}</title><h1>{n}</h1>" for n in range(30)]
    pages = crawl(spark, [(n, f"https://a.example/{n}", html) for n, html in enumerate(documents)])
    one = facts.page_facts(snapshots.crawl_pages(pages.coalesce(1))).orderBy("page_id").collect()
    many = facts.page_facts(snapshots.crawl_pages(pages.repartition(7, "html"))).orderBy("page_id").collect()
    assert one == many


def test_unclosed_tags_take_linear_time(spark):
    """Quadratic matching would need hours for these documents."""
    many = 100_000
    documents = [f"<h1>a</h1>{tag * many}" for tag in ("<h1>", "<script>", "<title>")]
    rows = facts_of(spark, *documents, "<title>t</title><h1>x</h1><h1>y", "<script>1</script><script>2")
    assert [r.h1s for r in rows] == [["a"], ["a"], ["a"], ["x"], []]
    assert rows[3].title == "t" and rows[2].title == ""


def _ld(*bodies):
    return "".join(f"<script>x</script><script type='application/ld+json'>{b}</script>" for b in bodies)


def test_rejected_json_ld_blocks_are_listed(spark):
    html = _ld('{"@type":"A"}', "", " \n", "null", "0.0", '""', '{"a":1} x', "{a:1}", "[1", "[]")
    pages = crawl(spark, [(1, "https://a.example/1", html), (2, "https://a.example/2", _ld("{}"))])
    rows = facts.json_ld_rejected(snapshots.crawl_pages(pages)).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.reason, r.body) for r in rows] == [
        (1, 3, "empty", ""), (1, 5, "empty", " \n"), (1, 7, "says nothing", "null"), (1, 9, "says nothing", "0.0"),
        (1, 11, "says nothing", '""'), (1, 13, "not one JSON value", '{"a":1} x'), (1, 15, "not one JSON value", "{a:1}"),
        (1, 17, "not one JSON value", "[1"),
    ]
    kept = facts.json_ld_rows(snapshots.crawl_pages(pages)).count()
    assert kept + len(rows) == 11


def test_type_walk_is_linear_in_shallow_blocks(spark):
    """Many objects beside each other make one level; the walk must not repeat itself for each of them."""
    times = []
    for n in (1000, 100_000):
        body = "[" + ",".join(f'{{"@type":"T{i % 7}"}}' for i in range(n)) + "]"
        start = time.perf_counter()
        assert sorted(facts_of(spark, _ld(body))[0].schema_types) == [f"T{i}" for i in range(7)]
        times.append(time.perf_counter() - start)
    assert times[1] < 30 * max(times[0], 1)


def test_type_walk_through_deep_blocks(spark):
    deep = '{"@type":"Inner"}'
    for n in range(300):
        deep = f'{{"@type":"L{n % 3}","@graph":[{deep}]}}' if n % 2 else f"[{deep}]"
    assert sorted(facts_of(spark, _ld(deep))[0].schema_types) == ["Inner", "L0", "L1", "L2"]
