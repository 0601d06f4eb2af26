from pagecensus.functions.urls import parse_or_assume_https, parse_url, template_of


def parse(spark, urls, how=parse_or_assume_https):
    df = spark.createDataFrame([(n, url) for n, url in enumerate(urls)], "n int, url string")
    rows = df.selectExpr("n", f"{how('url')} AS p").orderBy("n").collect()
    return [None if r.p is None else (r.p.url, r.p.origin) for r in rows]


def test_normalised_urls(spark):
    cases = {
        "HTTP://Example.COM": ("http://example.com/", "http://example.com"),
        "example.com/a?b#c": ("https://example.com/a?b#c", "https://example.com"),
        "https://a.b:443/x": ("https://a.b/x", "https://a.b"),
        "http://a.b:0080/x": ("http://a.b/x", "http://a.b"),
        "https://a.b:80/x": ("https://a.b:80/x", "https://a.b:80"),
        "https://u:p@a.b/": ("https://u:p@a.b/", "https://a.b"),
        "  https://a.b/x\n": ("https://a.b/x", "https://a.b"),
        "https://a.b/x y": ("https://a.b/x%20y", "https://a.b"),
        "https://a.b/é?ü": ("https://a.b/%C3%A9?%C3%BC", "https://a.b"),
        "https:\\\\a.b\\c": ("https://a.b/c", "https://a.b"),
        "https://a.b/x/../y/./z": ("https://a.b/y/z", "https://a.b"),
        "https://a.b/x/..": ("https://a.b/", "https://a.b"),
        "https://a.b/x/.": ("https://a.b/x/", "https://a.b"),
        "https://[::1]:8080/": ("https://[::1]:8080/", "https://[::1]:8080"),
        "mailto:a@b": ("mailto:a@b", "null"),
    }
    assert parse(spark, list(cases)) == list(cases.values())


def test_what_is_no_url(spark):
    assert parse(spark, ["a b", "", "https://", "/path", "https://a.b:99999/"], parse_url) == [None] * 5
    assert parse(spark, ["a b"]) == [None]


def test_normalising_twice_changes_nothing(spark):
    urls = ["http://A.b:80/é/../ü?x='y'", "c.d", "https://e.f/%C3%A9"]
    once = [p[0] for p in parse(spark, urls)]
    assert [p[0] for p in parse(spark, once)] == once


def test_templates(spark):
    paths = ["/", "", "/a", "/a/b", "/a/b/c", "/2024/x", "/x/20245", "//a//"]
    df = spark.createDataFrame([(n, p) for n, p in enumerate(paths)], "n int, path string")
    got = [r.t for r in df.selectExpr("n", f"{template_of('path')} AS t").orderBy("n").collect()]
    assert got == ["home", "home", "a index", "a page", "a detail", "article/date", "x page", "a index"]
