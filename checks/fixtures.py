"""Representative inputs derived from the raw ``pages`` table, the same rows in Spark and DuckDB.

The raw pages have no meta tags, links, images or structured data. The SQL below adds them by page
number, so that every rule fires on some pages and on none of the others. Each view is one SELECT
over the views before it; ``{name}`` placeholders differ between the two engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CRAWL_PAGES = """
SELECT page_id,
  CASE WHEN instr(substr(url, 9), '/') > 0 THEN substr(url, 1, 7 + instr(substr(url, 9), '/')) ELSE url END AS origin,
  url,
  CASE WHEN page_id % 31 = 0 THEN 0 WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 29 = 0 THEN 500 ELSE 200 END AS status,
  CASE WHEN page_id % 31 = 0 THEN 'fetch failed' END AS error,
  CASE WHEN page_id % 2 = 0 THEN 'default-src https:' END AS csp,
  replace(replace(replace(replace(replace(html,
    '<html lang=', concat('<html ', CASE WHEN page_id % 15 = 0 THEN 'dir="rtl" ' ELSE '' END, CASE WHEN page_id % 18 = 0 THEN 'data-x=' ELSE 'lang=' END)),
    '<title>', CASE WHEN page_id % 19 = 0 THEN '<notitle>' WHEN page_id % 20 = 0 THEN '<title>Editor: ' ELSE '<title>' END),
    '<h1>', CASE WHEN page_id % 14 = 0 THEN '<h2>' WHEN page_id % 10 = 0 THEN '<h1>Extra</h1><h1>' ELSE '<h1>' END),
    '</head>', concat(
      CASE WHEN page_id % 3 <> 0 THEN concat('<meta name="description" content="About page ', CAST(page_id AS {text}), '">') WHEN page_id % 6 = 0 THEN '<META property="description" content="By property">' ELSE '' END,
      CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN '<meta name="viewport" content="width=1024">' ELSE '<meta name="viewport" content="width = device-width, initial-scale=1">' END,
      CASE WHEN page_id % 11 = 0 THEN '<meta content="NOINDEX,follow" name="robots">' ELSE '' END,
      CASE WHEN page_id % 4 <> 0 THEN concat('<link rel="canonical" href="/c/', CAST(page_id AS {text}), '">') ELSE '' END,
      repeat('<link rel="stylesheet" href="/s.css">', CAST(page_id % 10 AS INT)),
      repeat('<script src="https://cdn.example.com/x.js"></script>', CAST(page_id % 12 AS INT)),
      CASE page_id % 8 WHEN 1 THEN '<script src="https://www.googletagmanager.com/gtm.js?id=GTM-ABC1"></script>' WHEN 2 THEN '<script>gtag("config","G-XYZ9")</script>' WHEN 3 THEN '<script>window.dataLayer=[];gtag("js")</script>' ELSE '' END,
      CASE WHEN page_id % 13 = 0 THEN '<script>eval("1")</script>' ELSE '' END,
      CASE page_id % 6 WHEN 1 THEN '<script type="application/ld+json">{{"@type":"Article","author":{{"@type":"Person","name":"V"}}}}</script>' WHEN 2 THEN '<script type="application/ld+json">{{"@type":"Article"}}</script>' WHEN 3 THEN '<script type="application/ld+json">[{{"@type":["NewsArticle","Thing"]}}]</script>' WHEN 4 THEN '<script type="application/ld+json">{{"@graph":[{{"@type":"NewsArticle","author":"V"}},{{"@type":"BreadcrumbList"}}]}}</script>' WHEN 5 THEN '<script type="application/ld+json">{{"@type":"Article"}} x</script>' ELSE '' END,
      '</head>')),
    '</article>', concat(
      CASE WHEN page_id % 9 = 0 THEN '<div data-reactroot></div>' ELSE '' END,
      repeat('<img src="a.png">', CAST(page_id % 8 AS INT)),
      CASE WHEN page_id % 16 = 7 THEN '<img loading="lazy" src="b.png">' ELSE '' END,
      '</article>')) AS html
FROM pages
"""

# Address shapes for templates; the home page of an origin can appear more than once.
PAGE_URLS = """
SELECT page_id, origin, CASE
  WHEN page_id % 21 = 0 THEN concat(origin, '/')
  WHEN page_id % 22 = 0 THEN concat(origin, '/2024/01/post-', CAST(page_id AS {text}))
  WHEN page_id % 23 = 0 THEN concat(origin, '/blog')
  WHEN page_id % 25 = 0 THEN concat(origin, '/shop/item/', CAST(page_id AS {text}))
  ELSE url END AS url
FROM crawl_pages
"""

# The crawl again, under those addresses.
SITE_SNAPSHOTS = """
SELECT c.page_id, c.origin, CASE
  WHEN c.page_id % 21 = 0 THEN concat(c.origin, '/')
  WHEN c.page_id % 22 = 0 THEN concat(c.origin, '/2024/01/post-', CAST(c.page_id AS {text}))
  WHEN c.page_id % 23 = 0 THEN concat(c.origin, '/blog')
  WHEN c.page_id % 25 = 0 THEN concat(c.origin, '/shop/item/', CAST(c.page_id AS {text}))
  ELSE c.url END AS url, c.status, c.error, c.csp, c.html
FROM crawl_pages c
"""

# One sitemap per origin. A sitemap file lists pages of one number range only; an origin with pages
# in several ranges gets an index of such files, so no row grows with the origin.
SITEMAP_BLOCKS = """
SELECT origin, page_id {div} 50000 AS block,
  concat('<urlset>', {agg_by_page}, '</urlset>') AS body
FROM (SELECT origin, page_id, concat('<url><loc> ', replace(url, '&', '&amp;'), ' </loc></url>') AS line FROM page_urls) AS lines
GROUP BY origin, page_id {div} 50000
"""
SITE_RESOURCES = """
SELECT origin,
  CASE WHEN length(origin) % 3 = 0 THEN '' WHEN length(origin) % 7 = 0 THEN '404 not found'
       ELSE concat('User-agent: *{newline}Allow: /{newline}Sitemap: ', origin, '/sitemap.xml') END AS robots_body,
  CASE WHEN length(origin) % 4 = 0 THEN 404 ELSE 200 END AS sitemap_status,
  CASE WHEN length(origin) % 4 = 0 THEN '<html>not found</html>'
       WHEN count(*) = 1 THEN min(body)
       ELSE concat('<sitemapindex>', {agg_by_block}, '</sitemapindex>') END AS sitemap_body
FROM (SELECT origin, body, block, concat('<sitemap><loc>', origin, '/sitemap-', CAST(block AS {text}), '.xml</loc></sitemap>') AS line
      FROM sitemap_blocks AS blocks) AS lines
GROUP BY origin
"""

# The files those indexes name.
SITEMAP_FILES = """
SELECT concat(origin, '/sitemap-', CAST(block AS {text}), '.xml') AS url, 200 AS status, body
FROM sitemap_blocks
"""

# Every origin again, with an index of up to seven child sitemaps per number range and one foreign
# entry. One child is broken, one is an index itself, so its entries count as pages.
INDEX_FILES = """
SELECT concat(origin, '/map-', CAST(file AS {text}), '.xml') AS url, origin, file,
  CASE WHEN file % 7 = 3 THEN 500 ELSE 200 END AS status,
  concat(CASE WHEN file % 7 = 5 THEN '<sitemapindex>' ELSE '<urlset>' END, {agg_by_page}, '</end>') AS body
FROM (SELECT origin, page_id, (page_id {div} 50000) * 7 + page_id % 7 AS file,
        concat('<url><loc> ', replace(url, '&', '&amp;'), ' </loc></url>') AS line FROM page_urls) AS lines
GROUP BY origin, file
"""
INDEX_RESOURCES = """
SELECT origin, 'User-agent: *' AS robots_body, 200 AS sitemap_status,
  concat('<sitemapindex><loc>https://elsewhere.example/x.xml</loc>', {agg_by_file}, '</sitemapindex>') AS sitemap_body
FROM (SELECT origin, file, concat('<sitemap><loc>', url, '</loc></sitemap>') AS line FROM index_files) AS lines
GROUP BY origin
"""

SEEDS = """
SELECT origin, concat(origin, '/') AS start_url, 10 AS max_pages
FROM (SELECT DISTINCT origin FROM crawl_pages) AS sites
"""

# Rendered, skipped and failed pages; text growth, changed headings and added structured data.
RENDERED_PAGES = """
SELECT page_id, url,
  (page_id % 5 <> 0) AS ok, (page_id % 10 = 0) AS skipped,
  CASE WHEN page_id % 10 = 5 THEN 'browser timeout' END AS error,
  CASE WHEN page_id % 5 = 0 THEN '' ELSE
    replace(replace(html, '</article>', concat(
        CASE WHEN page_id % 4 = 0 THEN repeat('lorem ipsum ', 200) ELSE '' END,
        CASE WHEN page_id % 7 = 0 THEN '<script type="application/ld+json">{{"@type":"Organization"}}</script>' ELSE '' END,
        '</article>')),
      '<h1>', CASE WHEN page_id % 6 = 0 THEN '<h1>New ' ELSE '<h1>' END) END AS html
FROM crawl_pages
"""

# The raw addresses in other spellings of the same thing.
URL_SPELLINGS = """
SELECT page_id, CASE WHEN page_id % 12 = 5 THEN concat('https://', CASE page_id % 5 WHEN 0 THEN 'Bücher.example' WHEN 1 THEN 'www.МОСКВА.example'
    WHEN 2 THEN '例え.テスト' WHEN 3 THEN 'a-Ñandú-z.example:443' ELSE 'über。example' END, '/en/', CAST(page_id AS {text})) ELSE CASE page_id % 8
  WHEN 0 THEN upper(substr(url, 1, instr(substr(url, 9), '/') + 8))
  WHEN 1 THEN substr(url, instr(url, '//') + 2)
  WHEN 2 THEN replace(url, '/en/', ':443/en/')
  WHEN 3 THEN replace(url, '/en/', ':80/en/')
  WHEN 4 THEN replace(url, '://', '://user@')
  WHEN 5 THEN concat('  ', url, ' ')
  WHEN 6 THEN substr(url, 1, 7 + instr(substr(url, 9), '/'))
  ELSE concat('mailto:', CAST(page_id AS {text})) END END AS raw_url
FROM pages
"""

# The crawl as it arrives: a page every half hour, every ninth one twice.
ARRIVALS = """
SELECT c.*, {moment} AS fetched_at FROM crawl_pages c
UNION ALL SELECT c.*, {moment} AS fetched_at FROM crawl_pages c WHERE c.page_id % 9 = 0
"""

VIEWS = {
    "crawl_pages": CRAWL_PAGES,
    "page_urls": PAGE_URLS,
    "site_snapshots": SITE_SNAPSHOTS,
    "sitemap_blocks": SITEMAP_BLOCKS,
    "site_resources": SITE_RESOURCES,
    "sitemap_files": SITEMAP_FILES,
    "index_files": INDEX_FILES,
    "index_resources": INDEX_RESOURCES,
    "seeds": SEEDS,
    "rendered_pages": RENDERED_PAGES,
    "url_spellings": URL_SPELLINGS,
    "arrivals": ARRIVALS,
}
_NEEDS = {
    "crawl_pages": ("pages",),
    "page_urls": ("crawl_pages",),
    "site_snapshots": ("crawl_pages",),
    "sitemap_blocks": ("page_urls",),
    "site_resources": ("sitemap_blocks",),
    "sitemap_files": ("sitemap_blocks",),
    "index_files": ("page_urls",),
    "index_resources": ("index_files",),
    "seeds": ("crawl_pages",),
    "rendered_pages": ("crawl_pages",),
    "url_spellings": ("pages",),
    "arrivals": ("crawl_pages",),
}

_SPARK_WORDS = {
    "moment": "timestamp_seconds(1714521600 + c.page_id * 1800)",
    "text": "STRING",
    "div": "DIV",
    "newline": "\\n",
    "agg_by_page": "listagg(line, '') WITHIN GROUP (ORDER BY page_id)",
    "agg_by_block": "listagg(line, '') WITHIN GROUP (ORDER BY block)",
    "agg_by_file": "listagg(line, '') WITHIN GROUP (ORDER BY file)",
}
_DUCKDB_WORDS = {
    "moment": "make_timestamp((1714521600 + c.page_id * 1800) * 1000000)",
    "text": "VARCHAR(20)",
    "div": "//",
    "newline": "\n",
    "agg_by_page": "string_agg(line, '' ORDER BY page_id)",
    "agg_by_block": "string_agg(line, '' ORDER BY block)",
    "agg_by_file": "string_agg(line, '' ORDER BY file)",
}


def duckdb_view(name: str) -> str:
    return VIEWS[name].format(**_DUCKDB_WORDS).strip()


def _page_stream(spark: SparkSession, path: str, table: DataFrame) -> DataFrame:
    """A stream over the files of ``path``. The source reads folders, so a single file is picked out of its folder."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(table.schema)
    if table.inputFiles()[0].endswith(f"/{name}"):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def spark_view(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """One of the views as a DataFrame over ``sf_dir``, or as a stream over its files."""
    if name == "pages":
        path = f"{sf_dir.rstrip('/')}/pages.parquet"
        table = spark.read.parquet(path)
        return _page_stream(spark, path, table) if stream else table
    sql = VIEWS[name].format(**_SPARK_WORDS)
    inputs = {need: spark_view(spark, sf_dir, need, stream) for need in _NEEDS[name]}
    for need in inputs:
        sql = sql.replace(f"FROM {need}", "FROM {" + need + "}")
    return spark.sql(_escape(sql, inputs), **inputs)


def _escape(sql: str, inputs: dict[str, DataFrame]) -> str:
    """Double the braces that are text, keep those that name an input."""
    doubled = sql.replace("{", "{{").replace("}", "}}")
    for need in inputs:
        doubled = doubled.replace("{{" + need + "}}", "{" + need + "}")
    return doubled
