"""Deterministic inputs of the queries: page variants, crawl records and score tables derived from the given tables.

Each is one SQL expression in the common subset of both engines, so the oracle reads the same rows; operators are never
shared this way.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANCHOR = '<meta charset="utf-8">'

# Head fragments and url parts by page_id % 12.
FRAGMENTS = (
    "",
    '<meta name="description" content="About things"><meta name="author" content="A. Writer"><meta name="article-date" content="2024-01-02"><meta name="keywords" content="a, b"><link rel="canonical" href="https://x.example/y">',
    '<meta name="ms.topic" content="overview">',
    '<meta name="ms.topic" content="quickstart"><meta name="topic" content="setup">',
    '<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"@type":"Question","acceptedAnswer":{"text":"yes"}}]}</script>',
    '<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[]}</script>',
    '<script type="application/ld+json">{"@type":"HowTo","name":"Do it","step":[{"text":"one"}],"description":"d","totalTime":"PT1M"}</script>',
    '<script type="application/ld+json">{"@type":"Article","headline":"H","datePublished":"2024-01-02","author":"A","articleSection":"news"}</script>',
    '<meta name="robots" content="noindex, nofollow">',
    '<link rel="alternate" type="text/markdown" href="/a.md"><meta name="markdown_url" content="/a.md"><link rel="index" href="/llms.txt" data-llm-hint="see index"><link rel="alternate" type="application/json" href="/a.json">',
    '<meta property="og:title" content="T"><meta property="og:description" content="D"><meta name="robots" content="nofollow">',
    '<script type="application/ld+json">{"@type": "Article", </script>',
)
URL_PARTS = ("", "", "", "", "", "", "/api/x", "", "/faq", "/how-to/y", "/samples/z", "/landing")


def _case(values: tuple[str, ...]) -> str:
    return "CASE CAST(page_id % 12 AS INT) " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


ENRICHED = f"SELECT page_id, concat('https://h', CAST(page_id AS STRING), '.example.com', {_case(URL_PARTS)}) AS url, replace(html, '{ANCHOR}', concat('{ANCHOR}', {_case(FRAGMENTS)})) AS html FROM pages"

#: Score rows in two render modes; each pillar is some whole number below 101, and each seventh http score is missing.
SCORES = """SELECT page_id AS pos, CAST(page_id / 2 AS BIGINT) AS page_id, url, '' AS html_path, render_mode, semantic_html, content_extractability,
    structured_data, dom_navigability, metadata_completeness, http_compliance, parseability_score, universal_score, content_type, failure_mode FROM (
  SELECT page_id, concat('https://s', CAST(CAST(floor(page_id / 3) AS BIGINT) AS STRING), '.example.com/p') AS url, CASE WHEN page_id % 2 = 0 THEN 'raw' ELSE 'rendered' END AS render_mode,
    CAST((page_id * 7) % 101 AS DOUBLE) AS semantic_html, CAST((page_id * 13) % 101 AS DOUBLE) / 2 AS content_extractability, CAST((page_id % 5) * 6 AS DOUBLE) AS structured_data,
    CAST(35 + page_id % 3 * 20 AS DOUBLE) + CAST(page_id % 4 AS DOUBLE) / 8 AS dom_navigability, CAST((page_id * 3) % 101 AS DOUBLE) AS metadata_completeness,
    CASE WHEN page_id % 7 = 0 THEN NULL ELSE CAST(62 + page_id % 30 AS DOUBLE) END AS http_compliance,
    CAST((page_id * 17) % 101 AS DOUBLE) AS parseability_score, CASE WHEN page_id % 9 = 0 THEN NULL ELSE CAST((page_id * 11) % 101 AS DOUBLE) END AS universal_score,
    CASE CAST(page_id % 6 AS INT) WHEN 0 THEN 'article' WHEN 1 THEN 'landing' WHEN 2 THEN 'faq' WHEN 3 THEN 'sample' WHEN 4 THEN 'tutorial' ELSE 'reference' END AS content_type,
    CASE CAST(page_id % 5 AS INT) WHEN 0 THEN 'clean' WHEN 1 THEN 'minor_issues' WHEN 2 THEN 'structure-missing' WHEN 3 THEN 'extraction-noisy' ELSE 'severe_issues' END AS failure_mode
  FROM pages) AS base"""

CRAWL = """SELECT page_id, url, CASE CAST(page_id % 7 AS INT) WHEN 5 THEN 404 WHEN 6 THEN 0 ELSE 200 END AS status,
    CASE CAST(page_id % 7 AS INT) WHEN 0 THEN '' WHEN 1 THEN '301' WHEN 2 THEN '302,308' WHEN 3 THEN '301,200,307' WHEN 4 THEN '303,303,200,302,301' WHEN 5 THEN '200' ELSE '301,302' END AS codes,
    CAST((page_id * 37) % 1200 AS DOUBLE) AS redirect_ms, CAST((page_id * 53) % 900 AS DOUBLE) AS final_ms,
    CASE WHEN page_id % 4 = 0 THEN 'etag' WHEN page_id % 4 = 1 THEN 'last-modified' WHEN page_id % 4 = 2 THEN 'cache-control' ELSE 'x' END AS header,
    CASE WHEN page_id % 3 = 0 THEN 'no-store' ELSE 'max-age=60' END AS header_value FROM pages"""

#: Crawl records of the enriched pages but for each tenth, and the robots.txt of their hosts.
CRAWLED = f"""SELECT e.page_id, e.url, c.status, c.codes, c.redirect_ms, c.final_ms, c.header, c.header_value FROM ({ENRICHED}) AS e JOIN ({CRAWL}) AS c ON e.page_id = c.page_id WHERE e.page_id % 10 <> 9"""

#: Recorded responses of a graph of redirects: trees, loops of two, chains longer than a walk, and targets without a response.
REDIRECTED = """SELECT concat('https://w', CAST(page_id AS STRING), '.example.com/') AS url, CASE CAST(page_id % 7 AS INT) WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 302 WHEN 3 THEN 307 WHEN 4 THEN 303 WHEN 5 THEN 308 ELSE 404 END AS status,
    CASE CAST(page_id % 7 AS INT) WHEN 0 THEN CAST(NULL AS STRING) WHEN 6 THEN CAST(NULL AS STRING) ELSE concat('https://w', CAST(CASE CAST(page_id % 7 AS INT) WHEN 3 THEN page_id - 7 WHEN 4 THEN page_id + 1 WHEN 5 THEN page_id - 1 ELSE CAST(floor(page_id / 2) AS BIGINT) END AS STRING), '.example.com/') END AS location,
    CAST(page_id % 50 AS DOUBLE) AS ms FROM pages"""

ROBOTS_FILES = """SELECT concat('h', CAST(page_id AS STRING), '.example.com') AS host, CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 404 WHEN 3 THEN CAST(NULL AS INT) ELSE 200 END AS robots_status,
    CASE CAST(page_id % 4 AS INT) WHEN 1 THEN concat('User-agent: *', chr(10), 'Disallow: /api', chr(10), 'Allow: /api/x/y') WHEN 2 THEN concat('User-agent: *', chr(10), 'Disallow: /') ELSE '' END AS robots_txt FROM pages"""

RESPONSES = """SELECT p.url, f.accept_header, CASE WHEN (p.page_id + f.k) % 3 = 0 AND f.k > 0 THEN 406 WHEN p.page_id % 11 = 0 AND f.k = 0 THEN 500 ELSE 200 END AS status_code,
    CAST(CASE WHEN p.page_id % 4 = 0 THEN 0 ELSE (p.page_id + f.k) % 2 END AS STRING) AS content_hash
    FROM pages p CROSS JOIN (VALUES ('text/html', 0), ('text/markdown', 1), ('text/plain', 2), ('application/json', 3), ('application/xml', 4)) AS f(accept_header, k)"""

ROBOTS = """SELECT * FROM (VALUES ('example.com', 0, 'User-agent: bot'), ('example.com', 1, 'Disallow: /'), ('example.com', 2, 'User-agent: *  # all'), ('example.com', 3, 'Disallow: /en/'),
    ('example.com', 4, 'Allow: /en/7'), ('example.com', 5, 'Disallow:'), ('example.org', 0, 'user-agent: *'), ('example.org', 1, 'disallow: /fr # french'), ('example.org', 2, 'Allow: /fr'), ('example.org', 3, 'Disallow: /es/1')) AS r(host, line_no, line)"""

VIOLATIONS = """SELECT concat('u', CAST(user_id AS STRING)) AS url, CAST(event_id % 13 AS STRING) AS rule_id,
    CASE event_type WHEN 'error' THEN 'critical' WHEN 'click' THEN 'serious' WHEN 'view' THEN 'moderate' WHEN 'purchase' THEN 'minor' ELSE 'other' END AS impact, CAST(1 + event_id % 5 AS INT) AS node_count FROM events"""

AXE_RUNS = """SELECT DISTINCT concat('u', CAST(user_id AS STRING)) AS url, CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'injection_failed' WHEN 1 THEN 'failed' ELSE 'ok' END AS outcome FROM events"""

#: Crawl records of two thirds of the score rows, by html_path.
RECORD_URLS = "SELECT concat('p', CAST(page_id AS STRING), '.html') AS html_path, concat('https://r', CAST(page_id AS STRING), '.example.com') AS url FROM pages WHERE page_id % 3 <> 2"

HISTORY = """SELECT concat('f', CAST(user_id % 7 AS STRING), '_scores.json') AS score_file, event_id AS pos, ts AS evaluated_at, concat(' https://h', CAST(user_id AS STRING), '.example.com/a', CASE WHEN event_id % 2 = 0 THEN '/#s' ELSE '' END) AS url,
    user_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id % 101 AS DOUBLE) END AS parseability_score FROM events"""

RUNS = "SELECT CAST(event_id % 3 AS INT) AS run, concat('u', CAST(user_id AS STRING)) AS url, CAST(50 + (event_id * 7 + user_id) % (3 + user_id % 17) AS DOUBLE) AS score FROM events"

EXPECTED = """SELECT * FROM (VALUES ('https://s1.example.com/p', 40.0, 70.0, 'docs'), ('https://s2.example.com/p', 10.0, 30.0, 'docs'), ('https://s3.example.com/p', 0.0, 100.0, 'blog'),
    ('https://s5.example.com/p', 85.0, 95.0, 'blog'), ('https://s8.example.com/p', 20.0, 60.0, CAST(NULL AS STRING))) AS e(url, lo, hi, category)"""

ANSWERS = """SELECT a.conv_id, a.turn AS pair_index, CAST(a.conv_id % 3 AS INT) AS run_index,
    CASE WHEN a.conv_id % 5 = 0 THEN 'Not in  document' WHEN a.conv_id % 5 = 1 THEN concat('  ', a.text, ' ') WHEN a.conv_id % 5 = 2 THEN concat('It says: ', a.text) ELSE a.text END AS answer FROM conversations a"""
TRUTHS = "SELECT conv_id, turn AS pair_index, max(CASE WHEN conv_id % 5 = 4 THEN concat(text, ' x') WHEN conv_id % 10 = 0 THEN '' ELSE text END) AS truth FROM conversations GROUP BY conv_id, turn"

STUDY = """SELECT p.pillar, CAST((d.doc_id * p.k) % 23 AS DOUBLE) AS score, CAST((d.n_chars + d.doc_id) % 11 AS DOUBLE) / 10 AS accuracy FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    CROSS JOIN (VALUES ('semantic_html', 7), ('structured_data', 5), ('http_compliance', 0)) AS p(pillar, k)"""


# Undeclared phrases by page_id % 12, each in the charset before it.
PHRASES = (
    ("cp1251", "Старый мост стоял над рекой, и каждое утро по нему шли люди."), ("koi8_r", "Зимой здесь тихо, снег лежит до самой весны."), ("cp932", "図書館の前に大きな木があります。春には花が咲きます。"),
    ("gb18030", "他们在山下的小村里住了很多年，每天早上去河边。"), ("cp949", "우리는 아침마다 강가를 걸으며 이야기를 나누었다."), ("cp950", "老師說明天我們要去看山上的花，大家都很高興。"),
    ("utf-16-le", "Ветер усилился – 風が強くなった."), ("cp1252", "Élève très appliqué, le garçon préférait l’été à l’hiver."), ("cp1250", "Wieczorem dzieci wróciły do domu, bo zaczął padać śnieg, a wiatr się wzmógł."),
    ("cp1253", "Το παλιό σπίτι στέκεται ακόμα δίπλα στη θάλασσα."), ("utf-8", "Ein grüner Fluß, 一条河, река."), ("euc_jp", "あの山の向こうには小さな町があると聞いた。"),
)


def encoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, content: each page's ASCII without its declared charset and a phrase behind it, as the bytes of the phrase's charset."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ascii_part = F.regexp_replace(F.replace("html", F.lit(ANCHOR), F.lit("")), r"[^\x00-\x7F]", "")
    k, content = F.col("page_id") % len(PHRASES), F.lit(None).cast("binary")
    for i, (name, phrase) in enumerate(PHRASES):
        wide = F.encode(F.concat(ascii_part, F.lit(phrase)), "UTF-16LE")
        content = F.when(k == i, wide if name == "utf-16-le" else F.concat(ascii_part.cast("binary"), F.unhex(F.lit(phrase.encode(name).hex())))).otherwise(content)
    return pages.select("page_id", content.alias("content"))


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """``sql`` over the named tables of ``sf_dir``, under view names of their own."""
    for t in tables:
        name = f"input_{t}_{zlib.crc32(sf_dir.encode()):08x}"
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(name)
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {name}", sql)
    return spark.sql(sql)
