"""The HTML tree, features and pillar scores against values worked out by hand from the rules."""

import pytest

from pageloom.constants import PILLARS
from pageloom.kernels import readability, structured
from pageloom.kernels.dom import Dom
from pageloom.kernels.features import features, hints

HEAD = '<html lang="en"><head><title>T</title>{}</head><body>{}</body></html>'
FAQ = '<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"acceptedAnswer":{"text":"a"}}]}</script>'
FAQ_EMPTY = '<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[]}</script>'
ARTICLE = '<script type="application/ld+json">[{"@type":"Article","headline":"h","datePublished":"d","author":"a","dateModified":"m","description":"x","publisher":"p"},{"@type":"BreadcrumbList","itemListElement":[1,2]}]</script>'
HINTED = '<link rel="alternate" type="text/markdown" href="a.md"><meta name="markdown_url" content="a.md"><link rel="index" href="/llms.txt"><link rel="alternate" type="application/json" href="a.json"><article data-llm-hint="no"></article>'
SEMANTIC = "<header></header><nav role='navigation'></nav><main><h1>a</h1><h2>b</h2><article></article><section></section><aside></aside><figure><figcaption></figcaption></figure><time datetime='2024'></time></main><footer><h2>c</h2><h3>d</h3></footer>"
PROSE = "<p>" + "A long sentence about one thing, with commas, and enough words to be read as prose. " * 6 + "</p>"
CLEAN = HEAD.format("", "<main><article><h1>One</h1>" + PROSE * 4 + "</article></main>")
CHROME = "<html><head><title></title></head><body><div class='menu'>" + "<a href='#'>link text here</a> " * 80 + "</div><div class='sidebar'>" + "<ul>" + "<li><a href='#'>item</a></li>" * 60 + "</ul></div><p>Tiny.</p><h2>x</h2><ul><li>a</li></ul><pre>c</pre></body></html>"


def test_tree_rules():
    d = Dom("<div>a<p>b<br>c</p></x><script>var t='</p>';</script><b>d")
    assert d.count("p") == 1 and d.text() == "abcd" and d.raw[d.first("script")] == "var t='</p>';"
    assert d.text(d.first("p")) == "bc" and d.length() == 4
    assert Dom("<pre><code>x</code></pre>").count("pre", "code") == 2
    assert Dom("<p> a &amp; <i> b </i></p>").text(separator="|") == "a &|b"
    assert Dom("").length() == 0 and Dom("<!-- x --><!DOCTYPE html>").text() == ""


def test_hints_only_on_links():
    got = hints(Dom(HINTED))
    assert got["has_markdown_alternate"] and got["has_markdown_url_meta"] and got["has_llms_txt_ref"] and got["has_non_html_alternate"]
    assert not got["has_llm_hints"]


@pytest.mark.parametrize(
    ("html", "levels", "valid_type"),
    [("<h2>a</h2><h3>b</h3>", [2, 3], None), (FAQ, [], "FAQPage"), ('<script type="application/ld+json">{"x":{"@type":["","Y"]}}</script>', [], None)],
)
def test_features(html, levels, valid_type):
    got = features(html)
    assert got["heading_levels"] == levels and got["schema_type"] == valid_type


def test_nested_type_is_found_parents_first():
    assert structured.top_type(["{bad", '{"a":[{"@type":"Inner"}],"@type":"Outer"}']) == "Outer"
    assert structured.merged(['{"name":"a"}', "[{\"name\":\"b\"},{\"x\":1}]", "{bad"]) == {"name": "b", "x": 1}


def scored(spark, pages):
    from pageloom.plans.scores import score_pages

    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.asDict() for r in score_pages(rows).orderBy("page_id").collect()]


def test_pillars_by_hand(spark):
    full = '<meta name="description" content="d"><meta name="author" content="a"><meta name="date" content="x"><meta name="keywords" content="k"><link rel="canonical" href="u">'
    pages = [
        ("", HEAD.format("", SEMANTIC)), ("", "<div><img><p>x</p></div>"), ("", HEAD.format(ARTICLE, "<h1>a</h1>")), ("", HEAD.format(FAQ, "<h1>a</h1>")), ("", HEAD.format(FAQ_EMPTY, "")),
        ("", HEAD.format(full, "")), ("", HEAD.format(HINTED, "")), ("", HEAD.format('<meta name="robots" content="noindex, nofollow">', "")), ("", HEAD.format('<script type="application/ld+json">{bad</script>', "")),
        ("", None), ("https://x.example/api/widgets", HEAD.format("", "")), ("", HEAD.format('<meta name="MS.Topic" content=" QuickStart ">' + FAQ, "")),
    ]
    got = scored(spark, pages)
    assert got[0]["semantic_html"] == pytest.approx(10 / 11 * 60 + 5 + 8)
    assert got[0]["metadata_completeness"] == 40 and got[0]["dom_navigability"] == 100 and got[0]["http_compliance"] == 62
    assert got[1]["semantic_html"] == 0 and got[1]["dom_navigability"] == 20
    assert got[2]["structured_data"] == 85 and got[2]["content_type"] == "article" and got[2]["content_type_source"] == "schema_type"
    assert got[3]["structured_data"] == 85 and got[3]["content_type"] == "faq"
    assert got[4]["structured_data"] == 25
    assert got[5]["metadata_completeness"] == 100
    assert got[6]["http_compliance"] == 62 + 16
    assert got[7]["http_compliance"] == 50
    assert got[8]["structured_data"] is None and got[8]["failed_pillars"] == ["structured_data"] and got[8]["failure_mode"] == "partial_evaluation"
    assert got[9]["failure_mode"] == "evaluation_error" and got[9]["parseability_score"] == 0 and len(got[9]["failed_pillars"]) == 6
    assert got[10]["content_type"] == "reference" and got[10]["content_type_source"] == "url"
    assert got[11]["content_type"] == "tutorial" and got[11]["content_type_source"] == "ms_topic"
    for row in got:
        assert all(row[p] is None or 0 <= row[p] <= 100 for p in PILLARS)


def test_extraction_tells_prose_from_chrome(spark):
    clean, chrome = scored(spark, [("", CLEAN), ("", CHROME)])
    assert 70 <= clean["content_extractability"] <= 100
    assert chrome["content_extractability"] <= 45
    assert clean["content_extractability"] - chrome["content_extractability"] > 30
    assert "link text" not in readability.extract(Dom(CHROME.replace("Tiny.", "x" * 300)))["text"]


def test_failure_modes_come_from_all_six_pillars(spark, small):
    """A page is partly evaluated only where a pillar fails, so the counts are those of the full scores in raw mode."""
    from collections import Counter

    from pageloom.plans import queries

    got = {(r["failure_mode"], r["content_type"]): r["pages"] for r in queries.failure_mode_dist(spark, small).collect()}
    rows = queries.page_scores(spark, small).where("render_mode = 'raw'").select("failure_mode", "content_type", "content_extractability").collect()
    assert got == Counter((r["failure_mode"], r["content_type"]) for r in rows) and all(r["content_extractability"] is not None for r in rows)
    assert len({mode for mode, _ in got}) > 1


def test_kernel_runs_once_and_filters_pass_below_it(spark, small):
    from pageloom.plans.queries import featured
    from pageloom.operators import pillars

    plan = featured(spark, small).select("page_id", pillars.semantic_html(), pillars.static_accessibility())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_kernel_holds_the_values_of_few_pages_at_once(spark):
    import pandas as pd

    from pageloom.kernels.features import FEATURES, PAGES, _kernel

    taken = []
    one = lambda h: taken.append(h) or features(h)
    batch = pd.Series([f"<p>{i}" for i in range(PAGES)] + [None, ""] + ["<p>x"] * PAGES * 2)
    out, sizes = _kernel(one, FEATURES).func(iter([batch])), []
    for frame in out:
        sizes.append(len(frame))
        assert len(taken) <= sum(sizes) + 1  # nothing is parsed ahead of what was passed on
    assert sum(sizes) == len(batch) and max(sizes) <= PAGES
