"""One pass over a page's HTML into a typed struct; everything after it is Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.constants import SEMANTIC_ELEMENTS, VAGUE_LINKS
from pageloom.kernels import readability, structured
from pageloom.kernels.dom import HEADINGS, Dom

ITEM = "struct<types array<string>, first_type string, checked_type string, filled array<string>, truthy array<string>, invalid array<string>>"
HINTS = "struct<has_markdown_alternate boolean, has_markdown_url_meta boolean, has_llm_hints boolean, has_llms_txt_ref boolean, has_non_html_alternate boolean, details array<string>>"
FEATURES = f"""struct<
    semantic array<struct<element string, count int>>, role_count int, heading_levels array<int>, headings array<struct<level int, text string>>,
    main_count int, article_count int, p_count int, div_count int, code_count int, table_count int, list_count int, h1_count int,
    total_length int, primary_length int, boilerplate_length int,
    img_count int, img_alt_count int, link_count int, link_descriptive_count int, has_title boolean, has_lang_attribute boolean,
    title_tag boolean, og_title boolean, meta_description boolean, og_description boolean, meta_author boolean, meta_date boolean, time_element boolean,
    meta_topic boolean, meta_keywords boolean, html_lang boolean, meta_lang boolean, canonical boolean,
    ld_name boolean, ld_description boolean, ld_author boolean, ld_publisher boolean, ld_date boolean, ld_section boolean,
    meta_robots string, hints {HINTS}, ms_topic string, schema_type string,
    body_text boolean, body_h123_count int, body_p_chars int, body_code_chars int,
    ld_items array<{ITEM}>, ld_valid boolean, opengraph_count int, microdata_count int, microformat_count int,
    samples struct<json_ld array<string>, opengraph array<string>, microdata array<string>, microformat array<string>>>"""

READABLE = """struct<raw_length int, extracted_length int, title_present boolean, headings int, lists int, code int,
    extracted_headings int, extracted_lists int, extracted_code int, main_present boolean, main_length int,
    main_words array<string>, extracted_words array<string>, preview string>"""

PRIMARY = ("main", "article", ".content", "#content", ".main-content")
BOILERPLATE = ("nav", "header", "footer", "aside", ".nav", ".navigation", ".sidebar", ".menu", ".header", ".footer", ".breadcrumb")


def _select(dom: Dom, selector: str) -> list[int]:
    return dom.with_class(selector[1:]) if selector[0] == "." else dom.with_id(selector[1:]) if selector[0] == "#" else dom.find_all(selector)


def _content(dom: Dom, found: list[int], key: str = "content") -> bool:
    """Whether the first of the tags has a non-blank value."""
    return bool(found) and bool(dom.attrs[found[0]].get(key, "").strip())


def _named(dom: Dom, test: Callable[[str], bool]) -> list[int]:
    return [i for i in dom.by_tag.get("meta", ()) if dom.attrs[i].get("name") and test(dom.attrs[i]["name"].lower())]


def hints(dom: Dom) -> dict:
    """Signs that a page offers machine-readable forms of itself."""
    seen, details = set(), []

    def note(key: str, text: str) -> None:
        seen.add(key)
        details.append(text)

    for link in dom.by_tag.get("link", ()):
        attrs, rel = dom.attrs[link], dom.rel(link)
        kind, href = attrs.get("type", "").lower(), attrs.get("href", "")
        if "alternate" in rel:
            if "markdown" in kind:
                note("has_markdown_alternate", f"alternate {kind} {href[:80]}")
            elif kind and not any(x in kind for x in ("html", "rss", "atom")):
                note("has_non_html_alternate", f"alternate {kind} {href[:80]}")
        if "index" in rel and "llms" in href.lower():
            note("has_llms_txt_ref", f"index {href[:100]}")
        if attrs.get("data-llm-hint") and ("alternate" in rel or "index" in rel):
            note("has_llm_hints", f"hint {attrs['data-llm-hint'][:100]}")
    url = _named(dom, lambda n: n == "markdown_url")
    if url and dom.attrs[url[0]].get("content"):
        note("has_markdown_url_meta", f"markdown_url {dom.attrs[url[0]]['content'][:100]}")
    if "has_llms_txt_ref" not in seen:
        for i in dom.find_all("a", "link"):
            if "llms.txt" in dom.attrs[i].get("href", "").lower():
                note("has_llms_txt_ref", f"link {dom.attrs[i]['href'][:100]}")
                break
    return {k: k in seen for k in ("has_markdown_alternate", "has_markdown_url_meta", "has_llm_hints", "has_llms_txt_ref", "has_non_html_alternate")} | {"details": details}


def features(html: str | Dom) -> dict:
    dom = html if isinstance(html, Dom) else Dom(html)
    heads = dom.find_all(*HEADINGS)
    primary = next((found[0] for s in PRIMARY if (found := _select(dom, s))), None)
    body = dom.first("body")
    length = dom.length(primary) if primary is not None else 0
    if not length:
        length = dom.length(body)
    links = [i for i in dom.by_tag.get("a", ()) if "href" in dom.attrs[i]]
    told = [t for t in (dom.plain(i).strip() for i in links) if len(t) > 3 and t.lower() not in VAGUE_LINKS]
    title = dom.first("title")
    blocks = structured.json_ld(dom)
    merged = structured.merged(blocks)
    records, good = structured.items(blocks)
    robots, topic = _named(dom, lambda n: n == "robots"), _named(dom, lambda n: n == "ms.topic")
    page_lang = [i for i in dom.by_tag.get("html", ()) if "lang" in dom.attrs[i]]
    within = lambda *tags: dom.find_all(*tags, within=body) if body is not None else []
    return {
        "semantic": [{"element": e, "count": dom.count(e)} for e in SEMANTIC_ELEMENTS if dom.count(e)],
        "role_count": sum("role" in a for a in dom.attrs),
        "heading_levels": [int(dom.tags[i][1]) for i in heads],
        "headings": [{"level": int(dom.tags[i][1]), "text": dom.text(i)[:50]} for i in heads[:10]],
        "main_count": dom.count("main"), "article_count": dom.count("article"), "p_count": dom.count("p"), "div_count": dom.count("div"),
        "code_count": dom.count("pre", "code"), "table_count": dom.count("table"), "list_count": dom.count("ul", "ol"), "h1_count": dom.count("h1"),
        "total_length": dom.length(), "primary_length": length,
        "boilerplate_length": sum(dom.length(i) for s in BOILERPLATE for i in _select(dom, s)),
        "img_count": dom.count("img"), "img_alt_count": sum("alt" in dom.attrs[i] for i in dom.by_tag.get("img", ())),
        "link_count": len(links), "link_descriptive_count": len(told),
        "has_title": title is not None and bool(dom.plain(title).strip()), "has_lang_attribute": bool(page_lang),
        "title_tag": title is not None and dom.length(title) > 0,
        "og_title": _content(dom, dom.metas(property="og:title")), "meta_description": _content(dom, dom.metas(name="description")),
        "og_description": _content(dom, dom.metas(property="og:description")), "meta_author": _content(dom, dom.metas(name="author")),
        "meta_date": _content(dom, _named(dom, lambda n: "date" in n)), "time_element": any("datetime" in dom.attrs[i] for i in dom.by_tag.get("time", ())),
        "meta_topic": _content(dom, _named(dom, lambda n: n in ("topic", "category"))), "meta_keywords": _content(dom, dom.metas(name="keywords")),
        "html_lang": bool(page_lang) and bool(dom.attrs[page_lang[0]]["lang"].strip()),
        "meta_lang": _content(dom, [i for i in dom.by_tag.get("meta", ()) if dom.attrs[i].get("http-equiv", "").lower() == "content-language"]),
        "canonical": _content(dom, [i for i in dom.by_tag.get("link", ()) if "canonical" in dom.rel(i)], "href"),
        "ld_name": bool(merged.get("name") or merged.get("headline")), "ld_description": bool(merged.get("description")),
        "ld_author": bool(merged.get("author")), "ld_publisher": bool(merged.get("publisher")),
        "ld_date": bool(merged.get("dateModified") or merged.get("datePublished")), "ld_section": bool(merged.get("articleSection")),
        "meta_robots": dom.attrs[robots[0]].get("content", "").lower() if robots else None,
        "hints": hints(dom),
        "ms_topic": dom.attrs[topic[0]].get("content", "").strip().lower() if topic else None,
        "schema_type": structured.top_type(blocks),
        "body_text": body is not None and dom.length(body) > 0, "body_h123_count": len(within("h1", "h2", "h3")),
        "body_p_chars": sum(dom.length(i) for i in within("p")), "body_code_chars": sum(len(dom.plain(i)) for i in within("pre", "code")),
        "ld_items": records, "ld_valid": good, **structured.other_formats(dom), "samples": structured.samples(dom, blocks),
    }


def readable(html: str | Dom) -> dict:
    dom = html if isinstance(html, Dom) else Dom(html)
    got = readability.extract(dom)
    main = next((i for t in ("main", "article") if (i := dom.first(t)) is not None), None)
    words = lambda text: text.lower().split()[:200]
    raw = dom.text(separator=" ")
    text = got["text"]
    return {
        "raw_length": len(raw), "extracted_length": len(text), "title_present": bool(got["title"]),
        "headings": dom.count(*HEADINGS), "lists": dom.count("ul", "ol"), "code": dom.count("pre", "code"),
        "extracted_headings": got["headings"], "extracted_lists": got["lists"], "extracted_code": got["code"],
        "main_present": main is not None, "main_length": len(dom.text(main, " ")) if main is not None else 0,
        "main_words": words(dom.text(main, " ")) if main is not None else [], "extracted_words": words(text),
        "preview": text[:300] + ("..." if len(text) > 300 else ""),
    }


#: Pages whose values are held at once; a batch of Arrow has up to 10,000.
PAGES = 128


def _kernel(one: Callable[[str], dict], schema: str) -> Callable[[Column], Column]:
    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = list(one("<p>").keys())
        for part in (batch.iloc[k : k + PAGES] for batch in batches for k in range(0, len(batch), PAGES)):
            rows = [one(h) if isinstance(h, str) and h else None for h in part]
            yield pd.DataFrame({n: pd.Series([r and r[n] for r in rows], dtype=object) for n in names})

    return run


def with_features(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``f``; null html gives null fields."""
    return pages.withColumn("f", _kernel(features, FEATURES)(html))


def _both(html: str) -> dict:
    dom = Dom(html)
    return {"f": features(dom), "r": readable(dom)}


def with_readable(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``f`` and ``r`` from one parse; queries without extraction use ``with_features`` and don't pay for it."""
    both = pages.withColumn("both", _kernel(_both, f"struct<f {FEATURES}, r {READABLE}>")(html))
    return both.select("*", "both.f", "both.r").drop("both")
