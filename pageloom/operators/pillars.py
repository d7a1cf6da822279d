"""Six pillar scores of a page from its feature struct ``f`` (and ``r`` for extraction), 0 to 100, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.constants import AXE_SEVERITY, FIELD_EXPECTATIONS, FORMAT_POINTS, GENERIC_FIELDS, KNOWN_TYPES, REQUIRED_FIELDS


def d(value: float) -> Column:
    """A double literal."""
    return F.lit(float(value))


def total(*parts: Column) -> Column:
    return reduce(lambda a, b: a + b, parts)


def f(name: str) -> Column:
    return F.col("f").getField(name)


def r(name: str) -> Column:
    return F.col("r").getField(name)


# ---- semantic HTML


def semantic_html() -> Column:
    coverage = F.size(f("semantic")) / d(11) * d(60)
    roles = F.least(f("role_count") * 5, F.lit(20)).cast("double")
    heads = F.least(F.size(f("heading_levels")) * 2, F.lit(20)).cast("double")
    return F.least(coverage + roles + heads, d(100))


def semantic_usage() -> Column:
    """element, count and proper_usage of each semantic element found: one main, at most two headers and footers."""
    proper = lambda x: F.when(x["element"] == "main", x["count"] == 1).when(x["element"].isin("header", "footer"), x["count"] <= 2).otherwise(True)
    return F.transform(f("semantic"), lambda x: F.struct(x["element"].alias("element"), x["count"].alias("count"), proper(x).alias("proper_usage")))


# ---- accessibility


def accessibility_checks() -> dict[str, Column]:
    return {
        "has_lang_attribute": f("has_lang_attribute"),
        "has_title": f("has_title"),
        "images_have_alt": (f("img_count") == 0) | (f("img_alt_count") >= f("img_count") * d(0.8)),
        "headings_structured": f("h1_count") >= 1,
        "links_descriptive": (f("link_count") == 0) | (f("link_descriptive_count") / f("link_count") >= d(0.7)),
    }


def static_accessibility() -> Column:
    return total(*(c.cast("int") for c in accessibility_checks().values())) / d(5) * d(100)


def axe_penalty(impact: Column, nodes: Column) -> Column:
    """Penalty of one violated rule."""
    severity = reduce(lambda e, kv: F.when(impact == kv[0], kv[1]).otherwise(e), AXE_SEVERITY.items(), F.lit(5))
    return F.least(severity * F.least(nodes, F.lit(3)), F.lit(25))


def axe_score(penalties: Column) -> Column:
    return F.greatest(d(0), d(100) - penalties)


# ---- structured data


def _by_type(table: dict, kind: Column, value) -> Column:
    return reduce(lambda e, kv: F.when(kind == kv[0], value(kv[1])).otherwise(e), table.items(), F.lit(None))


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, d(0), lambda s, x: s + x), F.size(values).cast("double"))


def type_appropriateness() -> Column:
    kinds = F.flatten(F.transform(f("ld_items"), lambda i: i["types"]))
    matched = F.size(F.filter(kinds, lambda k: k.isin(*KNOWN_TYPES)))
    return F.least(F.coalesce(F.try_divide(matched, F.size(kinds)), d(0)) * d(20), d(20))


def field_completeness() -> Column:
    def ratio(item: Column) -> Column:
        def share(fields: tuple) -> Column:
            required, recommended = fields
            held = lambda n: F.array_contains(item["filled"], n)
            good = [(held(n) & ~F.array_contains(item["invalid"], n)).cast("int") for n in required]
            return total(*good, *(held(n).cast("int") for n in recommended)) / d(len(required) + len(recommended))

        return _by_type(FIELD_EXPECTATIONS, item["checked_type"], share)

    ratios = F.filter(F.transform(f("ld_items"), ratio), lambda x: x.isNotNull())
    generic = F.size(F.array_intersect(F.flatten(F.transform(f("ld_items"), lambda i: i["truthy"])), F.array(*map(F.lit, GENERIC_FIELDS))))
    return F.when(F.size(ratios) > 0, F.least(d(30), d(30) * _mean(ratios))).when(F.size(f("ld_items")) > 0, generic / d(len(GENERIC_FIELDS)) * d(30)).otherwise(d(0))


def multiple_formats() -> Column:
    n = total(*(x.cast("int") for x in (F.size(f("ld_items")) > 0, f("opengraph_count") > 0, f("microdata_count") > 0, f("microformat_count") > 0)))
    return F.element_at(F.array(*map(d, FORMAT_POINTS)), n + 1)


def schema_validation() -> Column:
    def credit(item: Column) -> Column:
        def share(required: tuple) -> Column:
            present = total(*(F.array_contains(item["truthy"], n).cast("int") for n in required))
            return F.when(present == len(required), d(1)).otherwise(present / d(len(required)) * d(0.5))

        return _by_type(REQUIRED_FIELDS, item["first_type"], share)

    credits = F.filter(F.transform(f("ld_items"), credit), lambda x: x.isNotNull())
    return F.when(F.size(credits) > 0, _mean(credits) * d(30)).when(F.size(f("ld_items")) > 0, d(10)).otherwise(d(0))


def structured_data() -> Column:
    """Null, a failed pillar, if a JSON-LD block doesn't parse."""
    parts = type_appropriateness() + field_completeness() + multiple_formats() + schema_validation()
    return F.when(f("ld_valid"), F.least(parts, d(100)))


# ---- metadata


def metadata_fields() -> dict[str, tuple[int, Column]]:
    any_of = lambda *names: reduce(lambda a, b: a | b, (f(n) for n in names))
    return {
        "title": (15, any_of("title_tag", "og_title", "ld_name")),
        "description": (15, any_of("meta_description", "og_description", "ld_description")),
        "author": (15, any_of("meta_author", "ld_author", "ld_publisher")),
        "date": (15, any_of("meta_date", "time_element", "ld_date")),
        "topic": (15, any_of("meta_topic", "ld_section", "meta_keywords")),
        "language": (10, any_of("html_lang", "meta_lang")),
        "canonical_url": (15, any_of("canonical")),
    }


def metadata_completeness() -> Column:
    return total(*(F.when(test, points).otherwise(0) for points, test in metadata_fields().values())).cast("double")


# ---- HTTP


def hint_points() -> Column:
    points = (("has_markdown_alternate", 6), ("has_markdown_url_meta", 4), ("has_llm_hints", 4), ("has_llms_txt_ref", 3), ("has_non_html_alternate", 3))
    return F.least(total(*(F.when(f("hints").getField(n), p).otherwise(0) for n, p in points)), F.lit(20)).cast("double")


def reachability(url_known: Column, status: Column) -> Column:
    """status is null where the page was never asked for."""
    seen = F.when(status == 200, 15).when(status.isin(301, 302, 307, 308), 11).when((status > 0) & (status < 400), 8).otherwise(0)
    return F.when(~url_known | status.isNull(), 11).otherwise(seen).cast("double")


def redirect_efficiency(chain: Column, redirect_ms: Column, final_ms: Column) -> Column:
    """0 to 40 from the chain's status codes, and the time lost; 40 without crawl data."""
    n = F.size(chain)
    hops = F.when(n == 0, 25).when(n <= 2, 20).when(n <= 4, 10).otherwise(0)
    proper = F.size(F.filter(chain, lambda c: c.isin(301, 302, 303, 307, 308)))
    kinds = F.when(n == 0, d(10)).otherwise(proper / n.cast("double") * d(10))
    speed = F.when(final_ms > 0, F.least(d(5), F.greatest(d(5) - F.try_divide(redirect_ms, redirect_ms + final_ms) * d(10), d(0)))).otherwise(d(5))
    return F.when(chain.isNull(), d(40)).otherwise(hops + kinds + speed)


def redirect_class(n: Column, ms: Column) -> Column:
    return F.when(n == 0, "optimal").when((n <= 2) & (ms < 500), "good").when((n <= 4) & (ms < 1000), "moderate").when(n <= 6, "poor").otherwise("critical")


def revisits(targets: Column) -> Column:
    """Whether a redirect walk comes to a target twice, where it stops."""
    return F.size(F.array_distinct(targets)) < F.size(targets)


def crawl_permissions(robots_known: Column, blocked: Column) -> Column:
    """robots_known: whether robots.txt could be asked for; blocked: its answer for the page's path."""
    meta = F.when(f("meta_robots").contains("noindex"), 0).when(f("meta_robots").contains("nofollow"), 10).otherwise(12)
    return F.least(F.when(~robots_known, meta + 4).when(blocked, F.greatest(meta - 12, F.lit(0))).otherwise(meta + 8), F.lit(20)).cast("double")


def cache_headers(headers: Column) -> Column:
    """headers: a map with lower-case names, null where none could be read."""
    held = lambda n: F.map_contains_key(headers, n)
    control = F.when(held("cache-control"), F.when(F.lower(F.try_element_at(headers, F.lit("cache-control"))).contains("no-store"), 1).otherwise(4)).otherwise(0)
    return F.when(headers.isNull(), 10).otherwise(F.when(held("etag"), 8).otherwise(0) + F.when(held("last-modified"), 8).otherwise(0) + control).cast("double")


def http_compliance(reach: Column, redirects: Column, permissions: Column, cache: Column) -> Column:
    return F.least(reach + redirects / d(40) * d(25) + permissions + cache + hint_points(), d(100))


def http_offline() -> Column:
    none = F.lit(None)
    return http_compliance(reachability(F.lit(False), none.cast("int")), redirect_efficiency(none.cast("array<int>"), d(0), d(0)), crawl_permissions(F.lit(False), F.lit(False)), cache_headers(none.cast("map<string,string>")))


# ---- extraction


def signal_to_noise() -> Column:
    x = r("extracted_length") / r("raw_length").cast("double")
    score = F.when(x < 0.05, x * d(200)).when(x < 0.15, d(10) + (x - d(0.05)) * d(200)).when(x <= 0.85, d(30) + F.least(x, d(0.7)) / d(0.7) * d(10)).otherwise(d(35))
    return F.least(score, d(40))


def structure_preservation() -> Column:
    part = lambda n: F.when(r(n) == 0, d(5)).otherwise(F.least(r(f"extracted_{n}") / r(n).cast("double"), d(1)) * d(10))
    return F.least(part("headings") + part("lists") + part("code"), d(30))


def boundary_detection() -> Column:
    words = F.array_distinct(r("main_words"))
    overlap = F.size(F.array_intersect(words, F.array_distinct(r("extracted_words")))) / F.size(words).cast("double") * d(10)
    both = (r("main_length") > 0) & (r("extracted_length") > 0)
    region = F.when(~r("main_present"), d(3)).when(both & (F.size(words) > 0), overlap).otherwise(d(5))
    size = F.when(r("extracted_length") > 100, 10).when(r("extracted_length") > 20, 5).otherwise(0)
    return F.least(F.when(r("title_present"), d(10)).otherwise(d(0)) + size + region, d(30))


def content_extractability() -> Column:
    return F.when(r("raw_length") == 0, d(0)).otherwise(F.least(signal_to_noise() + structure_preservation() + boundary_detection(), d(100)))


# ---- parse signals


def heading_hierarchy_valid() -> Column:
    levels = f("heading_levels")
    steps = F.zip_with(F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0))), F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0))), lambda a, b: a > b + 1)
    return (F.size(levels) > 0) & ~F.exists(steps, lambda x: x)


def text_density() -> Column:
    return F.least(F.coalesce(F.try_divide(f("primary_length"), f("total_length")), d(0)), d(1))


def boilerplate_leakage() -> Column:
    return F.least(F.coalesce(F.try_divide(f("boilerplate_length"), f("total_length")), d(1)), d(1))


# ---- evidence


def evidence() -> Column:
    """array<string> of what a page's score rests on: containers, headings, density, offers to agents."""
    levels = f("heading_levels")
    jumps = F.aggregate(F.sequence(F.lit(1), F.size(levels)), F.lit(0), lambda n, k: n + F.coalesce(F.get(levels, k) > F.get(levels, k - 1) + 1, F.lit(False)).cast("int"))
    headings = F.when(F.size(levels) == 0, "No headings found").when(~heading_hierarchy_valid(), F.concat(jumps.cast("string"), F.lit(" hierarchy violations"))).otherwise(F.concat(F.size(levels).cast("string"), F.lit(" headings in order")))
    first = F.transform(F.slice(f("headings"), 1, 3), lambda h: F.concat(F.lit("h"), h["level"].cast("string"), F.lit(": "), h["text"]))
    containers = F.concat(f("main_count").cast("string"), F.lit(" main, "), f("article_count").cast("string"), F.lit(" article"))
    density = F.format_string("primary text %.0f%%, boilerplate %.0f%%", text_density() * 100, boilerplate_leakage() * 100)
    return F.array_compact(F.concat(F.array(containers, headings), first, F.array(density), f("hints")["details"]))


def hops_evidence(chain: Column) -> Column:
    """The first three hops of a redirect chain and how many follow; null without any."""
    shown, more = F.array_join(F.slice(chain, 1, 3).cast("array<string>"), " -> "), F.size(chain) - 3
    return F.when(F.size(chain) > 0, F.concat(F.lit("redirects: "), shown, F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise("")))
