"""DuckDB SQL of the registered queries, written against the tables alone: regular expressions stand in for the kernel."""

from __future__ import annotations

from pageloom.plans import inputs, oracle_values
from pageloom.plans.oracle_values import FORMAT_POINTS, MS_TOPIC_PROFILES, PILLARS, PROFILE_WEIGHTS, QUESTIONS, RULES, SCHEMA_PROFILES, SEMANTIC_ELEMENTS, SIGNS, STRUCTURE, URL_PROFILES

TAGLESS = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"


def _case(values: tuple[str, ...]) -> str:
    return "CASE CAST(page_id % 12 AS INT) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


def dbl(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def unescape(x: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def count(tag: str) -> str:
    return rf"len(regexp_extract_all(b, '(?i)<{tag}(?:\s|>|/)'))"


def length(x: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform(string_split_regex({x}, '<[^>]*>'), lambda p: length({trim(unescape('p'))}))), 0) AS INTEGER)"


def case(key: str, table: dict, default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def total(parts) -> str:
    return "(" + " + ".join(parts) + ")"


LD = r"regexp_extract(html, '(?s)<script type=\"application/ld\+json\">(.*?)</script>', 1)".replace('\\"', '"')
BARE = f"""enriched AS ({inputs.ENRICHED}),
bare AS (SELECT *, regexp_replace(html, '{TAGLESS}', '', 'g') AS b, {LD} AS ld, TRY_CAST(nullif({LD}, '') AS JSON) AS j FROM enriched)"""


def meta(name: str, key: str = "name") -> str:
    """Content of the first such meta tag."""
    return f"""regexp_extract(b, '<meta {key}="{name}" content="([^"]*)"', 1)"""


def has(name: str, key: str = "name") -> str:
    return f"({trim(meta(name, key))} <> '')"


def truthy(field: str) -> str:
    return f"(coalesce(j->>'{field}', '') NOT IN ('', '[]', '{{}}'))"


LEVELS = r"list_transform(regexp_extract_all(b, '(?i)<h([1-6])(?:\s|>|/)', 1), lambda x: CAST(x AS INTEGER))"
PARSE = f"""WITH {BARE}, l AS (SELECT *, {LEVELS} AS levels FROM bare)
SELECT page_id, {count("main")} > 0 AS has_main, {count("article")} > 0 AS has_article,
  len(levels) > 0 AND NOT coalesce(list_bool_or(list_transform(range(1, len(levels)), lambda i: levels[i + 1] > levels[i] + 1)), false) AS hierarchy_valid,
  {", ".join(f"CAST({total(count(t) for t in tags)} AS INTEGER) AS {n}" for n, tags in (("p_count", ("p",)), ("div_count", ("div",)), ("code_count", ("pre", "code")), ("table_count", ("table",)), ("list_count", ("ul", "ol"))))},
  coalesce(array_to_string(list_transform(levels, lambda x: CAST(x AS VARCHAR)), ','), '') AS levels FROM l"""


def element(tag: str) -> str:
    return f"regexp_extract(b, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1)"


DENSITY = f"""WITH {BARE}, t AS (SELECT page_id, {length("b")} AS total_length, {length(element("article"))} AS primary_length, {length(element("nav"))} + {length(element("footer"))} AS chrome FROM bare)
SELECT page_id, total_length, primary_length, least(primary_length / total_length, 1.0::DOUBLE) AS text_density, least(chrome / total_length, 1.0::DOUBLE) AS boilerplate_leakage FROM t"""

HEADS = total(count(f"h{i}") for i in range(1, 7))
FOUND = total(f"CAST({count(e)} > 0 AS INTEGER)" for e in SEMANTIC_ELEMENTS)
ROLES = r"len(regexp_extract_all(b, '(?i)<[a-z0-9]+\s[^>]*\brole='))"
SEM = f"least({FOUND} / {dbl(11)} * {dbl(60)} + CAST(least({ROLES} * 5, 20) AS DOUBLE) + CAST(least({HEADS} * 2, 20) AS DOUBLE), {dbl(100)})"
PROPER = {"main": "= 1", "header": "<= 2", "footer": "<= 2"}
USAGE = ", ".join(f"CASE WHEN {count(e)} > 0 THEN concat('{e}:', {count(e)}, ':', {count(e)} {PROPER.get(e, '> 0')}) END" for e in SEMANTIC_ELEMENTS)
SEMANTIC = f"WITH {BARE} SELECT page_id, {SEM} AS score, array_to_string(list_filter([{USAGE}], lambda x: x IS NOT NULL), ',') AS usage FROM bare"

LINKS = r"regexp_extract_all(b, '(?is)<a\s[^>]*href[^>]*>(.*?)</a>', 1)"
LINK_TEXT = trim(unescape("regexp_replace(t, '<[^>]*>', '', 'g')"))
TITLE = f"{trim(unescape(element('title')))} <> ''"
CHECKS = {
    "has_lang_attribute": r"regexp_matches(b, '(?i)<html[^>]*\slang=')",
    "has_title": TITLE,
    "images_have_alt": rf"({count('img')} = 0 OR len(regexp_extract_all(b, '(?i)<img\s[^>]*\salt=')) >= {count('img')} * {dbl(0.8)})",
    "headings_structured": f"{count('h1')} >= 1",
    "links_descriptive": f"(len({LINKS}) = 0 OR len(list_filter({LINKS}, lambda t: length({LINK_TEXT}) > 3 AND lower({LINK_TEXT}) NOT IN ('click here', 'read more', 'more'))) / len({LINKS}) >= {dbl(0.7)})",
}
A11Y = f"{total(f'CAST({c} AS INTEGER)' for c in CHECKS.values())} / {dbl(5)} * {dbl(100)}"
ACCESS = f"WITH {BARE} SELECT page_id, {', '.join(f'{c} AS {n}' for n, c in CHECKS.items())}, {A11Y} AS score FROM bare"

DATE_META = r"""(trim(regexp_extract(b, '(?i)<meta name="[^"]*date[^"]*" content="([^"]*)"', 1)) <> '')"""
TOPIC_META = r"""(trim(regexp_extract(b, '(?i)<meta name="(?:topic|category)" content="([^"]*)"', 1)) <> '')"""
FIELDS = {
    "title": (15, f"({TITLE} OR {has('og:title', 'property')} OR {truthy('name')} OR {truthy('headline')})"),
    "description": (15, f"({has('description')} OR {has('og:description', 'property')} OR {truthy('description')})"),
    "author": (15, f"({has('author')} OR {truthy('author')} OR {truthy('publisher')})"),
    "date": (15, rf"({DATE_META} OR regexp_matches(b, '(?i)<time\s[^>]*datetime') OR {truthy('dateModified')} OR {truthy('datePublished')})"),
    "topic": (15, f"({TOPIC_META} OR {truthy('articleSection')} OR {has('keywords')})"),
    "language": (10, """(trim(regexp_extract(b, '<html[^>]*lang="([^"]*)"', 1)) <> '')"""),
    "canonical_url": (15, """(trim(regexp_extract(b, '<link rel="canonical" href="([^"]*)"', 1)) <> '')"""),
}
MET = f"CAST({total(f'CASE WHEN {c} THEN {p} ELSE 0 END' for p, c in FIELDS.values())} AS DOUBLE)"
METADATA = f"WITH {BARE} SELECT page_id, {', '.join(f'{c} AS has_{n}' for n, (_, c) in FIELDS.items())}, {MET} AS score FROM bare"

HINTS = {
    "has_markdown_alternate": (6, """regexp_matches(b, '<link rel="alternate" type="[^"]*markdown')"""),
    "has_markdown_url_meta": (4, has("markdown_url")),
    "has_llm_hints": (4, """regexp_matches(b, '<link rel="(?:alternate|index)"[^>]*data-llm-hint="[^"]')"""),
    "has_llms_txt_ref": (3, """(regexp_matches(b, '(?i)<link rel="index"[^>]*href="[^"]*llms') OR regexp_matches(b, '(?i)<(?:a|link)\\s[^>]*href="[^"]*llms[.]txt'))"""),
    "has_non_html_alternate": (3, """regexp_matches(b, '<link rel="alternate" type="application/json"')"""),
}
POINTS = f"CAST(least({total(f'CASE WHEN {c} THEN {p} ELSE 0 END' for p, c in HINTS.values())}, 20) AS DOUBLE)"
HINT = f"WITH {BARE} SELECT page_id, {', '.join(f'{c} AS {n}' for n, (_, c) in HINTS.items())}, {POINTS} AS points FROM bare"

KIND = "coalesce(j->>'@type', '')"
VALID = "(ld = '' OR j IS NOT NULL)"
TYPE_POINTS = f"CASE WHEN {KIND} IN ('Article', 'FAQPage', 'HowTo') THEN {dbl(20)} ELSE {dbl(0)} END"
INT = lambda f: f"CAST({truthy(f)} AS INTEGER)"
ANSWERED = "CAST(coalesce(j->'mainEntity'->0->'acceptedAnswer', 'null') <> 'null' AS INTEGER)"
SHARE = {
    "Article": f"{total(map(INT, ('headline', 'datePublished', 'author', 'dateModified', 'description', 'publisher')))} / {dbl(6)}",
    "FAQPage": f"{ANSWERED} / {dbl(1)}",
    "HowTo": f"{total(map(INT, ('name', 'step', 'description', 'totalTime')))} / {dbl(4)}",
}
FIELD_POINTS = "CASE " + " ".join(f"WHEN {KIND} = '{k}' THEN least({dbl(30)}, {dbl(30)} * ({v}))" for k, v in SHARE.items()) + f" ELSE {dbl(0)} END"
N_FORMATS = f"CAST(j IS NOT NULL AS INTEGER) + CAST(regexp_matches(b, '<meta property=\"og:') AS INTEGER)"
FORMATS = "CASE " + f"{N_FORMATS} " + " ".join(f"WHEN {i} THEN {dbl(p)}" for i, p in enumerate(FORMAT_POINTS)) + " END"
NEEDED = {"Article": ("headline", "author", "datePublished"), "FAQPage": ("mainEntity",), "HowTo": ("name", "step")}
SCHEMA = "CASE " + " ".join(f"WHEN {KIND} = '{k}' THEN (CASE WHEN {total(map(INT, v))} = {len(v)} THEN {dbl(1)} ELSE {total(map(INT, v))} / {dbl(len(v))} * {dbl(0.5)} END) * {dbl(30)}" for k, v in NEEDED.items()) + f" ELSE {dbl(0)} END"
STR = f"CASE WHEN {VALID} THEN least({TYPE_POINTS} + {FIELD_POINTS} + {FORMATS} + {SCHEMA}, {dbl(100)}) END"
STRUCTURED = f"""WITH {BARE} SELECT page_id, {", ".join(f"CASE WHEN {VALID} THEN {c} END AS {n}" for n, c in (("type_points", TYPE_POINTS), ("field_points", FIELD_POINTS), ("format_points", FORMATS), ("schema_points", SCHEMA)))}, {STR} AS score FROM bare"""

ROBOTS_META = meta("robots")
META_POINTS = f"CASE WHEN contains({ROBOTS_META}, 'noindex') THEN 0 WHEN contains({ROBOTS_META}, 'nofollow') THEN 10 ELSE 12 END"
OFFLINE = f"least({dbl(11)} + {dbl(40)} / {dbl(40)} * {dbl(25)} + CAST(least({META_POINTS} + 4, 20) AS DOUBLE) + {dbl(10)} + {POINTS}, {dbl(100)})"

MS = f"lower({trim(meta('ms.topic'))})"
PATH = r"lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1))"
FRAGMENT = "CASE " + " ".join(f"WHEN contains({PATH}, '{f}') THEN '{f}'" for f, _ in URL_PROFILES) + " END"
BODY = "regexp_extract(b, '(?is)<body[^>]*>(.*)$', 1)"
CLASSES = f"""classes AS (SELECT *, {case(MS, MS_TOPIC_PROFILES)} AS by_topic, {case(f"lower({KIND})", SCHEMA_PROFILES)} AS by_type, {FRAGMENT} AS fragment FROM bare),
classified AS (SELECT *, {case("fragment", dict(URL_PROFILES))} AS by_url FROM classes)"""
PROFILE = "coalesce(by_topic, by_type, by_url, 'article')"
SOURCE = "CASE WHEN by_topic IS NOT NULL THEN 'ms_topic' WHEN by_type IS NOT NULL THEN 'schema_type' WHEN by_url IS NOT NULL THEN 'url' ELSE 'default' END"
CONTENT = f"WITH {BARE}, {CLASSES} SELECT page_id, {PROFILE} AS profile, {SOURCE} AS source, CASE {SOURCE} WHEN 'ms_topic' THEN {MS} WHEN 'schema_type' THEN j->>'@type' WHEN 'url' THEN fragment END AS matched_value FROM classified"

CHAIN = "list_transform(list_filter(string_split(codes, ','), lambda x: x <> ''), lambda x: CAST(x AS INTEGER))"
HOPS = f"crawl AS (SELECT *, {CHAIN} AS chain FROM ({inputs.CRAWL}) AS c)"
EFFICIENCY = f"""(CASE WHEN len(chain) = 0 THEN 25 WHEN len(chain) <= 2 THEN 20 WHEN len(chain) <= 4 THEN 10 ELSE 0 END
  + CASE WHEN len(chain) = 0 THEN {dbl(10)} ELSE len(list_filter(chain, lambda c: c IN (301, 302, 303, 307, 308))) / CAST(len(chain) AS DOUBLE) * {dbl(10)} END
  + CASE WHEN final_ms > 0 THEN least({dbl(5)}, greatest({dbl(5)} - redirect_ms / (redirect_ms + final_ms) * {dbl(10)}, {dbl(0)})) ELSE {dbl(5)} END)"""
REDIRECTS = f"""WITH {HOPS} SELECT page_id, CAST(len(chain) AS INTEGER) AS hops, {EFFICIENCY} AS efficiency,
  CASE WHEN len(chain) = 0 THEN 'optimal' WHEN len(chain) <= 2 AND redirect_ms < 500 THEN 'good' WHEN len(chain) <= 4 AND redirect_ms < 1000 THEN 'moderate' WHEN len(chain) <= 6 THEN 'poor' ELSE 'critical' END AS class,
  len(list_distinct(chain)) < len(chain) AS revisits FROM crawl"""
FORBIDDEN = "starts_with(regexp_extract(url, '^https://[^/]*(.*)$', 1), '/api') AND NOT starts_with(regexp_extract(url, '^https://[^/]*(.*)$', 1), '/api/x/y')"
RECORDS = f"records AS (SELECT *, {CHAIN} AS chain FROM ({inputs.CRAWLED}) AS c)"
HTTP_PARTS = {
    "reachability": "CAST(CASE WHEN status = 200 THEN 15 WHEN status IN (301, 302, 307, 308) THEN 11 WHEN status > 0 AND status < 400 THEN 8 ELSE 0 END AS DOUBLE)",
    "redirects": EFFICIENCY,
    "permissions": f"CAST(least(CASE WHEN page_id % 4 = 3 THEN {META_POINTS} + 4 WHEN page_id % 4 = 2 OR page_id % 4 = 1 AND {FORBIDDEN} THEN greatest({META_POINTS} - 12, 0) ELSE {META_POINTS} + 8 END, 20) AS DOUBLE)",
    "cache": "CAST(CASE header WHEN 'etag' THEN 8 WHEN 'last-modified' THEN 8 WHEN 'cache-control' THEN (CASE WHEN contains(header_value, 'no-store') THEN 1 ELSE 4 END) ELSE 0 END AS DOUBLE)",
}
HTTP = f"""WITH {BARE}, {RECORDS}, both_ AS (SELECT bare.*, status, chain, redirect_ms, final_ms, header, header_value FROM bare JOIN records USING (page_id)),
parts AS (SELECT page_id, {", ".join(f"{c} AS {n}" for n, c in HTTP_PARTS.items())}, {POINTS} AS points FROM both_)
SELECT page_id, reachability, redirects, permissions, cache, least(reachability + redirects / {dbl(40)} * {dbl(25)} + permissions + cache + points, {dbl(100)}) AS score FROM parts"""


def weighted(profile: str, present: tuple[str, ...] = PILLARS) -> str:
    def of(name: str) -> str:
        w = dict(zip(PILLARS, PROFILE_WEIGHTS[name], strict=True))
        held = " + ".join(f"coalesce({p} * {dbl(w[p])}, {dbl(0)})" if p in present else dbl(0) for p in PILLARS)
        over = " + ".join(f"CASE WHEN {p} IS NOT NULL THEN {dbl(w[p])} ELSE {dbl(0)} END" if p in present else dbl(0) for p in PILLARS)
        return f"coalesce(({held}) / nullif({over}, 0), {dbl(0)})"

    return of("article") if profile == "'article'" else f"CASE {profile} " + " ".join(f"WHEN '{n}' THEN {of(n)}" for n in PROFILE_WEIGHTS if n != "article") + f" ELSE {of('article')} END"


CORE = tuple(p for p in PILLARS if p != "content_extractability")
CORE_ROWS = f"""{BARE}, {CLASSES}, core AS (SELECT page_id, url, concat(substr(md5(url), 1, 12), '.html') AS html_path, 'raw' AS render_mode, {PROFILE} AS content_type, {SOURCE} AS content_type_source,
  {SEM} AS semantic_html, {STR} AS structured_data, {A11Y} AS dom_navigability, {MET} AS metadata_completeness, {OFFLINE} AS http_compliance FROM classified),
scored AS (SELECT *, {weighted("content_type", CORE)} AS parseability_score, {weighted("'article'", CORE)} AS universal_score, 'partial_evaluation' AS failure_mode, true AS partial_evaluation FROM core)"""

# Extraction over the given pages: an article is a heading and runs of paragraphs, each run inside the bold text of the one before; elsewhere text is in a title, a list of links, a block and a footer.


def pieces(x: str) -> str:
    """Stripped parts of a piece of HTML between its tags."""
    chars = "p"
    for entity, char in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        chars = f"regexp_replace({chars}, '{entity}', '{char}', 'g')"
    return f"list_filter(list_transform(string_split_regex({x}, '<[^>]*>'), lambda p: {trim(f"CASE WHEN contains(p, '&') THEN {chars} ELSE p END")}), lambda p: p <> '')"


def told(x: str) -> str:
    """Its text, with a space between the parts."""
    return f"array_to_string({pieces(x)}, ' ')"


def gain(t: str) -> str:
    return f"CASE WHEN length({t}) >= 25 THEN 1 + length({t}) - length(replace({t}, ',', '')) + least(length({t}) // 100, 3) ELSE 0 END"


def words(t: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({t}), '\s+'), lambda w: w <> '')[1:200])"


def joined(x: str) -> str:
    return f"array_to_string(list_filter({x}, lambda t: t <> ''), ' ')"


def spaceless(x: str) -> str:
    """Length of its parts."""
    return f"length(array_to_string({pieces(x)}, ''))"


LINKED = spaceless(f"array_to_string({LINKS}, '<>')")
UNLINKED = r"regexp_replace(b, '(?is)<ul\b.*?</ul>', '', 'g')"
EXTRACTED = f"""texts AS (SELECT *, string_split({element("article")}, '<p><b>') AS parts FROM classified),
cut AS (SELECT *, list_transform(parts, lambda x: {pieces("x")}) AS held, list_transform(parts, lambda x: list_transform(regexp_extract_all(x, '(?s)<p>(.*?)</p>', 1), lambda y: {told("y")})) AS inner_ FROM texts),
runs AS (SELECT *, list_transform(held, lambda l: array_to_string(l, ' ')) AS told, list_transform(held, lambda l: length(array_to_string(l, ''))) AS sizes FROM cut),
tails AS (SELECT *, list_transform(range(1, len(parts) + 1), lambda i: {joined("told[i:]")}) AS tails FROM runs),
ranked AS (SELECT *, list_transform(range(2, len(parts) + 1), lambda i: coalesce(list_sum(list_transform(inner_[i], lambda y: {gain("y")})), 0) + {gain("tails[i + 1]")}) AS bold, {gain("tails[2]")} AS run FROM tails),
first_ AS (SELECT *, CASE WHEN run > 0 THEN 10 + run END AS by_article, list_position(bold, list_max(bold)) AS k FROM ranked),
chosen AS (SELECT *, coalesce(list_max(bold) > by_article, false) AS deep, greatest(by_article, list_max(bold)) AS most FROM first_),
rated AS (SELECT *, tails[CASE WHEN deep THEN k + 1 ELSE 1 END] AS top, most IS NOT NULL AND list_sum(sizes[CASE WHEN deep THEN k + 1 ELSE 1 END:]) >= 250 AS enough FROM chosen),
again AS (SELECT *, CASE WHEN NOT enough THEN (0.5 * run + {gain(told(element("div")))}) * (1 - {LINKED} / greatest({spaceless(BODY)}, 1)) END AS body_rank, CASE WHEN NOT enough THEN 0.5 * {gain(told(element("div")))} * (1 - {LINKED} / greatest({spaceless("b")}, 1)) END AS html_rank FROM rated),
found AS (SELECT *, CASE WHEN enough OR most > greatest(body_rank, html_rank) THEN CASE WHEN deep THEN 'bold' ELSE 'article' END WHEN html_rank > 0 AND html_rank >= body_rank THEN 'html' ELSE 'body' END AS root FROM again),
extracted AS (SELECT *, CASE WHEN root IN ('bold', 'article') THEN top WHEN root = 'html' THEN {told(UNLINKED)} ELSE {told(f"regexp_extract({UNLINKED}, '(?is)<body[^>]*>(.*)$', 1)")} END AS text, {told("b")} AS raw FROM found),
shares AS (SELECT *, length(text) / length(raw) AS x, {words("tails[1]")} AS main_words, {words("text")} AS text_words FROM extracted)"""
NOISE = f"least(CASE WHEN x < {dbl(0.05)} THEN x * {dbl(200)} WHEN x < {dbl(0.15)} THEN {dbl(10)} + (x - {dbl(0.05)}) * {dbl(200)} WHEN x <= {dbl(0.85)} THEN {dbl(30)} + least(x, {dbl(0.7)}) / {dbl(0.7)} * {dbl(10)} ELSE {dbl(35)} END, {dbl(40)})"
PRESERVED = f"least(CASE WHEN {HEADS} = 0 THEN {dbl(5)} WHEN root = 'bold' THEN {dbl(0)} ELSE {dbl(10)} END + CASE WHEN {total((count('ul'), count('ol')))} = 0 THEN {dbl(5)} ELSE {dbl(0)} END + {dbl(5)}, {dbl(30)})"
REGION = f"CASE WHEN {count('article')} = 0 THEN {dbl(3)} WHEN text <> '' AND len(main_words) > 0 THEN len(list_intersect(main_words, text_words)) / CAST(len(main_words) AS DOUBLE) * {dbl(10)} ELSE {dbl(5)} END"
BOUNDARY = f"least(CASE WHEN {TITLE} THEN {dbl(10)} ELSE {dbl(0)} END + CASE WHEN length(text) > 100 THEN 10 WHEN length(text) > 20 THEN 5 ELSE 0 END + {REGION}, {dbl(30)})"
EXT = f"CASE WHEN raw = '' THEN {dbl(0)} ELSE least({NOISE} + {PRESERVED} + {BOUNDARY}, {dbl(100)}) END"
WHOLE_ROWS = f"""{BARE}, {CLASSES}, {EXTRACTED},
whole AS (SELECT page_id, html IS NULL AS failed, CASE WHEN html IS NULL THEN 'article' ELSE {PROFILE} END AS content_type, {", ".join(f"CASE WHEN html IS NOT NULL THEN {c} END AS {p}" for p, c in zip(PILLARS, (SEM, EXT, STR, A11Y, MET, OFFLINE), strict=True))} FROM shares),
weighed AS (SELECT *, {weighted("content_type")} AS parseability_score FROM whole),
scored AS (SELECT *, CASE WHEN failed THEN 'evaluation_error' WHEN {" OR ".join(f"{p} IS NULL" for p in PILLARS)} THEN 'partial_evaluation' WHEN parseability_score >= 90 THEN 'clean' WHEN parseability_score >= 75 THEN 'minor_issues'
  WHEN parseability_score >= 60 THEN 'moderate_issues' WHEN parseability_score >= 40 THEN 'significant_issues' ELSE 'severe_issues' END AS failure_mode FROM weighed)"""

AXE = f"""SELECT url, CAST(greatest(0, 100 - sum(least(CASE impact WHEN 'critical' THEN 25 WHEN 'serious' THEN 15 WHEN 'moderate' THEN 10 ELSE 5 END * least(node_count, 3), 25))) AS DOUBLE) AS axe_score, count(*) AS rules FROM ({inputs.VIOLATIONS}) AS v GROUP BY url"""

CRAWLED_HTTP = f"""least(CASE WHEN status IS NULL THEN {dbl(11)} ELSE {HTTP_PARTS["reachability"]} END + CASE WHEN chain IS NULL THEN {dbl(40)} ELSE {EFFICIENCY} END / {dbl(40)} * {dbl(25)}
  + {HTTP_PARTS["permissions"]} + CASE WHEN header IS NULL THEN {dbl(10)} ELSE {HTTP_PARTS["cache"]} END + {POINTS}, {dbl(100)})"""
CRAWLED_ROWS = f"""{BARE}, {CLASSES}, {RECORDS}, axe AS ({AXE}), met AS (SELECT classified.*, status, chain, redirect_ms, final_ms, header, header_value, axe_score FROM classified
  LEFT JOIN records USING (page_id) LEFT JOIN axe ON classified.url = concat('https://h', substr(axe.url, 2), '.example.com')),
core AS (SELECT page_id, url, concat(substr(md5(url), 1, 12), '.html') AS html_path, render_mode, {PROFILE} AS content_type, {SOURCE} AS content_type_source,
  {SEM} AS semantic_html, {STR} AS structured_data, CASE WHEN render_mode = 'rendered' THEN coalesce(axe_score, {A11Y}) ELSE {A11Y} END AS dom_navigability, {MET} AS metadata_completeness, {CRAWLED_HTTP} AS http_compliance
  FROM met CROSS JOIN (VALUES ('raw'), ('rendered')) AS m(render_mode)),
scored AS (SELECT *, {weighted("content_type", CORE)} AS parseability_score, {weighted("'article'", CORE)} AS universal_score, 'partial_evaluation' AS failure_mode, true AS partial_evaluation FROM core)"""

ROBOT_RULES = f"""lines AS ({inputs.ROBOTS}), bare_lines AS (SELECT host, line_no, trim(regexp_replace(line, '#.*$', '')) AS t FROM lines),
named AS (SELECT host, line_no, lower(trim(split_part(t, ':', 1))) AS name, trim(regexp_replace(t, '^[^:]*:?', '')) AS value FROM bare_lines),
agents AS (SELECT *, last_value(CASE WHEN name = 'user-agent' THEN value END IGNORE NULLS) OVER (PARTITION BY host ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS agent FROM named),
rules AS (SELECT host, line_no, name = 'allow' AS allow, value AS rule FROM agents WHERE agent = '*' AND name IN ('allow', 'disallow') AND value <> ''),
p AS (SELECT page_id, regexp_extract(url, '(example\\.(?:com|net|org))', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
best AS (SELECT p.*, r.allow, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST, r.line_no) AS k FROM p LEFT JOIN rules r ON p.host = r.host AND starts_with(p.path, r.rule))"""

NEG = f"""r AS ({inputs.RESPONSES}), base AS (SELECT url, status_code AS s, content_hash AS h FROM r WHERE accept_header = 'text/html'),
o AS (SELECT r.*, base.s, base.h FROM r JOIN base USING (url) WHERE accept_header <> 'text/html' AND status_code = 200),
a AS (SELECT url, count(*) AS n, count(*) FILTER (content_hash <> h) AS other, bool_or(contains(accept_header, 'markdown')) AS md,
  sum(CASE WHEN contains(accept_header, 'markdown') THEN 10 WHEN contains(accept_header, 'json') THEN 5 WHEN contains(accept_header, 'plain') THEN 3 ELSE 0 END) AS bonus FROM o GROUP BY url)"""

# The charsets that pages are written in, by page_id % 12.
ENCODINGS = _case(("cp1251", "koi8_r", "cp932", "gb18030", "cp949", "cp950", "utf-16-le", "cp1252", "cp1250", "cp1253", "utf-8", "euc_jp"))
ENCODED_PHRASES = _case(tuple(phrase for _, phrase in inputs.PHRASES))
NOT_ASCII = r"'[^\x00-\x7F]'"

S = f"s AS ({inputs.SCORES})"
SUFFIXED = "u AS (SELECT *, concat(url, CAST(pos AS VARCHAR)) AS page FROM s)"
WEIGHT = "CASE pillar " + " ".join(f"WHEN '{p}' THEN {dbl(w)}" for p, w in zip(PILLARS, PROFILE_WEIGHTS["article"], strict=True)) + " END"
CLUSTERS = f"""{S}, {SUFFIXED}, long AS ({" UNION ALL ".join(f"SELECT page, '{p}' AS pillar, round_even({p}, 0) AS score FROM u WHERE {p} IS NOT NULL" for p in PILLARS)}),
clusters AS (SELECT pillar, score, count(*) AS members FROM long WHERE score < 70 GROUP BY pillar, score HAVING count(*) >= 3),
members AS (SELECT pillar, score, page FROM long JOIN clusters USING (pillar, score))"""
HALVES = f"""{S}, {", ".join(f"{n} AS (SELECT url, {', '.join(f'max({c}) AS {c}' for c in (*PILLARS, 'parseability_score', 'content_type'))} FROM s WHERE {w} GROUP BY url)" for n, w in (("old_", "pos % 7 < 3"), ("new_", "pos % 7 >= 3")))}"""
EXPECT = f"e AS (SELECT url, CAST(lo AS DOUBLE) AS expected_min, CAST(hi AS DOUBLE) AS expected_max, category FROM ({inputs.EXPECTED}) AS x)"
VALIDATED = f"""{S}, {EXPECT}, v AS (SELECT s.url, coalesce(category, 'unknown') AS category, expected_min, expected_max, parseability_score AS actual,
  parseability_score BETWEEN expected_min AND expected_max AS in_range, greatest(parseability_score - expected_max, expected_min - parseability_score, {dbl(0)}) AS deviation FROM s JOIN e USING (url))"""
SPREAD = f"""x AS (SELECT url, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS stdev, min(score) AS low, max(score) AS high, count(DISTINCT run) AS runs FROM ({inputs.RUNS}) AS r GROUP BY url HAVING count(DISTINCT run) = 3),
spread AS (SELECT *, high - low AS range, CASE WHEN stdev <= 1 THEN 'high' WHEN stdev <= 3 THEN 'moderate' WHEN stdev <= 5 THEN 'some' ELSE 'low' END AS band, stdev > 5 OR high - low > 10 AS inconsistent FROM x)"""
BANDS = "count(*) AS pages, round_even(avg(parseability_score), 6) AS mean_score"
NORMAL = r"regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '(?s)#.*$', '')"
NORMAL_URL = f"CASE WHEN length({NORMAL}) - length(replace({NORMAL}, '/', '')) > 2 AND ends_with({NORMAL}, '/') THEN regexp_replace({NORMAL}, '/$', '') ELSE {NORMAL} END"


def answer_form(x: str) -> str:
    return rf"""regexp_replace(regexp_replace(lower({trim(x)}), '\s+', ' ', 'g'), '["''`]', '', 'g')"""


GRADES = f"""a AS ({inputs.ANSWERS}), t AS ({inputs.TRUTHS}), f AS (SELECT conv_id, pair_index, run_index, {answer_form("answer")} AS given, {answer_form("truth")} AS wanted FROM a JOIN t USING (conv_id, pair_index)),
g AS (SELECT conv_id, pair_index, run_index, CASE WHEN given = 'not in document' AND wanted <> '' THEN 'not_in_document' WHEN given = wanted OR wanted <> '' AND contains(given, wanted) THEN 'correct' ELSE 'incorrect' END AS label,
  CASE WHEN NOT (given = 'not in document' AND wanted <> '') AND given <> wanted AND wanted <> '' AND contains(given, wanted) THEN 'substring match' END AS grader_notes FROM f)"""

FIXES = ", ".join(f"CASE WHEN failure_mode = '{m}' AND {n} < {below} AND {n} >= {least} THEN {{'o': {-gain}, 'f': '{fix}', 'g': {gain}}} END" for m, n, below, least, _, fix, _, _, gain, _ in RULES)
SUBS = "sub AS (SELECT *, semantic_html AS semantic_structure, metadata_completeness AS heading_hierarchy, content_extractability AS content_density, dom_navigability AS boilerplate_resistance FROM s)"
FINDINGS = f"""WITH {S}, {SUBS}, f AS (SELECT *, list_sort(list_filter([{FIXES}], lambda x: x IS NOT NULL)) AS found FROM sub)
SELECT pos, coalesce(array_to_string(list_transform(found, lambda x: x.f), '; '), '') AS fixes, CAST(coalesce(list_sum(list_transform(found, lambda x: x.g)), 0) AS INTEGER) AS gain,
  CASE WHEN failure_mode = 'structure-missing' AND semantic_structure < 40 OR failure_mode = 'extraction-noisy' THEN 'Frontend Developer' WHEN failure_mode = 'structure-missing' AND heading_hierarchy < 50 THEN 'Content Author/Developer' ELSE 'Development Team' END AS owner,
  array_to_string(list_filter([CASE WHEN failure_mode = 'structure-missing' AND pos % 3 <> 1 THEN 'HTML lacks semantic content containers' END,
    CASE WHEN failure_mode = 'structure-missing' AND pos % 3 = 0 THEN 'No heading structure to indicate content organization' WHEN failure_mode = 'structure-missing' AND pos % 3 = 1 THEN 'Heading levels jump incorrectly (e.g., H1 directly to H3)' END,
    CASE WHEN failure_mode = 'extraction-noisy' AND content_density < 60 THEN 'Primary content not clearly distinguished from secondary content' END,
    CASE WHEN failure_mode = 'extraction-noisy' AND boilerplate_resistance < 60 THEN 'Navigation, sidebar, or footer content overwhelms primary content' END], lambda x: x IS NOT NULL), '; ') AS causes FROM f"""

TITLES = {p: p.replace("_", " ").title() for p in PILLARS}
LOWEST = "least(" + ", ".join(PILLARS) + ")"
ISSUE = "CASE " + " ".join(f"WHEN {p} = {LOWEST} THEN '{t}'" for p, t in TITLES.items()) + " END"


def any_sign(x: str, signs) -> str:
    return "(" + " OR ".join(f"contains({x}, '{s}')" for s in signs) + ")"


ASKED = "VALUES " + ", ".join(f"('{n}', '{k}', [{', '.join(repr(x) for x in w)}])" for n, _, k, w in QUESTIONS)
KIND_SIGNS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {any_sign('t' if k == 'code_example' else 'lower(t)', s)}" for k, s in SIGNS.items()) + " END"
QUALITY = f"""WITH q(name, kind, words) AS ({ASKED}), d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT *, length({trim("t")}) < 50 AS empty, length(t) AS n,
  CAST(CASE WHEN length({trim("t")}) < 50 THEN 0 ELSE len(list_filter(words, lambda w: contains(lower(t), w))) END AS INTEGER) AS matches FROM d CROSS JOIN q),
r AS (SELECT *, CASE WHEN empty THEN {dbl(0)} ELSE CASE WHEN n BETWEEN 100 AND 2000 THEN {dbl(30)} WHEN n > 50 THEN {dbl(15)} ELSE {dbl(0)} END + matches / CAST(len(words) AS DOUBLE) * {dbl(40)}
  + CASE WHEN {KIND_SIGNS} THEN {dbl(20)} ELSE {dbl(0)} END + CASE WHEN {any_sign("t", STRUCTURE)} THEN {dbl(10)} ELSE {dbl(0)} END END AS quality FROM m)
SELECT doc_id, name, matches, round_even(least(quality, {dbl(100)}), 9) AS quality, quality >= 60 AND n >= 100 AS success FROM r"""

ANSWERED = QUALITY.replace("SELECT doc_id, coalesce(text, '') AS t FROM documents", "SELECT doc_id, coalesce(source, '') AS url, coalesce(text, '') AS t FROM documents").replace("SELECT doc_id, name, matches,", "SELECT url, matches / CAST(len(words) AS DOUBLE) AS coverage,")

SITES = "CASE " + " ".join(f"WHEN contains(url, '{f}') THEN '{n}'" for f, n in oracle_values.SITES) + " ELSE split_part(split_part(url, '//', 2), '/', 1) END"
SHORT = "regexp_replace(url, '/+$', '')"

SQL = {
    "parse_signals": PARSE, "text_density_boilerplate": DENSITY, "semantic_html_score": SEMANTIC, "static_accessibility": ACCESS, "metadata_completeness": METADATA,
    "agent_hints": HINT, "structured_data_score": STRUCTURED, "content_type": CONTENT, "http_compliance": HTTP, "redirect_scores": REDIRECTS,
    "page_scores_crawled": f"WITH {CRAWLED_ROWS} SELECT * FROM scored",
    "page_scores_core": f"WITH {CORE_ROWS} SELECT * FROM scored",
    "failure_mode_dist": f"WITH {WHOLE_ROWS} SELECT failure_mode, content_type, count(*) AS pages, round_even(avg(parseability_score), 6) AS mean_score FROM scored GROUP BY ALL",
    "redirect_status_histogram": f"WITH {HOPS}, h AS (SELECT unnest(chain) AS status FROM crawl) SELECT status, count(*) AS hops, status IN (301, 302, 303, 307, 308) AS proper FROM h GROUP BY status",
    "successful_crawl": f"WITH {HOPS} SELECT page_id, status, concat(substr(md5(url), 1, 12), '.html') AS html_path, regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') AS valid_url FROM crawl WHERE status BETWEEN 200 AND 399",
    "charset_detection": f"SELECT page_id, charset, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {ENCODINGS} AS charset, regexp_replace(replace(html, '{inputs.ANCHOR}', ''), {NOT_ASCII}, '', 'g') || {ENCODED_PHRASES} AS t FROM pages)",
    "redirect_walks": f"""WITH RECURSIVE r AS ({inputs.REDIRECTED}), w AS (
            SELECT url AS start, url AS here, CAST([] AS VARCHAR[]) AS hops, '' AS codes, {dbl(0)} AS spent FROM r
            UNION ALL SELECT start, location, list_append(hops, location), CASE WHEN codes = '' THEN '' ELSE codes || ',' END || CAST(status AS VARCHAR), spent + ms FROM w JOIN r ON r.url = w.here
            WHERE status IN (301, 302, 303, 307, 308) AND location IS NOT NULL AND len(hops) < 10 AND len(list_filter(hops, lambda x: x = w.here)) < 2
        ), ended AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY start ORDER BY len(hops) DESC) = 1)
        SELECT start AS url, coalesce(status, 0) AS status, CASE WHEN status IS NULL THEN start ELSE here END AS final_url, CAST(len(hops) AS INTEGER) AS redirect_count, CASE WHEN status IS NULL THEN 0 ELSE spent END AS total_redirect_time_ms, codes
        FROM ended LEFT JOIN r ON r.url = ended.here""",
    "page_findings": f"""WITH {S}, one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY url ORDER BY render_mode = 'rendered' DESC, pos) = 1),
        rules(pillar, fix, owner) AS (VALUES ('semantic_html', 'Use semantic elements', 'Frontend Developer'), ('content_extractability', 'Separate content from chrome', 'Frontend Developer'), ('structured_data', 'Add JSON-LD', 'SEO or Platform Team'),
            ('dom_navigability', 'Name images and links', 'Frontend Developer'), ('metadata_completeness', 'Complete the metadata', 'Content Author'), ('http_compliance', 'Shorten redirects and allow agents', 'Platform Team')),
        weights(content_type, w) AS (VALUES ('article', [0.25, 0.20, 0.20, 0.15, 0.10, 0.10]), ('landing', [0.25, 0.10, 0.30, 0.15, 0.10, 0.10]), ('reference', [0.30, 0.10, 0.20, 0.15, 0.15, 0.10]),
            ('sample', [0.20, 0.25, 0.20, 0.10, 0.15, 0.10]), ('faq', [0.25, 0.15, 0.30, 0.15, 0.05, 0.10]), ('tutorial', [0.25, 0.25, 0.15, 0.15, 0.10, 0.10])),
        long AS (SELECT url, pos, content_type, unnest(['semantic_html', 'content_extractability', 'structured_data', 'dom_navigability', 'metadata_completeness', 'http_compliance']) AS pillar,
            unnest([semantic_html, content_extractability, structured_data, dom_navigability, metadata_completeness, http_compliance]) AS score, unnest(range(1, 7)) AS k FROM one),
        found AS (SELECT url, pillar, fix, owner, score, (70::DOUBLE - score) * CAST(w[k] AS DOUBLE) AS gain FROM long JOIN weights USING (content_type) JOIN rules USING (pillar) WHERE score < 70),
        by_page AS (SELECT url, arg_min(owner, (-gain, pillar)) AS owner, count(*) AS n, sum(gain ORDER BY -gain, pillar) AS gain,
            string_agg(fix || ':' || CASE WHEN gain >= 5 THEN 'High' WHEN gain >= 2 THEN 'Medium' ELSE 'Low' END || ':' || CASE WHEN score < 35 THEN 'critical' ELSE 'important' END, '; ' ORDER BY -gain, pillar) AS found FROM found GROUP BY url)
        SELECT one.url AS page, pos, coalesce(owner, 'Development Team') AS owner, coalesce(found, '') AS found, round_even(coalesce(gain, 0), 6) AS gain, CAST(coalesce(n, 0) AS INTEGER) AS causes, templates
        FROM one LEFT JOIN by_page USING (url) LEFT JOIN (
            SELECT url AS cluster_url, string_agg(DISTINCT pillar, ',' ORDER BY pillar) AS templates FROM (SELECT url, pillar, count(*) OVER (PARTITION BY pillar, round_even(score, 0)) AS shared FROM long WHERE score IS NOT NULL AND round_even(score, 0) < 70) WHERE shared >= 3 GROUP BY url
        ) ON cluster_url = one.url""",
    "robots_permission": f"WITH {ROBOT_RULES} SELECT page_id, host, path, coalesce(NOT allow, false) AS blocked FROM best WHERE k = 1",
    "negotiation_scores": f"""WITH {NEG} SELECT base.url, CASE WHEN s <> 200 THEN {dbl(0)} ELSE least({dbl(50)} + coalesce(12.5 * n + bonus, 0), {dbl(100)}) END AS format_availability_score,
        CASE WHEN coalesce(n, 0) = 0 THEN {dbl(100)} ELSE other / CAST(n AS DOUBLE) * {dbl(100)} END AS content_consistency_score, coalesce(n >= 2 AND other > 0 OR md, false) AS agent_optimization_detected FROM base LEFT JOIN a USING (url)""",
    "axe_penalty": AXE,
    "render_deltas": f"""WITH {S}, p AS (SELECT url AS page, arg_max(parseability_score, pos) FILTER (render_mode = 'raw') AS raw, arg_max(parseability_score, pos) FILTER (render_mode = 'rendered') AS rendered FROM s GROUP BY url)
        SELECT page, raw, rendered, rendered - raw AS delta, abs(rendered - raw) >= 15 AS flagged FROM p WHERE raw IS NOT NULL AND rendered IS NOT NULL""",
    "latest_per_page": f"WITH {S} SELECT url, pos, render_mode, parseability_score FROM s QUALIFY row_number() OVER (PARTITION BY url ORDER BY render_mode = 'rendered' DESC, pos) = 1",
    "template_clusters": f"WITH {CLUSTERS} SELECT pillar, score, members, round_even(({dbl(70)} - score) * {WEIGHT}, 9) AS uplift FROM clusters",
    "cluster_members": f"WITH {CLUSTERS} SELECT pillar, score, page FROM members",
    "cluster_pages": f"WITH {CLUSTERS} SELECT page, array_to_string(list_sort(list(DISTINCT pillar)), ',') AS template_pillars FROM members GROUP BY page",
    "page_deltas": f"""WITH {S}, p AS (SELECT url AS page, arg_max(parseability_score, pos) FILTER (render_mode = 'raw') AS raw, arg_max(parseability_score, pos) FILTER (render_mode = 'rendered') AS rendered FROM s GROUP BY url),
        one AS (SELECT url AS page, pos, parseability_score FROM s QUALIFY row_number() OVER (PARTITION BY url ORDER BY render_mode = 'rendered' DESC, pos) = 1)
        SELECT page, pos, parseability_score, rendered - raw AS render_delta, abs(rendered - raw) >= 15 AS flagged FROM one JOIN p USING (page)""",
    "page_summary": f"""WITH {S}, c AS ({inputs.RECORD_URLS}) SELECT coalesce(CASE WHEN pos % 2 = 0 THEN s.url END, c.url, 'Unknown URL') AS url, concat('p', pos, '.html') AS html_path, parseability_score, failure_mode,
        CASE WHEN failure_mode = 'partial_evaluation' THEN 'PARTIAL' WHEN failure_mode = 'clean' THEN 'PASS' WHEN parseability_score >= 60 THEN 'WARN' ELSE 'FAIL' END AS tag FROM s LEFT JOIN c ON c.html_path = concat('p', pos, '.html')""",
    "presentation_summary": f"""WITH {S} SELECT {BANDS}, count(*) FILTER (parseability_score >= 80) AS ready, count(*) FILTER (parseability_score >= 60 AND parseability_score < 80) AS needs_work,
        count(*) FILTER (parseability_score < 60) AS major_issues, round_even(count(*) FILTER (parseability_score >= 80) * {dbl(100)} / count(*), 6) AS ready_percent FROM s""",
    "violation_audit": f"""WITH v AS (SELECT *, least(CASE impact WHEN 'critical' THEN 25 WHEN 'serious' THEN 15 WHEN 'moderate' THEN 10 ELSE 5 END * least(node_count, 3), 25) AS penalty FROM ({inputs.VIOLATIONS}) AS x),
        r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY penalty DESC, rule_id, node_count, impact) AS rank, count(*) OVER (PARTITION BY url) AS n FROM v)
        SELECT url, string_agg(rule_id || ':' || impact || ':' || node_count, '; ' ORDER BY rank) AS violations, max(greatest(n - 10, 0)) AS more FROM r WHERE rank <= 10 GROUP BY url""",
    "hop_audit": f"""WITH c AS (SELECT page_id, CASE WHEN codes = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(codes, ',') END AS chain FROM ({inputs.CRAWL}) AS x)
        SELECT page_id, CASE WHEN len(chain) > 0 THEN 'redirects: ' || array_to_string(chain[1:3], ' -> ') || CASE WHEN len(chain) > 3 THEN ' and ' || (len(chain) - 3) || ' more' ELSE '' END END AS hops FROM c""",
    "axe_runs": f"""WITH r AS ({inputs.AXE_RUNS}), a AS ({AXE}) SELECT r.url, outcome, CASE outcome WHEN 'injection_failed' THEN {dbl(75)} WHEN 'failed' THEN {dbl(70)} ELSE coalesce(axe_score, {dbl(100)}) END AS axe_score FROM r LEFT JOIN a USING (url)""",
    "profile_impact": f"WITH {S} SELECT url AS page, content_type, parseability_score, universal_score, parseability_score - universal_score AS delta FROM s WHERE universal_score IS NOT NULL AND (SELECT bool_or(content_type <> 'article') FROM s)",
    "weighted_scores": f"WITH {S} SELECT pos, round_even({weighted('content_type')}, 9) AS profile_score, round_even({weighted(repr('article'))}, 9) AS article_score FROM s",
    "score_history": f"""WITH h AS ({inputs.HISTORY}) SELECT pos, {NORMAL_URL} AS url, parseability_score,
        parseability_score - last_value(parseability_score IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY evaluated_at, score_file, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS delta FROM h""",
    "benchmark_validation": f"WITH {VALIDATED} SELECT * FROM v",
    "validation_rates": f"""WITH {VALIDATED}, r AS (SELECT category, count(*) AS pages, count(*) FILTER (in_range) AS passed, avg(CAST(in_range AS DOUBLE)) AS rate, max(deviation) AS worst FROM v GROUP BY ROLLUP (category))
        SELECT coalesce(category, 'all') AS category, pages, passed, rate, worst, rate >= 0.7 AND worst <= 20 AS gate FROM r""",
    "run_consistency": f"WITH {SPREAD} SELECT url, round_even(mean, 6) AS mean, round_even(stdev, 6) AS stdev, low, high, runs, range, band, inconsistent FROM spread",
    "consistency_verdict": f"""WITH {SPREAD} SELECT count(*) AS urls, round_even(avg(stdev), 6) AS mean_stdev, round_even(max(stdev), 6) AS worst_stdev, {", ".join(f"count(*) FILTER (band = '{b}') AS {b}" for b in ("high", "moderate", "some", "low"))},
        count(*) FILTER (inconsistent) AS inconsistent, CASE WHEN max(stdev) > 10 THEN 'FAIL' WHEN max(stdev) > 5 THEN 'WARN' ELSE 'PASS' END AS verdict FROM spread""",
    "compare_runs": f"WITH {HALVES}, o AS (SELECT url, nullif(parseability_score, 0) AS old FROM old_), n AS (SELECT url, nullif(parseability_score, 0) AS new FROM new_) SELECT url, old, new, new - old AS delta FROM o FULL JOIN n USING (url)",
    "compare_pillars": f"""WITH {HALVES}, {", ".join(f"{n}l AS ({' UNION ALL '.join(f'SELECT {p!r} AS pillar, avg({p}) AS m FROM {n}_' for p in PILLARS)})" for n in ("old", "new"))}
        SELECT pillar, round_even(oldl.m, 6) AS old, round_even(newl.m, 6) AS new, round_even(newl.m - oldl.m, 6) AS delta FROM oldl FULL JOIN newl USING (pillar)""",
    "metadata_delta_stats": f"""WITH {HALVES}, x AS (SELECT new_.metadata_completeness - old_.metadata_completeness AS delta FROM old_ JOIN new_ USING (url))
        SELECT count(*) AS pages, round_even(avg(delta), 6) AS mean, median(delta) AS median, min(delta) AS low, max(delta) AS high, count(*) FILTER (delta <> 0) AS changed FROM x""",
    "golden_drift": f"""WITH {HALVES} SELECT url, old_.content_type AS content_type_golden, new_.content_type AS content_type_fresh,
        CASE WHEN old_.url IS NULL THEN 'added' WHEN new_.url IS NULL THEN 'missing' ELSE 'changed' END AS drift FROM old_ FULL JOIN new_ USING (url) WHERE old_.content_type IS DISTINCT FROM new_.content_type""",
    "run_summary": f"WITH {S} SELECT {BANDS}, count(*) FILTER (failure_mode IN ('clean', 'success')) AS clean, round_even(count(*) FILTER (failure_mode IN ('clean', 'success')) * {dbl(100)} / count(*), 6) AS clean_percent FROM s",
    "report_summary": f"WITH {S} SELECT {BANDS}, {', '.join(f'count(*) FILTER (failure_mode = {m!r}) AS {n}' for m, n in (('clean', 'clean'), ('structure-missing', 'structure_missing'), ('extraction-noisy', 'extraction_noisy')))} FROM s",
    "bulk_distribution": f"""WITH {S} SELECT content_type, {BANDS}, min(parseability_score) AS low, max(parseability_score) AS high, count(*) FILTER (parseability_score >= 80) AS ready, count(*) FILTER (parseability_score >= 60 AND parseability_score < 80) AS needs_work,
        count(*) FILTER (parseability_score < 60) AS major_issues, avg(parseability_score) >= 70 AND count(*) FILTER (parseability_score >= 60) * 100.0 / count(*) >= 80 AS gate FROM s GROUP BY content_type""",
    "mode_rollup": f"WITH {S} SELECT content_type, failure_mode, {BANDS} FROM s GROUP BY ROLLUP (content_type, failure_mode)",
    "primary_issue": f"""WITH {S} SELECT pos, {ISSUE} AS issue, CASE WHEN parseability_score >= 80 THEN '{oracle_values.READY}' WHEN parseability_score >= 60 THEN '{oracle_values.NEEDS_WORK}' ELSE '{oracle_values.MAJOR}' END AS status,
        CASE failure_mode WHEN 'structure-missing' THEN 'Add semantic HTML (<main>, <article>), fix heading hierarchy' WHEN 'extraction-noisy' THEN 'Reduce boilerplate, improve content/chrome separation' ELSE 'Review structure and optimize content organization' END AS hint,
        CASE WHEN failure_mode = 'partial_evaluation' THEN 'PARTIAL' WHEN failure_mode = 'clean' THEN 'PASS' WHEN parseability_score >= 60 THEN 'WARN' ELSE 'FAIL' END AS tag FROM s""",
    "worst_best_examples": f"""WITH {S}, lo AS (SELECT url AS page, parseability_score, 'worst' AS end FROM s ORDER BY parseability_score, pos LIMIT 2), hi AS (SELECT url AS page, parseability_score, 'best' AS end FROM s ORDER BY parseability_score DESC, pos DESC LIMIT 3)
        SELECT page, parseability_score, "end" FROM lo UNION ALL SELECT page, parseability_score, "end" FROM hi""".replace("AS end", 'AS "end"'),
    "display_order": f"WITH {S} SELECT pos, parseability_score, CAST(row_number() OVER (ORDER BY parseability_score, pos) AS INTEGER) AS shown_as FROM s",
    "report_findings": FINDINGS,
    "qa_grading": f"WITH {GRADES} SELECT * FROM g",
    "page_accuracy": f"WITH {GRADES} SELECT conv_id, count(*) AS answers, round_even(avg(CAST(label = 'correct' AS DOUBLE)), 9) AS accuracy FROM g GROUP BY conv_id",
    "spearman_by_pillar": f"""WITH st AS ({inputs.STUDY}), r AS (SELECT pillar, rank() OVER (PARTITION BY pillar ORDER BY score) + (count(*) OVER (PARTITION BY pillar, score) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY pillar ORDER BY accuracy) + (count(*) OVER (PARTITION BY pillar, accuracy) - 1) / 2.0 AS ry FROM st)
        SELECT pillar, count(*) AS n, round_even(coalesce(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 0), 9) AS rho FROM r GROUP BY pillar""",
    "grader_kappa": f"""WITH l AS (SELECT CAST(doc_id % 3 AS VARCHAR) AS a, CAST((doc_id + n_chars % 2) % 3 AS VARCHAR) AS b FROM documents), n AS (SELECT count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po FROM l),
        pa AS (SELECT a AS k, count(*) AS c FROM l GROUP BY a), pb AS (SELECT b AS k, count(*) AS c FROM l GROUP BY b), e AS (SELECT sum(CAST(pa.c AS DOUBLE) * pb.c) AS s FROM pa JOIN pb USING (k))
        SELECT n, round_even(po, 9) AS observed, round_even(s / (CAST(n AS DOUBLE) * n), 9) AS expected, round_even((po - s / (CAST(n AS DOUBLE) * n)) / (1 - s / (CAST(n AS DOUBLE) * n)), 9) AS kappa FROM n, e""",
    "answer_quality": QUALITY,
    "answer_ranking": f"""WITH a AS ({ANSWERED}), r AS (SELECT url, avg(quality) AS quality, avg(CAST(success AS DOUBLE)) AS success_rate, avg(coverage) AS coverage FROM a GROUP BY url)
        SELECT url, row_number() OVER (ORDER BY round_even(quality, 9) DESC, url) AS rank, round_even(quality, 6) AS quality, round_even(success_rate, 6) AS success_rate, round_even(coverage, 6) AS coverage FROM r""",
    "url_functions": f"SELECT page_id, {NORMAL_URL} AS normal, array_to_string(list_slice(string_split({SHORT}, '/'), greatest(len(string_split({SHORT}, '/')) - 1, 1), len(string_split({SHORT}, '/'))), '/') AS short, {SITES} AS site, concat(substr(md5(url), 1, 12), '.html') AS snapshot FROM pages",
    "distinct_urls": f"""WITH {HALVES} SELECT url, 'union' AS set FROM (SELECT url FROM old_ UNION SELECT url FROM new_) UNION ALL SELECT url, 'both' FROM (SELECT url FROM old_ INTERSECT SELECT url FROM new_)
        UNION ALL SELECT url, 'only_old' FROM (SELECT url FROM old_ EXCEPT SELECT url FROM new_)""".replace("AS set", 'AS "set"'),
    "url_batches": "WITH n AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS k FROM pages) SELECT CAST(floor(k / 50) AS BIGINT) AS batch, count(*) AS urls, min(page_id) AS first, max(page_id) AS last FROM n GROUP BY 1",
}
