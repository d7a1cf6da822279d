"""Findings, owners and ranked fixes of a page, as a rule table joined by failure mode.

A subscore that is missing counts as 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.constants import PILLARS, PROFILE_WEIGHTS

# Fixed values: (mode, subscore, below, at least, issue, fix, impact, effort, gain, priority).
RULES = (
    ("structure-missing", "semantic_structure", 60, 0, "Missing semantic HTML elements (<main>, <article>)", "Add `<main>` element", "High", "Low", 15, "critical"),
    ("structure-missing", "semantic_structure", 60, 0, None, "Add `<article>` wrapper", "Medium", "Low", 10, "important"),
    ("structure-missing", "heading_hierarchy", 50, 0, "Invalid or missing heading hierarchy", "Fix heading hierarchy", "High", "Medium", 12, "critical"),
    ("structure-missing", "heading_hierarchy", 80, 50, "Invalid or missing heading hierarchy", "Fix heading hierarchy", "Medium", "Medium", 8, "important"),
    ("extraction-noisy", "content_density", 60, 0, "Low content density - too much non-primary content", "Improve content density", "High", "Medium", 18, "critical"),
    ("extraction-noisy", "boilerplate_resistance", 60, 0, "High boilerplate contamination from navigation/sidebar elements", "Reduce boilerplate", "High", "High", 15, "planned"),
)

# An example of each fix.
EXAMPLES = {
    "Add `<main>` element": "<body>\n  <nav>...</nav>\n  <main>the page's own content</main>\n</body>",
    "Add `<article>` wrapper": "<main>\n  <article>one self-contained text</article>\n</main>",
    "Fix heading hierarchy": "<h1>Title</h1>\n<h2>Section</h2>\n<h3>Part of the section</h3>",
    "Improve content density": "<main>most of the page's text</main>\n<aside>little else</aside>",
    "Reduce boilerplate": "<footer>a few links</footer>",
}
ADVICE = {
    "structure-missing": "give pages a <main> or <article> and headings that go down one level at a time",
    "extraction-noisy": "move navigation and other chrome out of the content and shorten it",
}


def _sub(scores: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(scores, F.lit(name)), F.lit(0.0))


def findings(mode: Column, subscores: Column) -> Column:
    """array<struct(issue, fix, impact, effort, gain, priority)> of the rules that fire, largest gain first."""

    def fired(rule: tuple) -> Column:
        kind, name, below, least, issue, fix, impact, effort, gain, priority = rule
        row = F.struct(F.lit(-gain).alias("order"), F.lit(issue).cast("string").alias("issue"), F.lit(fix).alias("fix"), F.lit(impact).alias("impact"), F.lit(effort).alias("effort"), F.lit(gain).alias("gain"), F.lit(priority).alias("priority"))
        return F.when((mode == kind) & (_sub(subscores, name) < below) & (_sub(subscores, name) >= least), row)

    return F.array_sort(F.filter(F.array(*map(fired, RULES)), lambda x: x.isNotNull()))


def fix_owner(mode: Column, subscores: Column) -> Column:
    semantic, hierarchy = _sub(subscores, "semantic_structure") < 40, _sub(subscores, "heading_hierarchy") < 50
    structure = F.when(semantic, "Frontend Developer").when(hierarchy, "Content Author/Developer")
    return F.coalesce(F.when(mode == "structure-missing", structure).when(mode == "extraction-noisy", "Frontend Developer"), F.lit("Development Team"))


def root_causes(mode: Column, subscores: Column, evidence: Column) -> Column:
    """array<string> of causes; evidence is an array of strings."""
    seen = lambda word: F.exists(evidence, lambda e: F.contains(e, F.lit(word)))
    missing, noisy = mode == "structure-missing", mode == "extraction-noisy"
    causes = (
        F.when(missing & ~seen("main") & ~seen("article"), "HTML lacks semantic content containers"),
        F.when(missing & seen("No headings found"), "No heading structure to indicate content organization").when(missing & seen("hierarchy violations"), "Heading levels jump incorrectly (e.g., H1 directly to H3)"),
        F.when(noisy & (_sub(subscores, "content_density") < 60), "Primary content not clearly distinguished from secondary content"),
        F.when(noisy & (_sub(subscores, "boilerplate_resistance") < 60), "Navigation, sidebar, or footer content overwhelms primary content"),
    )
    return F.filter(F.array(*causes), lambda x: x.isNotNull())


# What a weak pillar means, for the modes and pillars that the scorer gives:
# (pillar, issue, cause, fix, owner, effort, advice, example).
PILLAR_RULES = (
    ("semantic_html", "few semantic elements carry the content", "HTML lacks semantic content containers", "Use semantic elements", "Frontend Developer", "Low", "wrap content in <main>, <article>, <section> and <nav>", "<body>\n  <nav>...</nav>\n  <main><article>the page's own content</article></main>\n</body>"),
    ("content_extractability", "the main text is hard to separate from the rest", "Primary content not clearly distinguished from secondary content", "Separate content from chrome", "Frontend Developer", "Medium", "shorten navigation and footers and keep the text in one container", "<main>most of the page's text</main>\n<aside>little else</aside>"),
    ("structured_data", "structured data is missing, incomplete or doesn't parse", "No complete JSON-LD record of a known type", "Add JSON-LD", "SEO or Platform Team", "Low", "describe the page by a JSON-LD record with its required fields", '<script type="application/ld+json">{"@context": "https://schema.org", "@type": "Article", "headline": "Title"}</script>'),
    ("dom_navigability", "elements lack names, alternatives or a first heading", "Images, links or headings without text for assistive readers", "Name images and links", "Frontend Developer", "Medium", "give images alternatives, links telling texts and the page one <h1>", '<h1>Title</h1>\n<img src="a.png" alt="what it shows">\n<a href="/guide">Installation guide</a>'),
    ("metadata_completeness", "titles, descriptions, authors or dates are missing", "Head lacks the fields that describe the page", "Complete the metadata", "Content Author", "Low", "fill title, description, author, date, language and canonical url", '<html lang="en">\n<title>Title</title>\n<meta name="description" content="one sentence">'),
    ("http_compliance", "requests are redirected, refused or not cacheable", "Redirects, robots rules or cache headers stand between agents and the page", "Shorten redirects and allow agents", "Platform Team", "High", "answer directly, allow agents in robots.txt and send cache headers", "User-agent: *\nAllow: /"),
)

#: A pillar below is a finding; below half of it it is critical.
WEAK = 70.0


def pillar_findings(scores: dict[str, Column], profile: Column, weak: float = WEAK) -> Column:
    """array<struct(pillar, issue, fix, impact, effort, gain, priority, example, owner, cause, advice)>, largest gain first.

    A pillar that was evaluated and is below ``weak`` is a finding; its gain is what ``weak`` would add to the page's score.
    """

    def weight(pillar: str) -> Column:
        at = PILLARS.index(pillar)
        return reduce(lambda e, kv: F.when(profile == kv[0], kv[1][at]).otherwise(e), PROFILE_WEIGHTS.items(), F.lit(PROFILE_WEIGHTS["article"][at]))

    def fired(rule: tuple) -> Column:
        pillar, issue, cause, fix, owner, effort, advice, example = rule
        gain = (F.lit(weak) - scores[pillar]) * weight(pillar)
        low = scores[pillar] < weak / 2
        row = F.struct(
            (-gain).alias("order"), F.lit(pillar).alias("pillar"), F.lit(issue).alias("issue"), F.lit(fix).alias("fix"), F.when(gain >= 5, "High").when(gain >= 2, "Medium").otherwise("Low").alias("impact"), F.lit(effort).alias("effort"),
            gain.alias("gain"), F.when(low, "critical").otherwise("important").alias("priority"), F.lit(example).alias("example"), F.lit(owner).alias("owner"), F.lit(cause).alias("cause"), F.lit(advice).alias("advice"),
        )
        return F.when(scores[pillar] < weak, row)

    return F.array_sort(F.array_compact(F.array(*map(fired, PILLAR_RULES))))


def page_owner(findings: Column) -> Column:
    """Who owns the finding with the largest gain."""
    return F.coalesce(F.get(findings, 0)["owner"], F.lit("Development Team"))


def pillar_causes(findings: Column, evidence: Column) -> Column:
    """Causes of the findings, and what the evidence says of headings."""
    seen = lambda word: F.exists(evidence, lambda e: F.contains(e, F.lit(word)))
    headings = F.when(seen("No headings found"), "No heading structure to indicate content organization").when(seen("hierarchy violations"), "Heading levels jump incorrectly (e.g., H1 directly to H3)")
    return F.array_compact(F.concat(F.transform(findings, lambda x: x["cause"]), F.array(headings)))
