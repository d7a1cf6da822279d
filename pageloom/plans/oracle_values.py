"""Fixed values of the SQL, written out on their own: a wrong value in the library doesn't make its queries agree."""

from __future__ import annotations

# Pillars in order, weights of each profile, signals of a page's profile.
PILLARS = ("semantic_html", "content_extractability", "structured_data", "dom_navigability", "metadata_completeness", "http_compliance")
PROFILE_WEIGHTS = {
    "article": (0.25, 0.20, 0.20, 0.15, 0.10, 0.10), "landing": (0.25, 0.10, 0.30, 0.15, 0.10, 0.10), "reference": (0.30, 0.10, 0.20, 0.15, 0.15, 0.10),
    "sample": (0.20, 0.25, 0.20, 0.10, 0.15, 0.10), "faq": (0.25, 0.15, 0.30, 0.15, 0.05, 0.10), "tutorial": (0.25, 0.25, 0.15, 0.15, 0.10, 0.10),
}
MS_TOPIC_PROFILES = {
    "overview": "landing", "landing-page": "landing", "hub-page": "landing", "reference": "reference", "api-reference": "reference", "rest-api": "reference", "language-reference": "reference",
    "sample": "sample", "samples": "sample", "faq": "faq", "tutorial": "tutorial", "quickstart": "tutorial", "how-to": "tutorial", "how-to-guide": "tutorial",
}
SCHEMA_PROFILES = {
    "faqpage": "faq", "howto": "tutorial", "softwaresourcecode": "sample", "collectionpage": "landing", "webpage": "landing",
    "apireference": "reference", "techarticle": "article", "article": "article", "newsarticle": "article", "blogposting": "article",
}
URL_PROFILES = (
    ("/api/", "reference"), ("/reference/", "reference"), ("/samples/", "sample"), ("/sample/", "sample"), ("/faq", "faq"),
    ("/tutorial", "tutorial"), ("/quickstart", "tutorial"), ("/how-to", "tutorial"), ("/overview", "landing"), ("/landing", "landing"),
)

# Points of structured data by the number of formats, semantic elements.
FORMAT_POINTS = (0, 5, 12, 17, 20)
SEMANTIC_ELEMENTS = ("header", "nav", "main", "article", "section", "aside", "footer", "figure", "figcaption", "time", "mark")

# Site names, labels of bands.
SITES = (
    ("microsoft.com", "Microsoft Learn"), ("aws.amazon.com", "AWS Docs"), ("cloud.google.com", "Google Cloud"), ("wikipedia.org", "Wikipedia"),
    ("github.com", "GitHub Docs"), ("stackoverflow.com", "Stack Overflow"), ("developers.google.com", "Google Developers"),
)
READY, NEEDS_WORK, MAJOR = "✅ Agent-Ready", "⚠️ Needs Work", "❌ Major Issues"

# Questions of the agent test (name, question, kind, words) and signs of an answer.
QUESTIONS = (
    ("getting_started", "What are the main steps to get started?", "steps", ("install", "setup", "configure", "first", "step", "start")),
    ("prerequisites", "What are the prerequisites and requirements?", "prerequisites", ("require", "need", "install", "version", "dependency", "prerequisite")),
    ("code_example", "Provide a code example or sample usage", "code_example", ("example", "code", "sample", "function", "import", "class")),
    ("troubleshooting", "What are common troubleshooting issues and solutions?", "troubleshooting", ("error", "problem", "issue", "solution", "fix", "debug")),
)
SIGNS = {"steps": ("step", "1.", "first", "then"), "code_example": ("```", "code", "function", "class"), "prerequisites": ("need", "install", "require", "version"), "troubleshooting": ("error", "problem", "solution", "fix")}
STRUCTURE = ("##", "-", "1.", "2.")

# Report rules (mode, subscore, below, at least, issue, fix, impact, effort, gain, priority).
RULES = (
    ("structure-missing", "semantic_structure", 60, 0, "Missing semantic HTML elements (<main>, <article>)", "Add `<main>` element", "High", "Low", 15, "critical"),
    ("structure-missing", "semantic_structure", 60, 0, None, "Add `<article>` wrapper", "Medium", "Low", 10, "important"),
    ("structure-missing", "heading_hierarchy", 50, 0, "Invalid or missing heading hierarchy", "Fix heading hierarchy", "High", "Medium", 12, "critical"),
    ("structure-missing", "heading_hierarchy", 80, 50, "Invalid or missing heading hierarchy", "Fix heading hierarchy", "Medium", "Medium", 8, "important"),
    ("extraction-noisy", "content_density", 60, 0, "Low content density - too much non-primary content", "Improve content density", "High", "Medium", 18, "critical"),
    ("extraction-noisy", "boilerplate_resistance", 60, 0, "High boilerplate contamination from navigation/sidebar elements", "Reduce boilerplate", "High", "High", 15, "planned"),
)
