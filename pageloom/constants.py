"""Fixed values that decide results."""

from __future__ import annotations

# Pillars in summation order, and the weights of each profile.
PILLARS = ("semantic_html", "content_extractability", "structured_data", "dom_navigability", "metadata_completeness", "http_compliance")
PROFILE_WEIGHTS = {
    "article": (0.25, 0.20, 0.20, 0.15, 0.10, 0.10),
    "landing": (0.25, 0.10, 0.30, 0.15, 0.10, 0.10),
    "reference": (0.30, 0.10, 0.20, 0.15, 0.15, 0.10),
    "sample": (0.20, 0.25, 0.20, 0.10, 0.15, 0.10),
    "faq": (0.25, 0.15, 0.30, 0.15, 0.05, 0.10),
    "tutorial": (0.25, 0.25, 0.15, 0.15, 0.10, 0.10),
}

# Signals of the page's profile.
MS_TOPIC_PROFILES = {
    "overview": "landing", "landing-page": "landing", "hub-page": "landing",
    "reference": "reference", "api-reference": "reference", "rest-api": "reference", "language-reference": "reference",
    "sample": "sample", "samples": "sample", "faq": "faq",
    "tutorial": "tutorial", "quickstart": "tutorial", "how-to": "tutorial", "how-to-guide": "tutorial",
}
SCHEMA_PROFILES = {
    "faqpage": "faq", "howto": "tutorial", "softwaresourcecode": "sample", "collectionpage": "landing", "webpage": "landing",
    "apireference": "reference", "techarticle": "article", "article": "article", "newsarticle": "article", "blogposting": "article",
}
URL_PROFILES = (
    ("/api/", "reference"), ("/reference/", "reference"), ("/samples/", "sample"), ("/sample/", "sample"), ("/faq", "faq"),
    ("/tutorial", "tutorial"), ("/quickstart", "tutorial"), ("/how-to", "tutorial"), ("/overview", "landing"), ("/landing", "landing"),
)

# Structured data.
FIELD_EXPECTATIONS = {
    "Article": (("headline", "datePublished"), ("author", "dateModified", "description", "publisher")),
    "FAQPage": (("mainEntity",), ()),
    "HowTo": (("name", "step"), ("description", "totalTime")),
    "BreadcrumbList": (("itemListElement",), ()),
}
KNOWN_TYPES = (
    "Article", "TechArticle", "HowTo", "WebPage", "WebSite", "FAQPage", "APIReference", "SoftwareApplication", "Organization",
    "Person", "Product", "BreadcrumbList", "ItemList", "CollectionPage", "AboutPage", "ContactPage", "CreativeWork",
    "DigitalDocument", "Report", "ScholarlyArticle", "BlogPosting", "NewsArticle", "Course", "Event", "Review",
)
REQUIRED_FIELDS = {
    "Article": ("headline", "author", "datePublished"), "TechArticle": ("headline", "author", "datePublished"),
    "WebPage": ("name", "description"), "WebSite": ("name", "url"), "Organization": ("name", "url"),
    "BreadcrumbList": ("itemListElement",), "FAQPage": ("mainEntity",), "HowTo": ("name", "step"), "Product": ("name", "description"),
}
GENERIC_FIELDS = ("name", "description", "dateModified", "author", "publisher", "headline", "datePublished", "image", "url")
FORMAT_POINTS = (0, 5, 12, 17, 20)

# Semantic elements, link texts that say nothing, axe severities.
SEMANTIC_ELEMENTS = ("header", "nav", "main", "article", "section", "aside", "footer", "figure", "figcaption", "time", "mark")
VAGUE_LINKS = ("click here", "read more", "more")
AXE_SEVERITY = {"critical": 25, "serious": 15, "moderate": 10, "minor": 5}

# Bands and thresholds.
FAILURE_BANDS = ((90.0, "clean"), (75.0, "minor_issues"), (60.0, "moderate_issues"), (40.0, "significant_issues"))
CLUSTER_MIN, UPLIFT_TARGET, WEAK_BELOW, RENDER_FLAG = 3, 70.0, 70.0, 15.0
RENDER_MODES = ("raw", "rendered")
NEGOTIATED = ("text/html", "text/markdown", "text/plain", "application/json", "application/xml")
METHODOLOGY = "six pillar page access evaluation"

# The score of an accessibility run that failed, by where; the url of rows without a crawl record.
AXE_FALLBACK = {"injection_failed": 75.0, "failed": 70.0}
UNKNOWN_URL = "Unknown URL"
