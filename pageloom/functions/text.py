"""String, URL and label functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_ENDS = r"^\s+|\s+$"

# URL fragments and site names, first match wins; labels of score bands.
SITES = (
    ("microsoft.com", "Microsoft Learn"), ("aws.amazon.com", "AWS Docs"), ("cloud.google.com", "Google Cloud"), ("wikipedia.org", "Wikipedia"),
    ("github.com", "GitHub Docs"), ("stackoverflow.com", "Stack Overflow"), ("developers.google.com", "Google Developers"),
)
READY, NEEDS_WORK, MAJOR = "✅ Agent-Ready", "⚠️ Needs Work", "❌ Major Issues"


def strip(text: Column) -> Column:
    """Without white space at the ends, not only blanks."""
    return F.regexp_replace(text, SPACE_ENDS, "")


def answer_form(text: Column) -> Column:
    """Stripped, lower-cased, white space collapsed, quotes and backticks gone."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text)), r"\s+", " "), "[\"'`]", "")


def normal_url(url: Column) -> Column:
    """Stripped, without fragment, and without one trailing slash if more than two slashes are left."""
    bare = F.regexp_replace(strip(url), "(?s)#.*$", "")
    slashes = F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit("")))
    return F.when((slashes > 2) & bare.endswith("/"), F.regexp_replace(bare, "/$", "")).otherwise(bare)


def short_url(url: Column) -> Column:
    """The last two parts of the path."""
    parts = F.split(F.regexp_replace(url, "/+$", ""), "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")


def site_name(url: Column, sites=SITES) -> Column:
    host = F.split_part(F.split_part(url, F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return reduce(lambda e, s: F.when(url.contains(s[0]), s[1]).otherwise(e), reversed(sites), host)


def snapshot_name(url: Column) -> Column:
    return F.concat(F.substring(F.md5(url.cast("binary")), 1, 12), F.lit(".html"))


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def status_label(score: Column) -> Column:
    return F.when(score >= 80, READY).when(score >= 60, NEEDS_WORK).otherwise(MAJOR)


def outcome_tag(score: Column, mode: Column) -> Column:
    """What the command line prints before a page."""
    return F.when(mode == "partial_evaluation", "PARTIAL").when(mode == "clean", "PASS").when(score >= 60, "WARN").otherwise("FAIL")
