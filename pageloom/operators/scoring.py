"""Profiles, weighted scores and failure modes."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.constants import FAILURE_BANDS, MS_TOPIC_PROFILES, PILLARS, PROFILE_WEIGHTS, SCHEMA_PROFILES, URL_PROFILES
from pageloom.operators.pillars import d, f


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), F.coalesce(key, F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def valid_url(url: Column) -> Column:
    """Scheme and host both present."""
    part = lambda p: F.coalesce(F.try_parse_url(url, F.lit(p)), F.lit("")) != ""
    return part("PROTOCOL") & part("HOST")


def url_fragment(url: Column) -> Column:
    """The first fragment, in order, that the lower-cased path holds."""
    path = F.lower(url_path(url))
    return reduce(lambda e, x: F.when(path.contains(x[0]), F.lit(x[0])).otherwise(e), reversed(URL_PROFILES), F.lit(None).cast("string"))


def dom_profile() -> Column:
    code = f("body_code_chars") / (f("body_code_chars") + f("body_p_chars")).cast("double")
    shape = F.when((f("body_h123_count") >= 6) & (f("body_p_chars") < 600), "landing").when((f("body_code_chars") > 0) & (f("body_p_chars") > 0) & (code > 0.6), "sample")
    return F.when(f("body_text"), shape)


def classify(url: Column) -> Column:
    """struct(profile, source, matched_value): ms.topic, then JSON-LD type, URL path, DOM shape, default."""
    topic, kind, fragment, shape = _lookup(MS_TOPIC_PROFILES, f("ms_topic")), _lookup(SCHEMA_PROFILES, F.lower(f("schema_type"))), url_fragment(url), dom_profile()
    said = lambda profile, source, value: F.struct(profile.alias("profile"), F.lit(source).alias("source"), value.alias("matched_value"))
    return (
        F.when(topic.isNotNull(), said(topic, "ms_topic", f("ms_topic")))
        .when(kind.isNotNull(), said(kind, "schema_type", f("schema_type")))
        .when(fragment.isNotNull(), said(_lookup(dict(URL_PROFILES), fragment), "url", fragment))
        .when(shape.isNotNull(), said(shape, "dom", shape))
        .otherwise(said(F.lit("article"), "default", F.lit(None).cast("string")))
    )


def weighted_score(profile: Column | str, scores: dict[str, Column] | None = None) -> Column:
    """Weighted mean over the pillars that could be evaluated; 0 without any."""
    scores = scores or {p: F.col(p) for p in PILLARS}

    def of(name: str) -> Column:
        weights = dict(zip(PILLARS, PROFILE_WEIGHTS[name], strict=True))
        held = reduce(lambda a, b: a + b, (F.coalesce(scores[p] * d(weights[p]), d(0)) for p in PILLARS))
        over = reduce(lambda a, b: a + b, (F.when(scores[p].isNotNull(), d(weights[p])).otherwise(d(0)) for p in PILLARS))
        return F.coalesce(F.try_divide(held, over), d(0))

    if isinstance(profile, str):
        return of(profile)
    return reduce(lambda e, name: F.when(profile == name, of(name)).otherwise(e), [n for n in PROFILE_WEIGHTS if n != "article"], of("article"))


def failure_mode(score: Column, evaluated: Column, partial: Column) -> Column:
    """evaluated: number of pillars with a score."""
    bands = reduce(lambda e, b: F.when(score >= b[0], b[1]).otherwise(e), reversed(FAILURE_BANDS), F.lit("severe_issues"))
    return F.when(evaluated == 0, "evaluation_error").when(partial, "partial_evaluation").otherwise(bands)
