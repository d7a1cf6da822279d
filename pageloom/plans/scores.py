"""From pages and crawl records to one score row per page and render mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.constants import METHODOLOGY, PILLARS, RENDER_MODES
from pageloom.functions.text import snapshot_name
from pageloom.kernels.features import with_features, with_readable
from pageloom.operators import pillars, robots, scoring
from pageloom.operators.pillars import d


def spread(pages: DataFrame) -> DataFrame:
    """Pages over all cores before the kernel: fewer files than cores arrive as few partitions, more stay as they are."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages if len(pages.inputFiles()) >= cores else pages.repartition(cores)


def page_features(pages: DataFrame, extraction: bool = False, over_cores: bool = True) -> DataFrame:
    rows = spread(pages) if over_cores else pages
    return with_readable(rows) if extraction else with_features(rows)


def pillar_columns(extraction: bool, http: Column | None = None, axe: Column | None = None) -> dict[str, Column]:
    """Each pillar's score; null where it could not be evaluated."""
    static = pillars.static_accessibility()
    return {
        "semantic_html": pillars.semantic_html(),
        "content_extractability": pillars.content_extractability() if extraction else F.lit(None).cast("double"),
        "structured_data": pillars.structured_data(),
        "dom_navigability": static if axe is None else F.coalesce(axe, static),
        "metadata_completeness": pillars.metadata_completeness(),
        "http_compliance": pillars.http_offline() if http is None else http,
    }


def score_pages(
    pages: DataFrame, extraction: bool = True, modes: tuple[str, ...] = ("raw",), axe: DataFrame | None = None, crawl: DataFrame | None = None, robots_files: DataFrame | None = None,
    over_cores: bool = True,
) -> DataFrame:
    """Score rows of (page_id, url, html): pillars, weighted scores, profile and failure mode.

    ``axe`` (url, axe_score) applies to rendered rows.  ``crawl`` (html_path, status, redirect_chain, total_redirect_time_ms,
    final_response_time_ms, headers) and ``robots_files`` (host, robots_status, robots_txt) decide http_compliance; what
    a page lacks of them counts as not asked for.  Null html gives an evaluation error.
    """
    unknown = set(modes) - set(RENDER_MODES)
    if unknown:
        raise ValueError(f"render modes unknown: {sorted(unknown)}")
    rows = page_features(pages, extraction, over_cores)
    asked = crawl is not None or robots_files is not None
    http = F.struct(pillars.f("meta_robots").alias("meta_robots"), pillars.f("hints").alias("hints")).alias("f")
    rows = rows.select("page_id", "url", F.col("html").isNull().alias("failed"), scoring.classify(F.col("url")).alias("class"), pillars.evidence().alias("evidence"), (pillars.r("preview") if extraction else F.lit(None).cast("string")).alias("preview"), *(c.alias(k) for k, c in pillar_columns(extraction).items()), *[http] * asked)
    if asked:  # the html is gone by now
        rows = with_crawl(rows, crawl, robots_files).drop("f")
    if axe is not None:
        rows = rows.join(axe.select("url", "axe_score"), "url", "left")
    if len(modes) > 1 or modes != ("raw",):
        rows = rows.select("*", F.explode(F.array(*map(F.lit, modes))).alias("render_mode"))
    else:
        rows = rows.withColumn("render_mode", F.lit("raw"))
    if axe is not None:
        rows = rows.withColumn("dom_navigability", F.when(F.col("render_mode") == "rendered", F.coalesce("axe_score", "dom_navigability")).otherwise(F.col("dom_navigability"))).drop("axe_score")
    rows = rows.withColumns({p: F.when(~F.col("failed"), F.col(p)) for p in PILLARS})
    return finish(rows)


def with_crawl(rows: DataFrame, crawl: DataFrame | None, robots_files: DataFrame | None) -> DataFrame:
    """``rows`` (url, f) with http_compliance by the page's crawl record, joined by html_path, and its host's robots.txt.

    Of several records of one page the last one counts, by timestamp if there is one.
    """
    reach, redirects, cache = pillars.reachability(F.lit(False), F.lit(None).cast("int")), pillars.redirect_efficiency(F.lit(None).cast("array<int>"), d(0), d(0)), pillars.cache_headers(F.lit(None).cast("map<string,string>"))
    if crawl is not None:
        chain = F.col("redirect_chain") if crawl.schema["redirect_chain"].dataType.simpleString() == "array<int>" else F.transform("redirect_chain", lambda hop: hop["status_code"])
        held = F.struct("status", chain.alias("chain"), F.col("total_redirect_time_ms").alias("redirect_ms"), F.col("final_response_time_ms").alias("final_ms"), F.transform_keys("headers", lambda k, _: F.lower(k)).alias("headers"))
        last = crawl.groupBy("html_path").agg(F.max_by(held, F.col("timestamp") if "timestamp" in crawl.columns else F.lit(0)).alias("crawl"))
        rows = rows.withColumn("html_path", snapshot_name(F.col("url"))).join(last, "html_path", "left").drop("html_path")
        c = lambda name: F.col("crawl").getField(name)
        reach, redirects, cache = pillars.reachability(F.lit(True), c("status")), pillars.redirect_efficiency(c("chain"), c("redirect_ms"), c("final_ms")), pillars.cache_headers(c("headers"))
    known, blocked = F.lit(False), F.lit(False)
    if robots_files is not None:
        rows = rows.join(robots.robots_answers(rows.select("url"), robots_files), "url", "left")
        known, blocked = F.coalesce("robots_known", F.lit(False)), F.coalesce("robots_blocked", F.lit(False))
    told = F.array_compact(F.array(pillars.hops_evidence(c("chain")) if crawl is not None else F.lit(None).cast("string"), F.when(blocked, "robots.txt forbids the path")))
    rows = rows.withColumn("evidence", F.concat("evidence", told))
    http = pillars.http_compliance(reach, redirects, pillars.crawl_permissions(known, blocked), cache)
    return rows.withColumn("http_compliance", http).drop("crawl", "robots_known", "robots_blocked")


def finish(rows: DataFrame) -> DataFrame:
    """Adds scores, failure mode and bookkeeping to rows with pillars, ``class`` and ``failed``."""
    expected = [p for p in PILLARS]
    n = reduce(lambda a, b: a + b, (F.col(p).isNotNull().cast("int") for p in expected))
    rows = rows.withColumn("content_type", F.when(F.col("failed"), "article").otherwise(F.col("class.profile")))
    rows = rows.withColumns({"parseability_score": scoring.weighted_score(F.col("content_type")), "universal_score": scoring.weighted_score("article"), "evaluated": n})
    failed = F.filter(F.array(*(F.when(F.col(p).isNull(), F.lit(p)) for p in expected)), lambda p: p.isNotNull())
    rows = rows.withColumns({"partial_evaluation": F.col("evaluated") < len(expected), "failed_pillars": failed})
    rows = rows.withColumn("pillar_reasons", F.map_from_entries(F.transform("failed_pillars", lambda p: F.struct(p.alias("key"), _reason(p).alias("value")))))
    mode = scoring.failure_mode(F.col("parseability_score"), F.col("evaluated"), F.col("partial_evaluation"))
    return rows.select(
        "page_id", "url", snapshot_name(F.col("url")).alias("html_path"), "render_mode", "content_type", F.col("class.source").alias("content_type_source"), *PILLARS,
        "parseability_score", "universal_score", mode.alias("failure_mode"), "partial_evaluation", "failed_pillars", "pillar_reasons", F.lit(METHODOLOGY).alias("evaluation_methodology"),
        "evidence", "preview",
    )


def _reason(pillar: Column) -> Column:
    """Why a pillar could not be evaluated."""
    reasons = F.when(pillar == "structured_data", "a JSON-LD block does not parse").when(pillar == "content_extractability", "extraction was not run")
    return F.when(F.col("failed"), "no HTML").otherwise(reasons.otherwise("no data"))


def environment(spark: SparkSession) -> dict[str, str]:
    """What a run's scores depend on, for its record."""
    import platform
    from importlib.metadata import version

    return {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, **{name: version(name) for name in ("pandas", "pyarrow")}}


def component_map() -> Column:
    """The pillars that were evaluated as a map."""
    held = F.array(*(F.struct(F.lit(p).alias("key"), F.col(p).alias("value")) for p in PILLARS))
    return F.map_from_entries(F.filter(held, lambda e: e["value"].isNotNull()))
