"""The registered queries: each operator over its whole input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.constants import PILLARS
from pageloom.functions import stats, text
from pageloom.operators import agent_perf, analytics, calibration, negotiation, pillars, report_rules, robots, scoring
from pageloom.plans import inputs
from pageloom.plans.scores import page_features, score_pages
from pageloom.sources import readers, reports

Query = Callable[[SparkSession, str], DataFrame]

d = pillars.d


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.view(spark, sf_dir, inputs.ENRICHED, "pages")


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_features(enriched(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.view(spark, sf_dir, inputs.SCORES, "pages")


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs, one row for each url; a url's three rows are in either or both, so some urls are in one run only."""
    rows = scores(spark, sf_dir)
    one = lambda df: df.groupBy("url").agg(*(F.max(c).alias(c) for c in (*PILLARS, "parseability_score", "content_type")))
    return one(rows.where("pos % 7 < 3")), one(rows.where("pos % 7 >= 3"))


# ---- pages


def parse_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, c = pillars.f, featured(spark, sf_dir)
    return c.select("page_id", (f("main_count") > 0).alias("has_main"), (f("article_count") > 0).alias("has_article"), pillars.heading_hierarchy_valid().alias("hierarchy_valid"), *(f(n).alias(n) for n in ("p_count", "div_count", "code_count", "table_count", "list_count")), F.array_join(F.transform(f("heading_levels"), lambda x: x.cast("string")), ",").alias("levels"))


def text_density_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = pillars.f
    return featured(spark, sf_dir).select("page_id", f("total_length").alias("total_length"), f("primary_length").alias("primary_length"), pillars.text_density().alias("text_density"), pillars.boilerplate_leakage().alias("boilerplate_leakage"))


def semantic_html_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = F.array_join(F.transform(pillars.semantic_usage(), lambda x: F.concat_ws(":", x["element"], x["count"].cast("string"), x["proper_usage"].cast("string"))), ",")
    return featured(spark, sf_dir).select("page_id", pillars.semantic_html().alias("score"), usage.alias("usage"))


def static_accessibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).select("page_id", *(c.alias(n) for n, c in pillars.accessibility_checks().items()), pillars.static_accessibility().alias("score"))


def metadata_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).select("page_id", *(c.alias(f"has_{n}") for n, (_, c) in pillars.metadata_fields().items()), pillars.metadata_completeness().alias("score"))


def agent_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("has_markdown_alternate", "has_markdown_url_meta", "has_llm_hints", "has_llms_txt_ref", "has_non_html_alternate")
    return featured(spark, sf_dir).select("page_id", *(pillars.f("hints").getField(n).alias(n) for n in names), pillars.hint_points().alias("points"))


def structured_data_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).select("page_id", *(F.when(pillars.f("ld_valid"), c).alias(n) for n, c in (("type_points", pillars.type_appropriateness()), ("field_points", pillars.field_completeness()), ("format_points", pillars.multiple_formats()), ("schema_points", pillars.schema_validation()))), pillars.structured_data().alias("score"))


def content_extractability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_features(enriched(spark, sf_dir), extraction=True)
    return rows.select("page_id", pillars.signal_to_noise().alias("signal_to_noise"), pillars.structure_preservation().alias("structure_preservation"), pillars.boundary_detection().alias("boundary_detection"), pillars.content_extractability().alias("score"), pillars.r("preview").alias("preview"))


def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).select("page_id", scoring.classify(F.col("url")).alias("c")).select("page_id", "c.profile", "c.source", "c.matched_value")


def http_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the pillar by crawl record and robots.txt, of the pages that have a record."""
    crawl = with_chain(inputs.view(spark, sf_dir, inputs.CRAWLED, "pages")).select("page_id", "status", "chain", "redirect_ms", "final_ms", F.create_map("header", "header_value").alias("headers"))
    rows = featured(spark, sf_dir).drop("html").join(crawl, "page_id")
    rows = rows.join(robots.robots_answers(rows.select("url"), inputs.view(spark, sf_dir, inputs.ROBOTS_FILES, "pages")), "url", "left")
    parts = {
        "reachability": pillars.reachability(F.lit(True), F.col("status")),
        "redirects": pillars.redirect_efficiency(F.col("chain"), F.col("redirect_ms"), F.col("final_ms")),
        "permissions": pillars.crawl_permissions(F.coalesce("robots_known", F.lit(False)), F.coalesce("robots_blocked", F.lit(False))),
        "cache": pillars.cache_headers(F.col("headers")),
    }
    return rows.select("page_id", *(c.alias(n) for n, c in parts.items()), pillars.http_compliance(*parts.values()).alias("score"))


def page_scores_crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pillars in both render modes, with accessibility runs, crawl records and robots.txt."""
    crawl = with_chain(inputs.view(spark, sf_dir, inputs.CRAWLED, "pages"))
    crawl = crawl.select(text.snapshot_name(F.col("url")).alias("html_path"), "status", F.col("chain").alias("redirect_chain"), F.col("redirect_ms").alias("total_redirect_time_ms"), F.col("final_ms").alias("final_response_time_ms"), F.create_map("header", "header_value").alias("headers"))
    files = inputs.view(spark, sf_dir, inputs.ROBOTS_FILES, "pages")
    rows = score_pages(enriched(spark, sf_dir), extraction=False, modes=("raw", "rendered"), axe=axe_pages(spark, sf_dir), crawl=crawl, robots_files=files)
    return rows.drop("evaluation_methodology", "failed_pillars", "pillar_reasons", "content_extractability", "evidence", "preview")


def page_scores_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pillars and their scores; extraction, which no SQL can express, is left out and the weights renormalise."""
    return score_pages(enriched(spark, sf_dir), extraction=False).drop("evaluation_methodology", "failed_pillars", "pillar_reasons", "content_extractability", "evidence", "preview")


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six pillars in both render modes."""
    return score_pages(enriched(spark, sf_dir), modes=("raw", "rendered"), axe=axe_pages(spark, sf_dir))


def axe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.axe_scores(inputs.view(spark, sf_dir, inputs.VIOLATIONS, "events"))
    return found.select(F.concat(F.lit("https://h"), F.substring("url", 2, 20), F.lit(".example.com")).alias("url"), "axe_score")


def failure_mode_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and mean scores by failure mode and profile, from all six pillars."""
    return score_pages(enriched(spark, sf_dir)).groupBy("failure_mode", "content_type").agg(F.count("*").alias("pages"), F.bround(F.avg("parseability_score"), 6).alias("mean_score"))


# ---- files


def charset_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The charset that each page's bytes are found to be in, and the text read from them."""
    rows = inputs.encoded_pages(spark, sf_dir).select("page_id", readers.read_text(F.col("content")).alias("found"))
    return rows.select("page_id", F.col("found.charset").alias("charset"), F.char_length("found.text").alias("n_chars"), F.md5("found.text").alias("text_md5"))


# ---- crawl records


def with_chain(crawl: DataFrame) -> DataFrame:
    return crawl.withColumn("chain", F.transform(F.filter(F.split("codes", ","), lambda x: x != ""), lambda x: x.cast("int")))


def crawl_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_chain(inputs.view(spark, sf_dir, inputs.CRAWL, "pages"))


def redirect_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawl_chains(spark, sf_dir)
    return rows.select("page_id", F.size("chain").alias("hops"), pillars.redirect_efficiency(F.col("chain"), F.col("redirect_ms"), F.col("final_ms")).alias("efficiency"), pillars.redirect_class(F.size("chain"), F.col("redirect_ms")).alias("class"), pillars.revisits(F.col("chain")).alias("revisits"))


def redirect_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.status_histogram(crawl_chains(spark, sf_dir).select(F.col("chain").alias("redirect_chain")))


def successful_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose request succeeded, with the snapshot's name, and whether the url is valid."""
    rows = crawl_chains(spark, sf_dir).where("status between 200 and 399")
    return rows.select("page_id", "status", text.snapshot_name(F.col("url")).alias("html_path"), scoring.valid_url(F.col("url")).alias("valid_url"))


def redirect_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url walked through recorded responses, by doubling the paths of the graph of redirects."""
    held = inputs.view(spark, sf_dir, inputs.REDIRECTED, "pages")
    responses = held.select("url", "status", F.when(F.col("location").isNotNull(), F.create_map(F.lit("Location"), "location")).alias("headers"), F.lit("<p>").alias("html"), "ms")
    rows = readers.walked(held.select("url"), responses)
    return rows.select("url", "status", "final_url", "redirect_count", "total_redirect_time_ms", F.array_join(F.transform("redirect_chain", lambda h: h["status_code"].cast("string")), ",").alias("codes"))


def robots_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract(url, r"(example\.(?:com|net|org))", 1).alias("host"), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1).alias("path"))
    return robots.robots_blocked(pages, robots.robots_rules(spark.sql(inputs.ROBOTS)))


def negotiation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negotiation.negotiation_scores(inputs.view(spark, sf_dir, inputs.RESPONSES, "pages"))


def axe_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.axe_scores(inputs.view(spark, sf_dir, inputs.VIOLATIONS, "events"))


def violation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.violation_audit(inputs.view(spark, sf_dir, inputs.VIOLATIONS, "events"))


def hop_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the evidence says of each page's redirects: the first three and how many more."""
    return crawl_chains(spark, sf_dir).select("page_id", pillars.hops_evidence(F.col("chain")).alias("hops"))


# ---- score tables


def render_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.render_deltas(scores(spark, sf_dir))


def latest_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.one_row_per_page(scores(spark, sf_dir)).select("url", "pos", "render_mode", "parseability_score")


def _suffixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).withColumn("url", F.concat("url", F.col("pos").cast("string")))


def template_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.template_clusters(_suffixed(spark, sf_dir)).withColumn("uplift", F.bround("uplift", 9))


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.cluster_members(_suffixed(spark, sf_dir))


def cluster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.cluster_pages(_suffixed(spark, sf_dir)).select("page", F.array_join("template_pillars", ",").alias("template_pillars"))


def page_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.page_deltas(scores(spark, sf_dir)).select("page", "pos", "parseability_score", "render_delta", "flagged")


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).select("pos", F.concat(F.lit("p"), F.col("pos").cast("string"), F.lit(".html")).alias("html_path"), F.when(F.col("pos") % 2 == 0, F.col("url")).alias("url"), "parseability_score", "failure_mode")
    return analytics.page_summary(rows, inputs.view(spark, sf_dir, inputs.RECORD_URLS, "pages"))


def presentation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.presentation_summary(scores(spark, sf_dir))
    return rows.withColumns({c: F.bround(c, 6) for c in ("mean_score", "ready_percent")})


def axe_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.axe_runs(inputs.view(spark, sf_dir, inputs.AXE_RUNS, "events"), inputs.view(spark, sf_dir, inputs.VIOLATIONS, "events"))


def profile_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.profile_impact(scores(spark, sf_dir))


def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return rows.select("pos", F.bround(scoring.weighted_score(F.col("content_type")), 9).alias("profile_score"), F.bround(scoring.weighted_score("article"), 9).alias("article_score"))


def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.view(spark, sf_dir, inputs.HISTORY, "events")
    return analytics.score_history(rows, None, "user_id").select("pos", text.normal_url(F.col("url")).alias("url"), "parseability_score", "delta")


def expectations(spark: SparkSession) -> DataFrame:
    rows = spark.sql(inputs.EXPECTED)
    return rows.select("url", F.col("lo").cast("double").alias("expected_min"), F.col("hi").cast("double").alias("expected_max"), "category")


def benchmark_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.benchmark_validation(scores(spark, sf_dir), expectations(spark))


def validation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.validation_rates(benchmark_validation(spark, sf_dir))


def run_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.run_consistency(inputs.view(spark, sf_dir, inputs.RUNS, "events"), 3)
    return rows.withColumns({"mean": F.bround("mean", 6), "stdev": F.bround("stdev", 6)})


def consistency_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.consistency_verdict(analytics.run_consistency(inputs.view(spark, sf_dir, inputs.RUNS, "events"), 3))
    return rows.withColumns({"mean_stdev": F.bround("mean_stdev", 6), "worst_stdev": F.bround("worst_stdev", 6)})


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.compare_runs(*halves(spark, sf_dir))


def compare_pillars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.compare_pillars(*halves(spark, sf_dir))
    return rows.select("pillar", *(F.bround(c, 6).alias(c) for c in ("old", "new", "delta")))


def metadata_delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.delta_stats(*halves(spark, sf_dir), "metadata_completeness")
    return rows.withColumn("mean", F.bround("mean", 6))


def golden_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.golden_drift(*halves(spark, sf_dir), "content_type")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.run_summary(scores(spark, sf_dir)).withColumns({"mean_score": F.bround("mean_score", 6), "clean_percent": F.bround("clean_percent", 6)})


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.report_summary(scores(spark, sf_dir)).withColumn("mean_score", F.bround("mean_score", 6))


def bulk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.score_distribution(scores(spark, sf_dir), "content_type").withColumn("mean_score", F.bround("mean_score", 6))


def mode_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.mode_rollup(scores(spark, sf_dir)).withColumn("mean_score", F.bround("mean_score", 6))


def primary_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.col("failure_mode")
    return scores(spark, sf_dir).select("pos", analytics.primary_issue().alias("issue"), text.status_label(F.col("parseability_score")).alias("status"), analytics.fix_hint(mode).alias("hint"), text.outcome_tag(F.col("parseability_score"), mode).alias("tag"))


def worst_best_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.worst_and_best(scores(spark, sf_dir), 5)


def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.display_order(scores(spark, sf_dir)).select("pos", "parseability_score", "shown_as")


def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, owner and causes of each page, its pillars standing in for the four subscores."""
    names = {"semantic_structure": "semantic_html", "heading_hierarchy": "metadata_completeness", "content_density": "content_extractability", "boilerplate_resistance": "dom_navigability"}
    subs = F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.col(v))))
    evidence = F.when(F.col("pos") % 3 == 0, F.array(F.lit("No headings found"))).when(F.col("pos") % 3 == 1, F.array(F.lit("one main"), F.lit("2 hierarchy violations"))).otherwise(F.array().cast("array<string>"))
    rows = scores(spark, sf_dir).select("pos", report_rules.findings(F.col("failure_mode"), subs).alias("found"), report_rules.fix_owner(F.col("failure_mode"), subs).alias("owner"), report_rules.root_causes(F.col("failure_mode"), subs, evidence).alias("causes"))
    return rows.select("pos", F.array_join("found.fix", "; ").alias("fixes"), F.coalesce(F.aggregate("found.gain", F.lit(0), lambda s, x: s + x), F.lit(0)).alias("gain"), "owner", F.array_join("causes", "; ").alias("causes"))


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the report finds on each page: its weak pillars by gain, who owns the first, and the causes."""
    rows = reports.page_findings(scores(spark, sf_dir))
    found = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["fix"], x["impact"], x["priority"])), "; ")
    gain = F.aggregate("findings", F.lit(0.0), lambda s, x: s + x["gain"])
    return rows.select("page", "pos", "owner", found.alias("found"), F.bround(gain, 6).alias("gain"), F.size("causes").alias("causes"), F.array_join("template_pillars", ",").alias("templates"))


# ---- study


def qa_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, truths = inputs.view(spark, sf_dir, inputs.ANSWERS, "conversations"), inputs.view(spark, sf_dir, inputs.TRUTHS, "conversations")
    return calibration.grade_answers(answers, truths, "conv_id", "pair_index")


def page_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.page_accuracy(qa_grading(spark, sf_dir), "conv_id").withColumn("accuracy", F.bround("accuracy", 9))


def spearman_by_pillar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(inputs.view(spark, sf_dir, inputs.STUDY, "documents", "labels"), "score", "accuracy", "pillar").withColumn("rho", F.bround("rho", 9))


def correlation_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.correlate(inputs.view(spark, sf_dir, inputs.STUDY, "documents", "labels"))


def grader_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.view(spark, sf_dir, "SELECT CAST(doc_id % 3 AS STRING) AS a, CAST((doc_id + n_chars % 2) % 3 AS STRING) AS b FROM documents", "documents")
    return calibration.cohen_kappa(rows, "a", "b").select("n", *(F.bround(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


def agent_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent_perf.agent_performance(enriched(spark, sf_dir).select("url", "html"))


def site_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent_perf.site_ranking(agent_performance(spark, sf_dir))


def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = agent_perf.standard_answers(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.coalesce("text", F.lit("")), F.col("doc_id"))
    return rows.select(F.col("kept_0").alias("doc_id"), "name", "matches", F.bround("quality", 9).alias("quality"), "success")


def answer_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources ranked by how well their documents answer the standard questions."""
    rows = agent_perf.standard_answers(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")))
    ranked = agent_perf.site_ranking(rows.withColumnRenamed("kept_0", "url"))
    return ranked.select("url", "rank", *(F.bround(c, 6).alias(c) for c in ("quality", "success_rate", "coverage")))


# ---- urls


def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = F.col("url")
    return rows.select("page_id", text.normal_url(url).alias("normal"), text.short_url(url).alias("short"), text.site_name(url).alias("site"), text.snapshot_name(url).alias("snapshot"))


def distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of the url sets of two runs."""
    old, new = (df.select("url") for df in halves(spark, sf_dir))
    named = lambda df, kind: df.select("url", F.lit(kind).alias("set"))
    return named(old.union(new).distinct(), "union").unionByName(named(old.intersect(new), "both")).unionByName(named(old.exceptAll(new), "only_old"))


def url_batches(spark: SparkSession, sf_dir: str, size: int = 50) -> DataFrame:
    """Batches of ``size`` urls in page order."""
    rows = analytics.numbered_batches(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id"), "page_id", size)
    return rows.groupBy("batch").agg(F.count("*").alias("urls"), F.min("page_id").alias("first"), F.max("page_id").alias("last"))


ALL: tuple[Query, ...] = (
    parse_signals, text_density_boilerplate, semantic_html_score, static_accessibility, metadata_completeness, agent_hints, structured_data_score,
    content_extractability, content_type, http_compliance, page_scores_core, page_scores, page_scores_crawled, failure_mode_dist, redirect_scores, redirect_status_histogram,
    charset_detection, page_findings, redirect_walks, violation_audit, hop_audit, answer_ranking, successful_crawl, robots_permission, negotiation_scores, axe_penalty, render_deltas, latest_per_page, template_clusters, cluster_members, cluster_pages, page_deltas, page_summary, presentation_summary, axe_runs, profile_impact,
    weighted_scores, score_history, benchmark_validation, validation_rates, run_consistency, consistency_verdict, compare_runs, compare_pillars,
    metadata_delta_stats, golden_drift, run_summary, report_summary, bulk_distribution, mode_rollup, primary_issue, worst_best_examples, display_order,
    report_findings, qa_grading, page_accuracy, spearman_by_pillar, correlation_study, grader_kappa, agent_performance, site_ranking, answer_quality,
    url_functions, distinct_urls, url_batches,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}
