"""Sinks: parquet tables, JSON and CSV exports, and texts made of small tables; ``reports`` has those that grow with the pages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.constants import PILLARS
from pageloom.functions.storage import write_small
from pageloom.functions.text import snapshot_name, status_label
from pageloom.operators import analytics, pillars
from pageloom.operators.agent_perf import site_ranking


HINTED = ("has_markdown_alternate", "has_markdown_url_meta", "has_llm_hints", "has_llms_txt_ref", "has_non_html_alternate")


def write_table(df: DataFrame, path: str, *by: str) -> None:
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One value a line: a url set."""
    df.select(column).write.mode("overwrite").text(path)


def markdown(df: DataFrame) -> str:
    """A table for printing; its rows pass through the driver, so large tables go to ``reports`` instead."""
    cell = lambda v: "" if v is None else f"{v:.1f}" if isinstance(v, float) else ", ".join(map(str, v)) if isinstance(v, list) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in df.toLocalIterator())])


def write_presentation(scores: DataFrame, stem: str) -> None:
    """A presentation's data: <stem>.json with the summary and pages' rows, <stem>.csv, and an executive summary <stem>.md."""
    rows = scores.select(analytics.page_key().alias("page"), "parseability_score", status_label(F.col("parseability_score")).alias("label"), "failure_mode", analytics.primary_issue().alias("issue"), *PILLARS)
    summary, ends = analytics.presentation_summary(scores), analytics.worst_and_best(scores)
    rows = rows.orderBy(F.desc("parseability_score"), "page")
    write_json(rows, f"{stem}.json")
    write_csv(rows, f"{stem}.csv")
    write_small(scores.sparkSession, f"{stem}.md", f"# Summary\n\n{markdown(summary)}\n\n## Worst and best pages\n\n{markdown(ends)}\n")


def parse_rows(features: DataFrame) -> DataFrame:
    """Parse results in their stored form, from pages with their features."""
    f = pillars.f
    hints = F.map_from_entries(F.transform(F.array(*(F.struct(F.lit(n).alias("key"), f("hints")[n].cast("string").alias("value")) for n in HINTED)), lambda e: e))
    signals = F.struct(
        (f("main_count") > 0).alias("has_main_element"), (f("article_count") > 0).alias("has_article_element"), pillars.heading_hierarchy_valid().alias("heading_hierarchy_valid"), pillars.text_density().alias("text_density_ratio"),
        f("code_count").alias("code_blocks_count"), f("table_count").alias("tables_count"), pillars.boilerplate_leakage().alias("boilerplate_leakage_estimate"), hints.alias("agent_content_hints"),
    )
    return features.select(snapshot_name(F.col("url")).alias("html_path"), signals.alias("signals"), pillars.evidence().alias("evidence"))


def negotiation_rows(scored: DataFrame, responses: DataFrame) -> DataFrame:
    """Records of content negotiation in their stored form: a url's answers, the HTML one apart, beside its scores.

    A url has an answer for each kind of request, so few.
    """
    given = dict(responses.dtypes)
    answer = F.struct(*((F.col(n) if n in given else F.lit(None)).cast(t).alias(n) for n, t in (("accept_header", "string"), ("content_type", "string"), ("content_length", "bigint"), ("status_code", "int"), ("content_hash", "string"), ("html_path", "string"), ("response_time_ms", "int"))))
    base = F.col("accept_header") == "text/html"
    held = responses.groupBy("url").agg(F.max(F.when(base, answer)).alias("baseline_format"), F.sort_array(F.collect_list(F.when(~base, answer))).alias("alternative_formats"))
    return scored.join(held, "url", "left").select("url", F.lit(None).cast("timestamp_ntz").alias("timestamp"), "baseline_format", "alternative_formats", "format_availability_score", "content_consistency_score", "agent_optimization_detected")


def write_summary(scores: DataFrame, path: str) -> None:
    """A bulk run's summary as one JSON object: counts, bands, modes, gate and the mean of each pillar."""
    whole = analytics.score_distribution(scores).first()
    modes = {r["failure_mode"]: r["count"] for r in scores.groupBy("failure_mode").count().collect()}
    means = scores.agg(*(F.avg(p).alias(p) for p in PILLARS)).first().asDict()
    write_small(scores.sparkSession, path, json.dumps({**whole.asDict(), "failure_modes": dict(sorted(modes.items(), key=lambda x: (-x[1], x[0]))), "pillar_means": means}, indent=2))


def tables_report(title: str, **parts: DataFrame) -> str:
    """A report of named tables: validation, consistency and agent runs."""
    return f"# {title}\n\n" + "\n\n".join(f"## {name.replace('_', ' ').capitalize()}\n\n{markdown(part)}" for name, part in parts.items()) + "\n"


def validation_report(validated: DataFrame) -> str:
    return tables_report("Benchmark validation", pass_rates=analytics.validation_rates(validated), pages=validated.orderBy("in_range", F.desc("deviation"), "url"))


def consistency_report(spread: DataFrame) -> str:
    return tables_report("Run consistency", verdict=analytics.consistency_verdict(spread), pages=spread.orderBy(F.desc("stdev"), "url"))


def agent_report(results: DataFrame) -> str:
    by_question = results.groupBy("name").agg(F.avg("quality").alias("quality"), F.avg(F.col("success").cast("double")).alias("success_rate")).orderBy("name")
    return tables_report("Agent performance", questions=by_question, pages=site_ranking(results).orderBy("rank"))


def history_table(history: DataFrame) -> str:
    """For printing; ``reports.write_history`` writes any number of rows."""
    return markdown(history.select(F.date_format("evaluated_at", "yyyy-MM-dd HH:mm").alias("time"), "corpus", "parseability_score", "universal_score", "content_type", "delta").orderBy("time"))
