"""Reports as ordered text that the executors write: blocks of text with sort keys, dealt to ranges, one numbered part each.

A report is a folder whose parts, one after another by name, are its text.  Nothing but the keys' ranges passes through the
driver.  A block's keys are its section, two numbers and a string; rows of a section that are pages carry the page's
columns through the sort and become text after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.constants import PILLARS
from pageloom.functions.text import status_label, title_case
from pageloom.operators import analytics, report_rules

KEYS = ("section", "a", "b", "c")

#: Evidence shown of a page; what is beyond is counted.
SHOWN = 10


def shown(value: Column, kind: str) -> Column:
    """A value as a cell of a table: numbers with one decimal, lists joined, null as nothing."""
    if kind in ("double", "float"):
        return F.when(value.isNull(), "").otherwise(F.format_string("%.1f", value))
    return F.coalesce(F.array_join(value.cast("array<string>"), ", ") if kind.startswith("array") else value.cast("string"), F.lit(""))


def table_line(df: DataFrame) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(shown(F.col(c), k) for c, k in df.dtypes)), F.lit(" |"))


def table_head(df: DataFrame) -> str:
    return "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)


def keyed(df: DataFrame, section: int, text: Column, a: Column | None = None, b: Column | None = None, c: Column | None = None) -> DataFrame:
    number = lambda x: F.lit(0.0) if x is None else F.coalesce(x.cast("double"), F.lit(-1e300))
    return df.select(F.lit(section).alias("section"), number(a).alias("a"), number(b).alias("b"), (F.lit("") if c is None else c).alias("c"), text.alias("text"))


def said(like: DataFrame, section: int, text: str) -> DataFrame:
    """One block of fixed text, before all others of its section."""
    one = like.sparkSession.range(1)
    return keyed(one, section, F.lit(text), F.lit(float("-inf")), F.lit(float("-inf")))


def table_blocks(df: DataFrame, section: int, title: str, a: Column | None = None, b: Column | None = None, c: Column | None = None) -> DataFrame:
    """A titled table, a block for each row, in the order of the keys."""
    return said(df, section, f"\n## {title}\n\n{table_head(df)}").unionByName(keyed(df, section, table_line(df), a, b, c))


def write_ordered(blocks: DataFrame, path: str, text: Column | None = None, parts: int | None = None) -> None:
    """Writes the blocks' text in the order of KEYS; ``parts=1`` for one part, written by one task."""
    rows = blocks.orderBy(*KEYS).select((F.col("text") if text is None else text).alias("value"))
    (rows.coalesce(parts) if parts else rows).write.mode("overwrite").text(path)


def page_findings(scores: DataFrame) -> DataFrame:
    """What a report says of each page: score, label, change by rendering, templates, findings, owner, causes, evidence, pillars."""
    pages = analytics.page_deltas(scores)
    held = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(p).alias("key"), F.col(p).alias("value")) for p in PILLARS)), lambda e: e["value"].isNotNull()))
    mode, found = F.col("failure_mode"), report_rules.pillar_findings({p: F.col(p) for p in PILLARS}, F.col("content_type"))
    evidence = F.coalesce("evidence", F.array().cast("array<string>")) if "evidence" in scores.columns else F.array().cast("array<string>")
    preview = F.col("preview") if "preview" in scores.columns else F.lit(None).cast("string")
    rows = pages.select(
        "page", "pos", "parseability_score", "universal_score", "failure_mode", "content_type", "render_delta", "flagged", status_label(F.col("parseability_score")).alias("label"),
        preview.alias("preview"), evidence.alias("evidence"), found.alias("findings"), held.alias("pillars"), mode.alias("mode"),
    )
    rows = rows.withColumns({"owner": report_rules.page_owner(F.col("findings")), "causes": report_rules.pillar_causes(F.col("findings"), F.col("evidence"))}).drop("mode")
    return rows.join(analytics.cluster_pages(analytics.one_row_per_page(scores)), "page", "left")


def page_text(page: Column) -> Column:
    """A page's part of the report."""
    f = lambda name: page[name]
    number = lambda x, form="%.1f": F.format_string(form, x)
    some = lambda rows, line: F.when(F.size(rows) > 0, F.array_join(F.transform(rows, line), "\n"))
    other = (f("content_type") != "article") & f("universal_score").isNotNull()
    score = F.concat(F.lit("Score "), number(F.coalesce(f("parseability_score"), F.lit(0.0))), F.when(other, F.concat(F.lit(" as "), f("content_type"), F.lit(", universal "), number(f("universal_score")))).otherwise(""), F.lit(", "), f("failure_mode"), F.lit(", "), f("content_type"), F.lit(".\n"))
    more = F.size(f("evidence")) - SHOWN
    lines = (
        F.concat(F.lit("### "), f("label"), F.lit(" "), f("page"), F.lit("\n")),
        score,
        F.when(F.size(f("template_pillars")) > 0, F.concat(F.lit("Pillars of shared templates: "), F.array_join(f("template_pillars"), ", "), F.lit(".\n"))),
        F.concat(F.lit("Rendered against raw: "), number(f("render_delta"), "%+.1f"), F.when(f("flagged"), ", depends on scripts").otherwise(""), F.lit(".\n")),
        F.concat(F.lit("> "), F.when(f("preview") == "", "(nothing extracted)").otherwise(F.replace(f("preview"), F.lit("\n"), F.lit(" "))), F.lit("\n")),
        some(f("findings"), lambda x: F.concat(F.lit("- "), x["issue"])),
        some(f("causes"), lambda x: F.concat(F.lit("- Cause: "), x)),
        some(F.slice(f("evidence"), 1, SHOWN), lambda x: F.concat(F.lit("- Evidence: "), x)),
        F.when(more > 0, F.concat(F.lit("- and "), more.cast("string"), F.lit(" more"))),
        F.concat(F.lit("- Owner: "), f("owner"), F.lit("\n")),
        F.concat(F.lit("| Fix | Impact | Effort | Gain | Priority |\n| --- | --- | --- | --- | --- |\n"), some(f("findings"), lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", x["fix"], x["impact"], x["effort"], F.concat(F.lit("+"), number(x["gain"])), x["priority"]), F.lit(" |"))), F.lit("\n")),
        some(f("findings"), lambda x: F.concat(x["fix"], F.lit(":\n\n```html\n"), x["example"], F.lit("\n```\n"))),
        some(F.map_entries(f("pillars")), lambda e: F.concat(F.lit("- "), title_case(e["key"]), F.lit(": "), number(e["value"]))),
    )
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def report_blocks(scores: DataFrame) -> DataFrame:
    """Summary, render changes, template clusters, profile impact, pages worst first with findings and fixes, recommendations."""
    pages = analytics.one_row_per_page(scores)
    modes = pages.groupBy("failure_mode").agg(F.count("*").alias("pages"))
    found = page_findings(scores)
    advice = found.select(F.explode("findings").alias("x")).groupBy("x.pillar", "x.advice").agg(F.count("*").alias("pages"), F.sum("x.gain").alias("gain"))
    plain = (
        said(scores, 0, "# Page access report"),
        table_blocks(analytics.report_summary(pages), 1, "Summary"),
        table_blocks(modes, 2, "Failure modes", -F.col("pages"), None, F.col("failure_mode")),
        table_blocks(analytics.render_deltas(scores), 3, "Raw against rendered", -F.abs("delta"), None, F.col("page")),
        table_blocks(analytics.template_clusters(pages), 4, "Shared templates", -F.col("members"), -F.col("uplift"), F.col("pillar")),
        table_blocks(analytics.profile_impact(pages), 5, "Profile impact", -F.abs("delta"), None, F.col("page")),
        said(scores, 6, "\n## Pages\n"),
        said(scores, 7, "\n## Recommendations\n"),
        keyed(advice, 7, F.concat(F.lit("- "), F.col("pages").cast("string"), F.lit(" pages: "), F.col("advice"), F.lit(".")), -F.col("gain"), None, F.col("pillar")),
    )
    blocks = plain[0]
    for part in plain[1:]:
        blocks = blocks.unionByName(part)
    page = F.struct(*found.columns)
    shown_pages = found.select(F.lit(6).alias("section"), F.coalesce("parseability_score", F.lit(-1.0)).cast("double").alias("a"), F.col("pos").cast("double").alias("b"), F.col("page").alias("c"), F.lit(None).cast("string").alias("text"), page.alias("page"))
    return blocks.withColumn("page", F.lit(None).cast(shown_pages.schema["page"].dataType)).unionByName(shown_pages)


def write_report(scores: DataFrame, path: str, parts: int | None = None) -> None:
    write_ordered(report_blocks(scores), path, F.coalesce("text", page_text(F.col("page"))), parts)


def write_tables(title: str, path: str, *tables: tuple[str, DataFrame, Column | None, Column | None], parts: int | None = None) -> None:
    """A report of (name, table, number to order by, string to order by): validation, consistency and agent runs, histories."""
    blocks = said(tables[0][1], 0, f"# {title}")
    for k, (name, df, number, string) in enumerate(tables, 1):
        blocks = blocks.unionByName(table_blocks(df, k, name, number, None, string))
    write_ordered(blocks, path, parts=parts)


def write_validation(validated: DataFrame, path: str) -> None:
    write_tables("Benchmark validation", path, ("Pass rates", analytics.validation_rates(validated), None, F.col("category")), ("Pages", validated, F.when(F.col("in_range"), 0.0).otherwise(-F.col("deviation")), F.col("url")))


def write_consistency(spread: DataFrame, path: str) -> None:
    write_tables("Run consistency", path, ("Verdict", analytics.consistency_verdict(spread), None, None), ("Pages", spread, -F.col("stdev"), F.col("url")))


def write_history(history: DataFrame, path: str) -> None:
    """Rows of ``score_history`` in time order."""
    time = F.date_format("evaluated_at", "yyyy-MM-dd HH:mm")
    rows = history.select(time.alias("time"), "corpus", "parseability_score", "universal_score", "content_type", "delta", F.unix_micros(F.col("evaluated_at").cast("timestamp")).alias("at"), "score_file", "pos")
    text = rows.select("time", "corpus", "parseability_score", "universal_score", "content_type", "delta")
    blocks = said(history, 0, f"# Score history\n\n{table_head(text)}").unionByName(keyed(rows, 1, table_line(text), F.col("at"), F.col("pos"), F.col("score_file")))
    write_ordered(blocks, path)
