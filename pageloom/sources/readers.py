"""Readers of URL lists, snapshots, crawl records and score files, and the tables that operators take."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pageloom.functions.skew import copied, dealt, hot_keys
from pageloom.functions.storage import durable
from pageloom.functions.text import snapshot_name, strip
from pageloom.kernels import charset
from pageloom.operators.analytics import with_urls

HOP = "struct<from_url string, to_url string, status_code int, redirect_time_ms double, headers map<string,string>>"
CRAWL = f"url string, timestamp timestamp_ntz, status int, headers map<string,string>, html_path string, redirect_chain array<{HOP}>, redirect_count int, total_redirect_time_ms double, final_response_time_ms double, final_url string"
ANSWER = "struct<accept_header string, content_type string, content_length bigint, status_code int, content_hash string, html_path string, response_time_ms int>"
NEGOTIATION = f"url string, timestamp timestamp_ntz, baseline_format {ANSWER}, alternative_formats array<{ANSWER}>, format_availability_score double, content_consistency_score double, agent_optimization_detected boolean"
SIGNALS = "struct<has_main_element boolean, has_article_element boolean, heading_hierarchy_valid boolean, text_density_ratio double, code_blocks_count int, tables_count int, boilerplate_leakage_estimate double, agent_content_hints map<string,string>>"
PARSED = f"html_path string, signals {SIGNALS}, evidence array<string>"
SCORE = "parseability_score double, failure_mode string, html_path string, url string, component_scores map<string,double>, partial_evaluation boolean, failed_pillars array<string>, content_type string, universal_score double, render_mode string"


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """One url a line; blank lines and comments go, repeats stay."""
    return spark.read.text(path).select(strip(F.col("value")).alias("url")).where("url <> '' and not startswith(url, '#')")


def urls_of(spark: SparkSession, urls: list[str] | None = None, lines: list[str] | None = None, path: str | None = None) -> DataFrame:
    """A file before arguments before lines of standard input."""
    if path:
        return url_list(spark, path)
    return spark.createDataFrame([(u.strip(),) for u in urls or lines or []], "url string").where("url <> '' and not startswith(url, '#')")


def _read_texts(contents: pd.Series) -> pd.DataFrame:
    names = contents.map(lambda c: None if c is None else charset.detect(bytes(c)))
    texts = [None if n is None else bytes(c).decode(n, "replace") for c, n in zip(contents, names, strict=True)]
    return pd.DataFrame({"charset": pd.Series(names, dtype=object), "text": pd.Series(texts, dtype=object)})


def read_text(content: Column) -> Column:
    """struct<charset, text> of a file's bytes: by mark, as valid UTF-8, as declared, else by its most coherent reading; never an error."""
    return F.pandas_udf(_read_texts, "charset string, text string")(content)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """html_path and html of every snapshot file, in the charset that it is found to be in."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("html_path"), read_text(F.col("content"))["text"].alias("html"))


def _records(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """JSON records, one a line or as one array over several lines."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    lines = first is not None and first[0].strip()[0] == "{" and first[0].strip()[-1] == "}"
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def crawl_records(spark: SparkSession, path: str) -> DataFrame:
    """Crawl results with defaults for missing fields; failed requests have status 0 and an empty html_path."""
    rows = _records(spark, CRAWL, path)
    return rows.na.fill({"status": 0, "html_path": "", "redirect_count": 0, "total_redirect_time_ms": 0.0, "final_response_time_ms": 0.0})


def crawled_pages(crawl: DataFrame, snaps: DataFrame) -> DataFrame:
    """Successful crawl rows with their html, by html_path."""
    return crawl.where("coalesce(html_path, '') <> ''").join(snaps, "html_path")


def result_scores(spark: SparkSession, path: str, crawl: DataFrame | None = None) -> DataFrame:
    """url and score of a result file: score rows, whose urls come from crawl records where they have none, or (url, score) rows."""
    rows = _records(spark, f"{SCORE}, score double", path)
    if crawl is not None:
        rows = with_urls(rows, crawl)
    return rows.select("url", F.coalesce("parseability_score", "score").alias("score")).where("url is not null and score is not null")


def score_rows(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark, SCORE, path)


def negotiation_records(spark: SparkSession, path: str) -> DataFrame:
    """Results of content negotiation as they are stored: one record for each url."""
    return _records(spark, NEGOTIATION, path)


def negotiation_responses(records: DataFrame) -> DataFrame:
    """url, accept_header, status_code, content_hash of every answer of the records: what they are scored from."""
    answers = F.array_compact(F.concat(F.array("baseline_format"), F.coalesce("alternative_formats", F.array().cast(f"array<{ANSWER}>"))))
    return records.select("url", F.inline(answers)).select("url", "accept_header", "status_code", "content_hash")


def parse_results(spark: SparkSession, path: str) -> DataFrame:
    """Parse results as they are stored: html_path, signals and evidence of each page."""
    return _records(spark, PARSED, path)


def score_files(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all *_scores.json below ``root`` with their file, corpus and time; malformed files are skipped."""
    rows = spark.read.schema(f"{SCORE}, bad string").option("columnNameOfCorruptRecord", "bad").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_scores.json").json(root)
    parts = F.split("_metadata.file_path", "/")
    rows = rows.select("*", F.col("_metadata.file_path").alias("score_file"), F.element_at(parts, -2).alias("corpus"), F.col("_metadata.file_modification_time").alias("evaluated_at"), F.monotonically_increasing_id().alias("pos"))
    return rows.where("bad is null and url is not null").drop("bad")


def with_snapshot_names(pages: DataFrame) -> DataFrame:
    return pages.withColumn("html_path", snapshot_name(F.col("url")))


# Status codes that redirect, and hops after which a walk ends.
REDIRECTS, MOST_HOPS = (301, 302, 303, 307, 308), 10


def last_answers(responses: DataFrame) -> DataFrame:
    """at, answer (status, headers, html, ms): of several responses of a url the last, by ``timestamp`` or ``seq`` where there is one.

    Without either, an answer that is no error counts before errors, so that a result doesn't depend on the rows' order.
    """
    answer = F.struct("status", "headers", "html", "ms")
    order = next((F.struct(F.col(c), F.lit(0)) for c in ("timestamp", "seq") if c in responses.columns), F.struct(F.col("status").between(200, 399), F.xxhash64("html", "ms")))
    return responses.groupBy(F.col("url").alias("at")).agg(F.max_by(answer, order).alias("answer"))


def redirect_edges(held: DataFrame) -> DataFrame:
    """at, end, hops of each url whose answer redirects: one hop."""
    location = F.try_element_at(F.transform_keys("answer.headers", lambda k, _: F.lower(k)), F.lit("location"))
    rows = held.where(F.col("answer.status").isin(*REDIRECTS)).select("at", "answer", location.alias("location")).where("coalesce(location, '') <> ''")
    whole = F.col("location").rlike("^https?://")
    rows = rows.withColumn("end", F.when(whole, F.col("location")).otherwise(F.pandas_udf(_joined, "string")("at", F.when(~whole, F.col("location")))))
    hop = F.struct(F.col("at").alias("from_url"), F.col("end").alias("to_url"), F.col("answer.status").alias("status_code"), F.col("answer.ms").alias("redirect_time_ms"), F.col("answer.headers").alias("headers"))
    return rows.select("at", "end", F.array(hop).alias("hops"))


def onward(paths: DataFrame, more: DataFrame, hot: DataFrame) -> DataFrame:
    """Paths (at, end, hops) prolonged by the paths ``more`` of their ends; where there is none they stay."""
    side = copied(more.select(F.col("at").alias("end"), F.col("end").alias("then"), F.col("hops").alias("more")), hot, "end")
    met = dealt(paths, hot, "end", F.col("at")).join(side, ["end", "cell"], "left")
    return met.select("at", F.coalesce("then", "end").alias("end"), F.concat("hops", F.coalesce("more", F.array().cast(f"array<{HOP}>"))).alias("hops"))


def walked(urls: DataFrame, responses: DataFrame) -> DataFrame:
    """Crawl records of (url), each walked through recorded ``responses`` (url, status, headers, html, ms).

    Locations may be relative.  A walk ends at an answer that doesn't redirect or says no location, with the hop that leads to
    a target for the second time, or after MOST_HOPS hops; then the answer of where it has come to counts.  A url without a
    response ends it with status 0 and no snapshot.

    Paths are doubled: the hops of all urls are joined with themselves to paths of two, four and eight, so a walk takes
    four joins, not one for each hop.  Targets that a large share of urls leads to are dealt to cells.
    """
    held = durable(last_answers(responses))
    one = durable(redirect_edges(held))
    hot = hot_keys(one, "end")
    two = durable(onward(one, one, hot))
    four = durable(onward(two, two, hot_keys(two, "end")))
    start = urls.select("url").distinct().select(F.col("url").alias("at"), F.col("url").alias("end"), F.array().cast(f"array<{HOP}>").alias("hops"))
    none = one.where("false").select("end").withColumn("cells", F.lit(1))  # start urls are distinct
    paths = durable(onward(start, four, none))
    paths = durable(onward(paths, four, hot_keys(paths, "end")))
    paths = durable(onward(paths, two, hot_keys(paths, "end")))

    # a walk has gone too far if it went on behind a target that it reached for the second time
    targets = F.transform("hops", lambda h: h["to_url"])
    again = F.filter(F.transform("hops", lambda h, k: F.when(F.array_position(targets, h["to_url"]) <= k, k + 1)), lambda k: k.isNotNull())
    length = F.least(F.size("hops"), F.coalesce(F.array_min(again), F.lit(MOST_HOPS)), F.lit(MOST_HOPS))
    cut = paths.withColumn("looped", F.array_min(again).isNotNull()).withColumn("hops", F.slice("hops", F.lit(1), length)).withColumn("end", F.coalesce(F.get("hops", F.size("hops") - 1)["to_url"], F.col("at")))
    ends = hot_keys(cut, "end")
    rows = dealt(cut, ends, "end", F.col("at")).join(copied(held.withColumnRenamed("at", "end"), ends, "end"), ["end", "cell"], "left")
    status, failed = F.coalesce("answer.status", F.lit(0)), F.col("answer.status").isNull()
    unled = status.isin(*REDIRECTS) & ~F.col("looped") & (F.size("hops") < MOST_HOPS)  # it is asked for again
    total = F.aggregate("hops", F.when(unled, F.coalesce("answer.ms", F.lit(0.0))).otherwise(0.0), lambda s, h: s + F.coalesce(h["redirect_time_ms"], F.lit(0.0)))
    return rows.select(
        F.col("at").alias("url"), status.alias("status"), "answer.headers", F.when(status > 0, snapshot_name(F.col("at"))).otherwise("").alias("html_path"), F.col("hops").alias("redirect_chain"), F.size("hops").alias("redirect_count"),
        F.when(failed, 0.0).otherwise(total).alias("total_redirect_time_ms"), F.coalesce("answer.ms", F.lit(0.0)).alias("final_response_time_ms"), F.when(failed, F.col("at")).otherwise(F.col("end")).alias("final_url"), "answer.html",
    )


def _joined(base: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b, t) if t else None for b, t in zip(base, target, strict=True)], dtype=object)


class Recorded(DataSource):
    """``recorded_crawl``: replays crawl records from JSON lines; where a live crawler would fetch, this one reads.

    Each path is one partition.  A live fetcher is a subclass of Replay that overrides ``fetch``.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_crawl"

    def schema(self) -> str:
        return "url string, status int, html string"

    def reader(self, schema) -> DataSourceReader:
        return Replay(self.options["paths"].split(","))


class Replay(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def fetch(self, partition: InputPartition) -> Iterator[dict]:
        import json

        with open(partition.value) as lines:
            yield from map(json.loads, lines)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in self.fetch(partition):
            yield row["url"], int(row.get("status", 0)), row.get("html")
