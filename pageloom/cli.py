"""Command line: parse, score, report, express, history and negotiate over tables of pages and crawl records."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pageloom.plans import benchmarks
from pageloom.plans.benchmarks import URL_SETS


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pageloom")
    sub = top.add_subparsers(dest="command", required=True)
    pages = argparse.ArgumentParser(add_help=False)
    pages.add_argument("pages", help="parquet of page_id, url, html")
    pages.add_argument("--out", required=True)
    c = sub.add_parser("crawl", help="walk urls through recorded responses (JSON lines of url, status, headers, html, ms) to crawl records and a pages table")
    c.add_argument("records", nargs="+")
    c.add_argument("--out", required=True)
    c.add_argument("--urls", nargs="*", help="urls to walk; without any, those of the records")
    c.add_argument("--urls-file")
    c.add_argument("--stdin", action="store_true")
    t = sub.add_parser("study", help="rows of a study's tables below a folder")
    t.add_argument("--root", required=True)
    e = sub.add_parser("parse", parents=[pages])
    e.add_argument("--json", action="store_true", help="parse results in their stored form")
    for name in ("score", "express"):
        p = sub.add_parser(name, parents=[pages])
        p.add_argument("--render-mode", choices=("raw", "rendered", "both"), default="raw")
        p.add_argument("--quiet", action="store_true")
        p.add_argument("--crawl", help="parquet of crawl records, as crawl writes it")
        p.add_argument("--robots", help="parquet of host, robots_status, robots_txt")
        p.add_argument("--name", help="a name for the run, kept in its record")
        p.add_argument("--performance", action="store_true", help="pages are spread over all cores before they are parsed (the default)")
        p.add_argument("--standard", action="store_true", help="pages are parsed as their files are split, for comparison")
        p.add_argument("--benchmark", action="store_true", help="time both ways and print pages a second")
        p.add_argument("--summary", help="also write a JSON summary of the run there")
    r = sub.add_parser("report")
    r.add_argument("scores")
    r.add_argument("--out", required=True, help="a folder; its parts by name are the report")
    r.add_argument("--parts", type=int, help="1 for a single part")
    r.add_argument("--presentation", help="also write <stem>.json, <stem>.csv and <stem>.md")
    h = sub.add_parser("history")
    h.add_argument("url")
    h.add_argument("--root", required=True)
    h.add_argument("--json", action="store_true")
    h.add_argument("--out", help="write the table there as ordered parts, for long histories")
    b = sub.add_parser("benchmark", help="list the url sets, write one, or validate a result file against the expected scores")
    b.add_argument("--set", choices=tuple(URL_SETS))
    b.add_argument("--scores", help="JSON of score rows or (url, score) rows")
    b.add_argument("--out")
    n = sub.add_parser("negotiate")
    n.add_argument("responses", help="parquet of url, accept_header, status_code, content_hash, or JSON of stored records")
    n.add_argument("--out", required=True)
    n.add_argument("--json", action="store_true", help="read and write records in their stored form")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from pageloom.functions.storage import exists, write_small
    from pageloom.operators import analytics, negotiation
    from pageloom.plans.scores import component_map, environment, page_features, score_pages
    from pageloom.sources import readers, reports, writers

    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pageloom").getOrCreate()
    if args.command == "crawl":
        schema = "url string, status int, headers map<string,string>, html string, ms double"
        responses = spark.read.schema(schema).json(args.records).withColumn("seq", F.monotonically_increasing_id())
        given = args.urls or args.urls_file or args.stdin
        urls = readers.urls_of(spark, args.urls, sys.stdin.readlines() if args.stdin else None, args.urls_file) if given else responses.select("url")
        rows = readers.walked(urls, responses)
        writers.write_table(rows.drop("html"), f"{args.out.rstrip('/')}.crawl")
        pages = rows.where("status between 200 and 399").select(F.monotonically_increasing_id().alias("page_id"), "url", "html")
        writers.write_table(pages, args.out)
    elif args.command == "study":
        for name in ("pages", "pairs", "reviews", "answers", "grades"):
            path = f"{args.root}/{name}.parquet"
            print(name, spark.read.parquet(path).count() if exists(spark, path) else "none")
    elif args.command == "parse":
        rows = page_features(spark.read.parquet(args.pages))
        writers.write_json(writers.parse_rows(rows), args.out) if args.json else writers.write_table(rows.drop("html"), args.out)
    elif args.command in ("score", "express"):
        modes = ("raw", "rendered") if args.render_mode == "both" else (args.render_mode,)
        read = lambda path: spark.read.parquet(path) if path else None
        scored = lambda spread: score_pages(read(args.pages), modes=modes, crawl=read(args.crawl), robots_files=read(args.robots), over_cores=spread).withColumn("component_scores", component_map())
        scores = scored(not args.standard)
        writers.write_table(scores, args.out)
        write_small(spark, f"{args.out.rstrip('/')}.run.json", json.dumps({"name": args.name, "render_mode": args.render_mode, "environment": environment(spark)}))
        written = spark.read.parquet(args.out).withColumn("pos", F.monotonically_increasing_id())
        if not args.quiet:
            print(writers.markdown(analytics.run_summary(written)))
        if args.summary:
            writers.write_summary(written, args.summary)
        if args.benchmark:
            for way, spread in (("performance", True), ("standard", False)):
                began = time.perf_counter()
                scored(spread).write.format("noop").mode("overwrite").save()
                print(f"{way}: {written.count() / (time.perf_counter() - began):.1f} rows a second")
        if args.command == "express":
            reports.write_report(written, f"{args.out.rstrip('/')}.md")
    elif args.command == "report":
        rows = spark.read.parquet(args.scores).withColumn("pos", F.monotonically_increasing_id())
        reports.write_report(rows, args.out, args.parts)
        if args.presentation:
            writers.write_presentation(rows, args.presentation)
    elif args.command == "history":
        rows = analytics.score_history(readers.score_files(spark, args.root), args.url).orderBy("evaluated_at", "score_file", "pos")
        found = rows.count()
        if args.out:
            rows.write.mode("overwrite").json(args.out) if args.json else reports.write_history(rows, args.out)
        else:
            print("\n".join(rows.toJSON().collect()) if args.json else writers.history_table(rows))
        return 0 if found else 1
    elif args.command == "benchmark":
        if args.set:
            writers.write_lines(benchmarks.url_set(spark, args.set).coalesce(1).sortWithinPartitions("place"), "url", args.out)
        elif args.scores:
            rows = readers.result_scores(spark, args.scores).withColumnRenamed("score", "parseability_score")
            validated = analytics.benchmark_validation(rows, benchmarks.expectations(spark))
            if args.out:
                reports.write_validation(validated, args.out)
            else:
                print(writers.validation_report(validated))
            return 0 if analytics.validation_rates(validated).where("category = 'all' and gate").count() else 1
        else:
            print(writers.markdown(benchmarks.url_sets(spark)))
    elif args.command == "negotiate":
        responses = readers.negotiation_responses(readers.negotiation_records(spark, args.responses)) if args.json else spark.read.parquet(args.responses)
        found = negotiation.negotiation_scores(responses)
        writers.write_json(writers.negotiation_rows(found, responses), args.out) if args.json else writers.write_table(found, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
