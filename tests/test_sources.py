"""Readers, sinks, the stream and the command line."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from pageloom import cli
from pageloom.constants import PILLARS
from pageloom.functions import skew, text
from pageloom.kernels import charset
from pageloom.operators import analytics
from pageloom.sources import artifacts, readers, reports, writers
from pageloom.streaming import continuous, trend


def test_url_list_keeps_repeats(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# all\n https://a \n\nhttps://b\nhttps://a\n")
    assert [r[0] for r in readers.url_list(spark, str(tmp_path / "u.txt")).collect()] == ["https://a", "https://b", "https://a"]
    assert readers.urls_of(spark, ["x", "#y", " "]).count() == 1


def test_snapshots_join_crawl(spark, tmp_path):
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap/a.html").write_bytes(b"<p>\xff ok</p>")
    (tmp_path / "crawl.json").write_text(json.dumps([{"url": "u1", "status": 200, "html_path": "a.html"}, {"url": "u2"}]))
    pages = readers.crawled_pages(readers.crawl_records(spark, str(tmp_path / "crawl.json")), readers.snapshots(spark, str(tmp_path / "snap"))).collect()
    assert [(p["url"], p["html"]) for p in pages] == [("u1", "<p>ÿ ok</p>")]


def test_charsets():
    page = '<meta charset="%s"><p>größe €</p>'
    for name in ("utf-8", "windows-1252", "iso-8859-15", "utf-16"):
        assert charset.decoded((page % name).encode(name)) == page % name
    assert charset.decoded("<p>größe</p>".encode("cp1252")) == "<p>größe</p>" and charset.decoded(b'<meta charset="nonsense">\xe4') == '<meta charset="nonsense">ä'
    assert charset.decoded(b"") == "" and charset.decoded(None) is None


def walk(url, answers):
    """One request after another, as a crawler makes them."""
    at, hops, spent = url, [], 0.0
    if at not in answers:
        return 0, url, [], 0.0
    while len(hops) < 10:
        status, to, ms = answers[at]
        if status not in (301, 302, 303, 307, 308):
            return status, at, hops, spent
        spent += ms
        if not to:
            break
        hops.append(to)
        at = to
        if hops.count(at) > 1:
            break
        if at not in answers:
            return 0, url, hops, 0.0
    return answers[at][0] if at in answers else 0, at if at in answers else url, hops, spent if at in answers else 0.0


@pytest.mark.parametrize("seed", range(3))
def test_walks_of_a_graph_of_redirects(spark, monkeypatch, seed):
    """Chains, loops of every length, dead ends, and a page that a third of the urls lead to."""
    rng = random.Random(seed)
    names = [f"http://h/{i}" for i in range(400)]
    answers = {u: (rng.choice([200, 404]) if rng.random() < 0.15 else rng.choice([301, 302, 308]), None if rng.random() < 0.03 else "http://h/0" if rng.random() < 0.3 else rng.choice(names), float(rng.randrange(9))) for u in names if rng.random() < 0.97}
    for k, size in enumerate((1, 2, 3, 9, 10, 11)):
        ring = [f"http://r{k}/{i}" for i in range(size)]
        answers |= {u: (301, ring[(i + 1) % size], 1.0) for i, u in enumerate(ring)}
    monkeypatch.setattr(skew, "HOT", 20)
    monkeypatch.setattr(skew, "LEAST", 0)
    responses = spark.createDataFrame([(u, s, {} if t is None else {"location": t}, "<p>", ms) for u, (s, t, ms) in answers.items()], "url string, status int, headers map<string,string>, html string, ms double").repartition(3)
    urls = sorted({*names, *answers, "http://h/unknown"})
    got = readers.walked(spark.createDataFrame([(u,) for u in urls], "url string"), responses).collect()
    assert {r["url"]: (r["status"], r["final_url"], [h["to_url"] for h in r["redirect_chain"]], r["total_redirect_time_ms"]) for r in got} == {u: walk(u, answers) for u in urls} and len(got) == len(urls)


def test_the_last_of_several_responses_counts(spark):
    schema = "url string, status int, headers map<string,string>, html string, ms double, timestamp long"
    rows = [("http://a", 500, None, "late", 1.0, 2), ("http://a", 200, None, "early", 1.0, 1), ("http://b", 200, None, "late", 1.0, 2), ("http://b", 503, None, "early", 1.0, 1)]
    by = lambda df: {r["url"]: r["html"] for r in readers.walked(df.select("url"), df).collect()}
    assert by(spark.createDataFrame(rows, schema)) == {"http://a": "late", "http://b": "late"}
    assert by(spark.createDataFrame(rows, schema).drop("timestamp")) == {"http://a": "early", "http://b": "late"}  # an answer before errors


def test_walks_follow_redirects(spark):
    schema = "url string, status int, headers map<string,string>, html string, ms double"
    hop = lambda url, to, code=301: (url, code, {"Location": to}, None, 10.0)
    held = [hop("http://a/1", "/2"), hop("http://a/2", "http://b/x?y", 308), ("http://b/x?y", 200, {"ETag": "e"}, "<p>", 5.0), hop("http://a/loop", "/pool"), hop("http://a/pool", "/loop", 302), hop("http://a/gone", "http://nowhere/"), ("http://a/bare", 302, {}, None, 1.0)]
    held += [hop(f"http://a/chain{i}", f"/chain{i + 1}") for i in range(15)]
    urls = spark.createDataFrame([(f"http://a/{p}",) for p in ("1", "loop", "gone", "bare", "chain0", "1")], "url string")
    got = {r["url"]: r for r in readers.walked(urls, spark.createDataFrame(held, schema)).collect()}
    one = got["http://a/1"]
    assert (one["status"], one["final_url"], one["redirect_count"], one["total_redirect_time_ms"], one["final_response_time_ms"], one["html"]) == (200, "http://b/x?y", 2, 20.0, 5.0, "<p>")
    assert [(h["from_url"], h["to_url"], h["status_code"]) for h in one["redirect_chain"]] == [("http://a/1", "http://a/2", 301), ("http://a/2", "http://b/x?y", 308)]
    assert (got["http://a/loop"]["redirect_count"], got["http://a/loop"]["status"], got["http://a/loop"]["final_url"]) == (3, 302, "http://a/pool")
    assert (got["http://a/gone"]["status"], got["http://a/gone"]["html_path"]) == (0, "") and got["http://a/bare"]["redirect_count"] == 0 and got["http://a/chain0"]["redirect_count"] == 10


def test_result_scores(spark, tmp_path):
    (tmp_path / "scores.json").write_text(json.dumps([{"html_path": "a.html", "parseability_score": 50.0}, {"html_path": "b.html", "parseability_score": 1.0}]))
    (tmp_path / "list.json").write_text(json.dumps([{"url": "u", "score": 7.0}]))
    crawl = spark.createDataFrame([("a.html", "https://a")], "html_path string, url string")
    assert sorted(map(tuple, readers.result_scores(spark, str(tmp_path / "scores.json"), crawl).collect())) == [("Unknown URL", 1.0), ("https://a", 50.0)]
    assert [tuple(r) for r in readers.result_scores(spark, str(tmp_path / "list.json")).collect()] == [("u", 7.0)]


def test_benchmark_command(spark, tmp_path, capsys):
    assert cli.main(["benchmark"], spark) == 0 and "| mixed | 8 |" in capsys.readouterr().out
    assert cli.main(["benchmark", "--set", "decent", "--out", str(tmp_path / "set")], spark) == 0
    assert readers.url_list(spark, str(tmp_path / "set")).count() == 5
    good = [{"url": "https://docs.github.com/en", "score": 90.0}, {"url": "https://news.ycombinator.com", "score": 40.0}]
    (tmp_path / "r.json").write_text(json.dumps(good))
    assert cli.main(["benchmark", "--scores", str(tmp_path / "r.json")], spark) == 0 and "champion" in capsys.readouterr().out
    (tmp_path / "r.json").write_text(json.dumps([{"url": g["url"], "score": 1.0} for g in good]))
    assert cli.main(["benchmark", "--scores", str(tmp_path / "r.json")], spark) == 1


def test_history_shows_every_row(spark):
    rows = spark.range(350).selectExpr("timestamp_seconds(id) evaluated_at", "'c' corpus", "1.0D parseability_score", "1.0D universal_score", "'article' content_type", "0.0D delta")
    assert len(writers.history_table(rows).splitlines()) == 352


def test_history_skips_malformed_files(spark, tmp_path, capsys):
    for i, rows in enumerate(([{"url": "https://x.example/p", "parseability_score": 50.0}], [{"url": "https://x.example/p/#a", "parseability_score": 60.0}])):
        (tmp_path / f"c{i}").mkdir()
        path = tmp_path / f"c{i}/r_scores.json"
        path.write_text(json.dumps(rows))
        os.utime(path, (time.time() - 100 + i, time.time() - 100 + i))
    (tmp_path / "c0/bad_scores.json").write_text("{not json")
    (tmp_path / "c0/other.json").write_text("[]")
    assert readers.score_files(spark, str(tmp_path)).count() == 2
    assert cli.main(["history", "https://x.example/p", "--root", str(tmp_path)], spark) == 0
    assert "10.0" in capsys.readouterr().out
    assert cli.main(["history", "https://nowhere.example", "--root", str(tmp_path)], spark) == 1


def test_recorded_source(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"url": "u", "status": 200, "html": "<p>"}\n{"url": "v"}\n')
    spark.dataSource.register(readers.Recorded)
    rows = spark.read.format("recorded_crawl").option("paths", str(tmp_path / "r.jsonl")).load()
    assert sorted((r["url"], r["status"]) for r in rows.collect()) == [("u", 200), ("v", 0)]


def test_crawl_command_replays_records(spark, tmp_path, capsys):
    (tmp_path / "r.jsonl").write_text('{"url": "u", "status": 200, "html": "<p>"}\n{"url": "v", "status": 404}\n')
    assert cli.main(["crawl", str(tmp_path / "r.jsonl"), "--out", str(tmp_path / "pages.parquet")], spark) == 0
    assert [r["url"] for r in spark.read.parquet(str(tmp_path / "pages.parquet")).collect()] == ["u"]
    writers.write_lines(spark.read.parquet(str(tmp_path / "pages.parquet")), "url", str(tmp_path / "set"))
    assert readers.url_list(spark, str(tmp_path / "set")).count() == 1
    assert cli.main(["study", "--root", str(tmp_path)], spark) == 0 and "pages 1" in capsys.readouterr().out


def joined(folder):
    """A report's parts, one after another by name."""
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_report_parts_are_one_ordered_text(spark, tmp_path, monkeypatch):
    """Many parts and one part hold the same text; pages come worst first; no page passes through the driver."""
    rows = spark.range(3000).selectExpr("id AS pos", "id AS page_id", "concat('https://p', id, '.example/x') AS url", "'' AS html_path", "if(id % 2 = 0, 'raw', 'rendered') AS render_mode", "if(id % 3 = 0, 'faq', 'article') AS content_type", *(f"cast((id * {k}) % 101 AS double) AS {p}" for k, p in enumerate(PILLARS, 7)), "cast((id * 31) % 101 AS double) AS parseability_score", "50D AS universal_score", "'severe_issues' AS failure_mode", "array('No headings found', concat('e', id)) AS evidence", "if(id % 2 = 0, '', concat('a', chr(10), 'b')) AS preview")
    monkeypatch.setattr(type(rows), "toLocalIterator", lambda *_: pytest.fail("pages on the driver"))
    monkeypatch.setattr(type(rows), "collect", lambda *_: pytest.fail("pages on the driver"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        reports.write_report(rows.repartition(5), str(tmp_path / "many"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    reports.write_report(rows, str(tmp_path / "one"), parts=1)
    assert len(list((tmp_path / "many").glob("part-*"))) > 1 and len(list((tmp_path / "one").glob("part-*"))) == 1
    text = joined(tmp_path / "many")
    assert text == joined(tmp_path / "one") and text.startswith("# Page access report\n") and text.count("\n### ") == 3000
    shown = [float(line.split()[1].rstrip(",")) for line in text.splitlines() if line.startswith("Score ")]
    assert shown == sorted(shown)
    assert [line for line in text.splitlines() if line.startswith("## ")] == [f"## {x}" for x in ("Summary", "Failure modes", "Raw against rendered", "Shared templates", "Profile impact", "Pages", "Recommendations")]
    assert "> a b\n" in text and "> (nothing extracted)" in text and "No heading structure" in text and " as faq, universal 50.0" in text


def test_page_report_says_what_the_rules_say(spark, tmp_path):
    one = {"pos": 1, "page_id": 1, "url": "https://a.example", "html_path": "", "render_mode": "raw", "content_type": "article", **dict.fromkeys(PILLARS, 90.0), "parseability_score": 60.0, "universal_score": 60.0, "failure_mode": "moderate_issues"}
    low = one | {"semantic_html": 30.0, "http_compliance": 60.0, "metadata_completeness": None}
    df = spark.createDataFrame([low], ", ".join(f"{k} {'long' if k in ('pos', 'page_id') else 'double' if isinstance(v, float) else 'string'}" for k, v in one.items()))
    row = reports.page_findings(df).first()
    assert [(f["pillar"], f["priority"], f["impact"], round(f["gain"], 6)) for f in row["findings"]] == [("semantic_html", "critical", "High", 10.0), ("http_compliance", "important", "Low", 1.0)]
    assert row["owner"] == "Frontend Developer" and len(row["causes"]) == 2 and "metadata_completeness" not in row["pillars"]
    reports.write_report(df, str(tmp_path / "r"))
    text = joined(tmp_path / "r")
    assert "- 1 pages: wrap content in <main>" in text and text.index("wrap content") < text.index("answer directly")


def test_histories_and_validations_as_ordered_parts(spark, tmp_path):
    rows = spark.range(2000).selectExpr("timestamp_seconds(100000 - id) evaluated_at", "'c' corpus", "cast(id AS double) parseability_score", "1.0D universal_score", "'article' content_type", "cast(null AS double) delta", "'f' score_file", "id AS pos").repartition(4)
    reports.write_history(rows, str(tmp_path / "h"))
    lines = joined(tmp_path / "h").splitlines()
    assert lines[0] == "# Score history" and [line.split(" | ")[2] for line in lines[4:]] == [f"{i:.1f}" for i in range(1999, -1, -1)] and lines[4].endswith("|  |")
    spread = spark.createDataFrame([("a", 1.0, 0.5, "high", False), ("b", 2.0, 9.0, "low", True)], "url string, mean double, stdev double, band string, inconsistent boolean")
    reports.write_consistency(spread, str(tmp_path / "c"))
    text = joined(tmp_path / "c")
    assert text.index("| b |") < text.index("| a |") and "WARN" in text


def test_express_writes_scores_and_report(spark, small, tmp_path, capsys):
    out = str(tmp_path / "scores")
    assert cli.main(["express", f"{small}/pages.parquet", "--out", out, "--render-mode", "both"], spark) == 0
    assert spark.read.parquet(out).count() == 100
    text = joined(tmp_path / "scores.md")
    assert "Shared templates" in text and text.count("\n### ") == 50 and "Rendered against raw" in text and "mean_score" in capsys.readouterr().out
    assert text.count("- Owner: ") == 50 and text.count("- Evidence: ") > 100 and "| Fix | Impact |" in text and "```html" in text and text.index("## Pages") < text.index("## Recommendations") < text.index(" pages: ")
    assert "> " in text and "headings" in text
    assert "spark" in json.loads((tmp_path / "scores.run.json").read_text())["environment"]
    assert cli.main(["report", out, "--out", str(tmp_path / "again.md"), "--presentation", str(tmp_path / "deck")], spark) == 0
    assert spark.read.json(str(tmp_path / "deck.json")).count() == 100 and "ready_percent" in (tmp_path / "deck.md").read_text()
    writers.write_csv(spark.read.parquet(out).select("url"), str(tmp_path / "csv"))
    writers.write_json(spark.read.parquet(out), str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 100


def test_stored_forms_round_trip(spark, small, tmp_path, capsys):
    assert cli.main(["parse", f"{small}/pages.parquet", "--out", str(tmp_path / "parsed"), "--json"], spark) == 0
    got = readers.parse_results(spark, str(tmp_path / "parsed"))
    assert got.count() == 50 and got.where("signals.has_main_element is not null and size(evidence) >= 3 and signals.agent_content_hints['has_llm_hints'] = 'false'").count() > 0
    answer = lambda kind, status, digest: {"accept_header": kind, "content_type": kind, "content_length": 5, "status_code": status, "content_hash": digest, "html_path": "a.html", "response_time_ms": 3}
    records = [{"url": "u", "timestamp": "2024-01-01T00:00:00", "baseline_format": answer("text/html", 200, "0"), "alternative_formats": [answer("text/markdown", 200, "1"), answer("text/plain", 406, "2")], "format_availability_score": 0.0}, {"url": "v", "baseline_format": answer("text/html", 500, "0"), "alternative_formats": []}]
    (tmp_path / "neg.json").write_text(json.dumps(records))
    assert cli.main(["negotiate", str(tmp_path / "neg.json"), "--out", str(tmp_path / "scored"), "--json"], spark) == 0
    again = spark.read.schema(readers.NEGOTIATION).json(str(tmp_path / "scored"))
    first = {tuple(r) for r in readers.negotiation_responses(readers.negotiation_records(spark, str(tmp_path / "neg.json"))).collect()}
    assert first == {tuple(r) for r in readers.negotiation_responses(again).collect()} and len(first) == 4
    by = {r["url"]: r for r in again.collect()}
    assert by["u"]["format_availability_score"] == 72.5 and by["u"]["agent_optimization_detected"] and by["v"]["format_availability_score"] == 0


def test_score_modes_give_the_same_rows(spark, small, tmp_path, capsys):
    for mode in ("--standard", "--performance"):
        assert cli.main(["score", f"{small}/pages.parquet", "--out", str(tmp_path / mode), mode, "--quiet", "--render-mode", "raw", "--summary", str(tmp_path / f"{mode}.json")], spark) == 0
    one, two = (spark.read.parquet(str(tmp_path / m)).select("page_id", "parseability_score", "failure_mode", "evidence", "preview") for m in ("--standard", "--performance"))
    assert one.exceptAll(two).isEmpty() and one.count() == two.count() == 50
    summary = json.loads((tmp_path / "--standard.json").read_text())
    assert summary["pages"] == 50 and sum(summary["failure_modes"].values()) == 50 and set(summary["pillar_means"]) == set(PILLARS)
    assert cli.main(["score", f"{small}/pages.parquet", "--out", str(tmp_path / "b"), "--quiet", "--benchmark"], spark) == 0
    assert capsys.readouterr().out.count("rows a second") == 2


def test_stream_scores_each_page_once(spark, small, tmp_path):
    pages = spark.read.parquet(f"{small}/pages.parquet").limit(5).withColumn("crawled_at", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    pages.union(pages).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = continuous.scored_stream(continuous.page_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("scored")
    assert got.count() == 5 and got.where("parseability_score > 0").count() == 5
    assert continuous.daily_scores(got).first()["pages"] == 5


def score_files(spark, tmp_path, seed=1):
    """Scores of a few urls in two files, the second later than the first."""
    rng = random.Random(seed)
    rows = [(f"f{i // 100}", i, f" https://h{rng.randrange(9)}.example/a/#x", None if rng.random() < 0.2 else float(rng.randrange(100))) for i in range(200)]
    df = spark.createDataFrame(rows, "score_file string, pos long, url string, parseability_score double").withColumn("evaluated_at", F.timestamp_seconds(F.col("pos") * 60))
    df = df.select("score_file", "pos", "evaluated_at", "url", "parseability_score")
    for k in range(2):
        df.where(f"score_file = 'f{k}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in order of their times
    return df


def test_trend_over_batches_is_the_history_of_the_whole(spark, tmp_path):
    df = score_files(spark, tmp_path)
    trend.use_rocksdb(spark)
    try:
        stream = trend.score_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
        trend.write_trend(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch").distinct().count() == 2
    want = analytics.score_history(df.withColumn("url", text.normal_url(F.col("url"))), None, "url")
    named = lambda rows: {(r["score_file"], r["pos"]): (r["url"], r["parseability_score"], r["delta"]) for r in rows.collect()}
    assert named(out) == named(want) and not out.where("late").count() and out.where("delta is not null").count() > 100


def test_a_replayed_batch_adds_no_row(spark, tmp_path):
    write = trend.append_once(str(tmp_path / "t"))
    df = spark.range(10)
    for batch in (0, 1, 1, 0):
        write(df.where(f"id % 2 = {batch}"), batch)
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.count() == 10 and {(r["batch"], r["id"] % 2) for r in got.collect()} == {(0, 0), (1, 1)}


def test_artifacts_are_files_by_name(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('set', id % 3, '/page-', id, '.md') AS name", "if(id = 7, null, concat('text é ', id)) AS content").repartition(4)
    out = tmp_path / "out"
    artifacts.write_artifacts(spark, rows, str(out))
    assert len(list(out.rglob("*.md"))) == 40 and (out / "set2/page-5.md").read_text() == "text é 5" and (out / "set1/page-7.md").read_text() == ""
    assert not list(out.glob("_staging/*"))
    artifacts.write_artifacts(spark, rows.limit(1).selectExpr("'set2/page-5.md' AS name", "'new' AS content"), str(out))
    assert (out / "set2/page-5.md").read_text() == "new" and len(list(out.rglob("*.md"))) == 40
    artifacts.write_artifacts(spark, spark.createDataFrame([("only.md", "x")], "name string, content string"), str(out), mode="overwrite")
    assert [p.name for p in out.rglob("*.md")] == ["only.md"]


@pytest.mark.parametrize("bad", ["../out.md", "a/../../b.md", "", "_staging/x"])
def test_an_aborted_job_of_artifacts_leaves_nothing(spark, tmp_path, bad):
    rows = spark.createDataFrame([(f"p{i}.md", "x") for i in range(20)] + [(bad, "y")], "name string, content string").repartition(3)
    with pytest.raises(Exception, match="no name of an artifact"):
        artifacts.write_artifacts(spark, rows, str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()] and not list((tmp_path / "out").glob("_staging/*"))


def test_sessions(spark, small):
    rows = continuous.event_windows(spark.read.parquet(f"{small}/events.parquet"))
    assert rows.agg(F.sum("events")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()

# Sentences in the charsets that their languages are written in.
SENTENCES = {
    "cp1252":["Le café était fermé, mais où est passé l’élève français à l’hôtel ?","Die Straße führt über schöne Brücken, größer als früher.","El niño comió jamón y bebió café en la mañana; ¿qué pasó?","A informação não é só para você, é também para nós: ações e corações.","Perché la città è così bella? Più di là, però.","Smørrebrød på en båd, ærligt talt, og få øl.","It’s a “quoted” sentence – with a dash… and a café."],
    "cp1250":["Zażółć gęślą jaźń, proszę państwa, książka leży na półce obok łóżka.","Příliš žluťoučký kůň úpěl ďábelské ódy, řekl člověk včera večer.","Az őszinte fű között űrhajós ült, és hűvös volt az idő."],
    "cp1254":["Bugün hava çok güzel, ağaçların altında oturup şarkı söylüyoruz; ışık ığdır."],
    "cp1251":["Съешь ещё этих мягких французских булок, да выпей чаю. Привет, мир!","Київ є столицею України, її найбільшим містом і центром."],
    "koi8_r":["Съешь ещё этих мягких французских булок, да выпей чаю. Привет, мир!"],
    "cp866":["Съешь этих мягких французских булок, да выпей чаю. Привет, мир!"],
    "iso8859_5":["Съешь ещё этих мягких французских булок, да выпей чаю. Привет, мир!"],
    "cp1253":["Η γρήγορη καφετιά αλεπού πηδά πάνω από το τεμπέλικο σκυλί."],
    "cp1255":["השועל החום המהיר קופץ מעל הכלב העצלן בכל יום של השבוע."],
    "cp1256":["الثعلب البني السريع يقفز فوق الكلب الكسول في كل يوم من أيام الأسبوع"],
    "cp932":["素早い茶色の狐がのろまな犬を飛び越える。今日はとても良い天気ですね。","東京都は日本の首都であり、人口が最も多い都市です。"],
    "euc_jp":["素早い茶色の狐がのろまな犬を飛び越える。今日はとても良い天気ですね。"],
    "gb18030":["敏捷的棕色狐狸跳过了懒狗。今天的天气很好，我们一起去公园散步吧。","中国的首都是北京，它是全国的政治和文化中心。"],
    "cp950":["敏捷的棕色狐狸跳過了懶狗。今天的天氣很好，我們一起去公園散步吧。"],
    "cp949":["빠른 갈색 여우가 게으른 개를 뛰어넘는다. 오늘은 날씨가 매우 좋습니다.","대한민국의 수도는 서울이며 인구가 가장 많은 도시이다."],
    "utf-16-le":["Съешь ещё этих мягких булок <p>x</p>","素早い茶色の狐 <b>a</b>"],"utf-16-be":["hello world <p>","素早い茶色の狐 <b>a</b>"],"utf-32-le":["hello <p>é"],
    "iso2022_jp":["素早い茶色の狐"],
}


@pytest.mark.parametrize("name", sorted(SENTENCES))
def test_charsets_are_found_without_a_declaration(name):
    for sentence in SENTENCES[name]:
        for page in ("{}", '<html><head><title>A page</title></head><body class="x"><p>{}</p><a href="/en/">more</a></body></html>'):
            content = page.format(sentence).encode(name)
            assert content.decode(charset.detect(content)) == page.format(sentence)


def test_charset_marks_declarations_and_junk():
    assert charset.decoded("\ufeffé".encode("utf-16-le")) == "é" and charset.decoded("é".encode("utf-8-sig")) == "é" and charset.decoded("é".encode("utf-32")) == "é"
    russian = SENTENCES["cp1251"][0]
    assert charset.decoded(b'<meta charset="nonsense"><meta charset="iso-8859-1">' + "é".encode("cp1252")).endswith("é")
    assert charset.decoded(b'<?xml version="1.0" encoding="koi8-r"?>' + russian.encode("koi8_r")).endswith(russian)
    assert charset.decoded(b'<meta charset="utf-8">' + russian.encode("cp1251")).endswith(russian)  # a declaration that can't be true
    assert charset.decoded(None) is None and charset.decoded(b"") == "" and charset.decoded(b"plain") == "plain"
    assert isinstance(charset.decoded(bytes(range(256)) * 50), str) and charset.decoded(b"\x00\x01") == "\x00\x01"
    long = ("x" * 99 + "é") * 100_000
    assert charset.decoded(long.encode("cp1252")) == long
