"""Row fixtures of the analytics: clusters, deltas, history, comparisons, grading and statistics."""

import datetime as dt
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pageloom.constants import PILLARS, PROFILE_WEIGHTS
from pageloom.functions import skew, stats, text
from pageloom.functions.order import running, running_by
from pageloom.operators import analytics, calibration, negotiation, pillars, robots, scoring
from pageloom.operators.agent_perf import Visible, extract_answer

FIELDS = "url string, html_path string, " + ", ".join(f"{p} double" for p in PILLARS) + ", parseability_score double, universal_score double, content_type string, failure_mode string, render_mode string, pos long"


def score_table(spark, rows):
    base = dict.fromkeys(PILLARS, 90.0) | {"html_path": "", "parseability_score": 80.0, "universal_score": 80.0, "content_type": "article", "failure_mode": "minor_issues", "render_mode": "raw"}
    filled = [base | {"url": f"u{i}", "pos": i} | r for i, r in enumerate(rows)]
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in filled], FIELDS)


def test_weights_sum_to_one():
    assert all(sum(w) == pytest.approx(1) for w in PROFILE_WEIGHTS.values())


def test_profiles_change_the_score(spark):
    rows = score_table(spark, [dict(zip(PILLARS, (50.0, 10.0, 90.0, 50.0, 50.0, 50.0), strict=True)), dict(zip(PILLARS, (60.0, 10.0, 85.0, 70.0, 70.0, 70.0), strict=True)), dict(zip(PILLARS, (None,) * 6, strict=True))])
    got = rows.select(*(scoring.weighted_score(p).alias(p) for p in ("faq", "article", "landing"))).collect()
    assert (got[0]["faq"], got[0]["article"]) == (pytest.approx(56.0), pytest.approx(50.0))
    assert (got[1]["landing"], got[1]["article"]) == (pytest.approx(66.0), pytest.approx(58.5))
    assert got[2]["faq"] == 0


def test_clusters(spark):
    rows = [{"structured_data": s, "dom_navigability": 35.0} for s in (12.4, 11.6, 12.0)]
    got = {(r["pillar"], r["score"]): r for r in analytics.template_clusters(score_table(spark, rows)).collect()}
    assert set(got) == {("structured_data", 12.0), ("dom_navigability", 35.0)}
    assert got["structured_data", 12.0]["members"] == 3 and got["structured_data", 12.0]["uplift"] == pytest.approx(11.6)
    assert analytics.template_clusters(score_table(spark, rows[:2])).count() == 0
    missing = [{"structured_data": 12.0}, {"structured_data": 12.0}, {"structured_data": None}]
    assert analytics.template_clusters(score_table(spark, missing)).count() == 0
    assert analytics.template_clusters(score_table(spark, [])).count() == 0


def test_render_deltas(spark):
    pair = lambda u, a, b: [{"url": u, "parseability_score": a}, {"url": u, "parseability_score": b, "render_mode": "rendered"}]
    rows = pair("a", 40.0, 72.0) + pair("b", 80.0, 60.0) + pair("c", 70.0, 78.0) + [{"url": "d", "render_mode": "rendered"}, {"url": None}]
    got = [(r["page"], r["delta"], r["flagged"]) for r in analytics.render_deltas(score_table(spark, rows)).collect()]
    assert got == [("a", 32.0, True), ("b", -20.0, True), ("c", 8.0, False)]


def test_profile_impact_gate_and_order(spark):
    rows = [{"parseability_score": 80.0 + d, "content_type": "faq"} for d in (1, 15, -10)]
    assert [r["delta"] for r in analytics.profile_impact(score_table(spark, rows)).collect()] == [15, -10, 1]
    assert analytics.profile_impact(score_table(spark, [{}, {}])).count() == 0


def test_history(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = spark.createDataFrame([("f1", 0, day(1), "https://x.example/page", 50.0), ("f2", 0, day(3), " https://x.example/page/#section", 70.0), ("f3", 0, day(2), "https://x.example/page/", None), ("f4", 0, day(4), "https://other.example/", 1.0)], "score_file string, pos long, evaluated_at timestamp, url string, parseability_score double")
    got = analytics.score_history(rows, "https://x.example/page").orderBy("evaluated_at").collect()
    assert [(r["score_file"], r["delta"]) for r in got] == [("f1", None), ("f3", None), ("f2", 20.0)]


def test_robots(spark):
    lines = spark.createDataFrame([("h", "User-agent: *\nDisallow: /a\nAllow: /a/b # yes\nDisallow:\nUser-agent: x\nDisallow: /")], "host string, robots_txt string")
    pages = spark.createDataFrame([(1, "h", "/a/c"), (2, "h", "/a/b/c"), (3, "h", "/z"), (4, "g", "/a")], "page_id long, host string, path string")
    got = robots.robots_blocked(pages, robots.robots_rules(robots.robots_lines(lines))).orderBy("page_id").collect()
    assert [r["blocked"] for r in got] == [True, False, False, False]


def brute_robots(pages, rules):
    """The first of the longest rules that a path begins with, rule by rule."""
    out = {}
    for i, host, path in pages:
        best = None
        for h, _, allow, rule in sorted(rules, key=lambda r: r[1]):
            if h == host and path.startswith(rule) and (best is None or len(rule) > len(best[0])):
                best = (rule, allow)
        out[i] = best is not None and not best[1]
    return out


def test_robots_hot_host_with_many_rules(spark, monkeypatch):
    """A third of the pages are of one host with 1,000 rules, of which many are prefixes of others."""
    monkeypatch.setattr(skew, "LEAST", 0)
    rng = random.Random(3)
    rules = [("hot", n, rng.random() < 0.5, "/" + "/".join(rng.choices("abc", k=rng.randrange(7))) + rng.choice(["", "x", "/"])) for n in range(1000)]
    rules += [(f"h{k}", n, rng.random() < 0.5, rng.choice(["/", "/a", "/a", "/é/日", "/a/b?c"])) for k in range(20) for n in range(3)]
    pages = [(i, "hot" if i % 3 == 0 else f"h{rng.randrange(30)}", "/" + "/".join(rng.choices(["a", "b", "c", "é", "日"], k=rng.randrange(9)))) for i in range(3000)]
    pages += [(9001, None, "/a"), (9002, "h1", ""), (9003, "HOT", "/")]
    left, right = spark.createDataFrame(pages, "page_id long, host string, path string").repartition(4), spark.createDataFrame(rules, "host string, line_no int, allow boolean, rule string")
    for share in (skew.HOT, 50):
        hot = skew.hot_keys(left, "host", share)
        assert hot.count() < share and "hot" in {r["host"] for r in hot.collect()}
        cells = [r["count"] for r in skew.dealt(left, hot, "host", F.col("page_id")).groupBy("host", "cell").count().collect()]
        assert max(cells) <= 3 * len(pages) / min(share, 100)
        got = robots.robots_blocked(left, rules=right, hot=hot)
        assert {r["page_id"]: r["blocked"] for r in got.collect()} == {**brute_robots(pages[:-3], rules), 9001: False, 9002: False, 9003: False}
    plan = robots.robots_blocked(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "startswith" not in plan.lower() and "NestedLoop" not in plan and "Cartesian" not in plan
    assert robots.robots_blocked(left.limit(0), right).count() == 0 and not any(r["blocked"] for r in robots.robots_blocked(left, right.limit(0)).collect())


def test_robots_of_several_answers(spark):
    urls = spark.createDataFrame([("https://a.example/x",), ("https://b.example/x",), ("https://c.example/x",)], "url string")
    deny, fine = "User-agent: *\nDisallow: /", ""
    files = [("a.example", 1, 200, fine), ("a.example", 2, 200, deny), ("b.example", 1, 200, deny), ("b.example", 2, 500, None), ("c.example", 1, None, None)]
    timed = spark.createDataFrame(files, "host string, timestamp long, robots_status int, robots_txt string")
    by = lambda df: {r["url"][8]: r["robots_blocked"] for r in robots.robots_answers(urls, df).collect()}
    assert by(timed) == {"a": True, "b": False}
    assert by(timed.drop("timestamp"))["b"] is True  # without times an answer that was read counts


def test_negotiation(spark):
    rows = [("a", h, 200, str(i)) for i, h in enumerate(("text/html", "text/markdown", "text/plain", "application/json", "application/xml"))] + [("b", "text/html", 500, "0"), ("c", "text/html", 200, "0"), ("c", "text/plain", 406, "1")]
    got = {r[0]: tuple(r)[1:] for r in negotiation.negotiation_scores(spark.createDataFrame(rows, "url string, accept_header string, status_code int, content_hash string")).collect()}
    assert got == {"a": (100.0, 100.0, True), "b": (0.0, 100.0, False), "c": (50.0, 100.0, False)}


def test_redirects(spark):
    rows = spark.createDataFrame([(None, 0.0, 0.0), ([], 0.0, 10.0), ([301, 200], 50.0, 50.0), ([301] * 6, 0.0, 0.0)], "chain array<int>, a double, b double")
    got = [r[0] for r in rows.select(pillars.redirect_efficiency(F.col("chain"), F.col("a"), F.col("b"))).collect()]
    assert got == [40.0, 40.0, 20 + 5 + 0.0, 15.0]


def test_compare_treats_zero_as_missing(spark):
    old, new = score_table(spark, [{"url": "a", "parseability_score": 0.0}, {"url": "b", "parseability_score": 50.0}]), score_table(spark, [{"url": "a", "parseability_score": 40.0}, {"url": "c"}])
    got = {r["url"]: (r["old"], r["new"], r["delta"]) for r in analytics.compare_runs(old, new).collect()}
    assert got == {"a": (None, 40.0, None), "b": (50.0, None, None), "c": (None, 80.0, None)}


def test_grading(spark):
    rows = spark.createDataFrame([("The port is 8080.", "8080"), ("not in document", "8080"), ("443", "8080"), ("Not in document", ""), ('"8080"', "8080 ")], "a string, t string")
    got = [tuple(r[0]) for r in rows.select(calibration.grade(F.col("a"), F.col("t"))).collect()]
    assert got == [("correct", "substring match"), ("not_in_document", None), ("incorrect", None), ("incorrect", None), ("correct", None)]


def test_reviews(spark):
    rows = spark.createDataFrame([(1, "accept", "g", "g"), (2, "reject", "g", None), (3, "edit", "g", "e"), (4, "edit", "g", None)], "i int, decision string, generated_pair string, edited_pair string")
    assert [(r["i"], r["pair"]) for r in calibration.approved(rows).orderBy("i").collect()] == [(1, "g"), (3, "e")]


def test_statistics(spark):
    rows = [("up", float(i), float(i)) for i in range(5)] + [("down", float(i), -float(i)) for i in range(5)] + [("ties", x, float(i)) for i, x in enumerate((1.0, 2.0, 2.0, 3.0))] + [("flat", 1.0, float(i)) for i in range(4)] + [("one", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "pillar string, score double, accuracy double")
    got = {r["pillar"]: r for r in calibration.correlate(df, resamples=500).collect()}
    assert got["up"]["rho"] == pytest.approx(1) and got["down"]["rho"] == pytest.approx(-1) and got["ties"]["rho"] == pytest.approx(0.9487, abs=1e-4)
    assert got["flat"]["rho"] == 0 and got["one"]["rho"] == 0 and got["one"]["p_value"] == 0
    assert got["ties"]["ci_low"] <= got["ties"]["rho"] <= got["ties"]["ci_high"] + 1e-9
    p = spark.range(1).select(stats.p_value(F.lit(0.5), F.lit(18))).first()[0]
    assert p == pytest.approx(0.0209, abs=1e-4)


def brute_intervals(pairs, resamples, seed=0):
    """Percentiles of rho by multinomial resamples of the rows, ranks made anew in each."""
    rng, found = np.random.default_rng(seed), []
    x, y = (np.array(c) for c in zip(*pairs, strict=True))
    for _ in range(resamples):
        at = rng.integers(0, len(x), len(x))
        a, b = (pd.Series(v[at]).rank().to_numpy() for v in (x, y))
        found.append(np.corrcoef(a, b)[0, 1] if a.std() and b.std() else 0.0)
    return np.percentile(found, [2.5, 97.5])


def test_bootstrap_is_near_the_multinomial_one(spark):
    rng = np.random.default_rng(4)
    groups = {}
    for name, n, slope, steps in (("some", 300, 0.5, 1000), ("none", 200, 0.0, 1000), ("tied", 400, 1.0, 4), ("strong", 150, 4.0, 1000)):
        x = np.round(rng.random(n) * steps) / steps
        groups[name] = list(zip(x.tolist(), (np.round((slope * x + rng.random(n)) * steps) / steps).tolist(), strict=True))
    df = spark.createDataFrame([(g, *p) for g, ps in groups.items() for p in ps], "g string, x double, y double").repartition(3)
    got = {r["g"]: (r["ci_low"], r["ci_high"]) for r in stats.bootstrap(df, "x", "y", "g", 2000).collect()}
    assert got == {r["g"]: (r["ci_low"], r["ci_high"]) for r in stats.bootstrap(df.repartition(5), "x", "y", "g", 2000).collect()}  # however the rows lie
    for g, pairs in groups.items():
        assert got[g] == pytest.approx(brute_intervals(pairs, 2000), abs=0.03)
    plan = stats.bootstrap(df, "x", "y", "g", 40)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "collect_list" in plan  # the list is of the resamples


def test_poisson_draws():
    for rate in (0.5, 1.0, 7.0, 59.0, 61.0, 5000.0):
        got = stats.poisson_draws(np.arange(4000) * 977 - 5, np.full(4000, rate), 20)
        assert got.mean() == pytest.approx(rate, rel=0.03) and got.var() == pytest.approx(rate, rel=0.05) and (got >= 0).all() and (got == np.rint(got)).all()
        assert abs(np.corrcoef(got[:, 0], got[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(got[:-1, 0], got[1:, 0])[0, 1]) < 0.06
    assert (stats.poisson_draws(np.array([9]), np.array([1.0]), 20) == stats.poisson_draws(np.array([3, 9]), np.array([4.0, 1.0]), 20)[1]).all()


@pytest.mark.parametrize("seed", range(3))
def test_running_sums_within_groups_over_several_ranges(spark, seed):
    """One group over most ranges, groups within a range, null groups and two columns of groups."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, "a", "a", "a", "a", "b", f"c{rng.randrange(6)}"]), rng.randrange(2), k, rng.randrange(9), rng.random()) for k in rng.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "g string, h int, k int, a long, b double").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r["k"]: (r["place"], r["a_upto"], r["b_upto"]) for r in running_by(df, ["g", "h"], [F.col("k")], place="place", a_upto="a", b_upto="b").collect()}
        ranks = stats.value_ranks(df.withColumn("v", F.col("a")), "v", "r", "g").collect()
        plan = running_by(df, ["g"], [F.col("k")], a_upto="a")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    for g, h in {(r[0], r[1]) for r in rows}:
        a = b = 0
        for place, r in enumerate(sorted((r for r in rows if r[:2] == (g, h)), key=lambda r: r[2]), 1):
            a, b = a + r[3], b + r[4]
            assert got[r[2]][:2] == (place, a) and got[r[2]][2] == pytest.approx(b)
    for r in ranks:
        mine = [x[3] for x in rows if x[0] == r["g"]]
        assert r["r"] == pd.Series(mine).rank()[mine.index(r["v"])] and r["r_rows"] == mine.count(r["v"])
    assert all("range" in line for line in plan.splitlines() if "Window [" in line)
    assert running_by(df.limit(0), ["g"], [F.col("k")], a_upto="a").count() == 0


def test_drift_joins_only_buckets_that_differ(spark, tmp_path):
    old = [(f"u{i}", f"v{i % 7}", None if i % 3 else float(i)) for i in range(5000)]
    new = [r for r in old if r[0] not in ("u3", "u4")] + [("new", "x", 1.0)]
    new = [(u, "changed", x) if u == "u10" else (u, v, None) if u == "u12" else (u, v, 5.0) if u == "u13" else (u, v, x) for u, v, x in new]
    a, b = (spark.createDataFrame(r, "url string, v string, x double").repartition(3) for r in (old, new))
    got = {r["url"]: r["drift"] for r in analytics.golden_drift(a, b, "v", "x").collect()}
    assert got == {"u3": "missing", "u4": "missing", "new": "added", "u10": "changed", "u12": "changed", "u13": "changed"}
    assert analytics.differing_buckets(a, b, "v", "x").count() == 6 and analytics.differing_buckets(a, a.repartition(5), "v", "x").count() == 0
    swapped = spark.createDataFrame([("u", None, "a")], "url string, v string, w string"), spark.createDataFrame([("u", "a", None)], "url string, v string, w string")
    assert analytics.golden_drift(*swapped, "v", "w").count() == 1
    assert analytics.check_golden(spark, a, str(tmp_path / "golden"), "v", "x", write=True) is None
    assert analytics.check_golden(spark, a, str(tmp_path / "golden"), "v", "x").count() == 0 and analytics.check_golden(spark, b, str(tmp_path / "golden"), "v", "x").count() == 6
    assert analytics.golden_drift(a.limit(0), b.limit(0), "v").count() == 0


def test_text_functions(spark):
    urls = [" https://x.example/a/#s ", "https://x.example/", "https://docs.github.com/en/get", "plain"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(text.normal_url(F.col("u")), text.site_name(F.col("u"))).collect()
    assert got[0][0] == "https://x.example/a" and got[1][0] == "https://x.example" and got[2][1] == "GitHub Docs" and got[3][1] == ""


def test_worst_and_best(spark):
    got = analytics.worst_and_best(score_table(spark, [{"parseability_score": float(i)} for i in range(9)]), 5).collect()
    assert sorted((r["end"], r["parseability_score"]) for r in got) == [("best", 6.0), ("best", 7.0), ("best", 8.0), ("worst", 0.0), ("worst", 1.0)]


def test_answers():
    html = "<nav>hidden install</nav><h2>Install first</h2><p>Run the installer and wait for it.</p><hr><p>Not part of the section at all.</p><ol><li>a</li><li>b</li><li>c</li></ol><pre>print('a long enough block')</pre>"
    assert extract_answer(html, "main steps to get started") == "## Install first\nRun the installer and wait for it.\n\nSteps:\n1. a\n2. b\n3. c"
    assert "```" in extract_answer(html, "a code example") and extract_answer(html, "troubleshoot") == ""
    assert Visible(html).text().startswith("Install first")


def test_running_sums_over_several_ranges(spark):
    rows = [(i * 37 % 101, i % 5, float(i % 3)) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, a long, b double").repartition(3)
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["k"]: (r["place"], r["a_upto"], r["b_upto"]) for r in running(df, ["k"], a_upto="a", b_upto="b").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    a = b = 0
    for place, (k, x, y) in enumerate(sorted(rows), 1):
        a, b = a + x, b + y
        assert got[k] == (place, a, b)
    assert running(df.limit(0), ["k"], a_upto="a").count() == 0


def test_bands_take_exact_deviations_whatever_the_order_of_rows(spark):
    """Whole scores with deviations of exactly 1, 3 and 5, each in forty orders: sums in any order must not move one over its band's edge."""
    exact = {"high": [51, 53, 51, 51, 52, 52, 52, 50, 50], "moderate": [52, 56, 52, 59, 51, 54, 56, 53, 59], "some": [63, 64, 56, 64, 57, 52, 62, 59, 51]}
    rng, rows = random.Random(3), []
    for band, held in exact.items():
        for k in range(40):
            rows += [(i % 3, f"{band} {k}", float(x)) for i, x in enumerate(rng.sample(held, len(held)))]
    spread = analytics.run_consistency(spark.createDataFrame(rows, "run int, url string, score double"), 3)
    assert {(r["url"].split()[0], r["band"], r["stdev"]) for r in spread.collect()} == {("high", "high", 1.0), ("moderate", "moderate", 3.0), ("some", "some", 5.0)}
    got = analytics.consistency_verdict(spread).first()
    assert (got["high"], got["moderate"], got["some"], got["low"], got["verdict"]) == (40, 40, 40, 0, "PASS")


def test_deviations_are_those_of_exact_arithmetic(spark):
    """As of fractions: whole ones exactly, others without a rounding before that to six digits (2.3456774999997 is 2.345677)."""
    rng = random.Random(5)
    held = {"tie": [0.0, 2.3456774999997, 4.6913549999994], "edge": [0.0, 3.0, 6.0], "beyond": [0.0, 3.00000000002, 6.00000000004]}
    held |= {f"u{k}": [rng.uniform(0, 100) for _ in range(3 + k % 9)] for k in range(200)}
    rows = [(i % 3, url, x) for url, scores in held.items() for i, x in enumerate(scores)]
    spread = analytics.run_consistency(spark.createDataFrame(rows, "run int, url string, score double"), 3)
    got = {r["url"]: r for r in spread.select("*", F.bround("stdev", 6).alias("rounded")).collect()}
    assert all(abs(got[url]["stdev"] - statistics.stdev(scores)) < 1e-13 for url, scores in held.items())
    assert got["tie"]["rounded"] == 2.345677 and got["edge"]["band"] == "moderate" and got["beyond"]["band"] == "some"
