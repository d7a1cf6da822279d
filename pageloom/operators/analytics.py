"""Analytics over score tables.

A score table has url, html_path, the six pillar columns (null: not evaluated), parseability_score, universal_score,
content_type, failure_mode, render_mode and ``pos``, the row's place in its file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.constants import AXE_FALLBACK, CLUSTER_MIN, PILLARS, PROFILE_WEIGHTS, RENDER_FLAG, UNKNOWN_URL, UPLIFT_TARGET, WEAK_BELOW
from pageloom.functions.order import running
from pageloom.functions.storage import durable
from pageloom.functions.text import normal_url, outcome_tag, title_case
from pageloom.operators.pillars import axe_penalty, axe_score


def page_key() -> Column:
    return F.when(F.coalesce("url", F.lit("")) != "", F.col("url")).otherwise(F.coalesce("html_path", F.lit("")))


def pillar_rows(scores: DataFrame, *keys: str) -> DataFrame:
    """One row for each page and evaluated pillar."""
    held = F.array(*(F.struct(F.lit(p).alias("pillar"), F.col(p).alias("score")) for p in PILLARS))
    return scores.select(*keys, F.inline(held)).where(F.col("score").isNotNull())


def weak_pillars(scores: DataFrame) -> DataFrame:
    """page, pillar and rounded score below WEAK_BELOW."""
    rows = pillar_rows(scores.withColumn("page", page_key()), "page").withColumn("score", F.bround("score"))
    return rows.where(F.col("score") < WEAK_BELOW)


def template_clusters(scores: DataFrame) -> DataFrame:
    """Weak rounded pillar scores that pages share: pillar, score, members, uplift; largest first.

    There are at most WEAK_BELOW scores for each pillar; the pages themselves are ``cluster_members``.
    """
    weight = reduce(lambda e, p: F.when(F.col("pillar") == p[0], p[1]).otherwise(e), zip(PILLARS, PROFILE_WEIGHTS["article"], strict=True), F.lit(0.0))
    found = weak_pillars(scores).groupBy("pillar", "score").agg(F.count("*").alias("members"))
    found = found.where(F.col("members") >= CLUSTER_MIN).withColumn("uplift", (F.lit(UPLIFT_TARGET) - F.col("score")) * weight)
    return found.select("pillar", "score", "members", "uplift").orderBy(F.desc("members"), F.desc("uplift"), "pillar", "score")


def cluster_members(scores: DataFrame) -> DataFrame:
    """pillar, score, page of each cluster's pages; a cluster with a third of all pages is rows like any other."""
    return weak_pillars(scores).join(F.broadcast(template_clusters(scores).select("pillar", "score")), ["pillar", "score"])


def cluster_pages(scores: DataFrame) -> DataFrame:
    """page and the pillars of the templates it belongs to."""
    return cluster_members(scores).groupBy("page").agg(F.sort_array(F.collect_set("pillar")).alias("template_pillars"))


def page_deltas(scores: DataFrame) -> DataFrame:
    """The report's rows with the page's change between render modes, null where it has not both."""
    deltas = render_deltas(scores).select("page", F.col("delta").alias("render_delta"), "flagged")
    return one_row_per_page(scores).withColumn("page", page_key()).join(deltas, "page", "left")


def with_urls(rows: DataFrame, crawl: DataFrame) -> DataFrame:
    """Score or parse rows with the url of their crawl record by html_path, ``Unknown URL`` where there is none."""
    known = crawl.where("coalesce(html_path, '') <> ''").groupBy("html_path").agg(F.min("url").alias("crawl_url"))
    out = rows.join(known, "html_path", "left")
    own = F.col("url") if "url" in rows.columns else F.lit(None).cast("string")
    return out.withColumn("url", F.coalesce(F.nullif(own, F.lit("")), "crawl_url", F.lit(UNKNOWN_URL))).drop("crawl_url")


def page_summary(scores: DataFrame, crawl: DataFrame) -> DataFrame:
    """url, score, outcome tag and failure mode of each row, as the command line prints them."""
    tag = outcome_tag(F.col("parseability_score"), F.col("failure_mode"))
    return with_urls(scores, crawl).select("url", "html_path", "parseability_score", "failure_mode", tag.alias("tag"))


def render_deltas(scores: DataFrame) -> DataFrame:
    """Raw against rendered score of each page that has both; the last row of each mode counts; largest change first."""
    last = lambda mode: F.max_by("parseability_score", F.when(F.col("render_mode") == mode, F.col("pos")))
    rows = scores.withColumn("page", page_key()).where("page <> ''").groupBy("page").agg(last("raw").alias("raw"), last("rendered").alias("rendered"))
    delta = F.col("rendered") - F.col("raw")
    rows = rows.where("raw is not null and rendered is not null").select("page", "raw", "rendered", delta.alias("delta"), (F.abs(delta) >= RENDER_FLAG).alias("flagged"))
    return rows.orderBy(F.abs("delta").desc(), "page")


def one_row_per_page(scores: DataFrame) -> DataFrame:
    """The report's rows: for each page the first rendered row if there is one, else the first."""
    order = Window.partitionBy(page_key()).orderBy((F.col("render_mode") == "rendered").cast("int").desc(), "pos")
    return scores.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def profile_impact(scores: DataFrame) -> DataFrame:
    """Profile against universal score, if any page has a profile other than article; largest change first."""
    delta = F.col("parseability_score") - F.col("universal_score")
    gate = scores.agg(F.coalesce(F.bool_or(F.col("content_type") != "article"), F.lit(False)).alias("any_profile"))
    rows = scores.where("universal_score is not null").select(page_key().alias("page"), "content_type", "parseability_score", "universal_score", delta.alias("delta"))
    return rows.join(F.broadcast(gate), F.col("any_profile")).drop("any_profile").orderBy(F.abs("delta").desc(), "page")


def score_history(rows: DataFrame, url: str | None = None, *by: str) -> DataFrame:
    """Scores in time order with the change since the last non-null score; ``url`` is compared in normal form.

    rows: score_file, pos, evaluated_at, url, parseability_score, ...
    """
    if url is not None:
        rows = rows.where(normal_url(F.col("url")) == normal_url(F.lit(url)))
    before = F.last("parseability_score", ignorenulls=True).over(Window.partitionBy(*by).orderBy("evaluated_at", "score_file", "pos").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("delta", F.col("parseability_score") - before)


def benchmark_validation(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """Scores against expected ranges: deviation is the distance outside the range; category 'unknown' if not given."""
    rows = scores.select("url", F.col("parseability_score").alias("actual")).join(expected, "url")
    outside = F.greatest(F.col("actual") - F.col("expected_max"), F.col("expected_min") - F.col("actual"), F.lit(0.0))
    return rows.select("url", F.coalesce("category", F.lit("unknown")).alias("category"), "expected_min", "expected_max", "actual", F.col("actual").between(F.col("expected_min"), F.col("expected_max")).alias("in_range"), outside.alias("deviation"))


def validation_rates(validated: DataFrame) -> DataFrame:
    """Pass rate and worst deviation by category and overall."""
    rows = validated.rollup("category").agg(F.count("*").alias("pages"), F.count_if("in_range").alias("passed"), F.avg(F.col("in_range").cast("double")).alias("rate"), F.max("deviation").alias("worst"))
    return rows.select(F.coalesce("category", F.lit("all")).alias("category"), "pages", "passed", "rate", "worst", ((F.col("rate") >= 0.7) & (F.col("worst") <= 20)).alias("gate"))


def run_consistency(runs: DataFrame, n_runs: int) -> DataFrame:
    """Spread of each url that all runs hold: (run, url, score).

    The bands end at whole deviations, and the order of sums moves last digits: what is whole but for those is set to the whole number, so an exact 3
    is no 3.0000000000000004.  All others stay as they are.
    """
    stdev = F.stddev_samp("score")
    settled = F.when(F.abs(stdev - F.rint(stdev)) < 1e-12, F.rint(stdev)).otherwise(stdev)
    rows = runs.groupBy("url").agg(F.avg("score").alias("mean"), F.coalesce(settled, F.lit(0.0)).alias("stdev"), F.min("score").alias("low"), F.max("score").alias("high"), F.count_distinct("run").alias("runs"))
    rows = rows.where(F.col("runs") == n_runs).withColumn("range", F.col("high") - F.col("low"))
    band = F.when(F.col("stdev") <= 1, "high").when(F.col("stdev") <= 3, "moderate").when(F.col("stdev") <= 5, "some").otherwise("low")
    return rows.withColumn("band", band).withColumn("inconsistent", (F.col("stdev") > 5) | (F.col("range") > 10))


def consistency_verdict(spread: DataFrame) -> DataFrame:
    worst = F.max("stdev")
    verdict = F.when(worst > 10, "FAIL").when(worst > 5, "WARN").otherwise("PASS")
    bands = [F.count_if(F.col("band") == b).alias(b) for b in ("high", "moderate", "some", "low")]
    return spread.agg(F.count("*").alias("urls"), F.avg("stdev").alias("mean_stdev"), worst.alias("worst_stdev"), *bands, F.count_if("inconsistent").alias("inconsistent"), verdict.alias("verdict"))


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scores of two runs by url; a score of 0 counts as missing."""
    side = lambda df, name: df.select("url", F.nullif(F.col("parseability_score"), F.lit(0.0)).alias(name))
    return side(old, "old").join(side(new, "new"), "url", "full").withColumn("delta", F.col("new") - F.col("old"))


def compare_pillars(old: DataFrame, new: DataFrame) -> DataFrame:
    side = lambda df, name: pillar_rows(df).groupBy("pillar").agg(F.avg("score").alias(name))
    return side(old, "old").join(side(new, "new"), "pillar", "full").withColumn("delta", F.col("new") - F.col("old"))


def delta_stats(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Mean, median, extremes and number of changed pages of one score between two runs; the median from counts of distinct changes."""
    joined = before.select("url", F.col(column).alias("a")).join(after.select("url", F.col(column).alias("b")), "url").select((F.col("b") - F.col("a")).alias("delta"))
    counts = joined.groupBy("delta").agg(F.count("*").alias("held"))
    rows = joined.agg(F.count("*").alias("pages"), F.count("delta").alias("known"), F.avg("delta").alias("mean"), F.min("delta").alias("low"), F.max("delta").alias("high"), F.count_if(F.col("delta") != 0).alias("changed"))
    upto = running(counts.where("delta is not null"), ["delta"], upto="held").join(F.broadcast(rows.select("known")), F.lit(True))
    middle = lambda k: F.min(F.when(F.col("upto") >= k, F.col("delta")))
    median = upto.agg(((middle(F.floor((F.col("known") + 1) / 2)) + middle(F.floor((F.col("known") + 2) / 2))) / 2).alias("median"))
    return rows.join(F.broadcast(median), F.lit(True)).select("pages", "mean", "median", "low", "high", "changed")


#: Buckets of urls whose checksums are compared before rows are.
BUCKETS = 4096


def checksums(rows: DataFrame, *columns: str) -> DataFrame:
    """bucket, n, mix, total: of each bucket of urls the number of rows and two 64-bit sums of row hashes, whatever the order."""
    held = [x for c in columns for x in (F.col(c), F.col(c).isNull())]  # a hash takes no notice of which columns are null
    row = rows.select(F.pmod(F.xxhash64("url"), F.lit(BUCKETS)).alias("bucket"), F.xxhash64("url", *held).alias("one"), F.xxhash64(F.lit(7), "url", *held).alias("two"))
    return row.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("one").alias("mix"), F.sum(F.col("two").cast("decimal(20,0)")).alias("total"))


def differing_buckets(old: DataFrame, new: DataFrame, *columns: str) -> DataFrame:
    """Buckets whose checksums differ, at most BUCKETS rows."""
    a, b = checksums(old, *columns), checksums(new, *columns)
    same = reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in ("n", "mix", "total")))
    return a.join(b, a["bucket"] == b["bucket"], "full").where(~same).select(F.coalesce(a["bucket"], b["bucket"]).alias("bucket"))


def golden_drift(committed: DataFrame, fresh: DataFrame, *columns: str) -> DataFrame:
    """Rows of either side that the other lacks or holds with other values.

    Checksums of buckets are compared first and only the rows of buckets that differ are joined, so of equal tables nothing
    but checksums is shuffled.
    """
    buckets = F.broadcast(durable(differing_buckets(committed, fresh, *columns)))
    asked = lambda df: df.join(buckets, F.pmod(F.xxhash64("url"), F.lit(BUCKETS)) == buckets["bucket"], "left_semi")
    side = lambda df, mark: asked(df.select("url", *columns)).select("url", F.lit(True).alias(f"in_{mark}"), *(F.col(c).alias(f"{c}_{mark}") for c in columns))
    rows = side(committed, "golden").join(side(fresh, "fresh"), "url", "full")
    same = reduce(lambda a, b: a & b, (F.col(f"{c}_golden").eqNullSafe(F.col(f"{c}_fresh")) for c in columns), F.col("in_golden").isNotNull() & F.col("in_fresh").isNotNull())
    kind = F.when(F.col("in_golden").isNull(), "added").when(F.col("in_fresh").isNull(), "missing").otherwise("changed")
    return rows.where(~same).withColumn("drift", kind).drop("in_golden", "in_fresh")


def check_golden(spark: SparkSession, fresh: DataFrame, path: str, *columns: str, write: bool = False) -> DataFrame | None:
    """Writes the golden table by url, or compares a fresh run with it: the drift by url, empty where nothing changed."""
    if write:
        fresh.select("url", *columns).orderBy("url").write.mode("overwrite").parquet(path)
        return None
    return golden_drift(spark.read.parquet(path), fresh, *columns).orderBy("url")


def run_summary(scores: DataFrame) -> DataFrame:
    clean = F.count_if(F.col("failure_mode").isin("clean", "success"))
    return scores.agg(F.count("*").alias("pages"), F.avg("parseability_score").alias("mean_score"), clean.alias("clean"), F.try_divide(clean * 100.0, F.count("*")).alias("clean_percent"))


def report_summary(scores: DataFrame) -> DataFrame:
    mode = lambda m: F.count_if(F.col("failure_mode") == m)
    return scores.agg(F.count("*").alias("pages"), F.avg("parseability_score").alias("mean_score"), mode("clean").alias("clean"), mode("structure-missing").alias("structure_missing"), mode("extraction-noisy").alias("extraction_noisy"))


def score_distribution(scores: DataFrame, *by: str) -> DataFrame:
    """Counts of the bands 80 and over, 60 to 80 and under 60, and the release gate."""
    s = F.col("parseability_score")
    high = F.count_if(s >= 80)
    gate = (F.avg(s) >= 70) & (F.try_divide(F.count_if(s >= 60) * 100.0, F.count("*")) >= 80)
    return scores.groupBy(*by).agg(F.count("*").alias("pages"), F.avg(s).alias("mean_score"), F.min(s).alias("low"), F.max(s).alias("high"), high.alias("ready"), F.count_if((s >= 60) & (s < 80)).alias("needs_work"), F.count_if(s < 60).alias("major_issues"), gate.alias("gate"))


def mode_rollup(scores: DataFrame) -> DataFrame:
    """Pages and mean score by content type and failure mode, with subtotals (an extension)."""
    return scores.rollup("content_type", "failure_mode").agg(F.count("*").alias("pages"), F.avg("parseability_score").alias("mean_score"))


def primary_issue() -> Column:
    """The lowest pillar, the first in order among equals, as a title; the failure mode if there is none."""
    held = F.filter(F.array(*(F.struct(F.col(p).alias("score"), F.lit(i).alias("i"), F.lit(p).alias("pillar")) for i, p in enumerate(PILLARS))), lambda x: x["score"].isNotNull())
    return F.coalesce(title_case(F.array_min(held)["pillar"]), F.initcap(F.replace(F.col("failure_mode"), F.lit("-"), F.lit(" "))))


def fix_hint(mode: Column) -> Column:
    # Recommendations by failure mode.
    return (
        F.when(mode == "structure-missing", "Add semantic HTML (<main>, <article>), fix heading hierarchy")
        .when(mode == "extraction-noisy", "Reduce boilerplate, improve content/chrome separation")
        .otherwise("Review structure and optimize content organization")
    )


def worst_and_best(scores: DataFrame, k: int = 5) -> DataFrame:
    """The floor(k/2) lowest and the ceil(k/2) highest pages."""
    rows = scores.select(page_key().alias("page"), "parseability_score", "pos")
    low = rows.orderBy("parseability_score", "pos").limit(k // 2).withColumn("end", F.lit("worst"))
    high = rows.orderBy(F.desc("parseability_score"), F.desc("pos")).limit(k - k // 2).withColumn("end", F.lit("best"))
    return low.unionByName(high).drop("pos")


def display_order(scores: DataFrame) -> DataFrame:
    """Pages by rising score with their display number."""
    return running(scores, ["parseability_score", "pos"], place="shown_as").withColumn("shown_as", F.col("shown_as").cast("int"))


def numbered_batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` with ``batch``, the number from 0 of the ``size`` rows in order of ``key`` that a row is in."""
    return running(rows, [key]).withColumn("batch", F.floor((F.col("place") - 1) / size)).drop("place")


def presentation_summary(scores: DataFrame) -> DataFrame:
    """Pages, mean score, the pages ready for agents and those in each band, of a presentation's first slide."""
    s = F.col("parseability_score")
    return scores.agg(F.count("*").alias("pages"), F.avg(s).alias("mean_score"), F.count_if(s >= 80).alias("ready"), F.count_if((s >= 60) & (s < 80)).alias("needs_work"), F.count_if(s < 60).alias("major_issues"), F.try_divide(F.count_if(s >= 80) * 100.0, F.count("*")).alias("ready_percent"))


def status_histogram(crawl: DataFrame) -> DataFrame:
    """Redirect codes over all hops: (redirect_chain array<int>)."""
    proper = F.col("status").isin(301, 302, 303, 307, 308)
    return crawl.select(F.explode("redirect_chain").alias("status")).groupBy("status").agg(F.count("*").alias("hops"), F.bool_and(proper).alias("proper"))


def axe_scores(violations: DataFrame) -> DataFrame:
    """url and score from (url, rule_id, impact, node_count)."""
    return violations.groupBy("url").agg(axe_score(F.sum(axe_penalty(F.col("impact"), F.col("node_count")))).alias("axe_score"), F.count("*").alias("rules"))


def violation_audit(violations: DataFrame, shown: int = 10) -> DataFrame:
    """url, the ``shown`` heaviest violations as text and how many more there are; a page with very many passes on no more than those."""
    penalty = axe_penalty(F.col("impact"), F.col("node_count"))
    order = Window.partitionBy("url").orderBy(F.desc("penalty"), "rule_id", "node_count", "impact")
    rows = violations.withColumn("penalty", penalty)
    first = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)
    said = F.struct("rank", F.concat_ws(":", "rule_id", "impact", F.col("node_count").cast("string")).alias("text"))
    listed = first.groupBy("url").agg(F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["text"]), "; ").alias("violations"))
    counts = violations.groupBy("url").agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))
    return listed.join(counts, "url")


def axe_runs(runs: DataFrame, violations: DataFrame) -> DataFrame:
    """url and axe_score of each run (url, outcome): its violations' score if it is ``ok``, else the fixed score of a failed run."""
    scored = axe_scores(violations).select("url", "axe_score")
    fallback = reduce(lambda e, kv: F.when(F.col("outcome") == kv[0], kv[1]).otherwise(e), AXE_FALLBACK.items(), F.lit(None).cast("double"))
    return runs.join(scored, "url", "left").select("url", "outcome", F.when(F.col("outcome") == "ok", F.coalesce("axe_score", F.lit(100.0))).otherwise(fallback).alias("axe_score"))
