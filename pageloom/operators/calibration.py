"""Calibration study: reviews, graded answers, accuracy and its correlation with pillar scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.stats import bootstrap, p_value, spearman
from pageloom.functions.text import answer_form

EXACT_NOTE = "substring match"


def approved(reviews: DataFrame) -> DataFrame:
    """Pairs to keep: not rejected, in the form the reviewer left them."""
    return reviews.where("decision <> 'reject' and edited_pair is not null").withColumn("pair", F.col("edited_pair"))


def grade(answer: Column, truth: Column) -> Column:
    """struct(label, grader_notes) of an answer against the expected text."""
    given, wanted = answer_form(answer), answer_form(truth)
    note = lambda text: F.lit(text).cast("string").alias("grader_notes")
    said = lambda label, text=None: F.struct(F.lit(label).alias("label"), note(text))
    return (
        F.when((given == "not in document") & (wanted != ""), said("not_in_document"))
        .when(given == wanted, said("correct"))
        .when((wanted != "") & F.contains(given, wanted), said("correct", EXACT_NOTE))
        .otherwise(said("incorrect"))
    )


def grade_answers(answers: DataFrame, pairs: DataFrame, *keys: str) -> DataFrame:
    """answers (keys, run_index, answer) joined with pairs (keys, truth)."""
    return answers.join(pairs, list(keys)).withColumn("g", grade(F.col("answer"), F.col("truth"))).select(*keys, "run_index", "g.label", "g.grader_notes")


def page_accuracy(grades: DataFrame, *by: str) -> DataFrame:
    return grades.groupBy(*by).agg(F.count("*").alias("answers"), F.avg((F.col("label") == "correct").cast("double")).alias("accuracy"))


def correlate(rows: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """pillar, n, rho, ci_low, ci_high, p_value of (pillar, score, accuracy)."""
    found = spearman(rows, "score", "accuracy", "pillar").withColumn("p_value", p_value(F.col("rho"), F.col("n")))
    return found.join(bootstrap(rows, "score", "accuracy", "pillar", resamples, seed=seed), "pillar").select("pillar", "n", "rho", "ci_low", "ci_high", "p_value")


def cohen_kappa(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two graders (an extension)."""
    n = F.sum("k")
    counts = labels.groupBy(a, b).agg(F.count("*").alias("k"))
    both = counts.select(F.col(a).alias("label"), F.col("k").alias("ka"), F.lit(0).alias("kb")).unionByName(counts.select(F.col(b).alias("label"), F.lit(0).alias("ka"), F.col("k").alias("kb")))
    chance = both.groupBy("label").agg(F.sum("ka").alias("ka"), F.sum("kb").alias("kb")).agg(F.sum(F.col("ka").cast("double") * F.col("kb")).alias("products"))
    seen = counts.agg(n.alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("k")).otherwise(0)).alias("agreed"))
    pe = F.col("products") / (F.col("n").cast("double") * F.col("n"))
    po = F.col("agreed") / F.col("n").cast("double")
    return seen.join(F.broadcast(chance), F.lit(True)).select("n", po.alias("observed"), pe.alias("expected"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))
