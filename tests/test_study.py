"""The study from pages to accuracy with stub models."""

import json

import pytest

from pageloom.operators import calibration, study


class Stub:
    def complete(self, prompt):
        return "no json" if "bad page" in prompt else json.dumps([{"question": "port?", "answer": "8080"}, {"question": "host?", "answer": "local"}])

    def answer(self, prompt):
        return (" The port is 8080. ", 10, 5) if "port?" in prompt else ("not in document", 9, 3)


def test_render():
    assert study.render("a {{X}} {{Y}}", {"X": "1"}) == "a 1 {{Y}}"
    with pytest.raises(KeyError):
        study.render("a", {"X": "1"})
    for raw in ("{}", "[1]", "```[]```"):
        with pytest.raises(ValueError):
            study.parse_pairs(raw)


def test_study_end_to_end(spark):
    pages = spark.createDataFrame([("a", "A", "u", "faq", "text"), ("b", "B", "u", "faq", "bad page")], "slug string, title string, url string, profile string, text string")
    written = study.write_questions(pages, Stub())
    assert {r["slug"]: r["error"] is None for r in written.collect()} == {"a": True, "b": False}
    pairs = study.numbered_pairs(written)
    none = spark.createDataFrame([("a", 1, "edit", " where? ", "", None)], "slug string, pair_index int, decision string, question string, answer string, reason string")
    reviews = study.reviewed(pairs, none, "me")
    assert [(r["decision"], r["edited_pair"]["question"], r["edited_pair"]["answer"]) for r in reviews.orderBy("pair_index").collect()] == [("accept", "port?", "8080"), ("edit", "where?", "local")]
    kept = calibration.approved(reviews).select("slug", "pair_index", "pair")
    given = study.answers(pages, kept, Stub(), runs=2)
    assert given.count() == 4
    grades = calibration.grade_answers(given, kept.selectExpr("slug", "pair_index", "pair.answer as truth"), "slug", "pair_index")
    got = calibration.page_accuracy(grades, "slug").first()
    assert (got["answers"], got["accuracy"]) == (4, 0.5)


def test_standard_answers_lower_a_text_once_for_all_questions(spark):
    """The same grades as ``answer_quality`` for each question, with the text lowered in one place of the plan and not beside the question's rows."""
    from pyspark.sql import functions as F

    from pageloom.operators import agent_perf

    texts = ["", "  \n ", "Install FIRST, then CONFIGURE the setup step; an ÉLAN of words that goes on for more than fifty characters", "## Error\n- fix 1. the problem " * 9, "import class ``` example CODE function " * 60]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = agent_perf.standard_answers(rows, F.col("text"), F.col("id"))
    plain = rows.join(agent_perf.questions(spark), F.lit(True))
    q = agent_perf.answer_quality(F.col("text"), F.col("keywords"), F.col("expected_type"))
    want = plain.select("id", "name", *(c.alias(k) for k, c in q.items()))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
