"""The calibration study's model calls: prompts, question pairs, reviews and answers, with the model injected.

A client is any picklable object: ``complete(prompt) -> text`` writes questions and ``answer(prompt) -> (text,
tokens_in, tokens_out)`` answers them.  Pages stay distributed; each worker calls the client for its own rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = "struct<question string, answer string, supporting_sentences array<string>>"
MANIFEST = "run_id string, corpus_ref string, scoring_model string, scoring_model_provider string, generator_model string, temperature double, seed int, runs_per_question int, started_at string"

QUESTIONS_PROMPT = """Write five questions that the page below answers, with the answer and the sentences that support it.
Reply with a bare JSON array of objects with the keys question, answer and supporting_sentences.

Title: {{TITLE}}
Address: {{URL}}
Kind of page: {{PROFILE}}

{{DOCUMENT_TEXT}}
"""
ANSWER_PROMPT = """Answer from the page below alone. If it doesn't hold the answer, reply: not in document

{{DOCUMENT_TEXT}}

Question: {{QUESTION}}
"""


class Writer(Protocol):
    def complete(self, prompt: str) -> str: ...


class Answerer(Protocol):
    def answer(self, prompt: str) -> tuple[str, int, int]: ...


def render(template: str, values: dict[str, str]) -> str:
    """Replaces ``{{KEY}}`` by its value.  A key the template lacks is a KeyError; other tokens stay as they are."""
    for key, value in values.items():
        token = f"{{{{{key}}}}}"
        if token not in template:
            raise KeyError(token)
        template = template.replace(token, value)
    return template


def parse_pairs(raw: str) -> list[dict]:
    """The pairs of a reply, which must be a bare JSON array of objects (else ValueError)."""
    data = json.loads(raw.strip())
    if not isinstance(data, list) or not all(isinstance(x, dict) for x in data):
        raise ValueError("the reply is not a JSON array of objects")
    return [{"question": x["question"], "answer": x["answer"], "supporting_sentences": list(x.get("supporting_sentences", []))} for x in data]


def write_questions(pages: DataFrame, client: Writer) -> DataFrame:
    """slug, prompt, raw and pairs of each page (slug, title, url, profile, text).

    A reply that can't be parsed gives null pairs and the reason in ``error``; other rows are not affected.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p in frame.itertuples(index=False):
                prompt = render(QUESTIONS_PROMPT, {"TITLE": p.title, "URL": p.url, "PROFILE": p.profile, "DOCUMENT_TEXT": p.text})
                raw, pairs, error = client.complete(prompt), None, None
                try:
                    pairs = parse_pairs(raw)
                except (ValueError, KeyError) as e:
                    error = str(e)
                rows.append((p.slug, prompt, raw, pairs, error))
            yield pd.DataFrame(rows, columns=["slug", "prompt", "raw", "pairs", "error"])

    return pages.select("slug", "title", "url", "profile", "text").mapInPandas(run, f"slug string, prompt string, raw string, pairs array<{PAIR}>, error string")


def numbered_pairs(written: DataFrame) -> DataFrame:
    """slug, pair_index, pair."""
    return written.select("slug", F.posexplode("pairs").alias("pair_index", "pair"))


def reviewed(pairs: DataFrame, decisions: DataFrame, reviewer: str) -> DataFrame:
    """Review records of (slug, pair_index, pair) under decisions (slug, pair_index, decision, question, answer, reason).

    Without a decision a pair is accepted; blank edits keep the generated words.
    """
    rows = pairs.join(decisions, ["slug", "pair_index"], "left")
    choice = F.coalesce("decision", F.lit("accept"))
    keep = lambda new, old: F.when(F.trim(F.coalesce(new, F.lit(""))) != "", F.trim(new)).otherwise(F.col(f"pair.{old}"))
    edited = F.struct(keep(F.col("question"), "question").alias("question"), keep(F.col("answer"), "answer").alias("answer"), F.col("pair.supporting_sentences").alias("supporting_sentences"))
    return rows.select(
        "slug", "pair_index", choice.alias("decision"), F.col("pair").alias("generated_pair"), F.when(choice == "accept", F.col("pair")).when(choice == "edit", edited).alias("edited_pair"),
        F.when(choice == "reject", F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("no reason given"))).alias("reject_reason"), F.lit(reviewer).alias("reviewer_id"),
    )


def answers(pages: DataFrame, pairs: DataFrame, client: Answerer, runs: int = 1) -> DataFrame:
    """slug, pair_index, run_index, answer and token counts of each question (slug, pair_index, pair), ``runs`` times."""
    asked = pairs.join(pages.select("slug", "text"), "slug").select("slug", "pair_index", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run_index"), F.col("pair.question").alias("question"), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for a in frame.itertuples(index=False):
                text, tokens_in, tokens_out = client.answer(render(ANSWER_PROMPT, {"DOCUMENT_TEXT": a.text, "QUESTION": a.question}))
                rows.append((a.slug, a.pair_index, a.run_index, text.strip(), tokens_in, tokens_out))
            yield pd.DataFrame(rows, columns=["slug", "pair_index", "run_index", "answer", "tokens_in", "tokens_out"])

    return asked.mapInPandas(run, "slug string, pair_index int, run_index int, answer string, tokens_in int, tokens_out int")
