"""How well an agent could answer standard questions from a page: extraction kernel and answer quality."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.order import running
from pageloom.kernels.dom import Dom

# The standard questions, the words an answer should hold, and signs of each kind of answer.
QUESTIONS = (
    ("getting_started", "What are the main steps to get started?", "steps", ("install", "setup", "configure", "first", "step", "start")),
    ("prerequisites", "What are the prerequisites and requirements?", "prerequisites", ("require", "need", "install", "version", "dependency", "prerequisite")),
    ("code_example", "Provide a code example or sample usage", "code_example", ("example", "code", "sample", "function", "import", "class")),
    ("troubleshooting", "What are common troubleshooting issues and solutions?", "troubleshooting", ("error", "problem", "issue", "solution", "fix", "debug")),
)
SIGNS = {
    "steps": ("step", "1.", "first", "then"),
    "code_example": ("```", "code", "function", "class"),
    "prerequisites": ("need", "install", "require", "version"),
    "troubleshooting": ("error", "problem", "solution", "fix"),
}
STRUCTURE = ("##", "-", "1.", "2.")
SECTION_WORDS = {
    "start": ("start", "setup", "install", "quick", "begin", "first", "initial"),
    "need": ("prerequisite", "requirement", "need", "before", "install", "setup"),
    "example": ("example", "sample", "demo", "tutorial", "usage"),
    "trouble": ("troubleshoot", "error", "problem", "issue", "fix", "solution", "debug"),
}
REQUIREMENT_WORDS = ("version", "install", "require")
HIDDEN = ("script", "style", "nav", "header", "footer")


class Visible:
    """A page without its hidden subtrees."""

    def __init__(self, html: str):
        self.dom = Dom(html)
        self.gone = [False] * len(self.dom.tags)
        for i in self.dom.find_all(*HIDDEN):
            self.gone[i : self.dom.ends[i]] = [True] * (self.dom.ends[i] - i)

    def all(self, *tags: str, within: int | None = None) -> list[int]:
        return [i for i in self.dom.find_all(*tags, within=within) if not self.gone[i]]

    def _nodes(self, i: int | None) -> Iterator[str]:
        d = self.dom
        first, last = (0, len(d.texts)) if i is None else (d.first_text[i], d.last_text[i])
        return (d.texts[k] for k in range(first, last) if d.text_parents[k] < 0 or not self.gone[d.text_parents[k]])

    def text(self, i: int | None = None) -> str:
        return "".join(t.strip() for t in self._nodes(i))

    def plain(self, i: int) -> str:
        return "".join(self._nodes(i))

    def after(self, heading: int) -> str:
        """Up to five texts of over 20 characters among the next siblings, up to a tag whose name begins with h."""
        d, out = self.dom, []
        for i in range(d.ends[heading], len(d.tags)):
            if d.parents[i] != d.parents[heading] or self.gone[i]:
                continue
            if d.tags[i].startswith("h") or len(out) == 5:
                break
            if len(text := self.text(i)) > 20:
                out.append(text)
        return "\n".join(out)

    def sections(self, words: tuple[str, ...]) -> list[str]:
        return [f"## {self.plain(h)}\n{self.after(h)}" for h in self.all("h1", "h2", "h3", "h4") if any(w in self.plain(h).lower() for w in words)]

    def items(self, i: int) -> list[str]:
        return [self.text(k) for k in self.all("li", within=i)]


def extract_answer(html: str | Visible, question: str) -> str:
    page, asked = html if isinstance(html, Visible) else Visible(html), question.lower()
    if "get started" in asked or "steps" in asked:
        lists = (page.items(i) for i in page.all("ol"))
        steps = ["Steps:\n" + "\n".join(f"{k}. {t}" for k, t in enumerate(x, 1)) for x in lists if len(x) >= 3]
        found, most = page.sections(SECTION_WORDS["start"]) + steps, 3
    elif "prerequisite" in asked:
        lists = (page.items(i) for i in page.all("ul", "ol"))
        wanted = next((x for x in lists if len(x) >= 2 and any(w in t.lower() for t in x for w in REQUIREMENT_WORDS)), None)
        found, most = page.sections(SECTION_WORDS["need"]) + (["Requirements:\n" + "\n".join(f"- {t}" for t in wanted)] if wanted else []), 2
    elif "code example" in asked:
        blocks = [f"```\n{t}\n```" for i in page.all("code", "pre") if len(t := page.text(i)) > 20]
        found, most = blocks + page.sections(SECTION_WORDS["example"]), 3
    elif "troubleshoot" in asked:
        found, most = page.sections(SECTION_WORDS["trouble"]), 3
    else:
        main = next((x for t in ("main", "article") if (x := page.all(t))), None) or [i for i, a in enumerate(page.dom.attrs) if a.get("role") == "main" and not page.gone[i]]
        return (" ".join(map(page.text, main)) or page.text())[:2000]
    return "\n\n".join(found[:most])


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, q, k, list(w)) for n, q, k, w in QUESTIONS], "name string, query string, expected_type string, keywords array<string>")


def _answers(html: pd.Series) -> pd.Series:
    """The answers to all questions from one parse of each page."""
    pages = (Visible(h) if h else None for h in html)
    return pd.Series([[extract_answer(page, q) if page else "" for _, q, _, _ in QUESTIONS] for page in pages], dtype=object)


def _any(text: Column, signs: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(s)) for s in signs))


def _empty(response: Column) -> Column:
    return F.length(F.regexp_replace(response, r"^\s+|\s+$", "")) < 50


def _grades(n: Column, empty: Column, found: Column, asked: Column, signs: Column, structure: Column) -> dict[str, Column]:
    matches = F.when(empty, 0).otherwise(found)
    size = F.when(n.between(100, 2000), 30.0).when(n > 50, 15.0).otherwise(0.0)
    coverage = matches / asked.cast("double")
    quality = F.when(empty, 0.0).otherwise(size + coverage * 40.0 + F.when(signs, 20.0).otherwise(0.0) + F.when(structure, 10.0).otherwise(0.0))
    return {"matches": matches, "coverage": coverage, "quality": F.least(quality, F.lit(100.0)), "success": (quality >= 60) & (n >= 100)}


def answer_quality(response: Column, keywords: Column, kind: Column, lower: Column | None = None) -> dict[str, Column]:
    """matches, coverage, quality (0 to 100) and success of an answer; ``lower``, its lower case as a column, spares lowering it for each keyword."""
    lower = F.lower(response) if lower is None else lower
    found = F.size(F.filter(keywords, lambda k: F.contains(lower, F.lower(k))))
    signs = reduce(lambda e, s: F.when(kind == s, _any(response if s == "code_example" else lower, SIGNS[s])).otherwise(e), SIGNS, F.lit(False))
    return _grades(F.length(response), _empty(response), found, F.size(keywords), signs, _any(response, STRUCTURE))


def standard_answers(rows: DataFrame, response: Column, *keep: Column) -> DataFrame:
    """``keep``, name, matches, coverage, quality and success of each row's text as the answer to each standard question.

    A text is lowered and trimmed once, and only counts and signs of it are repeated for each question.
    """
    kept = [f"kept_{i}" for i in range(len(keep))]
    rows = rows.select(*(c.alias(k) for c, k in zip(keep, kept, strict=True)), response.alias("response"))
    rows = rows.select(*kept, "response", F.lower("response").alias("lower"), F.length("response").alias("n"), _empty(F.col("response")).alias("empty"), _any(F.col("response"), STRUCTURE).alias("structure"))
    held = lambda words: reduce(lambda a, b: a + b, (F.contains("lower", F.lit(w.lower())).cast("int") for w in words))
    asked = [F.struct(F.lit(name).alias("name"), held(words).alias("found"), F.lit(len(words)).alias("asked"), _any(F.col("response" if kind == "code_example" else "lower"), SIGNS[kind]).alias("signs")) for name, _, kind, words in QUESTIONS]
    rows = rows.select(*kept, "n", "empty", "structure", F.inline(F.array(*asked)))
    q = _grades(*map(F.col, ("n", "empty", "found", "asked", "signs", "structure")))
    return rows.select(*kept, "name", *(c.alias(k) for k, c in q.items()))


def agent_performance(pages: DataFrame) -> DataFrame:
    """One row for each page and standard question; a page is shipped and parsed once."""
    asked = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("expected_type"), F.array(*map(F.lit, words)).alias("keywords")) for n, _, k, words in QUESTIONS))
    rows = pages.select("url", F.pandas_udf(_answers, "array<string>")("html").alias("responses"))
    rows = rows.select("url", F.inline(F.arrays_zip(F.col("responses").alias("response"), asked.alias("q")))).select("url", "response", F.lower("response").alias("lower"), "q.*")
    q = answer_quality(F.col("response"), F.col("keywords"), F.col("expected_type"), F.col("lower"))
    return rows.select("url", "name", F.substring("response", 1, 500).alias("response"), F.length("response").alias("response_length"), *(c.alias(k) for k, c in q.items()))


def site_ranking(results: DataFrame) -> DataFrame:
    """Pages by falling mean quality, then url, with their rank; means that differ by the order of their sums are equal."""
    rows = results.groupBy("url").agg(F.avg("quality").alias("quality"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("coverage").alias("coverage"))
    return running(rows, [F.bround("quality", 9).desc(), F.col("url")], place="rank")
