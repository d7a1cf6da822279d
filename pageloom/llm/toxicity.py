"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Token scores are log-odds of toxic against other labelled texts, counting a word once for each distinct text, under an
informative Dirichlet prior (PRIOR times each word's own count in the whole sample); words whose log-odds are not
significantly positive (z below Z) share one negative score, so a random text drifts downwards.  One linear scan finds
every maximal-scoring segment of a text.

Under that drift the best segment of clean text follows an extreme-value law (Karlin-Altschul): a segment of score S in N
words has the expected count ``E = K N exp(-lambda S)``.  Both parameters come from the clean training texts: lambda
solves ``sum p exp(lambda s) = 1`` over the shares p of their tokens, and K is the maximum-likelihood value for the best
segments of the texts that were not used to score the words (a text without any is censored at 0).  Segments with E below
SIGNIFICANT are toxic passages; their evidence, the sum of ``-ln E``, and its density, go through a logistic fit on the
training rows to the score.

Learning uses at most MAX_TRAIN labelled ids outside the held-out fold (the smallest hashes of the id); of equal texts one
counts.  Words are counted and texts measured by the executors; the driver sees the counts of words in toxic texts and a
few numbers for each text.  Texts are read whole.  Empty, null and wordless texts get the score of no evidence, the same
for all of them.  Rows that repeat are scored one by one, equal texts alike.  Columns besides those named are never looked
at, whatever their names.  With one label only, or none, every text gets one score, below the threshold without toxic
labels and above it without clean ones; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import durable, isolate, parallel, remainder

PRIOR, Z, MAX_TRAIN, SIGNIFICANT = 0.1, 2.5, 12_000, 0.5

#: A hit is forgotten after about this many ordinary words.
REACH = 12

#: predicted = 1 from here on.
THRESHOLD = 0.7

_WORD = regex.compile(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def log_odds(counts: dict[str, tuple[int, int]], n1: int, n0: int) -> dict[str, float]:
    """Significantly toxic words and their log-odds, from (toxic, other) counts and the sums of these over all words."""
    whole = PRIOR * (n1 + n0)
    odds = {}
    for w, (y1, y0) in sorted(counts.items()):
        a = PRIOR * (y1 + y0)
        a1, b1, a0, b0 = y1 + a, n1 + whole - y1 - a, y0 + a, n0 + whole - y0 - a
        if not y1 or min(b1, b0) <= 0:
            continue
        delta = math.log(a1 / b1) - math.log(a0 / b0)
        if delta / math.sqrt(1 / a1 + 1 / a0) >= Z:
            odds[w] = delta
    return odds


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word, score) in time linear in the hits.

    ``hits`` are the (place, score) of the positive words; each word between two hits scores ``-drift``.  Only a hit
    can begin or end a segment, so the scan walks hits and keeps the stack of candidate segments of the maximal
    scoring subsequence problem: left and right cumulative sums, merged while an earlier one dominates.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, left, right, next lower entry with less left
    total, after = 0.0, 0
    for place, score in hits:
        left = total - drift * (place - after)
        total, after = left + score, place + 1
        first, right = place, total
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= right:
                stack.append((first, place, left, right, k))
                break
            first, left = stack[k][0], stack[k][2]
            del stack[k:]
    return [(first, last, right - left) for first, last, left, right, _ in stack]


def decay(shares: list[tuple[float, float]], drift: float) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1; shares are (p, s) of positive words, the rest scores -drift."""
    rest = 1.0 - sum(p for p, _ in shares)
    value = lambda x: rest * math.exp(-drift * x) + sum(p * math.exp(s * x) for p, s in shares) - 1.0
    low, high = 0.0, 1e-3
    while value(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return max(low, 1e-3)


def hits_of(words: list[str], model: dict) -> list[tuple[int, float]]:
    table = model["words"]
    return [(i, table[w]) for i, w in enumerate(words) if w in table]


def passages(words: list[str], model: dict) -> list[tuple[int, int, float]]:
    """(first word, last word, -ln E) of every significant segment."""
    log_kn = math.log(model["k"] * max(1, len(words)))
    found = [(f, t, model["lambda"] * s - log_kn) for f, t, s in segments(hits_of(words, model), model["drift"])]
    return [x for x in found if x[2] > -math.log(SIGNIFICANT)]


def features(words: list[str], model: dict) -> tuple[float, float, float]:
    found = passages(words, model)
    evidence = sum(x[2] for x in found)
    return math.log1p(evidence), math.log1p(max((x[2] for x in found), default=0.0)), math.log1p(1000 * len(found) / (len(words) + 50))


def logistic(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights and bias by Newton steps under a small ridge."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w)), x.T @ (labels - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


Row = tuple[str | None, int, int]  # text, toxic, half


def count_words(rows: Iterable[Row]) -> dict[str, np.ndarray]:
    """For each word the texts that hold it by half and label, and then its tokens; "" has the number of texts."""
    counts: dict[str, np.ndarray] = {}
    none = np.zeros((2, 2, 2), np.int64)
    for text, toxic, half in rows:
        tokens = Counter(words_of(text))
        for word, n in tokens.items():
            held = counts.setdefault(word, none.copy())
            held[0, half, toxic] += 1
            held[1, half, toxic] += n
        counts.setdefault("", none.copy())[0, half, toxic] += 1
    return counts


def word_model(counts: dict[str, np.ndarray], totals: np.ndarray, halves: Sequence[int]) -> dict:
    """Word scores, drift and lambda of the texts of some halves; ``totals`` sums ``counts`` over all words."""
    pick = lambda x, kind, toxic: int(x[kind, list(halves), toxic].sum())
    odds = log_odds({w: (pick(x, 0, 1), pick(x, 0, 0)) for w, x in counts.items() if w}, pick(totals, 0, 1), pick(totals, 0, 0))
    drift = float(np.median(list(odds.values()))) / REACH if odds else 1.0
    clean = pick(totals, 1, 0) or 1
    return {"words": odds, "drift": drift, "lambda": decay([((pick(counts[w], 1, 0) + 0.5) / (clean + 1), s) for w, s in odds.items()], drift)}


def best_scores(rows: Iterable[Row], models: Sequence[dict]) -> list[tuple[int, int, int, float]]:
    """half, toxic, words and lambda * best segment (0 without any) of each text, by the model of the other half."""
    out = []
    for text, toxic, half in rows:
        words, model = words_of(text), models[1 - half]
        best = max((s for _, _, s in segments(hits_of(words, model), model["drift"])), default=0.0)
        out.append((half, toxic, len(words), model["lambda"] * best))
    return out


def gumbel_k(best: Iterable[tuple[int, float]]) -> float:
    """The most likely K for the (words, lambda * best segment) of clean texts."""
    seen, mass = 0.5, 1.0  # a text's worth of doubt keeps it finite
    for n, x in best:
        seen, mass = seen + (x > 0), mass + n * math.exp(-x)
    return seen / mass


def half_models(counts: dict[str, np.ndarray], totals: np.ndarray) -> list[dict]:
    return [word_model(counts, totals, [k]) for k in (0, 1)]


def with_k(models: list[dict], best: list[tuple[int, int, int, float]]) -> None:
    for k in (0, 1):
        models[k]["k"] = gumbel_k((n, x) for half, toxic, n, x in best if half != k and not toxic)


def feature_rows(rows: Iterable[Row], models: Sequence[dict]) -> list[tuple[int, float, float, float]]:
    """toxic and the features of each text, by the model of the other half."""
    return [(toxic, *features(words_of(text), models[1 - half])) for text, toxic, half in rows]


def whole_model(counts: dict[str, np.ndarray], totals: np.ndarray, models: list[dict], seen: list[tuple[int, float, float, float]]) -> dict:
    """The model of both halves, with K between theirs and the logistic fit on features that neither half's words saw.

    So words that are toxic by accident of their own rows don't inflate the evidence on which the logistic is fitted.
    """
    found = np.array(sorted(seen))
    model = word_model(counts, totals, [0, 1])
    return model | {"k": math.sqrt(models[0]["k"] * models[1]["k"]), "weights": logistic(found[:, 1:], found[:, 0]).tolist()}


def constant(toxic: bool) -> dict:
    """The model of texts with one label only."""
    return {"words": {}, "drift": 1.0, "lambda": 1.0, "k": 1.0, "weights": [0.0, 0.0, 0.0, 4.0 if toxic else -4.0]}


def fit(texts: list[str | None], toxic: list[int]) -> dict:
    """The model of a sample in memory; every other text is one half."""
    once = dict(zip(reversed(texts), reversed(toxic), strict=True))
    rows = [(t, y, i % 2) for i, (t, y) in enumerate(once.items())]
    if len(set(once.values())) < 2:
        return constant(1 in once.values())
    counts = count_words(rows)
    totals = sum(x for w, x in counts.items() if w)
    models = half_models(counts, totals)
    with_k(models, best_scores(rows, models))
    return whole_model(counts, totals, models, feature_rows(rows, models))


def score_text(text: str | None, model: dict) -> float:
    value = np.dot([*features(words_of(text), model), 1.0], model["weights"])
    return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held: int = 1) -> dict:
    """Fits on at most MAX_TRAIN labelled ids outside the held-out fold; whole texts stay with the executors."""
    known = isolate(labels, id_col, label_col).toDF("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) != held))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(3)))
    sample = known.orderBy("h").limit(MAX_TRAIN)
    rows = isolate(docs, id_col, text_col).toDF("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = F.min_by(F.struct("text", "toxic"), F.struct("h", "toxic"))
    rows = durable(rows.groupBy(F.xxhash64("text").alias("t"), F.xxhash64(F.lit(7), "text").alias("u")).agg(one.alias("x")).select("x.*", F.pmod("t", F.lit(2)).cast("int").alias("half")))
    seen = {r[0] for r in rows.select("toxic").distinct().collect()}
    if len(seen) < 2:
        return constant(1 in seen)
    counts, totals = _counted(rows)
    models = half_models(counts, totals)
    with_k(models, _measured(rows, models, best_scores, "half int, toxic int, words int, best double"))
    return whole_model(counts, totals, models, _measured(rows, models, feature_rows, "toxic int, f double, g double, h double"))


def _texts(frame: pa.RecordBatch) -> Iterable[Row]:
    return zip(*(frame[c].to_pylist() for c in ("text", "toxic", "half")), strict=True)


def _counted(rows: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts of the words in toxic texts, and the sums over all words."""
    names = [f"n{k}" for k in range(8)]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            counts = count_words(_texts(frame))
            held = np.array([x.reshape(-1) for x in counts.values()], np.int64).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *map(pa.array, held.T.copy())], ["word", *names])

    every = rows.mapInArrow(batches, "word string, " + ", ".join(f"{n} long" for n in names)).groupBy("word").agg(*[F.sum(n).alias(n) for n in names])
    every = durable(every)
    totals = np.array(every.where("word <> ''").agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in names]).first(), np.int64).reshape(2, 2, 2)
    toxic = every.where("word <> '' AND n1 + n3 > 0").collect()
    return {r[0]: np.array(r[1:], np.int64).reshape(2, 2, 2) for r in toxic}, totals


def _measured(rows: DataFrame, models: list[dict], kernel: Callable, schema: str) -> list[tuple]:
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = kernel(_texts(frame), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int32() if kind.endswith("int") else pa.float64()) for k, kind in enumerate(schema.split(", "))], [c.split()[0] for c in schema.split(", ")])

    return [tuple(r) for r in rows.mapInArrow(batches, schema).collect()]


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """doc_id, score, predicted; with ``spans`` also the first and last word and the evidence of each toxic passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = shared.value, np.array(shared.value["weights"])
        for frame in frames:
            values, found = np.zeros((frame.num_rows, 4)), []
            values[:, 3] = 1
            for i, text in enumerate(frame["text"].to_pylist()):
                split = words_of(text)
                values[i, :3] = features(split, model)
                if spans:
                    found.append([{"first": f, "last": t, "evidence": e} for f, t, e in passages(split, model)])
            score = 1 / (1 + np.exp(-np.clip(values @ weights, -30, 30)))
            out = [frame["doc_id"], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("evidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays(out + [pa.array(found, kind)] * spans, ["doc_id", "score", "predicted"] + ["passages"] * spans)

    rows = parallel(isolate(docs, id_col, text_col).toDF("doc_id", "text"))
    kind = docs.schema[docs.columns.index(id_col)].dataType.simpleString()
    more = ", passages array<struct<first:int,last:int,evidence:double>>" if spans else ""
    return rows.mapInArrow(batches, f"doc_id {kind}, score double, predicted int{more}")
