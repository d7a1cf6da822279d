"""Language ID: blended-spectrum n-gram presence kernel, Nystroem landmarks, one-versus-rest kernel ridge regression.

A text is the set of its letter n-grams of 1 to MAX_N characters (lower-cased; every run of other characters is one
blank).  The kernel of two texts is the size of the intersection of their sets, normalised by both sizes:
``k(x, y) = |X n Y| / sqrt(|X| |Y|)``.  Grams are held as presence flags over 2^BITS hash slots.

LANDMARKS texts, the first of each language in order of a hash of the id, span the Nystroem space.  Ridge regression with
one target for each language is solved on the labelled sample in that space; since scores are linear in the presence
vector, landmarks and weights fold into one matrix of slots x languages.  A batch of BATCH texts is one sparse presence
matrix (compressed rows), and its scores are one product of that matrix with the weights.

Fitting uses at most PER_LANG labelled rows of each language (the smallest hashes of the id, a documented bound) whose
fold allows it, and fewer of each if they are more than MOST_ROWS together; every language with such a row that has a letter
is a class, however rare.  A column with more than MOST_LANGS values isn't one of languages; the most frequent ones are
classes then, since a model has 256 KB a language.  For its languages the model is fixed in size and reaches the executors inside the scoring function.  Text is read whole, in chunks of
bounded memory.  Null text or text without a letter gets ``und`` with score 0; of languages with equal scores the first
in code-point order is predicted.  Rows that repeat are predicted and kept one by one, and equal texts alike.  Columns
besides those named are never looked at, whatever their names.  Without training rows every text is ``und``; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import durable, handed_back, isolate, numbered, parallel, remainder, small_side, thrifty

MAX_N, BITS, LANDMARKS, PER_LANG, RIDGE = 3, 16, 192, 500, 1e-3

#: The pipeline rejects ``und`` and texts that no language scores above this.
REJECT_BELOW = 0.15

#: Characters hashed at once, and texts scored at once.
CHUNK, BATCH = 1 << 18, 256

#: Numbers of a product held at once, and rows that a model is fitted on; so many languages and rows are the driver's bound.
PRODUCT, MOST_ROWS, MOST_LANGS = 1 << 22, 10_000, 1000

_OTHER = regex.compile(r"\P{L}+")


def gram_slots(text: str | None) -> np.ndarray | None:
    """The slots of the text's grams, each once; None without a letter."""
    if text is None:
        return None
    bare = _OTHER.sub(" ", text.lower())
    if not bare.strip():
        return None
    code = np.frombuffer(f" {bare.strip()} ".encode("utf-32-le"), np.uint32)
    flags = np.zeros(1 << BITS, bool)
    with np.errstate(over="ignore"):
        for begin in range(0, len(code), CHUNK):
            part = code[begin : begin + CHUNK + MAX_N - 1]
            h = np.zeros(len(part), np.uint32)
            for n in range(1, MAX_N + 1):
                m = len(part) - n + 1
                if m <= 0:
                    break
                h = (h[:m] + part[n - 1 :]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                flags[(h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(flags).astype(np.int32)


class Presence:
    """The presence matrix of some texts in compressed rows: row i holds 1 / sqrt(size) in the slots of text i."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.columns = np.concatenate([*sets, np.zeros(0, np.int32)])
        self.scale = np.maximum(self.sizes, 1) ** -0.5

    def __matmul__(self, dense: np.ndarray) -> np.ndarray:
        """The product with a matrix of slots x anything, some flags at a time: PRODUCT numbers are held at once."""
        out = np.zeros((len(self.sizes), dense.shape[1]))
        rows, step = np.repeat(np.arange(len(self.sizes)), self.sizes), max(1, PRODUCT // max(1, dense.shape[1]))
        for k in range(0, len(rows), step):
            row = rows[k : k + step]
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[starts]] += np.add.reduceat(dense[self.columns[k : k + step]], starts, axis=0)
        return out * self.scale[:, None]

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self.sizes), 1 << BITS), np.float32)
        out[np.repeat(np.arange(len(self.sizes)), self.sizes), self.columns] = np.repeat(self.scale, self.sizes)
        return out


def fit(texts: list[str | None], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages and the slots x languages weights."""
    return fit_slots([gram_slots(t) for t in texts], langs)


def fit_slots(sets: list[np.ndarray | None], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """``fit`` from the slots of the texts."""
    rows = [(s, str(y)) for s, y in zip(sets, langs, strict=True) if s is not None]
    labels = sorted({y for _, y in rows})
    if not rows:
        return [], np.zeros((1 << BITS, 0), np.float32)
    held: dict[str, list[np.ndarray]] = {}
    for s, y in rows:
        held.setdefault(y, []).append(s)
    by_lang = [held[name] for name in labels]
    basis = Presence([s for group in by_lang for s in group[: max(1, LANDMARKS // len(labels))]]).dense()
    slots = np.ascontiguousarray(basis.T)
    cross = np.concatenate([Presence([s for s, _ in rows[k : k + 32]]) @ slots for k in range(0, len(rows), 32)])  # few rows: each slot meets all landmarks
    values, vectors = np.linalg.eigh((basis @ slots).astype(np.float64))
    good = values > values.max() * 1e-6
    project = vectors[:, good] / np.sqrt(values[good])
    mapped = cross @ project
    wanted = np.array([y for _, y in rows])[:, None] == np.array(labels)[None, :]
    share = {name: 1.0 / (len(labels) * len(group)) for name, group in zip(labels, by_lang, strict=True)}
    weight = np.array([share[y] for _, y in rows])[:, None]
    gram = mapped.T @ (mapped * weight) + RIDGE * np.eye(mapped.shape[1]) / len(labels)
    solved = project @ np.linalg.solve(gram, mapped.T @ (wanted * weight))
    return labels, (slots.astype(np.float64) @ solved).astype(np.float32)


def scores(texts: list[str | None], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ridge scores of texts (zeros without a letter), one product for each batch, and which have letters."""
    out, lettered = [np.zeros((0, weights.shape[1]))], np.zeros(len(texts), bool)
    for k in range(0, len(texts), BATCH):
        sets = [gram_slots(t) for t in texts[k : k + BATCH]]
        lettered[k : k + BATCH] = [s is not None for s in sets]
        out.append(Presence([np.zeros(0, np.int32) if s is None else s for s in sets]) @ weights)
    return np.concatenate(out), lettered


def predict(texts: list[str | None], labels: list[str], weights: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The best language of each text (ties: first in code-point order) and its score, clipped to 0..1."""
    if not labels:
        return ["und"] * len(texts), np.zeros(len(texts))
    raw, lettered = scores(texts, weights)
    best = raw.argmax(axis=1)
    value = np.clip(raw[np.arange(len(texts)), best], 0.0, 1.0) * lettered
    return [labels[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], value


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: int = 2) -> tuple[list[str], np.ndarray]:
    """Fits on at most PER_LANG labelled rows a language outside the held-out fold, and MOST_ROWS of all languages or one of each.

    Executors find the slots of those rows' texts, and 8 KB a row reach the driver, never a text.
    """
    rows = isolate(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang")
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder(F.col("doc_id"), 4) != held)).withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(4)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # each scan task passes on PER_LANG rows of a language at most
    near = durable(rows.select("lang", "h").withColumn("place", place).where(F.col("place") <= PER_LANG))
    langs = near.groupBy("lang").agg(F.count("*").alias("held")).orderBy(F.desc("held"), "lang").limit(MOST_LANGS)
    langs = durable(langs)
    each = max(1, min(PER_LANG, MOST_ROWS // max(1, langs.count())))
    last = near.where(F.col("place") <= each).join(F.broadcast(langs), "lang").groupBy("lang").agg(F.max("h").alias("last"))  # at most MOST_LANGS rows
    chosen = rows.join(F.broadcast(last), "lang").where(F.col("h") <= F.col("last")).withColumn("place", place).where(F.col("place") <= each).select("h", "text", "lang")

    def packed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            flags = []
            for text in frame["text"]:
                flag, slots = np.zeros(1 << BITS, bool), gram_slots(text.as_py())
                if slots is not None:
                    flag[slots] = True
                flags.append(np.packbits(flag).tobytes())
            yield pa.RecordBatch.from_arrays([frame["h"], pa.array(flags, pa.binary()), frame["lang"]], ["h", "flags", "lang"])

    kind = dict(rows.dtypes)["lang"]
    sample = chosen.mapInArrow(thrifty(packed), f"h long, flags binary, lang {kind}").collect()
    sample.sort(key=lambda r: (r["h"], bytes(r["flags"]), str(r["lang"])))
    sets = [np.flatnonzero(np.unpackbits(np.frombuffer(r["flags"], np.uint8))).astype(np.int32) for r in sample]
    return fit_slots([s if len(s) else None for s in sets], [r["lang"] for r in sample])


def identify(docs: DataFrame, labels: list[str], weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast((labels, weights))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            lang, score = predict(frame["text"].to_pylist(), *model.value)
            yield pa.RecordBatch.from_arrays([frame["doc_id"], pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = parallel(isolate(docs, id_col, text_col).toDF("doc_id", "text"))
    return rows.mapInArrow(thrifty(batches), f"doc_id {docs.schema[docs.columns.index(id_col)].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, labels: list[str], weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast((labels, weights))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        lang, score = predict(list(texts), *model.value)
        return handed_back(pd.Series([x != "und" and s >= REJECT_BELOW for x, s in zip(lang, score, strict=True)], dtype=bool))

    plain, at, old = numbered(docs)
    return parallel(plain).where(known(at[text_col])).toDF(*old)
