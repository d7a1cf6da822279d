"""Lexical retrieval packing: a sharded BM25 index returns unused neighbours of each seed document, which fill its window.

Retrieval is confined to a shard, so documents are dealt to shards by content.  A router, fitted on at most SAMPLE
documents (the smallest hashes; a documented bound), projects a document's weighted tokens to DIMS random directions and
halves the sample along principal directions, level by level; documents are range-sorted by (leaf, place on the leaf's own
principal direction, hash), so like documents lie side by side and copies of one document fill as many shards as they
need.  A shard is the next SHARD_DOCS documents (or SHARD_TOKENS tokens) in that order, which bounds a task's memory.  The
README has the recall that is measured.  Document frequencies and mean length are those of all documents.

For each shard an inverted index over token ids is built by one sort.  The next unused document in order seeds the open
window; all of the seed's tokens are looked up and its unused neighbours follow by falling BM25 score, until the window is
full or no document with a score is left: then the next document in order goes in as the next seed.  A document that
reaches the end of the window is cut there; its rest opens the next one and it is that window's seed, so every window but a
shard's last is full.  The last is cut into parts whose lengths are powers of two, which need no padding.

A document is its byte-level BPE ids and then END.  Null text counts as empty and is the one id END.  Very long texts are
cut over as many windows as they need.  Rows that repeat, with their doc_id or without, are packed on their own.  Columns
besides doc_id and text are never looked at, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import cells, durable, isolate, parallel, release, stored, thrifty

WINDOW, END, SHARD_DOCS, SHARD_TOKENS = 2048, 1, 4096, 1 << 22

#: Documents that fit the router, its projection's width, and the most levels of halving.
SAMPLE, DIMS, LEVELS = 4096, 32, 8

#: Token ids are below this.
VOCABULARY = 1 << 16

#: So many neighbours are sorted before the rest, which few windows reach.
HEAD = 32

#: Tokens in at least 1/DENSE of a shard's documents have a whole row of weights, which is added faster than a list.
DENSE = 8

#: BM25.
K1, B = 1.2, 0.75

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The ids of a whole text and END; the special token's string in a text is its one id."""
    ids = _encoding(path).encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32)
    return np.append(ids, np.uint32(END)).astype(np.uint32)


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.default_rng(2048).normal(size=(VOCABULARY, DIMS)).astype(np.float32)


def direction_of(ids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The unit vector of a document's weighted tokens."""
    tokens, counts = np.unique(ids, return_counts=True)
    found = (idf[tokens] * (counts / (counts + K1)).astype(np.float32)) @ _directions()[tokens]
    return found / max(float(np.linalg.norm(found)), 1e-9)


class Router:
    """A tree that halves the sample along its principal direction at each node; leaves are numbered from left to right."""

    def __init__(self, sample: list[np.ndarray], levels: int):
        df = np.bincount(np.concatenate([*map(np.unique, sample), np.zeros(0, np.int64)]).astype(np.int64), minlength=VOCABULARY)
        self.idf, self.levels = idf_of(df, len(sample)), levels
        self.center, self.along = np.zeros((2, 2 << levels, DIMS), np.float32)
        self.cut = np.zeros(2 << levels, np.float32)
        points = np.stack([direction_of(ids, self.idf) for ids in sample]) if sample else np.zeros((0, DIMS), np.float32)
        self._halve(points, 1, 0)

    def _halve(self, points: np.ndarray, node: int, level: int) -> None:
        if len(points) > 1:
            self.center[node] = points.mean(axis=0)
            around = points - self.center[node]
            self.along[node] = np.linalg.eigh((around.T @ around).astype(np.float64))[1][:, -1]
        place = (points - self.center[node]) @ self.along[node]
        self.cut[node] = np.median(place) if len(points) else 0.0
        if level < self.levels:
            for side in (0, 1):
                self._halve(points[(place > self.cut[node]) == bool(side)], 2 * node + side, level + 1)

    def route(self, ids: np.ndarray) -> tuple[int, float]:
        """Leaf and place of a document."""
        point, node = direction_of(ids, self.idf), 1
        place = lambda: float((point - self.center[node]) @ self.along[node])
        for _ in range(self.levels):
            node = 2 * node + (place() > self.cut[node])
        return int(node), round(place(), 6)


class Bm25Shard:
    """An inverted index of a shard's documents over token ids, by the idf and mean length of all documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray | None = None, mean: float = 0.0):
        self.docs, self.n = docs, len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        owner = np.repeat(np.arange(self.n, dtype=np.uint32), lengths)
        keys = np.sort((np.concatenate(docs).astype(np.uint32) << np.uint32(16)) | owner)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        tf = np.diff(np.append(first, len(keys))).astype(np.float32)
        token, self.doc = (keys[first] >> np.uint32(16)).astype(np.int64), (keys[first] & np.uint32(0xFFFF)).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=VOCABULARY))])
        self.df = np.diff(self.begin)
        self.idf = idf_of(self.df, self.n) if idf is None else idf
        norm = (K1 * (1 - B + B * lengths / (mean or lengths.mean()))).astype(np.float32)
        self.weight = self.idf[token] * tf * np.float32(K1 + 1) / (tf + norm[self.doc])
        self.row = np.where(self.df * DENSE >= self.n, np.cumsum(self.df * DENSE >= self.n) - 1, -1)
        held = self.row[token] >= 0
        self.rows = np.zeros((self.row.max() + 1, self.n), np.float32)
        self.rows[self.row[token[held]], self.doc[held]] = self.weight[held]

    def ranked(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """All unused documents that share a token with ``seed``, by falling score, then place."""
        terms = np.unique(self.docs[seed])
        terms = terms[self.df[terms] > 1]
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in terms[self.row[terms] < 0]]
        score = np.zeros(self.n, np.float32)
        if spans:
            score += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        for k in self.row[terms[self.row[terms] >= 0]].tolist():
            score += self.rows[k]
        score *= unused.astype(np.float32)
        left = np.flatnonzero(score > 0)
        if len(left) > HEAD:
            least = -np.partition(-score[left], HEAD - 1)[HEAD - 1]
            head, left = left[score[left] >= least], left[score[left] < least]
            yield from head[np.argsort(-score[head], kind="stable")].tolist()
        yield from left[np.argsort(-score[left], kind="stable")].tolist()

    def neighbours(self, seed: int, unused: np.ndarray) -> list[int]:
        return list(self.ranked(seed, unused))


def pack(docs: list[np.ndarray], idf: np.ndarray | None = None, mean: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard; without ``idf`` the shard is all there is."""
    if not docs:
        return []
    index, unused = Bm25Shard(docs, idf, mean), np.ones(len(docs), bool)
    pieces, sequence, filled = [], 0, 0

    def place(doc: int) -> None:
        nonlocal sequence, filled
        unused[doc], start, total = False, 0, len(docs[doc])
        while start < total:
            length = min(total - start, WINDOW - filled)
            pieces.append((doc, start, length, sequence, filled))
            start, filled = start + length, filled + length
            if filled == WINDOW:
                sequence, filled = sequence + 1, 0

    for seed in range(len(docs)):
        if not unused[seed]:
            continue
        place(seed)
        last = seed
        while filled:
            window = sequence
            for last in index.ranked(last, unused):
                place(last)
                if sequence != window:
                    break
            else:
                break  # no unused neighbour is left: the next seed goes on filling the window
    return _tail(pieces, sequence, filled)


def _tail(pieces: list[tuple[int, int, int, int, int]], sequence: int, filled: int) -> list[tuple[int, int, int, int, int]]:
    """The unfilled last window, cut into sequences of falling powers of two."""
    done = [p for p in pieces if p[3] < sequence]
    bits = [1 << k for k in range(filled.bit_length() - 1, -1, -1) if filled >> k & 1]
    ends = np.cumsum(bits).tolist()
    for doc, start, length, _, offset in (p for p in pieces if p[3] == sequence):
        while length:
            k = next(i for i, e in enumerate(ends) if offset < e)
            part = min(length, ends[k] - offset)
            done.append((doc, start, part, sequence + k, offset - (ends[k] - bits[k])))
            start, length, offset = start + part, length - part, offset + part
    return done


def routed(docs: DataFrame, path: str) -> tuple[DataFrame, str, int]:
    """doc_id, leaf, place, tie and ids (two bytes each) of every document as a stored table, its path, and their number."""
    keyed = docs.withColumn("h", F.xxhash64("doc_id", "text"))
    n = docs.count()
    last = keyed.groupBy("h").agg(F.count("*").alias("rows")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    sample = keyed.where(F.col("h") <= (last if last is not None else 0)).dropDuplicates(["h"]).orderBy("h")

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [token_ids(text, path).astype(np.uint16).tobytes() for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["h"], pa.array(ids, pa.binary())], ["h", "ids"])

    held = sorted((r["h"], bytes(r["ids"])) for r in sample.select("h", "text").mapInArrow(thrifty(tokenised), "h long, ids binary").collect())
    levels = min(LEVELS, max(0, (cells(n, SHARD_DOCS) - 1).bit_length()))
    router = docs.sparkSession.sparkContext.broadcast(Router([np.frombuffer(ids, np.uint16) for _, ids in held], levels))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                ids = [token_ids(text, path) for text in part["text"].to_pylist()]
                leaf, place = zip(*(router.value.route(x) for x in ids), strict=True)
                columns = [part["doc_id"], pa.array(leaf, pa.int32()), pa.array(place), part["tie"], pa.array([x.astype(np.uint16).tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "place", "tie", "ids"])

    tied = docs.withColumn("tie", F.xxhash64("doc_id", "text", F.monotonically_increasing_id()))
    return *stored(tied.mapInArrow(thrifty(dealt), "doc_id long, leaf int, place double, tie long, ids binary")), n


def statistics(tokens: DataFrame) -> tuple[np.ndarray, float]:
    """idf by token id and mean length over all documents; the driver gets one row for each token id."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(VOCABULARY, np.int64), 0
        docs = 0
        for batch in batches:
            for ids in (np.frombuffer(x.as_buffer(), np.uint16) for x in batch["ids"]):
                df[np.unique(ids)] += 1
                docs, total = docs + 1, total + len(ids)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *held.tolist()], pa.int32()), pa.array([docs, total, *df[held].tolist()], pa.int64())], ["token", "n"])

    found = dict(map(tuple, tokens.select("ids").mapInArrow(thrifty(counted), "token int, n long").groupBy("token").agg(F.sum("n")).collect()))
    docs, total = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(VOCABULARY, np.int64)
    df[list(found)] = list(found.values())
    return idf_of(df, docs), total / max(docs, 1)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or tokenizer_path()
    rows = parallel(isolate(docs, id_col, text_col).toDF("doc_id", "text")).selectExpr("cast(doc_id as long) doc_id", "text")
    tokens, at, n = routed(rows, path)
    known = docs.sparkSession.sparkContext.broadcast(statistics(tokens))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        names, docs, held = [], [], 0
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                names.append(doc_id)
                docs.append(np.frombuffer(ids.as_py(), np.uint16))
                held += len(docs[-1])
                if len(docs) == SHARD_DOCS or held >= SHARD_TOKENS:
                    yield names, docs
                    names, docs, held = [], [], 0
        if docs:
            yield names, docs

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = TaskContext.get().partitionId() << 32
        for names, docs in shards(batches):
            pieces = pack(docs, *known.value)
            crc = [zlib.crc32(docs[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
            at = np.array(pieces, np.int64).reshape(-1, 5)
            columns = [pa.array([names[d] for d in at[:, 0]], pa.int64()), pa.array(at[:, 1]), pa.array(at[:, 2]), pa.array(crc, pa.int64()), pa.array([len(docs[d]) for d in at[:, 0]], pa.int64()), pa.array(at[:, 3] + sequences), pa.array(at[:, 4])]
            sequences += int(at[:, 3].max()) + 1
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECE.split(", ")])

    order = ["leaf", "place", "tie"]
    dealt = tokens.repartitionByRange(cells(n, SHARD_DOCS), *order).sortWithinPartitions(*order)
    pieces = durable(dealt.select("doc_id", "ids").mapInArrow(thrifty(packed), PIECE))
    release(tokens, at)
    return pieces
