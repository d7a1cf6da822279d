"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Distinct vectors are dealt to shards of about SHARD vectors by a hash.  Each shard's graph is stored durably as flat
arrays: the neighbour table of each layer, the nodes of the upper layers, and the vectors.  Queries meet every shard: a
task takes a block of at most about QUERY_BLOCK queries and GROUP shards, asks its shards one after another and passes on
the best TOP over all of them, so few rows are left to merge.  With few shards a group has fewer, to use more tasks.  The
work still grows with queries x shards, as it must where each query asks each shard; shards are copied once for each
block, and TOP rows leave each query and group.

Equal vectors are one node that carries its TOP + 1 smallest ids.  That is exact, not a cap: copies share every
distance, ties go to the smaller id, and no query can return more than TOP of them besides itself.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id; vectors of
another dimension meet only their own kind.  Rows that repeat are one candidate.  An id with several vectors is one
candidate too, at the nearest of them, and a query id with several asks with each and gets one list.  With fewer candidates
than TOP all are returned.  Columns besides id and vector are never looked at, whatever their names.  An empty table gives
an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.llm.common import cells, durable, isolate

SHARD, LINKS, EF_BUILD, EF_SEARCH, TOP, QUERY_BLOCK, GROUP, TASKS = 8192, 12, 48, 160, 10, 32_768, 16, 64

INDEX = "shard int, dims int, vectors binary, ids binary, tops binary, layers binary, sizes array<int>"


def squared(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = points - q
    return np.einsum("ij,ij->i", d, d)


class Graph:
    """HNSW over the rows of ``points``; ``layers[l][node]`` is a row of neighbours, -1 where there is none."""

    def __init__(self, points: np.ndarray, tops: np.ndarray | None = None, layers: list[np.ndarray] | None = None):
        self.points, self.n = points, len(points)
        if layers is not None:
            self.tops, self.layers = tops, layers
            self.entry = int(np.argmax(tops))
            return
        rng = np.random.default_rng(self.n)
        self.tops = np.minimum(8, (-np.log(1 - rng.random(self.n)) / np.log(LINKS)).astype(np.int32))
        self.layers = [np.full((self.n, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(int(self.tops.max(initial=0)) + 1)]
        self.entry, self._seen, self._mark = 0, np.zeros(self.n, np.int32), 0
        for node in range(1, self.n):
            self._insert(node)

    def _search(self, q: np.ndarray, entries: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nearest found from ``entries``, nearest first."""
        table, points = self.layers[layer], self.points
        self._mark += 1
        seen, mark = self._seen, self._mark
        near = list(entries)
        heapq.heapify(near)
        best = [(-d, i) for d, i in entries]
        heapq.heapify(best)
        seen[[i for _, i in entries]] = mark
        while near:
            d, i = heapq.heappop(near)
            if d > -best[0][0] and len(best) >= ef:
                break
            around = table[i]
            around = around[around >= 0]
            around = around[seen[around] != mark]
            if not len(around):
                continue
            seen[around] = mark
            for e, j in zip(squared(points[around], q).tolist(), around.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-e, j))
                    heapq.heappush(near, (e, j))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, j))
                    heapq.heappush(near, (e, j))
        return sorted((-d, i) for d, i in best)

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours nearer to the node than to any neighbour already chosen; places left go to the nearest others."""
        if len(found) <= most:
            return [i for _, i in found]
        nodes = [i for _, i in found]
        points = self.points[nodes]
        norm = np.einsum("ij,ij->i", points, points)
        between = norm[:, None] + norm[None, :] - 2 * points @ points.T
        own = np.array([d for d, _ in found])
        closest, chosen, passed = np.full(len(nodes), np.inf), [], []
        for k in range(len(nodes)):
            if own[k] < closest[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                np.minimum(closest, between[k], out=closest)
            else:
                passed.append(k)
        return [nodes[k] for k in (chosen + passed)[:most]]

    def _insert(self, node: int) -> None:
        q, top = self.points[node], int(self.tops[node])
        at = [(float(squared(self.points[[self.entry]], q)[0]), self.entry)]
        height = int(self.tops[self.entry])
        for layer in range(height, top, -1):
            at = self._search(q, at, 1, layer)
        for layer in range(min(top, height), -1, -1):
            at = self._search(q, at, EF_BUILD, layer)
            table = self.layers[layer]
            own = self._choose(at, LINKS)
            table[node, : len(own)] = own
            for other in own:
                row = table[other]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                    continue
                all_ = np.append(row, node)
                d = squared(self.points[all_], self.points[other])
                order = np.argsort(d, kind="stable")
                kept = self._choose(list(zip(d[order].tolist(), all_[order].tolist(), strict=True)), len(row))
                row[:] = -1
                row[: len(kept)] = kept
        if top > height:
            self.entry = node

    def nearest(self, q: np.ndarray, ef: int) -> list[int]:
        if not hasattr(self, "_seen"):
            self._seen, self._mark = np.zeros(self.n, np.int32), 0
        at = [(float(squared(self.points[[self.entry]], q)[0]), self.entry)]
        for layer in range(int(self.tops[self.entry]), 0, -1):
            at = self._search(q, at, 1, layer)
        return [i for _, i in self._search(q, at, ef, 0)]


def usable(vector: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    wide = vector.cast("array<double>")
    finite = F.forall(wide, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id")
    points = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    graph = Graph(points)
    ids = np.full((len(rows), TOP + 1), -1, np.int64)
    held = np.zeros((len(rows), TOP + 1), bool)
    for i, members in enumerate(rows["members"]):
        ids[i, : len(members)], held[i, : len(members)] = np.sort(members), True
    flat = b"".join(t[graph.tops >= k].tobytes() for k, t in enumerate(graph.layers))
    sizes = [int((graph.tops >= k).sum()) for k in range(len(graph.layers))]
    return pd.DataFrame([(int(rows["shard"].iloc[0]), points.shape[1], points.tobytes(), ids.tobytes() + held.tobytes(), graph.tops.astype(np.int32).tobytes(), flat, sizes)], columns=[c.split()[0] for c in INDEX.split(", ")])


def load(row: pd.Series) -> tuple[Graph, np.ndarray, np.ndarray]:
    """The graph, ids and id flags of a stored shard."""
    points = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dims"])
    n, tops = len(points), np.frombuffer(row["tops"], np.int32)
    ids = np.frombuffer(row["ids"], np.int64, n * (TOP + 1)).reshape(n, -1)
    held = np.frombuffer(row["ids"], bool, n * (TOP + 1), ids.nbytes).reshape(n, -1)
    layers, at = [], 0
    for k, size in enumerate(row["sizes"]):
        width = 2 * LINKS if k == 0 else LINKS
        table = np.full((n, width), -1, np.int32)
        table[tops >= k] = np.frombuffer(row["layers"], np.int32, size * width, at).reshape(size, width)
        layers.append(table)
        at += 4 * size * width
    return Graph(points, tops, layers), ids, held


def _answer(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The best TOP of some shards for each of some queries."""
    best: dict[int, dict[int, float]] = {}
    for k in range(len(index)):
        graph, ids, held = load(index.iloc[k])
        for q_id, vector in zip(queries["query_id"], queries["vector"], strict=True):
            q = np.asarray(vector, np.float64)
            nodes = graph.nearest(q, EF_SEARCH)
            mine, fresh = best.setdefault(q_id, {}), set()
            for score, i in zip(np.sqrt(squared(graph.points[nodes], q)).tolist(), nodes, strict=True):
                if len(fresh) > TOP:
                    break
                for v in ids[i][held[i]].tolist():
                    if v != q_id:
                        fresh.add(v)
                        mine[v] = min(score, mine.get(v, score))
            if len(mine) > 4 * TOP:
                best[q_id] = _top(mine)
    out = [(q_id, v, s) for q_id, mine in best.items() for v, s in _top(mine).items()]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": np.int64, "vec_id": np.int64, "score": float})


def _top(found: dict[int, float]) -> dict[int, float]:
    return {v: s for s, v in heapq.nsmallest(TOP, ((s, v) for v, s in found.items()))}


def build_index(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The stored shards of (vec_id, vector) and their number."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    heads = vectors.groupBy("vector", "vec_id").agg(F.count("*").alias("rows")).withColumn("rank", rank).where(F.col("rank") <= TOP + 1)
    nodes = durable(heads.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.collect_list("vec_id").alias("members")))
    shards = cells(nodes.count(), SHARD)
    nodes = nodes.select("*", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), F.size("vector").alias("dims"))
    return durable(nodes.groupBy("shard", "dims").applyInPandas(_build, INDEX)), shards


def nearest_neighbours(embeddings: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the TOP nearest found of every query, its own row left out."""
    named = lambda df: isolate(df, id_col, vector_col).toDF("vec_id", "vector").where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    index, shards = build_index(named(embeddings))
    asked = durable(named(queries).withColumnRenamed("vec_id", "query_id"))
    blocks = cells(asked.count(), QUERY_BLOCK)
    groups = min(shards, max(-(-shards // GROUP), -(-TASKS // blocks)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("*", F.size("vector").alias("dims"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), each(groups).alias("group"))
    spread = index.select("*", F.pmod("shard", F.lit(groups)).cast("int").alias("group"), each(blocks).alias("block"))
    keys = ["group", "dims", "block"]
    found = spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_answer, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= TOP)
