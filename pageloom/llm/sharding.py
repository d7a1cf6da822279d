"""Sharding by longest processing time: groups of equal texts, largest first, go to the least-loaded shard.

Law: ``bytes`` (near-equal sizes).  Groups of one size are interchangeable, so the heap is run over sizes with the number of
their groups: the r-th group of a size goes to the shard with the r-th smallest of (load + m size, shard) over all shards and
m = 0, 1, ...  With rising r shards join in order of their loads and take turns between, so a size's groups are told by at most
one cycle of shards for each shard.  That is the placement that a heap over all groups one by one would make, at any size.

The driver sees a number for each distinct size, of which a corpus of B bytes can have sqrt(2 B) at most (245,000 in 30 GB), and
sends back their cycles.  Groups are ranked within their size by their key over ranges, so reruns agree and a size may hold any
share of the groups.  No document row is collected.

Null text has no bytes (size 1, crc32 0) and is a group of its own beside empty text.  Rows that repeat are rows of one group.
A group larger than a shard's share stays whole, since groups may not be split; the other shards then stay level.  Columns
besides doc_id and text are never looked at, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions.order import running_by
from pageloom.llm.common import cells, durable, isolate, small_side

#: Rows in one cell of a shard, within which slots are numbered.
CELL_ROWS = 20_000


def cycles(sizes: list[tuple[int, int]], shards: int) -> list[list[tuple[int, list[int]]]]:
    """Of each (size, groups), by falling size: (first rank, shards in turn) of the runs that its groups are dealt in."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, groups in sizes:
        turn: list[tuple[int, int]] = []
        runs, rank = [], 0
        while rank < groups:
            if heap:
                turn = sorted([*turn, heapq.heappop(heap)])
            many = groups - rank
            if heap:  # those of (load + m size, shard) that come before the least-loaded shard of the rest
                load, shard = heap[0]
                many = min(many, sum((load - own + size - (s > shard)) // size for own, s in turn if own <= load))
            if many:
                runs.append((rank, [s for _, s in turn]))
                turn = sorted((own + size * (many // len(turn) + (i < many % len(turn))), s) for i, (own, s) in enumerate(turn))
                rank += many
        for t in turn:
            heapq.heappush(heap, t)
        out.append(runs)
    return out


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null under this law)."""
    rows = isolate(docs, id_col, text_col).toDF("doc_id", "text")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = durable(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.col("text").isNull()).alias("text_key")))
    n = rows.count()
    groups = durable(rows.groupBy("text_key").agg(F.sum("size").alias("group_size")))
    held = groups.groupBy("group_size").agg(F.count("*").alias("groups")).toArrow()
    sizes = sorted(zip(held["group_size"].to_pylist(), held["groups"].to_pylist(), strict=True), reverse=True)
    runs = cycles(sizes, shards)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("turn", pa.list_(pa.int32()))]))
    table = pa.table([pa.array([s for s, _ in sizes], pa.int64()), pa.array([[{"first": f, "turn": t} for f, t in r] for r in runs], kind)], ["group_size", "runs"])
    dealt = docs.sparkSession.createDataFrame(table)
    ranked = running_by(groups, ["group_size"], [F.col("text_key")], place="rank").join(small_side(dealt, sum(map(len, runs)) * (shards + 4), 4), "group_size")
    at = F.element_at(F.filter("runs", lambda r: r["first"] < F.col("rank")), -1)
    of_group = ranked.select("text_key", F.get(at["turn"], F.pmod(F.col("rank") - 1 - at["first"], F.size(at["turn"])).cast("int")).alias("shard"))
    out = rows.join(small_side(of_group, groups.count(), 24), "text_key")
    parts = cells(n, CELL_ROWS * shards)
    out = out.select("doc_id", "size", "text_crc32", "row", "shard", F.pmod(F.xxhash64("row"), F.lit(parts)).alias("cell"))
    before = out.groupBy("shard", "cell").agg(F.count("*").alias("held"))
    before = before.select("shard", "cell", (F.sum("held").over(Window.partitionBy("shard").orderBy("cell")) - F.col("held")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("row")) - 1
    out = out.withColumn("place", place).join(small_side(before, parts * shards, 24), ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
