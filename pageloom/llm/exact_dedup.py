"""Exact dedup: a minimal perfect hash over the distinct digests of a history of documents.

``build_index`` turns a history into an index: its distinct digests, cut into buckets of about BUCKET_DIGESTS, each one
minimal perfect hash whose slots hold the full 32-byte digest, the locator of the row that stays (doc_id and row) and the
number of equal rows.  An index is a table; ``write_index`` keeps it for later runs.  All winners come from it: each row
of the documents is looked up in its bucket and is a member only if all 32 bytes agree.  Nonmembers, which the history
never had, are grouped separately.

Without an index of an earlier run the documents are their own history: of equal texts the row with the largest doc_id
stays (null doc_id is smallest), and of rows that also share the doc_id exactly one.  Against an earlier index every
member is a repeat and goes; keep_id and group_size are the history's, and only nonmembers stay, one of each text.

A bucket meets its rows in as many cells as its rows fill, CELL_ROWS in each, so a digest shared by a third of all rows is
looked up by many tasks and no cell grows with the table.  Null text counts as empty.  Texts are read whole.  Columns
besides doc_id and text are never looked at, whatever their names.  An empty table, or an empty history, gives an empty
index, and an empty table an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import cells, durable, handed_back, isolate, numbered, small_side

#: Digests in one perfect hash, and rows looked up in it at once.
BUCKET_DIGESTS, CELL_ROWS = 50_000, 100_000

#: Stands for a null doc_id in a slot.
NULL_ID = np.iinfo(np.int64).min

INDEX = "buckets int, bucket int, displacements binary, digests binary, winners binary, winner_rows binary, sizes binary"
PROBED = "row long, doc_id long, digest binary, found boolean, keep_id long, keep_row long, group_size long"


def _mix(high: np.ndarray, low: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of 16 digest bytes under a seed (multiply-xorshift)."""
    with np.errstate(over="ignore"):
        x = high ^ (low * np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(seed, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(32))


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(digests).view(np.uint64)
    return words[:, 1].copy(), words[:, 2].copy()


def build_perfect_hash(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacement of each group, and the slot of each digest: n digests fill slots 0..n-1 without a gap.

    Hash and displace: digests fall into about n/4 groups; the groups, largest first, try displacements until all
    their digests land in free slots.
    """
    n = len(digests)
    high, low = _halves(digests)
    groups = max(1, -(-n // 4))
    group = (_mix(high, low, 0) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=groups)
    starts = np.concatenate([[0], np.cumsum(counts)])
    taken, displacement, slot = np.zeros(n, bool), np.zeros(groups, np.int32), np.zeros(n, np.int64)
    for g in np.argsort(-counts, kind="stable"):
        rows = order[starts[g] : starts[g + 1]]
        if not len(rows):
            break
        tries, first = 16 if len(rows) > 1 else 64, 1
        while True:
            seeds = np.arange(first, first + tries, dtype=np.uint64)
            at = (_mix(high[rows, None], low[rows, None], seeds[None, :]) % np.uint64(n)).astype(np.int64)
            free = ~taken[at].any(axis=0)
            if len(rows) > 1:
                ranked = np.sort(at, axis=0)
                free &= (ranked[1:] != ranked[:-1]).all(axis=0)
            if free.any():
                k = int(np.argmax(free))
                displacement[g], slot[rows] = int(seeds[k]), at[:, k]
                taken[at[:, k]] = True
                break
            first, tries = first + tries, min(tries * 4, 65_536)
    return displacement, slot


def probe(digests: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    high, low = _halves(digests)
    group = (_mix(high, low, 0) % np.uint64(len(displacement))).astype(np.int64)
    return (_mix(high, low, displacement[group].astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy().astype(np.int64)


def _index(rows: pa.Table) -> pa.Table:
    """One bucket's perfect hash."""
    digests = _matrix(rows["digest"])
    displacement, slot = build_perfect_hash(digests)

    def slotted(values: np.ndarray) -> bytes:
        out = np.empty_like(values)
        out[slot] = values
        return out.tobytes()

    held = [displacement.tobytes(), slotted(digests), *(slotted(_longs(rows[c])) for c in ("keep_id", "keep_row", "group_size"))]
    columns = [rows[c].combine_chunks()[:1].cast(pa.int32()) for c in ("buckets", "bucket")]
    return pa.table([*columns, *(pa.array([x], pa.binary()) for x in held)], [c.split()[0] for c in INDEX.split(", ")])


def _lookup(rows: pa.Table, index: pa.Table) -> pa.Table:
    """The rows of one cell with what their bucket's slots hold of them."""
    found, values = np.zeros(rows.num_rows, bool), [np.zeros(rows.num_rows, np.int64)] * 3
    if rows.num_rows and index.num_rows:
        at = index.to_pylist()[0]
        held, asked = np.frombuffer(at["digests"], np.uint8).reshape(-1, 32), _matrix(rows["digest"])
        slot = probe(asked, np.frombuffer(at["displacements"], np.int32), len(held))
        found = (held[slot] == asked).all(axis=1)
        values = [np.frombuffer(at[k], np.int64)[slot] for k in ("winners", "winner_rows", "sizes")]
    null = ~found | (values[0] == NULL_ID)
    columns = [pa.array(found), pa.array(values[0], mask=null), *(pa.array(v, mask=~found) for v in values[1:])]
    return pa.table([rows["row"], rows["doc_id"], rows["digest"], *columns], [c.split()[0] for c in PROBED.split(", ")])


def digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id and the SHA-256 of each whole text, kept durably: row numbers must not change between uses."""
    rows = isolate(docs, id_col, text_col).toDF("doc_id", "text")
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return durable(rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), sha.alias("digest")))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest; partial aggregation folds hot groups before the shuffle."""
    best = F.max(F.struct("doc_id", "row"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def index_of(rows: DataFrame) -> DataFrame:
    """The index of (row, doc_id, digest) rows."""
    known = durable(grouped(rows))
    buckets = cells(known.count(), BUCKET_DIGESTS)
    known = known.select("*", F.lit(buckets).alias("buckets"), _bucket(buckets).alias("bucket"))
    return durable(known.groupBy("bucket").applyInArrow(lambda rows: handed_back(_index(rows)), INDEX))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of a history of documents."""
    return index_of(digested(docs, id_col, text_col))


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    build_index(docs, id_col, text_col).write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dealt(rows: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows by bucket and part, about CELL_ROWS in each at most, and the index once for each part of a bucket."""
    first = index.select("buckets").first()
    buckets = first[0] if first else 1
    asked = rows.select("*", _bucket(buckets).alias("bucket"))
    parts = durable(asked.groupBy("bucket").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")))  # one row for each bucket
    parts = small_side(parts, buckets, 16)
    asked = asked.join(parts, "bucket").select("row", "doc_id", "digest", "bucket", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"))
    return asked, index.join(parts, "bucket").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def looked_up(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The rows with found, keep_id, keep_row and group_size from the index."""
    asked, spread = dealt(rows, index)
    return asked.groupBy("bucket", "part").cogroup(spread.groupBy("bucket", "part")).applyInArrow(lambda rows, index: handed_back(_lookup(rows, index)), PROBED)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; ``index`` is an earlier run's, or the documents' own."""
    rows = digested(docs, id_col, text_col)
    out = looked_up(rows, index_of(rows) if index is None else index)
    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")]
    if index is None:  # every row is a member of its own history
        return out.withColumn("kept", F.col("row") == F.col("keep_row")).select(columns)
    out = durable(out)
    members = out.where("found").withColumn("kept", F.lit(False))
    new = out.where("not found").select("row", "doc_id", "digest")
    others = new.join(grouped(new), "digest").withColumn("kept", F.col("row") == F.col("keep_row"))
    return members.select(columns).unionByName(others.select(columns))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    plain, at, old = numbered(docs)
    found = durable(exact_duplicates(docs, id_col, text_col, index))
    lost = found.where("not kept").select(F.col("doc_id").alias("lost_id"), "text_sha256")
    again = found.where("kept").join(lost, (F.col("doc_id").eqNullSafe(F.col("lost_id"))) & (found["text_sha256"] == lost["text_sha256"]), "left_semi").select(F.col("doc_id").alias("again_id"), F.col("text_sha256").alias("again_sha"))
    again = durable(again)
    losers = lost.join(again, F.col("lost_id").eqNullSafe(F.col("again_id")) & (F.col("text_sha256") == F.col("again_sha")), "left_anti").distinct()
    keyed = plain.withColumn("sha", F.sha2(F.coalesce(at[text_col], F.lit("")).cast("binary"), 256))
    kept = keyed.join(small_side(losers, found.where("not kept").count()), F.col(at[id_col]).eqNullSafe(F.col("lost_id")) & (F.col("sha") == F.col("text_sha256")), "left_anti")
    if not again.isEmpty():  # rows repeated with their doc_id: one of each stays
        kept = kept.dropDuplicates([at[id_col], "sha"])
    return kept.drop("sha").toDF(*old)
