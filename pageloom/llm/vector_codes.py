"""Vector code compression: integer parts, a codebook for each part position, weighted Lloyd over distinct parts.

Each component x becomes the integer floor(1024 x) and a vector is cut into PARTS consecutive parts (of equal length where
that divides the dimension, else as near as floors allow).  Equal parts at a position are one weighted row.  A codebook starts
as that part of the ENTRIES smallest ids; each round gives every distinct part to its nearest entry (squared distance, ties to
the lower index) and replaces each entry by the floored weighted mean of its parts; entries without parts stay.  Last, distinct
parts are assigned once more and codes and errors are joined back to the vectors.  All of it is exact integer arithmetic.

Only codebooks reach the driver (ENTRIES x dimension integers); of a round each task passes on at most ENTRIES sums a
position.  Distinct parts are written once and read by each round, in parts of any number.  To join back, parts that at least
one in HOT vectors share are a table of at most HOT rows a position and go to the vectors; all others meet by shuffle.
Errors of a label are summed by partial aggregation, so a label may hold any share of the rows.

Vectors that are null or hold null or non-finite components are dropped.  Vectors of another dimension than the most common one
(ties: the smaller), without components, or with a component so large that a squared distance might leave 64 bits, can't be
coded: they stay, with a null code and error, and no part in the codebooks.  Null ids come last in the order of the start;
equal ids are ordered by their vectors; rows that repeat are rows.  Null labels are one label.  With fewer vectors than
ENTRIES there are fewer entries.  Other columns are never looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import isolate, release, small_side, stored

SCALE, PARTS, ENTRIES, ROUNDS, HOT = 1024, 4, 256, 4, 1000

#: Numbers of a block of distances in a task.
BLOCK = 1 << 21


def bounds(dims: int) -> list[int]:
    return [p * dims // PARTS for p in range(PARTS + 1)]


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the index of the nearest entry, the lowest among equals, and the squared distance; exact."""
    index, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    if not parts.shape[1]:
        return index, error
    top = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    small = 4 * parts.shape[1] * top * top < 1 << 53  # then sums of products are exact in doubles
    step = max(1, BLOCK // max(1, len(book) * (1 if small else parts.shape[1])))
    as_double, squares = book.astype(np.float64), np.einsum("ij,ij->i", book, book).astype(np.float64)
    for at in range(0, len(parts), step):
        rows = parts[at : at + step]
        if small:
            away = squares[None, :] - 2 * (rows.astype(np.float64) @ as_double.T)
        else:
            gaps = rows[:, None, :] - book[None, :, :]
            away = np.einsum("ijk,ijk->ij", gaps, gaps)
        index[at : at + step] = best = away.argmin(axis=1)
        gap = rows - book[best]
        error[at : at + step] = np.einsum("ij,ij->i", gap, gap)
    return index, error


def matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def by_position(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Position, row numbers and parts of a batch of distinct parts."""
    at = batch.column("pos").to_numpy()
    for p in np.unique(at):
        rows = np.flatnonzero(at == p)
        yield int(p), rows, matrix(batch.column("part").take(pa.array(rows)))


def partial_sums(books: list[np.ndarray]):
    """A task's weighted sums of each entry's parts, as (pos, entry, weight, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in books]
        weights = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for p, rows, parts in by_position(batch):
                index, _ = nearest(parts, books[p])
                np.add.at(sums[p], index, parts * weight[rows, None])
                np.add.at(weights[p], index, weight[rows])
        held = [(p, int(e), int(w[e]), sums[p][e].tolist()) for p, w in enumerate(weights) for e in np.flatnonzero(w)]
        if held:
            pos, entry, weight, total = map(list, zip(*held, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int32()), pa.array(entry, pa.int32()), pa.array(weight, pa.int64()), pa.array(total, pa.list_(pa.int64()))], ["pos", "entry", "weight", "sums"])

    return run


def assignment(books: list[np.ndarray]):
    """Adds each distinct part's entry and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, rows, parts in by_position(batch):
                entry[rows], error[rows] = nearest(parts, books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry), pa.array(error)], [*batch.schema.names, "entry", "error"])

    return run


def lloyd_round(parts: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one weighted round over the distinct parts."""
    held = parts.mapInArrow(partial_sums(books), "pos int, entry int, weight long, sums array<long>")
    summed = held.select("pos", "entry", "weight", F.posexplode_outer("sums").alias("k", "s")).groupBy("pos", "entry", "k").agg(F.sum("weight").alias("weight"), F.sum("s").alias("s"))
    out = [b.copy() for b in books]
    for p, e, k, weight, s in summed.collect():  # at most one row for each number of the codebooks
        if k is not None:
            out[p][e][k] = s // weight
    return out


def integer_vectors(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """row, vec_id, label, ints, dims of the rows whose vectors hold finite numbers only; ints is null where a component is out of 64 bits."""
    flat = isolate(rows, vec_id, vector, label).toDF("vec_id", "vector", "label")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    fits = F.forall("vector", lambda x: F.abs(x) < 2.0**40)
    flat = flat.where(F.col("vector").isNotNull() & F.coalesce(fine, F.lit(False)))
    return flat.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.when(fits, scaled).alias("ints"), F.size("vector").alias("dims"))


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, one row for each vector that is kept."""
    vectors, path = stored(integer_vectors(rows, vec_id, vector, label))
    common = vectors.where("dims > 0 and ints is not null").groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    dims = common["dims"] if common else 0
    limit = isqrt(((1 << 63) - 1) // max(1, dims)) // 2  # then no sum of squared gaps of a vector leaves 64 bits
    coded = vectors.where((F.col("dims") == dims) & (F.col("dims") > 0) & F.forall("ints", lambda x: F.abs(x) < limit))
    cut = bounds(dims)
    part = lambda p: F.slice("ints", cut[p] + 1, cut[p + 1] - cut[p])
    pieces = coded.select("row", F.posexplode(F.array(*[part(p) for p in range(PARTS)])).alias("pos", "part"))
    parts, parts_path = stored(pieces.groupBy("pos", "part").agg(F.count("*").alias("weight")))
    first = coded.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(ENTRIES).select("ints").collect()
    start = np.array([r["ints"] for r in first], np.int64).reshape(len(first), dims)
    books = [np.ascontiguousarray(start[:, cut[p] : cut[p + 1]]) for p in range(PARTS)]
    for _ in range(ROUNDS):
        books = lloyd_round(parts, books)
    digest = hashlib.sha256(",".join(str(x) for b in books for entry in b.tolist() for x in entry).encode()).hexdigest()

    given, given_path = stored(parts.mapInArrow(assignment(books), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in parts.schema)}, entry int, error long"))
    release(parts, parts_path)
    total = coded.count()
    shared = F.col("weight") * HOT > total
    hot, rest = (given.where(c).select("pos", "part", "entry", "error") for c in (shared, ~shared))
    told = pieces.join(F.broadcast(hot.withColumnsRenamed({"entry": "hot_entry", "error": "hot_error"})), ["pos", "part"], "left")  # at most HOT rows a position
    near = told.where("hot_entry is not null").selectExpr("row", "pos", "hot_entry AS entry", "hot_error AS error")
    met = near.unionByName(told.where("hot_entry is null").join(rest, ["pos", "part"]).select("row", "pos", "entry", "error"))
    at = lambda p: F.max(F.when(F.col("pos") == p, F.lower(F.lpad(F.hex("entry"), 2, "0"))))
    whole = met.groupBy("row").agg(F.concat(*[at(p) for p in range(PARTS)]).alias("code"), F.sum("error").alias("error"))
    joined, joined_path = stored(vectors.select("row", "vec_id", "label").join(whole, "row", "left").drop("row"))
    release(given, given_path)
    release(vectors, path)
    labels = joined.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    side = small_side(labels, joined.agg(F.approx_count_distinct("label")).first()[0] * 2)
    out = joined.join(side, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
