"""Helpers shared by the operators: column isolation, durable cut points and bounded broadcasts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.storage import durable as durable
from pageloom.functions.storage import shared_folder

#: A side is broadcast only up to this many bytes of plain rows; beyond it the same join is shuffled.
BROADCAST_BYTES = 32 << 20

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def isolate(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns ``names``, matched by exact case; other columns can't clash with an operator's own."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
    """``df`` under positional column names, the new name of each old one, and the old names in order."""
    old = df.columns
    new = [f"c{i}" for i in range(len(old))]
    return df.toDF(*new), {n: new[old.index(n)] for n in old}, old


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, for wide rows that are read several times, and its path."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def release(table: DataFrame, path: str) -> None:
    """Empties a stored table that nothing will read again."""
    table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


def small_side(df: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """A broadcast hint if ``rows`` (counted by the caller) of ``width`` bytes are within BROADCAST_BYTES, else ``df`` for a shuffled join."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def remainder(column: Column, divisor: int) -> Column:
    """crc32 of the column as text, modulo ``divisor``: the fold of a row."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


T = TypeVar("T")


def handed_back(result: T) -> T:
    """``result``; what a kernel freed goes back to the system, since an idle worker's memory counts beside its executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other systems do without
    if trim:
        trim(0)
    return result


def thrifty(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel of ``mapInArrow`` that hands back its memory after its last batch."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(frames)
        handed_back(None)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallel(df: DataFrame) -> DataFrame:
    """Spread rows that come from fewer files than there are cores; more files keep their splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def cells(rows: int, each: int, least: int = 1, most: int = 1 << 20) -> int:
    """How many hash cells hold about ``each`` of ``rows`` rows."""
    return max(least, min(most, -(-rows // each)))
