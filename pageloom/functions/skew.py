"""Cells for keys that hold a large share of a table's rows, so that no task of a join gathers such a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.storage import durable

#: A key with more than one in HOT rows is hot, if it has LEAST at all; one cell of it has about one in HOT of all rows.
HOT = 1000

#: Keys of fewer rows are none, in a table of any size: one task has them in a moment.
LEAST = 10_000


def hot_keys(rows: DataFrame, key: str, share: int | None = None) -> DataFrame:
    """key, cells of the hot keys: fewer than ``share`` rows, whatever the table, so they can be broadcast.

    One partial aggregation; a null key is none, since it joins nothing.
    """
    share = share or HOT
    counts = durable(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("held")))
    total = counts.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    cells = F.ceil(F.col("held") * share / max(1, total)).cast("int")
    return counts.where((F.col("held") * share > total) & (F.col("held") >= LEAST)).select(key, cells.alias("cells"))


def dealt(rows: DataFrame, hot: DataFrame, key: str, *by: Column) -> DataFrame:
    """``rows`` with ``cell``: by a hash of ``by`` for a hot key, else 0."""
    return rows.join(F.broadcast(hot), key, "left").withColumn("cell", F.pmod(F.xxhash64(*by), F.coalesce("cells", F.lit(1))).cast("int")).drop("cells")


def copied(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``rows`` once for each cell of their key, to meet ``dealt`` rows."""
    return rows.join(F.broadcast(hot), key, "left").withColumn("cell", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1))).drop("cells")
