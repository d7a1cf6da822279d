"""Ranks and running sums over a whole table without gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions.storage import durable


def running(rows: DataFrame, keys: Sequence[Column], place: str = "place", **sums: str) -> DataFrame:
    """``rows`` with ``place``, their rank by ``keys`` from 1, and for each ``name=column`` the sum of the column up to and with the row.

    Rows are dealt to ranges of the keys and numbered within each; the counts and sums of the ranges ahead are added,
    which are as many as there are shuffle partitions.  Rows with equal keys share a range and come in any order.
    """
    dealt = durable(rows.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))  # ranges must not move between uses
    held = sorted(map(tuple, dealt.groupBy("range").agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in sums.values()]).collect()))
    kinds = ["long", *("double" if dict(rows.dtypes)[c] in ("double", "float") else "long" for c in sums.values())]
    ahead = [accumulate([r[k] for r in held], initial=0.0 if kind == "double" else 0) for k, kind in enumerate(kinds, 1)]
    schema = ", ".join(["range int", *(f"ahead_{k} {kind}" for k, kind in enumerate(kinds))])
    offsets = rows.sparkSession.createDataFrame([(r[0], *(next(a) for a in ahead)) for r in held], schema)
    within = Window.partitionBy("range").orderBy(*keys)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(F.broadcast(offsets), "range")
    totals = [(F.sum(c).over(upto) + F.col(f"ahead_{k}")).alias(name) for k, (name, c) in enumerate(sums.items(), 1)]
    return out.select(*rows.columns, (F.row_number().over(within) + F.col("ahead_0")).alias(place), *totals)


def running_by(rows: DataFrame, by: Sequence[str], keys: Sequence[Column], place: str | None = None, **sums: str) -> DataFrame:
    """``running`` within each group of the columns ``by``: a group may be any share of the rows.

    Rows are dealt to ranges of (by, keys), so a group is a run of neighbouring ranges and only the first group of a range
    can have begun before it.  What that group has in earlier ranges is added: one row for each range reaches the driver.
    """
    names = [f"sum_{k}" for k in range(len(sums) + 1)]
    group = F.struct(*by)
    dealt = durable(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by], *keys).withColumn("range", F.spark_partition_id()))
    whole = dealt.groupBy("range", group.alias("group")).agg(F.count("*").alias(names[0]), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in zip(names[1:], sums.values(), strict=True)])
    ends = whole.groupBy("range").agg(F.min("group").alias("first"), F.max("group").alias("last"), F.max_by(F.struct(*names), "group").alias("held")).collect()
    kinds = [f.dataType.simpleString() for f in whole.select(*names).schema]
    carried, last, offsets = [0] * len(names), None, []
    for r in sorted(ends, key=lambda r: r["range"]):
        begun = last is not None and r["first"] == last
        offsets.append((r["range"], r["first"], *(carried if begun else [0] * len(names))))
        goes_on = begun and r["last"] == last
        carried = [c + h for c, h in zip(carried, r["held"], strict=True)] if goes_on else list(r["held"])
        last = r["last"]
    offsets = [(o[0], o[1], *(float(v) if k == "double" else v for v, k in zip(o[2:], kinds, strict=True))) for o in offsets]
    schema = f"range int, first {whole.schema['group'].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    out = dealt.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, schema)), "range")
    ahead = lambda n: F.when(group.eqNullSafe(F.col("first")), F.col(n)).otherwise(0)
    within = Window.partitionBy("range", *by).orderBy(*keys)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = [(F.sum(c).over(upto) + ahead(n)).alias(name) for n, (name, c) in zip(names[1:], sums.items(), strict=True)]
    if place:
        totals.insert(0, (F.row_number().over(within) + ahead(names[0])).alias(place))
    return out.select(*rows.columns, *totals)
