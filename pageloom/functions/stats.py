"""Ranks, rank correlation, p-values and bootstrap intervals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.order import running_by
from pageloom.functions.storage import durable


def value_ranks(rows: DataFrame, value: str, rank: str, *by: str) -> DataFrame:
    """Each distinct value within ``by`` with its mean rank and number of rows: a running sum over ranges of distinct values."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias(f"{rank}_rows"))
    upto = running_by(counts, by, [F.col(value)], **{rank: f"{rank}_rows"})
    return upto.withColumn(rank, F.col(rank) - (F.col(f"{rank}_rows") - 1) / F.lit(2.0))


def spearman(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """n and rho for each group; 0 for fewer than two rows or no variance.  Rows with equal values are one weighted row."""
    pairs = rows.groupBy(*by, x, y).agg(F.count("*").alias("weight"))
    pairs = pairs.join(value_ranks(rows, x, "rx", *by), [*by, x]).join(value_ranks(rows, y, "ry", *by), [*by, y])
    n, dx, dy = F.sum("weight"), F.col("rx") - F.col("mean"), F.col("ry") - F.col("mean")
    sizes = rows.groupBy(*by).agg(((F.count("*") + 1) / F.lit(2.0)).alias("mean"))
    found = pairs.join(sizes, list(by)).groupBy(*by).agg(n.alias("n"), F.sum(F.col("weight") * dx * dy).alias("xy"), F.sum(F.col("weight") * dx * dx).alias("xx"), F.sum(F.col("weight") * dy * dy).alias("yy"))
    return found.select(*by, "n", F.coalesce(F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0)), F.lit(0.0)).alias("rho"))


def _erfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: math.erfc(v) if v == v else None)


def p_value(rho: Column, n: Column) -> Column:
    """Two-sided, by the normal tail of the t statistic."""
    t = rho * F.sqrt((n - 2) / F.greatest(F.lit(1e-9), 1 - rho * rho))
    return F.when((n < 3) | (F.abs(rho) >= 1), 0.0).otherwise(F.pandas_udf(_erfc, "double")(F.abs(t) / math.sqrt(2)))


#: Resamples of one row: their weights are columns.
BLOCK = 20

#: Expected numbers of draws beyond which the normal approximation stands in for the Poisson law.
MANY = 60.0


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 random bits of each number (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Of each 64 bits a number within (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def poisson_draws(key: np.ndarray, rate: np.ndarray, size: int) -> np.ndarray:
    """``size`` Poisson draws for each key: a function of key and place alone, so any task draws the same."""
    with np.errstate(over="ignore"):
        bits = _mixed(_mixed(key.astype(np.uint64))[:, None] + np.arange(1, size + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95))
        again = _mixed(bits + np.uint64(1))
    u, lam = _uniform(bits), np.broadcast_to(rate[:, None].astype(float), bits.shape)
    out = np.zeros(bits.shape)
    few = lam <= MANY
    term = np.where(few, np.exp(-np.where(few, lam, 0.0)), 1.0)
    total, k = term.copy(), 0
    while (open_ := few & (u > total)).any() and k < 400:
        k += 1
        term = term * lam / k
        total = np.where(open_, total + term, total)
        out = np.where(open_, k, out)
    z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * _uniform(again))
    return np.where(few, out, np.maximum(0, np.rint(lam + np.sqrt(lam) * z + (z * z - 1) / 6)))


def bootstrap(rows: DataFrame, x: str, y: str, by: str, resamples: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of rho for each group: order statistics of seeded Poisson resamples.

    In a resample each row counts as often as a Poisson draw says, so rows that are equal in x and y count as one draw with
    their number as its rate, made from a hash of the values and the resample.  Ranks of a resample are running sums of such
    counts over ranges, and rho comes from sums: nothing gathers the rows of a group, or its distinct values.
    """
    pairs = rows.groupBy(by, x, y).agg(F.count("*").alias("rate"))
    spread = pairs.select(F.col(by).alias("of"), F.col(x).alias("x"), F.col(y).alias("y"), "rate", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // BLOCK) - 1))).alias("block"))

    def draw(keys: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series(list(poisson_draws(keys.to_numpy(), rates.to_numpy(), BLOCK)), dtype=object)

    key = F.xxhash64(F.lit(seed), "of", "x", "y", "block")
    drawn = spread.withColumn("w", F.pandas_udf(draw, "array<double>")(key, "rate"))
    w = [f"w{k}" for k in range(BLOCK)]
    drawn = durable(drawn.select("of", "block", "x", "y", *(F.get("w", k).alias(n) for k, n in enumerate(w))))

    def ranked(value: str, rank: str) -> DataFrame:
        """Mean ranks of each distinct value in each resample of its block."""
        held = drawn.groupBy("of", "block", value).agg(*(F.sum(n).alias(n) for n in w))
        upto = running_by(held, ["of", "block"], [F.col(value)], **{f"u{n}": n for n in w})
        return upto.select("of", "block", value, *((F.col(f"u{n}") - (F.col(n) - 1) / 2).alias(f"{rank}{n}") for n in w))

    both = drawn.join(ranked("x", "a"), ["of", "block", "x"]).join(ranked("y", "b"), ["of", "block", "y"])
    c = F.col
    sums = [F.struct(F.sum(n).alias("n"), F.sum(c(n) * c(f"a{n}") * c(f"b{n}")).alias("ab"), F.sum(c(n) * c(f"a{n}") * c(f"a{n}")).alias("aa"), F.sum(c(n) * c(f"b{n}") * c(f"b{n}")).alias("bb")).alias(n) for n in w]
    found = both.groupBy("of", "block").agg(*sums).select("of", "block", F.posexplode(F.array(*w)).alias("k", "s")).where(c("block") * BLOCK + c("k") < resamples)
    # ranks of a resample of n rows have the mean (n + 1) / 2
    n, off = c("s.n"), c("s.n") * (c("s.n") + 1) * (c("s.n") + 1) / 4
    norm = F.sqrt(F.greatest(F.lit(0.0), c("s.aa") - off)) * F.sqrt(F.greatest(F.lit(0.0), c("s.bb") - off))
    rho = F.when((n > 1) & (norm > 0), (c("s.ab") - off) / norm).otherwise(0.0)
    values = F.sort_array(F.collect_list(rho))  # as many as there are resamples
    at = lambda q: F.get("values", F.least(F.size("values") - 1, F.floor(F.size("values") * q).cast("int")))
    return found.groupBy(c("of").alias(by)).agg(values.alias("values")).select(by, at(alpha / 2).alias("ci_low"), at(1 - alpha / 2).alias("ci_high"))
