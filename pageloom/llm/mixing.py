"""Mixing to target weights by a time-varying curriculum.

Each source has a target number of words and a weight schedule over training time t in [0, 1],
``w(t) = target * (1 + slope * (2 t - 1))``.  Its integral is the cumulative demand
``D(t) = target * (t + slope * (t^2 - t))``; a document whose words begin at cumulative word c of its source is trained
at the t that solves D(t) = c.  Passes over a source repeat it in the same order.  ``mix`` and ``curriculum`` return
documents and takes range-sorted by position; documents of which nothing is taken come last.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; a target stops
at twice its source's words and the excess is shared out by weight until no target is above.

Cumulative words are one running sum in the order (source, hash of doc_id and text, row) over ranges of rows, less the words
of the sources before: a source with a third of all rows is many ranges, and so is a row repeated as often.  The ranks of
sources and the level of their targets come from running sums over ranges of sources, so sources may be hosts.

Documents without words are taken zero words.  Null text has none; null sources are one source.  Rows that repeat are
documents of their own, and which of them is taken first is arbitrary, since they are equal.  Reruns agree.  Extra columns
are kept by ``curriculum``, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions.order import running
from pageloom.llm.common import WORD, durable, isolate, numbered, small_side

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0

#: Slope of each weight class's schedule: heavy sources fall over time, light ones rise.
SLOPES = (-0.5, 0.5, 0.0)

def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, slope, words_before (words of the sources ahead) from (source, source_size).

    Targets are the smaller of cap and weight * level.  By rising cap / weight, a source is full if all ahead of it are
    and the level that the rest would then share is above its own.
    """
    ranked = running(sizes, [F.col("source").asc_nulls_last()], upto="source_size")
    kind = F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))).cast("int") + 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), kind)
    rows = ranked.select("source", "source_size", (F.col("upto") - F.col("source_size")).alias("words_before"), pick(WEIGHTS).alias("weight"), pick(SLOPES).alias("slope"), (F.col("source_size") * MOST).alias("cap"))
    rows = durable(rows.withColumn("ratio", F.col("cap") / F.col("weight")))
    total, weights = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    filled = running(rows, ["ratio", F.col("source").asc_nulls_last()], caps="cap", held="weight")
    level = (SHARE * total - (F.col("caps") - F.col("cap"))) / (weights - (F.col("held") - F.col("weight")))
    level = filled.where(level * F.col("weight") < F.col("cap")).agg(F.min_by(level, "place")).first()[0]
    target = F.col("cap") if level is None else F.least("cap", F.col("weight") * level)
    return rows.select("source", "source_size", target.alias("target"), "slope", "words_before")


def measured(rows: DataFrame) -> DataFrame:
    """Adds source_size, target, slope, before (words of the source ahead of this document) to (source, size, order_key, row, ...)."""
    sources = durable(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = durable(source_targets(sources)).withColumnRenamed("source", "of")
    ordered = running(rows, [F.col("source").asc_nulls_last(), F.col("order_key"), F.col("row")], upto="size")
    out = ordered.join(small_side(targets, targets.count(), 128), F.col("source").eqNullSafe(F.col("of")))
    return out.withColumn("before", F.col("upto") - F.col("size") - F.col("words_before"))


def taken(size: Column, source_size: Column, target: Column, before: Column) -> Column:
    """Words taken: whole passes over the source, then the rest of the target from its first words on."""
    passes = F.floor(F.try_divide(target, source_size))
    rest = F.floor(target - passes * source_size)
    return F.coalesce(passes * size + F.greatest(F.lit(0), F.least(size, rest - before)), F.lit(0)).cast("long")


def position(words: Column, target: Column, slope: Column) -> Column:
    """The t in [0, 1] at which the cumulative demand reaches ``words``."""
    u = F.least(F.lit(1.0), F.coalesce(F.try_divide(words, target), F.lit(0.0)))
    line = F.lit(1.0) - slope
    root = (F.sqrt(line * line + F.lit(4.0) * slope * u) - line) / F.nullif(F.lit(2.0) * slope, F.lit(0.0))
    return F.coalesce(root, u) + F.lit(0.0)  # no negative zero


def order_key(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of doc_id and text: the order of a source's documents."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = isolate(docs, id_col, text_col, source_col).toDF("doc_id", "text", "source")
    return durable(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("order_key"), F.monotonically_increasing_id().alias("row")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position of every document."""
    out = measured(_rows(docs, id_col, text_col, source_col))
    words = taken(F.col("size"), F.col("source_size"), F.col("target"), F.col("before"))
    first = F.when(words > 0, position(F.col("before"), F.col("target"), F.col("slope")))
    out = out.select("doc_id", "size", "source_size", "target", words.alias("taken"), first.alias("first_position"))
    by = [F.col("first_position").asc_nulls_last(), F.col("doc_id")]
    return out.repartitionByRange(*by).sortWithinPartitions(*by)


#: Rows that agree in these are equal but for columns that the mix doesn't look at.
KEY = ["order_key", "of"]


def _known(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _takes(flat: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """The passes that take each row, with the words of a cut one and the position, and the keys to join them by."""
    takes = flat.where("taken > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    left = F.least("size", F.col("taken") - F.col("pass") * F.col("size"))
    at = position(F.col("pass") * F.col("source_size") + F.col("before"), F.col("target"), F.col("slope"))
    takes = durable(takes.select(*keys, F.when(left < F.col("size"), left).alias("cut"), at.alias("at")))
    return small_side(takes, takes.count()), keys


def _numbered(plain: DataFrame, again: DataFrame) -> DataFrame:
    """The rows whose KEY is in ``again`` with ``nth``, their number from 0 among equals, counted task by task of the scan."""
    rows = durable(plain.withColumn("row", F.monotonically_increasing_id()).join(again, KEY, "left_semi").withColumn("task", F.shiftright("row", 33)))  # read twice
    held = rows.groupBy(*KEY, "task").agg(F.count("*").alias("held"))
    ahead = F.sum("held").over(Window.partitionBy(*KEY).orderBy("task")) - F.col("held")
    nth = F.row_number().over(Window.partitionBy(*KEY, "task").orderBy("row")) - 1
    numbers = rows.withColumn("own", nth).join(held.select(*KEY, "task", ahead.alias("ahead")), [*KEY, "task"])
    return numbers.withColumn("nth", F.col("own") + F.col("ahead")).select(*plain.columns, "nth")


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs`` once for each pass that takes them, range-sorted by training position.

    The one document of a source at which its target ends appears in the last pass with the words still wanted, cut
    after the last of them; every other take is the whole text.
    """
    plain, at, old = numbered(docs)
    plain = plain.select("*", order_key(F.col(at[id_col]), F.col(at[text_col])).alias("order_key"), _known(F.col(at[source_col])).alias("of"))
    flat = measured(_rows(docs, id_col, text_col, source_col)).withColumn("of", _known(F.col("source")))
    flat = flat.select(*KEY, "row", "size", "source_size", "target", "slope", "before", taken(F.col("size"), F.col("source_size"), F.col("target"), F.col("before")).alias("taken"))
    flat = durable(flat)
    again = durable(flat.groupBy(*KEY).agg(F.count("*").alias("rows")).where("rows > 1").select(*KEY))
    if again.isEmpty():
        out = plain.join(*_takes(flat, KEY))
    else:  # equal rows are numbered on both sides: the nth gets the nth one's takes
        few = again.count()
        once = plain.join(small_side(again, few), KEY, "left_anti").join(*_takes(flat.join(small_side(again, few), KEY, "left_anti"), KEY))
        ranks = running(flat.join(small_side(again, few), KEY, "left_semi"), [F.col(c) for c in (*KEY, "row")])
        least = ranks.groupBy(*KEY).agg(F.min("place").alias("least"))
        ranks = ranks.join(least, KEY).withColumn("nth", F.col("place") - F.col("least"))
        out = once.unionByName(_numbered(plain, small_side(again, few)).join(*_takes(ranks, [*KEY, "nth"])).drop("nth"))
    words = F.expr(f"regexp_extract_all(`{at[text_col]}`, r'([^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*)', 1)")
    cut_text = F.array_join(F.slice(words, F.lit(1), F.col("cut").cast("int")), "")
    out = out.withColumn(at[text_col], F.when(F.col("cut").isNull(), F.col(at[text_col])).otherwise(F.rtrim(cut_text)))
    return out.repartitionByRange("at", "order_key").sortWithinPartitions("at", "order_key").select(*at.values()).toDF(*old)
