r"""How the sources of a language differ in their words, by joint histograms of counts.

Terms are the maximal runs of ASCII letters and of anything beyond ASCII, A-Z lower-cased.  A language keeps the V terms that
are in at least LEAST of its documents.  A group (lang, source) that has n occurrences of a term and N of all kept terms gives
it p = 1 + floor(SCALE (n + 1) / (N + V)), and a language likewise.  Two rates differ by f = floor((p - q)^2 / q).

``pair`` compares each two sources of a language over all kept terms.  Terms are not looked at one by one: for each pair the
distinct combinations (count here, count there) are tallied, and f is evaluated once for each and taken times its tally.  Only
terms that both sources have are joined.  Combinations with a zero follow from each source's own tally of counts: a joint cell
takes as many terms off the two cells (count, 0) and (0, count) that would hold them if the sources shared no term, and what is
left of V is the cell (0, 0).  One aggregation adds all of that up.  ``term`` lists the terms that a group uses more often than
its language, the TOP by f.

Each task counts the terms of its texts in dictionaries of at most FLUSH counts and passes on a row for each term, so neither a
hot source nor a hot term is more than a row from each task and flush.  Those rows meet once, and a kept term's groups are
stored as lists of about BLOCK groups at most; lists of one term meet two by two, so a language may have any number of sources.
The pairs themselves are the result.  All arithmetic is exact.

Null texts, langs and sources are empty strings, so they form a group; a group without terms still gets its pairs.  Rows that
repeat are documents of their own.  Other columns are never looked at.  Equal values are ranked by the item's UTF-8 bytes.  An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.llm.common import durable, isolate, release, small_side, stored

LEAST, SCALE, TOP, BLOCK, FLUSH, ROWS = 3, 1_000_000_000, 200, 256, 400_000, 20_000

#: A run of letters in UTF-8 bytes of which A-Z are lower-cased.
TERM = re.compile(rb"[a-z\x80-\xff]+")

#: Texts beyond so many bytes are read match by match.
LONG = 1 << 20


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text as bytes) -> lang, term, docs, counts: documents with a term so far, and its occurrences by source."""
    docs: dict[str, Counter] = {}
    n: dict[str, dict[str, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, found in docs.items():
            place = {t: k for k, t in enumerate(found)}
            names = list(n[lang])
            at = [np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in n[lang].values()]
            held = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in n[lang].values()])
            of = np.repeat(np.arange(len(names)), [len(x) for x in at])
            at = np.concatenate(at)
            order = np.argsort(at, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(place)))]).astype(np.int32)
            one = pa.StructArray.from_arrays([pa.DictionaryArray.from_arrays(pa.array(of[order], pa.int32()), pa.array(names, pa.string())).cast(pa.string()), pa.array(held[order])], ["source", "n"])
            terms = pa.array([t.decode("utf-8", "replace") for t in place], pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array([lang] * len(place), pa.string()), terms, pa.array(list(found.values()), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), one)], ["lang", "term", "docs", "counts"])
            for begin in range(0, batch.num_rows, ROWS):
                yield batch.slice(begin, ROWS)
        docs.clear()
        n.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            found, counts = docs.setdefault(lang, Counter()), n.setdefault(lang, {}).setdefault(source, Counter())
            before, data = len(counts), text.as_py().lower()  # of bytes, so A-Z only
            words = TERM.findall(data) if len(data) <= LONG else Counter(m.group() for m in TERM.finditer(data))
            counts.update(words)
            found.update(set(words))
            held += len(counts) - before
            if held >= FLUSH:
                yield from flush()
                held = 0
    yield from flush()


def plain(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    rows = isolate(docs, lang, source, text).toDF("lang", "source", "text")
    return rows.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def kept_terms(rows: DataFrame) -> DataFrame:
    """lang, term, source, n, all (occurrences in the language) of the terms in at least LEAST documents of their language.

    Each task's counts of a term meet once, by (lang, term); all that follows needs no further shuffle.
    """
    found = rows.mapInArrow(counted, "lang string, term string, docs long, counts array<struct<source: string, n: long>>").repartition("lang", "term")
    of_term = Window.partitionBy("lang", "term")
    here = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    found = found.select("lang", "term", "counts", F.sum("docs").over(of_term).alias("docs"), F.sum(here).over(of_term).alias("all")).where(f"docs >= {LEAST}")
    return found.select("lang", "term", "all", F.inline("counts")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.first("all").alias("all"))


def rate(n: Column, total: Column) -> Column:
    """1 + floor(SCALE (n + 1) / total), in decimals, which no count overflows."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), total.cast("decimal(20,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def joint_histograms(lists: DataFrame, own: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, x, y, m: for each pair a < b of a language's groups, how many kept terms have x occurrences in a and y in b.

    ``lists`` has lang, term, i, blocks, held (array of g, n): a term's groups, by blocks of them.  ``own`` has g, n, h: how
    many terms a group has n times; ``groups`` has lang, g, v (kept terms of the language), i, blocks.
    """
    two = lists.where("blocks > 1")  # terms of a language whose groups are several blocks also meet across blocks
    across = two.select("lang", "term", "i", "held").join(two.select("lang", "term", F.col("i").alias("j"), F.col("held").alias("other")), ["lang", "term"]).where("i < j").select("held", "other")
    sides = lists.select("held", F.col("held").alias("other")).unionByName(across.unionByName(across.select(F.col("other").alias("held"), F.col("held").alias("other"))))
    one = sides.select("other", F.inline("held").alias("a", "x"))
    both = durable(one.select("a", "x", F.inline("other").alias("b", "y")).where("a < b").groupBy("a", "b", "x", "y").agg(F.count("*").alias("m")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left, right = groups.select("lang", F.col("g").alias("a"), "v", "i", each.alias("j")), groups.select("lang", F.col("g").alias("b"), F.col("i").alias("j"), each.alias("i"))
    pairs = durable(left.join(right, ["lang", "i", "j"]).where("a < b").select("a", "b", "v"))
    value = lambda c: F.col(c) if isinstance(c, str) else F.lit(c).cast("long")
    cell = lambda x, y, m: F.struct(value(x).alias("x"), value(y).alias("y"), m.cast("long").alias("m"))
    m, h = F.col("m"), F.col("h")
    shared = both.select("a", "b", F.inline(F.array(cell("x", "y", m), cell("x", 0, -m), cell(0, "y", -m), cell(0, 0, m))))
    of_a = pairs.join(own.withColumnRenamed("g", "a"), "a").select("a", "b", F.inline(F.array(cell("n", 0, h), cell(0, 0, -h))))
    of_b = pairs.join(own.withColumnRenamed("g", "b"), "b").select("a", "b", F.inline(F.array(cell(0, "n", h), cell(0, 0, -h))))
    none = pairs.select("a", "b", value(0).alias("x"), value(0).alias("y"), F.col("v").alias("m"))
    tallied = none.unionByName(shared).unionByName(of_a).unionByName(of_b).groupBy("a", "b", "x", "y").agg(F.sum("m").alias("m"))
    return tallied.where("m <> 0 or (x = 0 and y = 0)")  # a pair without terms keeps its empty cell


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank."""
    rows = plain(docs, text, lang, source)
    named = durable(rows.select("lang", "source").distinct())
    per_lang = named.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    named = durable(named.join(per_lang, "lang").withColumn("g", F.monotonically_increasing_id()).withColumn("i", F.pmod(F.xxhash64("g"), F.col("blocks"))))
    n_groups = named.count()
    near = lambda df: small_side(df, n_groups, 256)
    held = kept_terms(rows).join(near(named), ["lang", "source"]).groupBy("lang", "term", "i").agg(F.first("all").alias("all"), F.first("blocks").alias("blocks"), F.collect_list(F.struct("g", "n")).alias("held"))
    first = F.row_number().over(Window.partitionBy("lang", "term").orderBy("i")) == 1
    lists, path = stored(held.withColumn("first", first))

    own = durable(lists.select(F.inline("held")).groupBy("g", "n").agg(F.count("*").alias("h")))
    sizes = lists.where("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n"))
    totals = own.groupBy("g").agg(F.sum(F.col("n") * F.col("h")).alias("group_n"))
    groups = durable(named.join(totals, "g", "left").join(sizes, "lang", "left").fillna(0, ["group_n", "v", "lang_n"]).withColumn("base", F.col("group_n") + F.col("v")))

    tallied = joint_histograms(lists, own, groups)
    side = lambda c, base: groups.select(F.col("g").alias(c), F.col("base").alias(base))
    rated = tallied.join(near(side("a", "base_a")), "a").join(near(side("b", "base_b")), "b")
    rated = rated.withColumn("p", F.when(F.col("m") != 0, rate(F.col("x"), F.col("base_a")))).withColumn("q", F.when(F.col("m") != 0, rate(F.col("y"), F.col("base_b"))))
    worth = lambda p, q: F.sum(F.coalesce(divergence(F.col(p), F.col(q)) * F.col("m"), F.lit(0))).alias(p)
    sums = rated.groupBy("a", "b").agg(worth("p", "q"), worth("q", "p"))
    way = lambda g, other, value: F.struct(F.col(g).alias("g"), F.col(other).alias("other"), F.col(value).alias("value"))
    both_ways = sums.select(F.inline(F.array(way("a", "b", "p"), way("b", "a", "q"))))
    names = lambda c, *out: groups.select(F.col("g").alias(c), *out)
    pair = both_ways.join(near(names("g", "lang", "source")), "g").join(near(names("other", F.col("source").alias("item"))), "other")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    used = lists.select("term", "all", F.inline("held")).join(near(groups.select("lang", "source", "g", "base", "v", "lang_n")), "g")
    p, q = rate(F.col("n"), F.col("base")), rate(F.col("all"), F.col("lang_n") + F.col("v"))
    term = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    term = term.select("lang", "source", "part", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    out = durable(ranked(pair).unionByName(ranked(term).where(f"rank <= {TOP}")))
    release(lists, path)
    return out
