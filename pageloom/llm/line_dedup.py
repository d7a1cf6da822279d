"""Line dedup: lines spread over many distinct sites are boilerplate and are removed.

Each line is keyed by a 128-bit hash of its text without surrounding white space.  Texts are cut into lines once; the keys,
with their sites and places, are a stored table from which the rest is made.  A HyperLogLog sketch of sites per key is
built in each task and merged by aggregation.  Keys whose estimate lies within BAND of the threshold get an exact distinct
count; beyond it the estimate, whose error is far smaller than the band, decides.  Removal depends on a text alone, so
the places of removed lines are gathered once for each distinct text and joined back by its hash.

Blank lines are never boilerplate and stay where they are.  A null site counts as a site of its own.  Null text stays
null and has no lines; empty text has one, blank.  A text all of whose lines go becomes empty.  A text of very many lines
takes time in proportion to them.  Rows that repeat are cleaned alike, and count once for their site.  Other columns are
kept, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import durable, numbered, release, small_side, stored

#: Lines on at least this many sites go.
MIN_SITES = 5

#: Sketch size (2^LG_K registers, 1.6 % error) and the share of the threshold around it that is counted exactly.
LG_K, BAND = 12, 0.5


#: White space at the ends of a line that its key ignores.
BLANK = " \t\x0b\x0c\r\n"


def line_key(line: Column) -> Column:
    """128 bits of the trimmed line; null for a blank one."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(7), bare, F.length(bare)).alias("b")))


def text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text, F.length(text)).alias("b"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The keys of (key, site) rows that are on at least ``min_sites`` sites."""
    sketch = F.hll_sketch_agg("site", F.lit(LG_K))
    spread = lines.groupBy("key").agg(F.hll_sketch_estimate(sketch).alias("sites"))
    spread = durable(spread.where(F.col("sites") >= min_sites * (1 - BAND)))
    near = spread.where(F.col("sites") <= min_sites * (1 + BAND)).select("key")
    pairs = lines.join(small_side(near, near.count()), "key", "left_semi").groupBy("key", "site").agg(F.count("*").alias("rows"))
    exact = pairs.groupBy("key").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("key")
    return exact.unionByName(spread.where(F.col("sites") > min_sites * (1 + BAND)).select("key"))


def drop_boilerplate_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with each text cleaned, and three more columns: n_lines, n_removed, removed_chars."""
    plain, at, old = numbered(docs)
    text, site = F.col(at[text_col]), F.col(at[site_col])
    sites = F.concat(F.when(site.isNull(), "n").otherwise("s"), F.coalesce(site.cast("string"), F.lit("")))
    parts = F.split(text, "\n")
    lines = plain.where(text.isNotNull()).select(sites.alias("site"), text_key(text).alias("text_key"), parts.alias("parts"))  # no text beside its lines
    lines = lines.select("site", "text_key", F.posexplode("parts").alias("pos", "line"))
    lines, path = stored(lines.select("site", "text_key", "pos", line_key(F.col("line")).alias("key")).where("key is not null"))
    gone = durable(boilerplate(lines.select("key", "site"), min_sites))
    hits = lines.join(small_side(gone, gone.count()), "key", "left_semi").groupBy("text_key", "pos").agg(F.count("*").alias("copies"))
    removed = durable(hits.groupBy("text_key").agg(F.collect_list("pos").alias("removed")))
    release(lines, path)
    held = removed.agg(F.coalesce(F.sum(F.size("removed") * 4 + 64), F.lit(0))).first()[0]
    # the text travels as its lines, which are not cut again for each line that stays
    whole = plain.select(*[F.lit(None).cast("string").alias(c) if c == at[text_col] else F.col(c) for c in at.values()], text_key(text).alias("text_key"), parts.alias("parts"))
    out = whole.join(small_side(removed, held, 1), "text_key", "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("removed"))
    kept = F.transform(stay, lambda i: F.get("parts", i))
    cleaned = F.array_join(F.when(F.col("removed").isNull(), F.col("parts")).otherwise(kept), "\n")
    length = lambda lines: F.aggregate(lines, F.lit(0), lambda n, line: n + F.length(line) + 1)
    gone_lines = F.transform("removed", lambda i: F.get("parts", i))
    shorter = F.least(F.coalesce(length(gone_lines), F.lit(0)), length(F.col("parts")) - 1)
    counts = [F.when(F.col("parts").isNull(), 0).otherwise(F.size("parts")), F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")), F.coalesce(shorter, F.lit(0))]
    return out.select(*[cleaned.alias(c) if c == at[text_col] else F.col(c) for c in at.values()], *counts).toDF(*old, "n_lines", "n_removed", "removed_chars")
