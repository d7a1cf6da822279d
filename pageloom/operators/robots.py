"""robots.txt: whether the longest rule for every agent that a path begins with forbids it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions.skew import copied, dealt, hot_keys


def robots_lines(texts: DataFrame) -> DataFrame:
    """(host, robots_txt) -> host, line_no, line."""
    return texts.select("host", F.posexplode(F.split("robots_txt", "\r?\n")).alias("line_no", "line"))


def robots_rules(lines: DataFrame) -> DataFrame:
    """host, line_no, allow, rule of the lines under ``User-agent: *``; comments are cut and empty rules ignored."""
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = lines.withColumn("name", F.lower(F.trim(F.split_part(bare, F.lit(":"), F.lit(1))))).withColumn("value", F.trim(F.regexp_replace(bare, "^[^:]*:?", "")))
    agent = F.last(F.when(F.col("name") == "user-agent", F.col("value")), ignorenulls=True).over(Window.partitionBy("host").orderBy("line_no"))
    rows = rows.withColumn("agent", agent).where("agent = '*' and name in ('allow', 'disallow') and value <> ''")
    return rows.select("host", "line_no", (F.col("name") == "allow").alias("allow"), F.col("value").alias("rule"))


def prefix_index(rules: DataFrame) -> DataFrame:
    """host, rule, allow: one row for each prefix of a host that has a rule, the first line among equals."""
    return rules.groupBy("host", "rule").agg(F.min_by("allow", "line_no").alias("allow"))


def rule_hits(pages: DataFrame, rules: DataFrame, hot: DataFrame) -> DataFrame:
    """page_id, host, path, size, allow of each rule that a page's path begins with.

    A path is cut at the lengths that the rules of its host have, and the cuts are looked up by equality.  Pages of a ``hot``
    host are dealt to cells, and the host's rules are copied to each.
    """
    index = prefix_index(rules)
    lengths = index.groupBy("host").agg(F.sort_array(F.collect_set(F.char_length("rule"))).alias("lengths"))  # no more than the longest rule has characters
    asked = dealt(pages, hot, "host", F.col("page_id"), F.col("path")).join(copied(lengths, hot, "host"), ["host", "cell"])
    cuts = F.filter("lengths", lambda n: n <= F.char_length("path"))
    tried = asked.select("page_id", "host", "path", "cell", F.explode(cuts).alias("size")).withColumn("rule", F.substring(F.col("path"), F.lit(1), F.col("size")))
    return tried.join(copied(index, hot, "host"), ["host", "cell", "rule"]).select("page_id", "host", "path", "size", "allow")


def robots_blocked(pages: DataFrame, rules: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """pages (page_id, host, path) with ``blocked``: by the longest rule that fits, the first among equals."""
    hot = hot_keys(pages, "host") if hot is None else hot
    none = pages.select("page_id", "host", "path", F.lit(-1).alias("size"), F.lit(True).alias("allow"))
    best = none.unionByName(rule_hits(pages, rules, hot)).groupBy("page_id", "host", "path").agg(F.max_by("allow", "size").alias("allow"))
    return best.select("page_id", "host", "path", (~F.col("allow")).alias("blocked"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """The path of a url, ``/`` if it has none."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def robots_answers(urls: DataFrame, files: DataFrame) -> DataFrame:
    """url, robots_known, robots_blocked of each distinct url, from (host, robots_status, robots_txt).

    A host whose robots.txt could be asked for is known; without status 200 it forbids nothing.  Of several answers of a host
    the last one counts, by ``timestamp`` if there is one, else one with status 200 before others.
    """
    pages = urls.distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    status = F.col("robots_status")
    order = F.struct(F.col("timestamp") if "timestamp" in files.columns else F.lit(0), F.coalesce(status == 200, F.lit(False)), status, "robots_txt")
    texts = files.groupBy("host").agg(F.max_by(F.struct(status.alias("status"), "robots_txt"), order).alias("last")).select("host", "last.*")
    rules = robots_rules(robots_lines(texts.where("status = 200")))
    hot = hot_keys(pages, "host")
    known = copied(texts.where("status is not null").select("host"), hot, "host")
    asked = dealt(pages, hot, "host", F.col("url")).join(known, ["host", "cell"], "left_semi")
    blocked = robots_blocked(asked.select(F.col("url").alias("page_id"), "host", "path"), rules, hot)
    return blocked.select(F.col("page_id").alias("url"), F.lit(True).alias("robots_known"), F.col("blocked").alias("robots_blocked"))
