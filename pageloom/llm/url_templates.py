"""URL filters: a path-template tree per host, with smoothed labelled purity.

Rules give verdicts and, with them, labels.  The tree of a host is built from its paths level by level.  At a node a
segment stays literal if it has no digit and holds at least 1/BRANCH of the node's pages, or if it is constant: its pages
outnumber its peers, the node's segments (with a digit or without, as itself) that are up to twice as frequent or rare.
So a small section and a constant such as v2 are literal, and ids and slugs, of which many are equally rare, are not; a
node of n pages has at most some multiple of sqrt(n) literal branches.  The other segments become the wildcard ``*``; where
some of them have labels and some don't, those with labels become another one, ``*#``.  In a literal segment ``*`` is written
%2A and ``|`` %7C, as a URL may have them, so that no segment is taken for a wildcard or for merged branches.  A node of
fewer than LEAF pages, which is what a rejection takes, gets no branches: whatever follows is ``**``.  There is no bound on
depth; the tree ends where its nodes have become that small or all paths have ended.

Sibling branches are merged if chi-square tests find neither their next templates nor their labels to differ; a branch
without labels merges only with others without, so that no label reaches pages of another kind.  Templates below a branch
are counted in SHAPES hash cells for that, so a node's merging sees numbers of its branches and not the templates of its
host.  A merged template is rejected if ``(blocked + STRENGTH * base) / (labelled + STRENGTH)`` reaches PURITY, where
``base`` is the share of blocked pages among all pages; a template without labels is therefore allowed unless most of the
web is blocked.

Pages are counted by (host, path) first.  The tree of a host of at most SMALL pages is built and merged in one task, in any
number of levels; the trees of larger hosts are built level by level over all of them, aggregated over (host, template), down to
nodes of at most SMALL pages, each of which one task completes.  So a host with a third of all pages is as light as any other,
and deep paths take rounds only where many pages share them.  All ways give the same templates.  Null urls
and urls without ``://`` have an empty host and path.  Empty segments don't count, so a path of slashes is the host's root.
Pages that repeat, or have no page_id, are pages of their own.  Columns besides page_id and url are never looked at, whatever
their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import durable, isolate, small_side

BRANCH, STRENGTH, PURITY, ALPHA, SHAPES = 16, 4.0, 0.8, 0.05, 256

#: Blocked pages that a rejection takes if few others are blocked.
LEAF = round(STRENGTH * PURITY / (1 - PURITY))

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

#: The wildcards of segments, of those with labels where others have none, and of all that follows a small node.
ANY, RULED, REST = "*", "*#", "**"

#: Pages of a host whose tree one task builds.
SMALL = 20_000

#: log2 of a count in whole steps, and a factor of two with rounding.
STEPS = 1_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (ties: first in code-point order), or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        domain, slash, begin = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + begin)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def templates(rows: DataFrame) -> DataFrame:
    """(host, path, pages, labelled, ...) with ``template``, an array of literal segments and wildcards.

    Level by level; a node of at most SMALL pages is completed in one task.
    """
    kept = rows.columns
    parts = F.filter(F.split("path", "/+"), lambda s: s != "")
    rows = durable(rows.withColumn("parts", parts).withColumn("template", F.array().cast("array<string>")))
    done = []
    for level in count():
        segment = F.get("parts", F.lit(level))
        done.append(rows.where(F.size("parts") <= level).select(*kept, "template"))
        rows = rows.where(F.size("parts") > level)
        counts = durable(rows.select("host", "template", segment.alias("segment"), "pages", "labelled").groupBy("host", "template", "segment").agg(F.sum("pages").alias("n"), (F.sum("labelled") > 0).alias("ruled")))
        if counts.isEmpty():
            return reduce(DataFrame.unionByName, done)
        large = durable(counts.groupBy("host", "template").agg(F.sum("n").alias("total")).where(F.col("total") > SMALL).select("host", "template"))
        several = small_side(large, large.count(), 256)
        small = rows.join(several, ["host", "template"], "left_anti").groupBy("host", "template").applyInPandas(_subtree, rows.schema)
        done.append(durable(small.select(*kept, "template")))
        rows = rows.join(several, ["host", "template"], "left_semi")
        named = durable(_named(counts.join(several, ["host", "template"], "left_semi")).select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("segment").alias("s"), "name"))
        known = (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (segment == F.col("s"))
        met = rows.join(small_side(named, named.count(), 256), known, "left")
        rows = durable(met.select(*kept, "parts", F.concat("template", F.array(F.coalesce("name", F.lit(ANY)))).alias("template")))


def _subtree(rows: pd.DataFrame) -> pd.DataFrame:
    """Completes the templates of one node's paths."""
    level = len(rows["template"].iloc[0])
    below = host_templates([tuple(p[level:]) for p in rows["parts"]], rows["pages"].tolist(), (rows["labelled"] > 0).tolist())
    return rows.assign(template=[[*t, *b] for t, b in zip(rows["template"], below, strict=True)])


def written(segment: str) -> str:
    return segment.replace("*", "%2A").replace("|", "%7C")


def names_of(counts: dict[str, int], ruled: set[str]) -> dict[str, str]:
    """The name of each segment of one node, as ``_named`` has it."""
    digit = {s: any("0" <= c <= "9" for c in s) for s in counts}
    step = {n: math.floor(math.log(n) / math.log(2) * STEPS) for n in set(counts.values())}
    total, literal = sum(counts.values()), set()
    for kind in (False, True):
        mine = sorted((step[n], n, s) for s, n in counts.items() if digit[s] == kind)
        steps = np.array([x[0] for x in mine], np.int64)
        peers = np.searchsorted(steps, steps + STEPS + 1, "right") - np.searchsorted(steps, steps - STEPS - 1, "left")
        literal |= {s for (_, n, s), k in zip(mine, peers, strict=True) if n > k or (not kind and n * BRANCH >= total)}
    others = counts.keys() - literal
    mixed = bool(others & ruled) and bool(others - ruled)
    return {s: written(s) if s in literal else RULED if mixed and s in ruled else ANY for s in counts}


def host_templates(paths: list[tuple[str, ...]], pages: list[int], ruled: list[bool]) -> list[tuple[str, ...]]:
    """The template of each path of one host, level by level; a node is a number, so deep paths cost no more than their segments."""
    at, parents, names = [0] * len(paths), [-1], [""]
    open_, level = [i for i, p in enumerate(paths) if p], 0
    while open_:
        nodes: dict[int, list[int]] = {}
        for i in open_:
            nodes.setdefault(at[i], []).append(i)
        open_ = []
        for node, rows in nodes.items():
            counts: dict[str, int] = {}
            for i in rows:
                counts[paths[i][level]] = counts.get(paths[i][level], 0) + pages[i]
            small = sum(counts.values()) < LEAF
            name = dict.fromkeys(counts, REST) if small else names_of(counts, {paths[i][level] for i in rows if ruled[i]})
            child: dict[str, int] = {}
            for i in rows:
                own = name[paths[i][level]]
                if own not in child:
                    child[own] = len(names)
                    parents.append(node)
                    names.append(own)
                at[i] = child[own]
                if not small and len(paths[i]) > level + 1:
                    open_.append(i)
        level += 1
    known: dict[int, tuple[str, ...]] = {0: ()}
    for k in sorted(set(at)):
        out, node = [], k
        while node not in known:
            out.append(names[node])
            node = parents[node]
        known[k] = known[node] + tuple(reversed(out))
    return [known[k] for k in at]


def cell_of(rest: tuple[str, ...]) -> int:
    """The hash cell of what follows a branch; ``merged`` has the same."""
    return zlib.crc32("/".join(rest).encode()) % SHAPES if rest else -1


def host_merged(counts: dict[tuple[str, ...], tuple[int, int, int]]) -> dict[tuple[str, ...], tuple[str, ...]]:
    """Each template of one host with its branches merged, top down."""
    whole: dict[tuple[str, ...], list[str]] = {t: [] for t in counts}
    stems: dict[int, list[tuple[str, ...]]] = {0: list(counts)}
    level = 0
    while stems:
        below: dict[int, list[tuple[str, ...]]] = {}
        for held in stems.values():
            branches: dict[str, list[tuple[str, ...]]] = {}
            for t in held:
                if len(t) > level:
                    branches.setdefault(t[level], []).append(t)
            name = {b: b for b in branches}
            if len(branches) > 1:
                shapes: dict[str, dict[int, tuple[int, int, int]]] = {}
                for b, ts in branches.items():
                    for t in ts:
                        own, cell = shapes.setdefault(b, {}), cell_of(t[level + 1 :])
                        own[cell] = tuple(map(sum, zip(own.get(cell, (0, 0, 0)), counts[t], strict=True)))
                name = merge_siblings(shapes)
            ids: dict[str, int] = {}
            for b, ts in branches.items():
                k = ids.setdefault(name[b], len(below))
                for t in ts:
                    whole[t].append(name[b])
                below.setdefault(k, []).extend(ts)
        stems, level = below, level + 1
    return {t: tuple(w) for t, w in whole.items()}


def _host(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole templates of the paths of one small host."""
    paths = [tuple(s for s in p.split("/") if s) for p in rows["path"]]
    own = host_templates(paths, rows["pages"].tolist(), (rows["labelled"] > 0).tolist())
    counts: dict[tuple[str, ...], tuple[int, int, int]] = {}
    for t, *x in zip(own, rows["pages"], rows["blocked"], rows["labelled"] - rows["blocked"], strict=True):
        counts[t] = tuple(map(sum, zip(counts.get(t, (0, 0, 0)), map(int, x), strict=True)))
    whole = host_merged(counts)
    return pd.DataFrame({"host": rows["host"], "path": rows["path"], "template": [list(whole[t]) for t in own]})


def _named(counts: DataFrame) -> DataFrame:
    """(host, template, segment, name) of the segments at a level that are not ``*``, from the counts of nodes that have branches."""
    node, digit, step = ["host", "template"], F.col("segment").rlike("[0-9]"), F.floor(F.log2("n") * STEPS)
    alike = counts.groupBy(*node, digit.alias("digit"), "n").agg(F.count("*").alias("kinds"))
    near = Window.partitionBy(*node, "digit").orderBy(step).rangeBetween(-STEPS - 1, STEPS + 1)
    total = F.sum(F.col("n") * F.col("kinds")).over(Window.partitionBy(*node))
    literal = (F.col("n") > F.sum("kinds").over(near)) | (~F.col("digit") & (F.col("n") * BRANCH >= total))
    peers = durable(alike.select(*node, "digit", "n", literal.alias("literal")))
    known = counts.withColumn("digit", digit).join(small_side(peers, peers.count(), 256), [*node, "digit", "n"])
    mixed = known.where(~F.col("literal")).groupBy(*node).agg(F.min("ruled").alias("least"), F.max("ruled").alias("most")).where(~F.col("least") & F.col("most"))
    mixed = durable(mixed.select(*node, F.lit(True).alias("mixed")))
    known = known.join(small_side(mixed, mixed.count(), 256), node, "left")
    written = F.replace(F.replace("segment", F.lit("*"), F.lit("%2A")), F.lit("|"), F.lit("%7C"))
    name = F.when(F.col("literal"), written).when(F.col("mixed") & F.col("ruled"), F.lit(RULED))
    return known.withColumn("name", name).where(F.col("name").isNotNull())


def differ(a: dict[str, float], b: dict[str, float]) -> bool:
    """Whether two count tables differ by a chi-square test of homogeneity at ALPHA (Wilson-Hilferty tail)."""
    names = sorted(set(a) | set(b))
    na, nb = sum(a.values()), sum(b.values())
    if len(names) < 2 or not na or not nb:
        return False
    stat = 0.0
    for name in names:
        x, y = a.get(name, 0), b.get(name, 0)
        for seen, n in ((x, na), (y, nb)):
            want = (x + y) * n / (na + nb)
            stat += (seen - want) ** 2 / want
    df = len(names) - 1
    z = ((stat / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2)) < ALPHA


def merge_siblings(branches: dict[str, dict[str, tuple[int, int, int]]]) -> dict[str, str]:
    """Branch -> merged name.  A branch is {rest of the template: (pages, blocked, allowed)}.

    Larger branches first, each joins the first cluster that no test tells apart from it.
    """
    clusters: list[tuple[list[str], dict, dict]] = []
    for name in sorted(branches, key=lambda b: (-sum(x[0] for x in branches[b].values()), b)):
        shape = {rest: x[0] for rest, x in branches[name].items()}
        label = {"block": sum(x[1] for x in branches[name].values()), "allow": sum(x[2] for x in branches[name].values())}
        for names, shapes, labels in clusters:
            if bool(sum(label.values())) == bool(sum(labels.values())) and not differ(shape, shapes) and not differ({k: v for k, v in label.items() if v or labels[k]}, {k: v for k, v in labels.items() if v or label[k]}):
                names.append(name)
                for total, own in ((shapes, shape), (labels, label)):
                    for k, v in own.items():
                        total[k] = total.get(k, 0) + v
                break
        else:
            clusters.append(([name], dict(shape), dict(label)))
    return {n: "|".join(sorted(names)) for names, _, _ in clusters for n in names}


def merged(counts: DataFrame) -> DataFrame:
    """(host, own, template, pages, blocked, allowed) with ``template``'s branches merged.

    Level by level; what is below a node of at most SMALL pages is merged in one task.
    """
    kept = counts.columns
    branch = lambda level: F.get("template", F.lit(level))
    done = []
    for level in count():
        stem = F.slice("template", 1, level)
        done.append(counts.where(branch(level).isNull()))
        counts = counts.where(branch(level).isNotNull())
        large = durable(counts.groupBy("host", stem.alias("stem")).agg(F.sum("pages").alias("total")).where(F.col("total") > SMALL).select("host", "stem"))
        several = small_side(large, large.count(), 256)
        at = counts.withColumn("stem", stem)
        small = at.join(several, ["host", "stem"], "left_anti").groupBy("host", "stem").applyInPandas(_merged_below, at.schema)
        done.append(durable(small.select(*kept)))
        counts = durable(at.join(several, ["host", "stem"], "left_semi"))
        if counts.isEmpty():
            return reduce(DataFrame.unionByName, done)
        rest = F.slice("template", level + 2, F.size("template"))
        cell = F.when(F.size(rest) > 0, F.crc32(F.array_join(rest, "/").cast("binary")) % SHAPES).otherwise(-1).cast("int")
        below = counts.groupBy("host", "stem", branch(level).alias("branch"), cell.alias("cell")).agg(*[F.sum(c).alias(c) for c in ("pages", "blocked", "allowed")])
        names = durable(below.groupBy("host", "stem").applyInPandas(_cluster, "host string, stem array<string>, branch string, name string").where("branch <> name"))
        named = small_side(names.toDF("h", "s", "b", "name"), names.count(), 256)
        known = (F.col("host") == F.col("h")) & (F.col("stem") == F.col("s")) & (branch(level) == F.col("b"))
        renamed = F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("stem", F.array("name"), rest))
        counts = durable(counts.join(named, known, "left").withColumn("template", renamed).select(*kept))


def _merged_below(rows: pd.DataFrame) -> pd.DataFrame:
    """Merges all branches below one node."""
    level = len(rows["stem"].iloc[0])
    below = [tuple(t[level:]) for t in rows["template"]]
    counts: dict[tuple[str, ...], tuple[int, int, int]] = {}
    for t, *x in zip(below, rows["pages"], rows["blocked"], rows["allowed"], strict=True):
        counts[t] = tuple(map(sum, zip(counts.get(t, (0, 0, 0)), map(int, x), strict=True)))
    whole = host_merged(counts)
    return rows.assign(template=[[*s, *whole[t]] for s, t in zip(rows["stem"], below, strict=True)])


def _cluster(rows: pd.DataFrame) -> pd.DataFrame:
    """The names of the branches of one node."""
    branches: dict = {}
    for name, cell, *x in rows[["branch", "cell", "pages", "blocked", "allowed"]].itertuples(index=False):
        branches.setdefault(name, {})[cell] = tuple(x)
    names = merge_siblings(branches)
    return pd.DataFrame({"host": rows["host"].iloc[0], "stem": [rows["stem"].iloc[0]] * len(names), "branch": list(names), "name": list(names.values())})


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity."""
    rows = isolate(pages, id_col, url_col).toDF("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    label = F.lit(None).cast("string")
    for rule, verdict in rules:
        label = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(label)
    rows = durable(rows.withColumn("label", label))
    paths = durable(rows.groupBy("host", "path").agg(F.count("*").alias("pages"), F.count_if(F.col("label") == "block").alias("blocked"), F.count("label").alias("labelled")))
    n, bad = paths.agg(F.sum("pages"), F.sum("blocked")).first()
    whole = whole_templates(paths)
    base = (bad or 0) / (n or 1)
    pure = (F.sum("blocked") + STRENGTH * base) / (F.sum("labelled") + STRENGTH)
    judged = durable(whole.groupBy("host", "template").agg(pure.alias("purity")))
    at = durable(whole.select("host", "path", "template").join(small_side(judged, judged.count(), 256), ["host", "template"]))
    out = rows.join(small_side(at, at.count(), 512), ["host", "path"])
    method = F.when(F.col("purity") >= PURITY, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")


def whole_templates(paths: DataFrame) -> DataFrame:
    """(host, path, pages, blocked, labelled) with ``template``, each host's branches merged: small hosts in a task each, larger ones by levels."""
    sizes = durable(paths.groupBy("host").agg(F.sum("pages").alias("held")).where(F.col("held") > SMALL).select("host"))
    several = small_side(sizes, sizes.count())
    small = paths.join(several, "host", "left_anti").groupBy("host").applyInPandas(_host, "host string, path string, template array<string>")
    out = durable(paths.join(small, ["host", "path"]).select(*paths.columns, "template"))
    large = paths.join(several, "host", "left_semi")
    if sizes.isEmpty():
        return out
    rows = templates(large).withColumnRenamed("template", "own")
    counts = durable(rows.groupBy("host", "own").agg(*[F.sum(c).alias(c) for c in ("pages", "blocked", "labelled")]))
    found = merged(counts.select("host", "own", F.col("own").alias("template"), "pages", "blocked", (F.col("labelled") - F.col("blocked")).alias("allowed")))
    found = found.select(F.col("host").alias("h"), F.col("own").alias("o"), "template")
    known = (F.col("host") == F.col("h")) & (F.col("own") == F.col("o"))
    return out.unionByName(rows.join(small_side(found, found.count(), 512), known).select(*paths.columns, "template"))
