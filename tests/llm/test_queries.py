"""The queries against SQL or brute force over a whole small table."""

import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from oracle import connect, differences

from pageloom.llm import packing, queries, url_templates

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    con = connect(DATA)
    return lambda sql: con.execute(sql).fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, tmp_path, name):
    assert differences(queries.queries()[name](spark, DATA), queries.ORACLE[name], DATA, str(tmp_path / "o")) == ([], [], {})


def test_op1_held_out(spark):
    from metrics import auc

    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, sf).collect()}
    truth = connect(sf).execute("select doc_id, toxic from labels").fetchall()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    held = [(got[i]["score"], y) for i, y in truth if got[i]["held_out"]]
    assert auc(held) > 0.8
    assert sum(s >= 0.7 and y == 0 for s, y in held) <= 0.05 * len(held)
    assert sum(s >= 0.7 for s, y in held if y) >= 0.6 * sum(y for _, y in held)


def test_op2_held_out(spark, rows):
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, DATA).collect()}
    held = [(got[i]["lang_pred"], y) for i, y in rows("select doc_id, lang from documents") if got[i]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert np.mean([a == b for a, b in held]) > 0.95


def plain_url(url):
    """Host and path of a url."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut].translate(str.maketrans(url_templates.UPPER, url_templates.UPPER.lower())), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    return host, path


def plain_rule(host, path):
    fits = [r for r, _ in url_templates.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=len, default=None)


def plain_templates(paths):
    """Template of each (id, segments, ruled) of one host, node by node."""
    out = {}

    def grow(rows, level, stem):
        out.update({i: stem for i, segs, _ in rows if len(segs) == level})
        rows = [r for r in rows if len(r[1]) > level]
        if 0 < len(rows) < url_templates.LEAF:
            out.update({i: (*stem, "**") for i, *_ in rows})
            return
        count, ruled = Counter(r[1][level] for r in rows), {r[1][level] for r in rows if r[2]}
        digit = lambda s: any(c in "0123456789" for c in s)
        peers = lambda s: sum(digit(o) == digit(s) and count[o] <= 2.000001 * count[s] and count[s] <= 2.000001 * count[o] for o in count)
        literal = {s for s in count if count[s] > peers(s) or (not digit(s) and count[s] * url_templates.BRANCH >= len(rows))}
        others = set(count) - literal
        mixed = bool(others & ruled) and bool(others - ruled)
        name = lambda s: s.replace("*", "%2A").replace("|", "%7C") if s in literal else "*#" if mixed and s in ruled else "*"
        below = defaultdict(list)
        for r in rows:
            below[name(r[1][level])].append(r)
        for n, held in below.items():
            grow(held, level + 1, (*stem, n))

    grow(paths, 0, ())
    return out


def plain_merge(templates, label):
    """Templates with their branches merged, top down."""
    whole = dict(templates)
    for level in range(max(map(len, templates.values()), default=0)):
        nodes = defaultdict(lambda: defaultdict(list))
        for i, t in whole.items():
            if len(t) > level:
                nodes[t[:level]][t[level]].append(i)
        for branches in nodes.values():
            clusters = []
            for name in sorted(branches, key=lambda b: (-len(branches[b]), b)):
                mine = branches[name]
                tables = lambda ids: (Counter(whole[i][level + 1 :] for i in ids), Counter(label[i] for i in ids if label[i]))
                shape, marks = tables(mine)
                for cluster in clusters:
                    shapes, others = tables(cluster[1])
                    if bool(marks) == bool(others) and not url_templates.differ(shape, shapes) and not url_templates.differ(marks, others):
                        cluster[0].append(name)
                        cluster[1] = cluster[1] + mine
                        break
                else:
                    clusters.append([[name], mine])
            renamed = {i: "|".join(sorted(names)) for names, ids in clusters for i in ids}
            for i, n in renamed.items():
                whole[i] = (*whole[i][:level], n, *whole[i][level + 1 :])
    return whole


def test_op3_brute_force(spark, rows):
    """Templates, merging, purity and verdicts from the urls alone."""
    pages, verdicts = rows("select page_id, url from pages"), dict(url_templates.RULES)
    known = {i: plain_url(u) for i, u in pages}
    rule = {i: plain_rule(*x) for i, x in known.items()}
    label = {i: verdicts.get(r) for i, r in rule.items()}
    hosts, whole = defaultdict(list), {}
    for i, (host, path) in known.items():
        hosts[host].append((i, [s for s in path.split("/") if s], label[i] is not None))
    for held in hosts.values():
        whole |= plain_merge(plain_templates(held), label)
    marked = Counter((known[i][0], whole[i], label[i]) for i in whole)
    base = sum(v == "block" for v in label.values()) / len(pages)
    got = {r["page_id"]: r for r in queries.op3_url_templates(spark, DATA).collect()}
    assert len(got) == len(pages)
    for i, r in got.items():
        block, allow = (marked[known[i][0], whole[i], v] for v in ("block", "allow"))
        purity = (block + url_templates.STRENGTH * base) / (block + allow + url_templates.STRENGTH)
        assert (r["host"], r["path"], r["rule"], r["template"]) == (*known[i], rule[i], "/" + "/".join(whole[i]))
        assert r["purity"] == pytest.approx(purity) and r["verdict"] == (label[i] or ("block" if purity >= url_templates.PURITY else "allow"))


def test_op3_rules_match_sql(spark, tmp_path):
    case = " ".join(f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '{r[r.index('/'):]}') THEN '{r}'" for r, _ in sorted(url_templates.RULES, key=lambda x: -len(x[0])))
    sql = rf"""WITH p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{url_templates.UPPER}', '{url_templates.UPPER.lower()}') AS host, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        r AS (SELECT *, CASE {case} END AS rule FROM p)
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, CASE rule {" ".join(f"WHEN '{r}' THEN '{v}'" for r, v in url_templates.RULES)} END AS ruled FROM r"""
    got = queries.op3_url_templates(spark, DATA).selectExpr("page_id", "host", "path", "rule", "if(rule is null, null, verdict) ruled")
    assert differences(got, sql, DATA, str(tmp_path / "o")) == ([], [], {})


def test_op4_round_trip(spark, rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, packing.END] for i, t in rows("select doc_id, text from documents")}
    got = queries.op4_retrieval_packing(spark, DATA).collect()
    held, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
        held[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, spans in held.items():
        assert sorted(spans)[0][0] == 0 and sum(n for _, n in spans) == len(ids[i])
    assert set(held) == set(ids)
    waste = 0
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= packing.WINDOW
        waste += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert waste == 0


def brute_components(texts, n, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_op5_brute_force(spark, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op5_jaccard_join(spark, DATA).collect()}
    assert got == brute_components(rows("select doc_id, text from documents"), 3, 90)


def test_op6_laws(spark, rows):
    got = queries.op6_sharding(spark, DATA).collect()
    texts = dict(rows("select doc_id, text from documents"))
    loads, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and 0 <= r["shard"] < 16
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[texts[r["doc_id"]]].add(r["shard"])
    assert len(got) == len(texts) and all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) - min(loads.values()) <= max(r["size"] for r in got)


def test_op7_recall_and_scores(spark, rows):
    vectors = {i: np.array(v, float) for i, v in rows("select vec_id, embedding from embeddings")}
    got = defaultdict(list)
    for r in queries.op7_hnsw(spark, DATA).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    hits = 0
    assert set(got) == {i for i in vectors if i % 100 == 0}
    for q, found in got.items():
        true = sorted((float(np.sqrt(((v - vectors[q]) ** 2).sum())), i) for i, v in vectors.items() if i != q)[:10]
        hits += len({i for _, i in true} & {i for _, i in found})
        assert found == sorted(found) and all(s == pytest.approx(float(np.linalg.norm(vectors[i] - vectors[q])), abs=1e-12) for s, i in found)
    assert hits >= 0.9 * 10 * len(got)


def test_op10_targets(spark, rows):
    docs = {i: (s, len((t or "").encode().split())) for i, t, s in rows("select doc_id, text, source from documents")}
    sizes = Counter()
    for s, n in docs.values():
        sizes[s] += n
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    taken = Counter()
    for r in queries.op10_curriculum_mixing(spark, DATA).collect():
        s, n = docs[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * n
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
