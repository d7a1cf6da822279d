"""Chat formatting, vector codes and the source audit: brute force, round trips, odd rows and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.llm import chat, divergence, vector_codes

# ---- chat formatting

PARTS = f"array<{chat.PART}>"
TURNS = f"conv_id long, turn long, role string, parts {PARTS}, formatted string, PARTS string, loss int"


def text(t):
    return ("text", t, None, None, None, None, None)


def read(df):
    return {r["conv_id"]: r for r in chat.read_back(df).collect()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_control_strings_in_texts_are_escaped_and_come_back(spark):
    bits = ["<|turn|>", "<|text|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|image:1|>", "<<|", "\\", "\\\\<", "[[INST]", "<", "|>", "\n", "é日", "\x00", "", "</", "s>"]
    rng = random.Random(5)
    convs = {c: [(rng.choice(["user", "assistant", "a</s>b", ""]), "".join(rng.choices(bits, k=rng.randrange(12)))) for _ in range(rng.randrange(1, 6))] for c in range(60)}
    rows = [(c, k, role, [text(t)], "clash", "x", 1) for c, turns in convs.items() for k, (role, t) in enumerate(turns)]
    rng.shuffle(rows)
    formatted = chat.format_turns(spark.createDataFrame(rows, TURNS).repartition(3))
    for r in formatted.collect():
        inner = r["formatted"][len(chat.TURN) : -len(chat.END)]
        assert not re.search(r"<\||</?s>|<</?SYS>>|\[/?INST\]", inner.replace(chat.TEXT, "", 1))
    got = read(formatted)
    assert set(got) == set(convs)
    for c, turns in convs.items():
        said = "".join(t for role, t in turns if role == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{t}\n" for a, t in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), sha(said))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(), st.lists(st.integers(0, 400)))))
def test_reader_takes_any_cut_of_the_stream(pieces):
    reader, whole = chat.Reader(), "".join(f"{chat.TURN}u{chat.TEXT}{p.replace('<', '').replace(chr(92), '')}{chat.END}" for p, _ in pieces)
    cuts = sorted({min(len(whole), c) for _, cs in pieces for c in cs} | {0, len(whole)})
    for a, b in zip(cuts, cuts[1:], strict=False):
        reader.feed(whole[a:b], [])
    assert reader.row()[0] == len(pieces) and reader.row()[4] == len(whole)


def test_typed_parts_become_ordered_placeholders(spark):
    parts = [text("see <|image:2|> "), ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 2.5, None), text(" and "), ("document", None, "c.pdf", None, None, None, 3), ("video", None, "d", None, None, None, None), None, ("image", "alt", None, None, None, None, None), ("audio", None, "e", None, None, None, None)]
    rows = [(1, 0, "assistant", parts, "", "", 0), (1, 1, "user", parts, "", "", 0), (2, 0, "assistant", [], "", "", 0), (2, 1, "assistant", None, "", "", 0), (None, None, None, [text(None)], "", "", 0)]
    formatted = chat.format_turns(spark.createDataFrame(rows, TURNS))
    by = {(r["conv_id"], r["turn"]): r for r in formatted.collect()}
    one = by[1, 0]
    assert one["formatted"] == "<|turn|>assistant<|text|>see <\\|image:2|> <|image:2|><|audio:3|> and <|document:5|><|document:6|><|image:8|><|audio:9|></s>"
    assert [(a["place"], a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [(2, "image", "a.png", 3), (3, "audio", "b.wav", 63), (5, "document", "c.pdf", 768), (6, "document", "d", 256), (8, "image", None, 1), (9, "audio", "e", 1)]
    assert all(one["formatted"][a["at"] :].startswith(f"<|{a['kind']}:{a['place']}|>") for a in one["attachments"])
    assert [one["formatted"][s["at"] : s["at"] + s["size"]] for s in one["loss"]] == ["see <\\|image:2|> ", " and "]
    assert by[1, 1]["loss"] == [] and [a["at"] for a in by[1, 1]["attachments"]] == [a["at"] - 5 for a in one["attachments"]]
    assert by[2, 0]["formatted"] == by[2, 1]["formatted"] == "<|turn|>assistant<|text|></s>" and by[2, 0]["loss"] == [] == by[2, 0]["attachments"]
    got = read(formatted)
    assert got[1]["loss_sha256"] == sha("see <|image:2|>  and ") and got[None]["turns_sha256"] == sha("\n\n")


def test_chat_ties_repeats_long_texts_and_empty(spark):
    long = "</s>\\" * 300_000
    rows = [(1, 0, "user", [text("b")]), (1, 0, "user", [text("b")]), (1, 0, "assistant", [text("z")]), (1, None, "user", [text("last")]), (2, 7, "assistant", [text(long)]), (2, -1, None, [text("")])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PARTS}")
    got = read(chat.format_turns(df.repartition(3)))
    assert got[1]["turns_sha256"] == sha("assistant\nz\nuser\nb\nuser\nb\nuser\nlast\n") and got[1]["n_turns"] == 4
    assert got[2]["loss_chars"] == len(long) and got[2]["loss_sha256"] == sha(long) and got[2]["turns_sha256"] == sha(f"\n\nassistant\n{long}\n")
    assert read(chat.format_turns(df.limit(0))) == {}


def test_chat_one_hot_conversation_is_a_stream(spark):
    """A conversation with most rows is read in order and never gathered: the reader keeps one turn."""
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, id, -5) AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text").withColumn("parts", chat.text_part(F.col("text")))
    formatted = chat.format_turns(df.repartition(5))
    assert not re.search("Exchange|collect", formatted.select("formatted")._jdf.queryExecution().executedPlan().toString().split("Exchange RoundRobin")[0])
    assert read(formatted)[-5]["turns_sha256"] == sha("".join(f"{'assistant' if i % 2 else 'user'}\nt{i}\n" for i in range(30_000) if i % 3))


# ---- vector codes


def brute_codes(rows):
    """The codes by plain integers, one vector after another, without folding equal parts."""
    kept = [(i, [int(np.floor(1024.0 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = len(kept[0][1])
    cut = [p * d // 4 for p in range(5)]
    books = [[v[cut[p] : cut[p + 1]] for _, v, _ in sorted(kept)[:256]] for p in range(4)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda part, book: min((away(part, e), k) for k, e in enumerate(book))
    for _ in range(4):
        for p, book in enumerate(books):
            of = defaultdict(list)
            for _, v, _ in kept:
                of[best(v[cut[p] : cut[p + 1]], book)[1]].append(v[cut[p] : cut[p + 1]])
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(book)]
    out = []
    for i, v, lab in kept:
        found = [best(v[cut[p] : cut[p + 1]], books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), lab))
    sums = Counter()
    for _, _, e, lab in out:
        sums[lab] += e
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return Counter((i, c, e, sums[lab], digest) for i, c, e, lab in out)


VECTORS = "vec_id long, embedding array<float>, label int, row string, part int, PART int, code string"


@pytest.mark.parametrize(("n", "dims", "scale"), [(700, 8, 0.01), (40, 6, 0.3), (300, 4, 5000.0)])
def test_codes_brute(spark, n, dims, scale):
    """Few distinct parts, a vector in a third of the rows, a dimension that 4 doesn't divide, and gaps beyond doubles."""
    rng = np.random.default_rng(n)
    same = rng.normal(size=dims) * scale
    rows = [(i * 3 - 50, [float(np.float32(x)) for x in (same if rng.random() < 0.35 else np.round(rng.normal(size=dims) * scale, 2 if scale < 1 else 0))], int(rng.integers(3)) if rng.random() < 0.8 else None) for i in range(n)]
    rows += [(-900, None, 1), (-901, [float("nan")] * dims, 1), (-902, [None] * dims, 1), (-903, [float("-inf")] + [0.0] * (dims - 1), None), rows[5]]
    df = spark.createDataFrame([(*r, "clash", 1, 2, "c") for r in rows], VECTORS).repartition(3)
    got = Counter(tuple(r) for r in vector_codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == brute_codes(rows)


@pytest.mark.parametrize("top", [100, 1 << 22, 1 << 27])
def test_nearest_is_exact_with_ties_to_the_lower_index(top):
    rng = np.random.default_rng(top)
    parts, book = rng.integers(-top, top, (300, 16)), rng.integers(-top, top, (40, 16))
    book[7] = book[3]
    parts[:9] = book[7]
    index, error = vector_codes.nearest(parts, book)
    for row, k, e in zip(parts.tolist(), index, error, strict=True):
        assert (e, k) == min((sum((a - b) ** 2 for a, b in zip(row, entry, strict=True)), j) for j, entry in enumerate(book.tolist()))
    assert (index[:9] == 3).all()


def test_codes_odd(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [1.0], 1), (4, [], 2), (5, [1e30, 0.0], 2), (None, [3.0, 4.0], None), (1, [1.0, 2.0], 1), (6, [1e10, 1.0], None)]
    df = spark.createDataFrame([(*r, "clash", 1, 2, "c") for r in rows], VECTORS)
    got = {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.compress(df).collect()}
    assert {x[0] for x in got} == {1, 2, 3, 4, 5, 6, None} and vector_codes.compress(df).count() == len(rows)
    assert {x[1:3] for x in got if x[0] in (3, 4, 5, 6)} == {(None, None)} and all(len(x[1]) == 8 and x[2] == 0 for x in got if x[0] in (1, 2, None))
    assert {x[3] for x in got if x[0] == 4} == {None}
    empty = vector_codes.compress(df.limit(0))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    assert vector_codes.compress(df.where("vec_id = 4")).collect()[0]["code"] is None


def test_hot_parts_meet_without_a_shuffle(spark, monkeypatch):
    """With few parts told to all vectors, and with none, the codes are the same."""
    rows = [(i, [float(i % 7), 0.5, float(i % 3), float(i)], i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted(vector_codes.compress(df).collect())
    for hot in (2, 10**9):
        monkeypatch.setattr(vector_codes, "HOT", hot)
        assert sorted(vector_codes.compress(df).collect()) == want


# ---- source divergence


def brute_audit(rows):
    """Every term of every pair, from the definition."""
    docs = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in tx or ""))) for la, so, tx in rows]
    out = set()
    for la in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == la]
        df = Counter(w for _, _, ws in mine for w in set(ws))
        kept = sorted(w for w, k in df.items() if k >= 3)
        counts = {so: Counter(w for _, s, ws in mine if s == so for w in ws) for so in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())
        rate = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[k] for k in kept) + len(kept)) for w in kept}  # noqa: E731, B023
        ps, q = {so: rate(c) for so, c in counts.items()}, rate(whole)
        for so, p in ps.items():
            pair = [(sum((p[w] - o[w]) ** 2 // o[w] for w in kept), other) for other, o in ps.items() if other != so]
            term = [((p[w] - q[w]) ** 2 // q[w], w) for w in kept if counts[so][w] and p[w] > q[w]]
            for part, found in (("pair", pair), ("term", term)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(la, so, part, item, v, k) for k, (v, item) in enumerate(ordered, 1) if part == "pair" or k <= 200}
    return out


DOCS = "lang string, source string, text string, term string, n long, g int, LANG string"


def audited(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "clash", 1, 2, "x") for r in rows], DOCS).repartition(parts)
    got = divergence.audit(df).collect()
    assert len(got) == len(set(got))
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got}


@pytest.mark.parametrize(("block", "flush"), [(256, 400_000), (3, 50)])
def test_audit_brute(spark, monkeypatch, block, flush):
    """Sources of unlike words, one with a third of the rows, more sources than a block, dictionaries emptied often."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = random.Random(block)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}é"[: 2 + i % 2] for i in range(90)] + ["ÄÖ", "Über", "x日本"]
    rows = []
    for i in range(500):
        s = 0 if rng.random() < 0.35 else rng.randrange(11)
        rows.append((rng.choice(["en", "de", None]), f"s{s}" if s else None, " ".join(rng.choices(words[s * 3 : s * 3 + 40 + s], k=rng.randrange(30))).title()))
    rows += [("en", "quiet", "!!! 123"), ("en", "null", None), ("xx", "a", None), ("xx", "b", ""), ("yy", "only", "rare words"), rows[0], rows[0]]
    want = brute_audit(rows)
    assert audited(spark, rows) == want
    # the counting itself, with small dictionaries and long texts
    monkeypatch.setattr(divergence, "FLUSH", flush)
    monkeypatch.setattr(divergence, "LONG", 20)
    batch = pa.RecordBatch.from_arrays([pa.array([x or "" for x in c]) if k < 2 else pa.array([(x or "").encode() for x in c], pa.binary()) for k, c in enumerate(zip(*rows, strict=True))], ["lang", "source", "text"])
    n = Counter()
    for out in divergence.counted(iter([batch])):
        for la, t, held in zip(*(out.column(c).to_pylist() for c in ("lang", "term", "counts")), strict=True):
            for c in held:
                n[la, c["source"], t] += c["n"]
    plain = Counter((la or "", so or "", w) for la, so, tx in rows for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in tx or "")))
    assert n == plain


def test_audit_ranks_stop_at_200_and_empty(spark):
    rows = [("en", "a", " ".join("".join(chr(97 + int(c)) for c in f"{i:03d}") for i in range(600)))] * 3 + [("en", "b", "zz " * 4000)] * 3
    got = audited(spark, rows)
    assert got == brute_audit(rows) and max(r[5] for r in got if r[2] == "term") == 200
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_rates_are_exact_for_huge_counts(spark):
    rows = [(10**15 + 7, 10**16 + 3), (0, 1), (0, 3), (10**12, 10**12 + 1)]
    got = spark.createDataFrame(rows, "n long, m long").select("n", "m", divergence.rate(F.col("n"), F.col("m")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 1) // r["m"] for r in got)
