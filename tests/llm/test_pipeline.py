"""The pipeline's stages against plain versions, one after another."""

from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F
from test_queries import brute_components

from pageloom.llm import mixing
from pageloom.llm.common import isolate

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DATA)
        if name != cp.STAGES[-1][0]:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, docs := spark.read.parquet(str(tmp_path / name)))
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())

    before, after = seen["language_id"]
    letters = before.where(F.regexp_count("text", F.lit(r"\p{L}")) > 20)
    assert set(ids(letters)) <= set(ids(after))

    before, after = seen["exact_dedup"]
    assert ids(after) == sorted(r[0] for r in before.groupBy("text").agg(F.max("doc_id")).select("max(doc_id)").collect())

    before, after = seen["ngram_jaccard_join"]
    groups = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert ids(after) == sorted(i for i, (_, c) in groups.items() if i == c)

    before, after = seen["mixing"]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(before).collect()}
    got = Counter()
    for r in after.collect():
        got[r["doc_id"]] += len(r["text"].encode().split())
    assert dict(got) == {i: t for i, t in taken.items() if t}

    before, after = seen["packing"]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_run_gives_the_stages_rows(spark):
    got = cp.run(spark, DATA)
    assert {"doc_id", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


def test_run_of_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Nulls, empty and very long texts and repeated rows go through all stages; an empty table gives no rows."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, rows in (("odd", odd), ("empty", empty)):
        isolate(rows, *columns).write.parquet(str(tmp_path / name / "documents.parquet"))
    got = cp.run(spark, str(tmp_path / "odd")).collect()
    ids = {r["doc_id"] for r in got}
    assert {2, 8, 12} <= ids | {1} and not ids & {3, 4, 5, 11}  # no letters: rejected; 9 is a near copy of 8
    assert 9 not in ids
    assert cp.run(spark, str(tmp_path / "empty")).count() == 0


def test_a_kernel_hands_back_its_memory_after_its_last_batch(monkeypatch):
    """Many small objects, freed below one that is kept, stay with the process unless they are handed back."""
    import os

    from pageloom.llm import common

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    kept = []

    def kernel(frames):
        for frame in frames:
            held = [bytes(2000) for _ in range(50_000)]
            kept.append(bytes(2000))  # on top of the heap
            yield len(held)
            del held

    at_end = []
    plain = common.handed_back
    monkeypatch.setattr(common, "handed_back", lambda x: at_end.append(resident()) or plain(x))
    assert list(common.thrifty(kernel)(iter([1, 2]))) == [50_000, 50_000]
    assert len(at_end) == 1 and resident() < at_end[0] - (50 << 20)
    assert plain("x") == "x"
