import hashlib

import pytest

import corpus_pipeline as cp
from tabcord.functions.durable import work_dir
from tabcord.llm import queries
from tabcord.llm.frames import materialise

from .conftest import vocabulary


def test_stages_follow_each_other(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    seen = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in cp.STAGES:
        after = materialise(stage(spark, docs, sf), "stage")
        if name == "bpe":
            break
        assert after.columns == columns
        now = {r.doc_id: r.text for r in after.collect()}
        assert set(now) <= set(seen) and now
        if name != "personal data":
            assert all(seen[d] == t for d, t in now.items())
            assert len(now) < len(seen)
        else:
            assert set(now) == set(seen) and now != seen
        if name == "near-duplicates":
            assert len(set(now.values())) == len(now)
        if name == "benchmark decontamination":
            items = [r.text.lower() for r in benchmark.collect()]
            assert not any(i in t.lower() for t in now.values() for i in items)
        docs, seen = after, now
    library = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = after.collect()
    assert {r.doc_id for r in got} == set(seen)
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(seen[r.doc_id].encode()).hexdigest()
        assert r.n_tokens == len(library.encode(seen[r.doc_id], add_special_tokens=False).ids)


def files_below(spark):
    import os

    place = work_dir(spark)
    return {os.path.join(d, f) for d, _, names in os.walk(place) for f in names if f.endswith(".parquet")}


def test_run_gives_the_last_stage_and_leaves_nothing_else(spark, sf):
    before = files_below(spark)
    got = cp.run(spark, sf)
    left = files_below(spark) - before
    assert left and all("/bpe/" in f for f in left)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert got.count() > 0


def test_odd_documents(spark, sf, odd, none):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars", "key", "score")
    for frame in (plain, none):
        docs = frame
        for _, stage in cp.STAGES:
            docs = materialise(stage(spark, docs, sf), "stage")
        assert docs.count() <= frame.count()


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
