import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabcord.llm import lexical, queries

from .conftest import ODD, ODD_SCHEMA

ITEM = "item_id long, text string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return Counter(t.translate(UPPER) for t in found)


def plain(docs, items, top=20):
    """Rank every document for every item, score by score."""
    vectors = [(i, terms(t)) for i, t in docs]
    vectors = [(i, v) for i, v in vectors if v]
    n_docs, n_terms = len(vectors), sum(v.total() for _, v in vectors)
    df = Counter(t for _, v in vectors for t in v)
    out = []
    for item, text in sorted(set(items), key=repr):
        asked, scored = terms(text), []
        for doc_id, v in vectors:
            m = 75 + 25 * v.total() * n_docs // n_terms
            score = 0
            for t, times in asked.items():
                if t in v:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * (10**9 * v[t] // (1000 * v[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, null, doc_id) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if null else doc_id, -score))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_terms_equal_the_pattern():
    text = "Ab1 é×ÀZ—x_y <|z|> \x7f\x85  日本 " * 3
    for size in (1, 3, 1 << 22):
        lexical.PIECE = size
        got = Counter({k.decode(): n for k, n in lexical.counted(text).items()})
        assert got == terms(text)
    lexical.PIECE = 1 << 22


@pytest.mark.parametrize("slab, bucket", [(16_384, 512), (50, 7)])
def test_ranking_equals_brute_force(spark, sf, docs, monkeypatch, slab, bucket):
    monkeypatch.setattr(lexical, "SLAB", slab)
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    few = docs.repartition(3)
    assert found(lexical.search(few, items)) == plain(rows, asked)


def test_odd_tables(spark, odd, none, frame):
    asked = [
        (1, "the same line AGAIN word"),
        (1, "the same line AGAIN word"),
        (1, "naïve ÉTÉ 42"),
        (2, None),
        (3, ""),
        (None, "日本語 one x"),
        (4, "unseen words only here"),
        (5, "word " * 40_000 + "hello"),
    ]
    items = frame(ITEM, *asked).withColumns(
        {c: F.lit(f"own {c}") for c in ("rank", "doc_id", "score", "query", "terms")}
    )
    rows = [(r[0], r[1]) for r in ODD]
    want = plain(rows, asked)
    assert found(lexical.search(odd, items)) == want and len(want) > 8
    assert found(lexical.search(odd, items, block_items=2)) == want
    assert found(lexical.search(none, items)) == []
    assert found(lexical.search(odd, frame(ITEM))) == []
    blank = spark.createDataFrame([(1, None, None, None, 0), (2, " -- ", "", "", 0)], ODD_SCHEMA)
    assert found(lexical.search(blank, items)) == []


def test_ties_and_copies(frame):
    rows = [(i, "alpha beta" if i % 2 else "alpha beta gamma") for i in range(300, 0, -1)]
    rows += [(7, "alpha beta"), (None, "alpha beta")]
    asked = [(1, "alpha"), (2, "gamma beta alpha"), (3, "beta beta")]
    df = frame("doc_id long, text string", *rows).repartition(4)
    for top in (1, 3, 400):
        assert found(lexical.search(df, frame(ITEM, *asked), top=top)) == plain(rows, asked, top)


def test_bounds_are_never_below_a_score():
    rng = np.random.default_rng(3)
    weights = rng.integers(1, 9000, 60)
    for _ in range(30):
        doc = np.repeat(np.arange(40), 12)
        term = np.concatenate([np.sort(rng.choice(60, 12, False)) for _ in range(40)])
        impact = rng.integers(1, 1_000_000, len(doc))
        import pyarrow as pa

        rows = list(lexical.bucket_rows(pa.array(range(40)), doc, term, impact, weights))
        own = dict(zip(lexical.BUCKET_ROW.names, rows[0], strict=True))
        bucket = lexical.Bucket(own)
        asked = np.sort(rng.choice(60, 15, False))
        times = rng.integers(1, 4, 15)
        query = lexical.Query(1, asked, times * weights[asked], np.sqrt(weights[asked]))
        postings = bucket.postings(query)
        scores = bucket.scores(query, postings)
        assert scores.max() <= query.length * bucket.longest * (1 + 1e-9)
        for least in (1, int(np.median(scores)), int(scores.max())):
            kept = set(bucket.survivors(query, postings, least).tolist())
            assert set(np.flatnonzero(scores >= least).tolist()) <= kept
        assert len(bucket.survivors(query, postings, int(scores.max()))) < 40


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 5), st.text("ab é", max_size=8)), max_size=10),
    st.lists(st.tuples(st.integers(0, 2), st.text("ab é", max_size=6)), max_size=4),
)
def test_any_rows(spark, rows, asked):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(asked, ITEM)
    assert found(lexical.search(docs, items, top=3)) == plain(rows, asked, 3)


def test_query(spark, sf):
    df = queries.op11_search(spark, sf)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    rows = df.collect()
    assert {r.rank for r in rows} == set(range(1, 21))
    assert len(rows) == 20 * len({r.item_id for r in rows})
