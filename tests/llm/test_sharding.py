import math
import struct
import zlib
from collections import Counter

import xxhash

from tabcord.llm import sharding


def plain_draw(key, node, weight):
    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    bits = xxhash.xxh64_intdigest(node.encode(), seed) >> 11
    return -math.log((bits + 0.5) / (1 << 53)) / weight


def plain_shard(tree, key, *path):
    if len(path) == 3:
        return path[2]
    times = {c: plain_draw(key, "/".join([*path, str(c)]), w) for c, w in tree.children(*path).items()}
    if len(times) == 1:
        return plain_shard(tree, key, *path, next(iter(times)))
    return plain_shard(tree, key, *path, min(times, key=times.get))


def test_rows_descend_as_drawn(docs):
    tree, grown = sharding.layout(24), sharding.layout(25)
    rows = {r.doc_id: r.text.encode() for r in docs.collect()}
    got = sharding.assign(docs, tree, grown).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.shard == plain_shard(tree, r.doc_id)
        assert r.grown_shard == plain_shard(grown, r.doc_id)
        assert (r.size, r.text_crc32) == (len(rows[r.doc_id]) + 8, zlib.crc32(rows[r.doc_id]))


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "'x' AS text")
    got = sharding.assign(rows, sharding.layout(24), sharding.layout(25), bucket_rows=20).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    moved = sum(r.grown_shard == 24 for r in got)
    assert 150 < moved < 340  # a twenty-fifth is 240
    held = Counter(r.shard for r in got)
    assert set(held) == set(range(24)) and min(held.values()) > 170 and max(held.values()) < 340
    for shard, n in held.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))


def test_weights_move_rows_only_through_changed_subtrees():
    before = sharding.layout(24)
    rows = [(a, b, s, 3.0 if s == 5 else w) for a, b, s, w in before.shards]
    after = sharding.Tree(tuple(rows))
    region, rack = next((a, b) for a, b, s, _ in rows if s == 5)
    for key in range(1500):
        x, y = plain_shard(before, key), plain_shard(after, key)
        if x != y:
            place = {s: (a, b) for a, b, s, _ in rows}
            assert place[y][0] == region
            assert place[x][0] != region or place[y][1] == rack


def test_odd_table(odd, none):
    got = sharding.assign(odd, sharding.layout(24)).collect()
    assert len(got) == odd.count()
    assert {r.size for r in got if r.doc_id in (1, 2)} == {8}
    assert all(r.grown_shard is None and r.law == "key" for r in got)
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.assign(none, sharding.layout(24), sharding.layout(25)).count() == 0


def test_equal_rows_and_clashing_columns(spark):
    rows = spark.range(3000).selectExpr(
        "CASE WHEN id < 2000 THEN 7 ELSE id END AS doc_id",
        "'x' AS text",
        "'own' AS shard",
        "'own' AS copies",
        "'own' AS bucket",
    )
    got = sharding.assign(rows, sharding.layout(24), bucket_rows=20).collect()
    assert len(got) == 3000 and len({r.shard for r in got if r.doc_id == 7}) == 1
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_a_thousand_shards_are_one_small_plan(spark):
    import time

    rows = spark.range(500).selectExpr("id AS doc_id")
    tree = sharding.layout(1000, base=1000)
    start = time.perf_counter()
    got = rows.select("doc_id", sharding.descend(tree, rows["doc_id"]).alias("shard"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert time.perf_counter() - start < 3
    assert plan.count("xxhash64") <= 3
    assert all(r.shard == plain_shard(tree, r.doc_id) for r in got.collect())
