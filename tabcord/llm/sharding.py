"""Shards by a hierarchical weighted hash tree.

A :class:`Tree` has regions, racks in them and shards in those, each shard
with a weight; a rack or region weighs what it holds.  A row descends level
by level: at each node every child makes a hash draw of (row key, child) and
its exponential race time ``-ln(u) / weight`` decides; the earliest child
wins.  Draws depend on nothing but key and node, so a changed weight moves
rows only into (if it grew) or out of (if it shrank) that subtree and its
ancestors' subtrees; rows between two untouched subtrees never move.

:func:`layout` builds the tree for a number of shards so that growth opens a
new region: the added shard is then the only node whose weight changed, and
one more shard takes rows only into itself.

All of it is SQL functions.  Every row gets a shard: a null key draws like a
value of its own, equal keys go together.  Slots are gapless from 0 within a
shard, in buckets by row hash and ascending by key within a bucket; ties take
them in order of checksum and size.  Equal rows are counted before they are
ordered and get their slots from the count, and buckets hold a bounded expected
number of distinct rows, so no shard or repeated row passes through one sort.
Null texts are empty; long texts give only their size and checksum.  An empty
table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import materialise, text_of


@dataclass(frozen=True)
class Tree:
    """(region, rack, shard, weight) of every shard."""

    shards: tuple[tuple[str, str, int, float], ...]

    def children(self, *path: str) -> dict[object, float]:
        """Weights of the nodes below a path, in order of name."""
        out: dict[object, float] = {}
        for row in self.shards:
            if row[: len(path)] == path:
                out[row[len(path)]] = out.get(row[len(path)], 0.0) + row[3]
        return {k: w for k, w in out.items() if w > 0}


def layout(shards: int, base: int = 24) -> Tree:
    """Three regions of two racks for the first ``base`` shards; each later shard opens a region."""
    rows = []
    for s in range(shards):
        if s < base:
            rows.append((f"region-{s * 3 // base}", f"rack-{s * 6 // base}", s, 1.0))
        else:
            rows.append((f"region-{3 + s - base}", f"rack-{6 + s - base}", s, 1.0))
    return Tree(tuple(rows))


def draw(key: Column, node: Column, weight: Column) -> Column:
    """A node's race time for a key: exponential with the weight as its rate."""
    bits = F.shiftrightunsigned(F.xxhash64(key, node), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / weight


def nodes(tree: Tree, *path: str) -> list[dict]:
    """The nodes below a path that weigh anything, with their own nodes, in order."""
    out = []
    for child, weight in tree.children(*path).items():
        own = {"node": "/".join([*path, str(child)]), "weight": weight}
        below = {"shard": child} if len(path) == 2 else {"below": nodes(tree, *path, child)}
        out.append({**own, **below})
    return out


_LEVEL = "array<struct<node:string,weight:double,{}>>"
_TREE = _LEVEL.format("below:" + _LEVEL.format("below:" + _LEVEL.format("shard:int")))


def descend(tree: Tree, key: Column) -> Column:
    """The shard that a key reaches: at each level the child with the earliest time.

    The tree is one constant and a level one expression over its nodes, so the
    plan does not grow with the number of shards and a row draws only for the
    children on its way.
    """
    found = nodes(tree)
    if not found:
        raise ValueError("no shard has a weight")

    def first(children: Column, then: str) -> Column:
        # i parts equal times, so what follows is never compared
        times = F.transform(
            children,
            lambda c, i: F.struct(
                draw(key, c["node"], c["weight"]).alias("time"), i.alias("i"), c[then].alias(then)
            ),
        )
        return F.array_min(times)[then]

    whole = F.from_json(F.lit(json.dumps(found)), _TREE)
    return first(first(first(whole, "below"), "below"), "shard")


def assign(
    docs: DataFrame,
    tree: Tree,
    grown: Tree | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_rows: int = 50_000,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    text = F.encode(text_of(text_col), "UTF-8")
    key = F.col("doc_id")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).select(
        "*",
        descend(tree, key).alias("shard"),
        (descend(grown, key) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    same = ("shard", "doc_id", "text_crc32", "size", "grown_shard")
    kinds = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"))
    kinds = materialise(kinds, "shards")
    # as many buckets as the rows need, by a hash of the whole row so that no key fills one
    buckets = max(1, -(-kinds.count() // (bucket_rows * len(tree.shards))))
    kinds = kinds.withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets))
    )
    held = kinds.groupBy("shard", "bucket").agg(F.sum("copies").alias("held"))
    before = Window.partitionBy("shard").orderBy("bucket")
    offsets = held.select(
        "shard",
        "bucket",
        F.coalesce(
            F.sum("held").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("first"),
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    ahead = F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    return (
        kinds.withColumn("place", F.coalesce(ahead, F.lit(0)))
        .join(offsets, ["shard", "bucket"])
        .select("*", copy)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("first") + F.col("place") + F.col("copy")).cast("long").alias("slot"),
            F.col("grown_shard").cast("int").alias("grown_shard"),
        )
    )
