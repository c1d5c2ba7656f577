"""Ranked lexical search: the best documents for each query text, exactly.

A document's impact vector has, per term, a whole number that grows with the
term's count and falls with the document's length; a score is the product of a
query's counts, the term weights and the impacts.  Following LEMP (Teflioudi,
Gemulla, Mykytiuk, 2015), vectors are ordered by length and cut into buckets:

* every task orders slabs of its documents by vector length, longest first, and
  stores each bucket as flat posting arrays with its largest length;
* the longest buckets of all slabs give each query a first threshold, the score
  of its k-th best document there;
* then all buckets are read but those too short for every query (a filter that
  reaches the Parquet scan).  For a query, Cauchy-Schwarz ends a slab at the
  first bucket that is too short; inside a bucket, the coordinates with the
  largest query weight bound every document (known part of the product, lengths
  of what is left), and only survivors are scored, in 64-bit integers.

Bounds are never below the true score, so results are exact.  Queries are
handled in blocks of bounded size; a task keeps k documents a query, so no group grows
with the table, and copies, frequent words and long documents move nothing.

Defined results.  Null and empty texts, and texts without a term, neither rank
nor count.  Repeated rows of the documents are documents each; equal scores rank by ascending
id, null ids last.  Rows of the queries that repeat id and text are one query;
one id with several texts is several queries.  Empty tables give no rows.  Long texts are read whole, a
few MB of terms at a time.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import materialise, text_of

#: Documents a query ranks.
TOP = 20
#: Documents and vector entries of a slab; documents of a bucket.
SLAB, ENTRIES, BUCKET = 16_384, 1 << 22, 512
#: Coordinates of a query that bound a document.
FOCUS = 6
#: Queries and characters of a block.
ITEMS, CHARS = 4096, 1 << 26
#: Bytes of a text whose terms are listed at once.
PIECE = 1 << 22

_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, a few MB at a time."""
    raw = text.encode("utf-8", "surrogatepass").translate(_KEEP)
    at = 0
    while at < len(raw):
        end = at + PIECE
        end = len(raw) if end >= len(raw) or (cut := raw.find(b" ", end)) < 0 else cut
        yield raw[at:end].split()
        at = end


def counted(text: str) -> Counter:
    found: Counter = Counter()
    for some in terms_of(text):
        found.update(some)
    return found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Query:
    """A query's item id, terms (ascending), and count times weight of each."""

    item_id: int | None
    terms: np.ndarray
    gains: np.ndarray
    roots: np.ndarray

    def __post_init__(self) -> None:
        # gain = count * weight; a document's coordinate is root * impact, so q * z = gain * impact
        self.q = self.gains / self.roots
        self.length = float(np.sqrt((self.q**2).sum()))
        order = np.argsort(-self.q, kind="stable")
        self.focus, rest = order[:FOCUS], order[FOCUS:]
        self.rest = float(np.sqrt((self.q[rest] ** 2).sum()))


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, number of terms, and the counts of known terms of every document."""
    schema = "doc_id long, n long, terms array<int>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, terms, counts = [], [0], [], []
            for value in batch.column("text"):
                found = counted(value.as_py())
                sizes.append(found.total())
                own = sorted((vocabulary[t], found[t]) for t in found.keys() & vocabulary.keys())
                terms.extend(t for t, _ in own)
                counts.extend(c for _, c in own)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                ],
                ["doc_id", "n", "terms", "counts"],
            )

    return materialise(docs.mapInArrow(run, schema), "term_counts")


BUCKET_ROW = T.StructType(
    [
        T.StructField("first", T.BooleanType()),
        T.StructField("longest", T.DoubleType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        *(
            T.StructField(c, T.BinaryType())
            for c in ("lengths", "terms", "starts", "places", "impacts")
        ),
    ]
)


def bucket_rows(
    ids: pa.Array, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, weights: np.ndarray
) -> Iterator[list]:
    """A slab's buckets, longest vectors first, from its entries (document, term, impact)."""
    squares = np.bincount(doc, weights[term] * impact.astype(np.float64) ** 2, len(ids))
    order = np.argsort(-squares, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    place = rank[doc]
    by = np.lexsort((place, term, place // BUCKET))
    place, term, impact = place[by], term[by], impact[by]
    edges = np.searchsorted(place // BUCKET, np.arange(-(-len(ids) // BUCKET) + 1))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        mine = order[k * BUCKET : (k + 1) * BUCKET]
        own, starts = np.unique(term[a:b], return_index=True)
        lengths = np.sqrt(squares[mine])
        yield [
            k == 0,
            float(lengths[0]),
            ids.take(pa.array(mine)),
            lengths.tobytes(),
            own.astype(np.int32).tobytes(),
            np.append(starts, b - a).astype(np.int32).tobytes(),
            (place[a:b] - k * BUCKET).astype(np.int32).tobytes(),
            impact[a:b].astype(np.int32).tobytes(),
        ]


def _buckets(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Stored buckets of all documents that hold a known term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            ids = pa.concat_arrays([h[0] for h in held])
            sizes = np.cumsum([0] + [len(h[0]) for h in held])
            doc = np.concatenate([h[1] + at for h, at in zip(held, sizes, strict=False)])
            term, impact = (np.concatenate([h[k] for h in held]) for k in (2, 3))
            held.clear()
            for row in bucket_rows(ids, doc, term, impact, weights):
                row[2] = pa.ListArray.from_arrays(pa.array([0, len(row[2])], pa.int32()), row[2])
                cells = [
                    c if isinstance(c, pa.Array) else pa.array([c], k)
                    for c, k in zip(row, kinds, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(cells, BUCKET_ROW.names)

        kinds = [pa.bool_(), pa.float64(), None, *[pa.binary()] * 5]
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                some = batch.slice(a, 1024)
                sizes = some.column("n").to_pylist()
                lists = some.column("terms")
                many = lists.value_lengths().to_numpy()
                doc = np.repeat(np.arange(len(many)), many)
                term = lists.flatten().to_numpy()
                tf = some.column("counts").flatten().to_numpy()
                m = np.array([75 + 25 * n * n_docs // n_terms for n in sizes], np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
                held.append((some.column("doc_id"), doc, term, impact))
                if (
                    sum(len(h[0]) for h in held) >= SLAB
                    or sum(len(h[1]) for h in held) >= ENTRIES
                ):
                    yield from close()
        if held:
            yield from close()

    known = vectors.where(F.size("terms") > 0)
    return materialise(known.mapInArrow(run, BUCKET_ROW), "buckets")


class Bucket:
    """A stored bucket opened for queries."""

    def __init__(self, row: dict) -> None:
        self.first, self.longest, self.doc_ids = row["first"], row["longest"], row["doc_ids"]
        self.lengths = np.frombuffer(row["lengths"])
        self.terms, self.starts, self.places, self.impacts = (
            np.frombuffer(row[k], np.int32) for k in ("terms", "starts", "places", "impacts")
        )

    def postings(self, query: Query) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Per query term the places and impacts of the documents that hold it."""
        at = np.minimum(np.searchsorted(self.terms, query.terms), len(self.terms) - 1)
        return [
            (
                self.places[self.starts[j] : self.starts[j + 1]],
                self.impacts[self.starts[j] : self.starts[j + 1]].astype(np.int64),
            )
            if same
            else None
            for j, same in zip(at, self.terms[at] == query.terms, strict=True)
        ]

    def survivors(self, query: Query, postings: list, least: int) -> np.ndarray:
        """Places of the documents whose bound reaches a score."""
        part = np.zeros(len(self.lengths))
        known = np.zeros(len(self.lengths))
        for k in query.focus:
            if postings[k] is not None:
                places, impacts = postings[k]
                z = query.roots[k] * impacts
                part[places] += query.q[k] * z
                known[places] += z * z
        left = np.sqrt(np.maximum(self.lengths**2 - known, 0) + 1e-9 * self.lengths**2)
        return np.flatnonzero((part + query.rest * left) * (1 + 1e-9) >= least)

    def scores(self, query: Query, postings: list) -> np.ndarray:
        """Exact scores of all documents of the bucket."""
        total = np.zeros(len(self.lengths), np.int64)
        for gain, found in zip(query.gains.tolist(), postings, strict=True):
            if found is not None:
                total[found[0]] += gain * found[1]
        return total


def _ranked(buckets: DataFrame, queries: list[Query], least: list[int], top: int) -> DataFrame:
    """Each task's best documents of each query, with scores of at least ``least``."""
    schema = T.StructType.fromDDL("query int, doc_id long, score long")
    last = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        floor = list(least)
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                bucket = Bucket({c: batch.column(c)[i].as_py() for c in names})
                for k, query in enumerate(queries):
                    if query.length * bucket.longest * (1 + 1e-9) < floor[k]:
                        continue
                    postings = bucket.postings(query)
                    may = bucket.survivors(query, postings, floor[k])
                    if not len(may):
                        continue
                    scores = bucket.scores(query, postings)[may]
                    at = np.flatnonzero(scores >= floor[k])
                    if len(at) > top:
                        # no document below the k-th score of its own bucket can rank
                        at = at[scores[at] >= np.partition(scores[at], len(at) - top)[-top]]
                    if not len(at):
                        continue
                    found = [(bucket.doc_ids[may[j]], int(scores[j])) for j in at.tolist()]
                    best[k] = sorted(
                        best[k] + found, key=lambda x: (-x[1], last if x[0] is None else x[0])
                    )[:top]
                    if len(best[k]) == top:
                        floor[k] = max(floor[k], best[k][-1][1])
        rows = [(k, d, s) for k, own in enumerate(best) for d, s in own]
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.int64())
            cells = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cells, schema.names)

    return buckets.mapInArrow(run, schema)


def _by_rank(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _block(docs: DataFrame, items: list[tuple], top: int) -> DataFrame:
    """Results of one block of queries (item id, text)."""
    counts = [(i, counted(text)) for i, text in items]
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*(c for _, c in counts))))}
    vectors = _vectors(docs, vocabulary)
    some = vectors.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    n_docs, n_terms = some[0] or 0, some[1] or 0
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
    queries = []
    for item_id, found in counts:
        own = sorted((vocabulary[t], c) for t, c in found.items())
        own = [(t, c) for t, c in own if weights[t] > 0 and df[t] > 0]
        if own:
            terms, times = np.array(own, np.int64).T
            w = weights[terms]
            queries.append(Query(item_id, terms, times * w, np.sqrt(w)))
    schema = "item_id long, rank int, doc_id long, score long"
    if not queries:
        return docs.sparkSession.createDataFrame([], schema)
    buckets = _buckets(vectors, weights, n_docs, n_terms)
    least = [1] * len(queries)
    longest = _ranked(buckets.where("first"), queries, least, top)
    for r in _by_rank(longest, top).where(F.col("rank") == top).collect():
        least[r["query"]] = max(1, r.score)
    needed = min(s / q.length for s, q in zip(least, queries, strict=True)) / (1 + 1e-9)
    found = _ranked(buckets.where(F.col("longest") >= needed), queries, least, top)
    ids = F.array(*(F.lit(q.item_id).cast("long") for q in queries))
    return _by_rank(found, top).select(
        F.get(ids, F.col("query")).alias("item_id"), "rank", "doc_id", "score"
    )


def search(
    documents: DataFrame,
    items: DataFrame,
    top: int = TOP,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    query_col: str = "text",
    block_items: int = ITEMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each query with a score above 0."""
    docs = documents.select(
        F.col(doc_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")
    )
    asked = items.select(
        F.col(item_col).cast("long").alias("item_id"), text_of(query_col).alias("text")
    ).distinct()
    n, chars = asked.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    blocks = max(-(-n // block_items), -(-(chars or 0) // CHARS), 1)
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for k in range(blocks):
        own = asked.where(number == k).orderBy("item_id", "text").collect()
        block = _block(docs, [tuple(r) for r in own], top)
        found = block if found is None else found.unionByName(block)
    return found
