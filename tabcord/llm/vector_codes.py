"""Product codes of vectors, found over Hilbert-sorted blocks.

Vectors become integers (``floor(4096 * x)``) and are cut into equal parts.
Every task gathers slabs of vectors; inside a slab the sub-vectors of each part
are sorted along a Hilbert curve and cut into flat blocks, each with the box
(smallest and largest component) and the sum of its rows.  Slabs are stored
once.  A round of assignment reads them: the distances from a block's box to
the codebook entries bound those of its rows from both sides, which leaves a
shortlist of entries for the block.  A shortlist of one takes the whole block by
its stored sum; the others are decided by exact integer distances to the
shortlist only.  Tasks emit sums per entry, so a round moves a few thousand
numbers a task and no key can be hot; blocks never leave the task that made them.

Integers are exact at any size: slabs of components beyond 64-bit distances are
kept apart and computed with Python integers, and so are entries beyond them.

Defined results.  Rows whose vector is null, or holds null or non-finite
components, are dropped; so are those whose length is not the usual one: the
most frequent positive multiple of the number of parts, the larger if equal.  Equal
distances take the lower entry.  The first entries are those of the smallest
ids, repeated ids by their components, null ids last; fewer vectors than entries give a shorter codebook.
Repeated rows are coded each.  A null id is kept.  Errors beyond 64 bits are
given as the largest long.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a block; components of a slab; bits of a coordinate on the curve.
BLOCK, SLAB, BITS = 128, 1 << 18, 4
#: Most label sums that are sent to every task.
SENT = 100_000
MOST = 2**63 - 1


def safe_limit(width: int, parts: int) -> int:
    """Components below it (of rows and entries) have summed distances below 2**63."""
    return min(2**31 - 1, math.isqrt(2**61 // (width * parts)))


def hilbert_order(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Rows of an integer array along a Hilbert curve through their box.

    Skilling's transform ("Programming the Hilbert curve", 2004) over all rows at once.
    """
    low = x.min(axis=0)
    span = max(int((x.max(axis=0) - low).max()), 1)
    v = np.asarray((x - low) * ((1 << bits) - 1) // span).astype(np.int64)
    width = v.shape[1]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(width):
            hit = (v[:, i] & q) != 0
            swap = np.where(hit, 0, (v[:, 0] ^ v[:, i]) & (q - 1))
            v[:, 0] ^= np.where(hit, q - 1, swap)
            v[:, i] ^= swap
        q >>= 1
    for i in range(1, width):
        v[:, i] ^= v[:, i - 1]
    turn = np.zeros(len(v), np.int64)
    q = top
    while q > 1:
        turn ^= np.where((v[:, -1] & q) != 0, q - 1, 0)
        q >>= 1
    v ^= turn[:, None]
    planes = [(v >> b) & 1 for b in range(bits - 1, -1, -1)]
    key = np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)
    return np.lexsort(key.T[::-1]).astype(np.int32)


@dataclass
class Blocks:
    """One part of a slab: sorted rows, their places in the slab, boxes and sums of blocks."""

    rows: np.ndarray
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @staticmethod
    def of(rows: np.ndarray, place: np.ndarray) -> Blocks:
        at = np.arange(0, len(rows), BLOCK)
        low, high, total = (
            f.reduceat(rows, at, axis=0) for f in (np.minimum, np.maximum, np.add)
        )
        return Blocks(rows, place, low, high, total)


def exact(entries: list[list[int]], limit: int) -> np.ndarray:
    """Entries as 64-bit integers where distances stay exact, else as Python integers."""
    small = all(abs(v) < limit for e in entries for v in e)
    return np.array(entries, dtype=np.int64 if small else object)


def shortlists(b: Blocks, entries: np.ndarray) -> np.ndarray:
    """Per block, which entries may be nearest to one of its rows.

    Box distances leave the entries not farther from the box than another
    entry's farthest point of it.  The entry with the nearest farthest point
    then bars those that are farther than itself from every point of the box:
    the difference of two squared distances is linear, so its largest value
    over a box is a sum over coordinates.  Equal distances stay, so that ties
    reach the kernel.
    """
    under = b.low[:, None, :] - entries[None]
    over = entries[None] - b.high[:, None, :]
    near = np.maximum(np.maximum(under, over), 0)
    far = np.maximum(np.abs(under), np.abs(over))
    reach = (far * far).sum(axis=2)
    may = (near * near).sum(axis=2) <= reach.min(axis=1)[:, None]
    pivot = entries[reach.argmin(axis=1)]
    apart = entries[None] - pivot[:, None, :]
    most = np.maximum(apart * b.low[:, None, :], apart * b.high[:, None, :]).sum(axis=2)
    norms = (entries * entries).sum(axis=1)
    return may & (2 * most + (pivot * pivot).sum(axis=1)[:, None] - norms[None] >= 0)


def nearest(
    rows: np.ndarray, choice: np.ndarray, entries: np.ndarray, limit: int
) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row of a block, among its (ascending) shortlist."""
    used = entries[choice]
    if used.dtype == object and (np.abs(used) < limit).all():
        used = used.astype(np.int64)
    score = (used * used).sum(axis=1) - 2 * (rows @ used.T)
    best = score.argmin(axis=1)
    return choice[best], score[np.arange(len(rows)), best] + (rows * rows).sum(axis=1)


def part_sums(b: Blocks, entries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of rows and number of rows that each entry is nearest to."""
    may = shortlists(b, entries)
    sums = np.zeros(entries.shape, b.rows.dtype)
    counts = np.zeros(len(entries), np.int64)
    alone = may.sum(axis=1) == 1
    for i, own in enumerate(may):
        rows = b.rows[i * BLOCK : (i + 1) * BLOCK]
        choice = np.flatnonzero(own)
        if alone[i]:
            sums[choice[0]] += b.total[i]
            counts[choice[0]] += len(rows)
            continue
        found, _ = nearest(rows, choice, entries, limit)
        of = (found[None] == choice[:, None]).astype(np.int64)
        sums[choice] += of @ rows
        counts[choice] += of.sum(axis=1)
    return sums, counts


def part_codes(b: Blocks, entries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each row, in the slab's order."""
    code = np.empty(len(b.rows), np.uint8)
    error = np.empty(len(b.rows), object)
    for i, own in enumerate(shortlists(b, entries)):
        at = slice(i * BLOCK, (i + 1) * BLOCK)
        code[b.place[at]], error[b.place[at]] = nearest(
            b.rows[at], np.flatnonzero(own), entries, limit
        )
    return code, error


# -- slabs ------------------------------------------------------------------------------------


def whole_numbers(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Rows of ``floor(4096 * x)`` below the limit, the rest as Python integers, and which it is."""
    big = (np.abs(values) >= (limit - 1) / SCALE).any(axis=1)
    small = np.floor(values[~big] * SCALE).astype(np.int64)
    # at 2**53 and above a double is a whole number
    grow = lambda v: int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE)
    return big, small, [[grow(v) for v in row] for row in values[big].tolist()]


def slab_row(rows: np.ndarray, parts: int) -> dict:
    """A slab's stored form: sorted rows, places, boxes and sums of every part."""
    width = rows.shape[1] // parts
    made = []
    for p in range(parts):
        own = rows[:, p * width : (p + 1) * width]
        place = hilbert_order(own)
        made.append(Blocks.of(own[place], place))
    place = np.concatenate([b.place for b in made]).astype(np.int32).tobytes()
    if rows.dtype == object:
        numbers = [str(v) for b in made for v in b.rows.ravel()]
        return {"wide": True, "place": place, "numbers": ",".join(numbers).encode()}
    flat = {
        name: np.concatenate([getattr(b, name).ravel() for b in made]).astype(kind).tobytes()
        for name, kind in (("rows", "i4"), ("low", "i4"), ("high", "i4"), ("total", "i8"))
    }
    numbers = flat.pop("rows")
    return {"wide": False, "place": place, "numbers": numbers, **flat}


def slab_parts(row: dict, n: int, parts: int, width: int) -> list[Blocks]:
    """The parts of a stored slab."""
    place = np.frombuffer(row["place"], np.int32).reshape(parts, n)
    if row["wide"]:
        numbers = np.array([int(v) for v in row["numbers"].split(b",")], object)
        rows = numbers.reshape(parts, n, width)
        return [Blocks.of(rows[p], place[p]) for p in range(parts)]
    rows = np.frombuffer(row["numbers"], np.int32).reshape(parts, n, width).astype(np.int64)
    low, high, total = (
        np.frombuffer(row[k], kind).reshape(parts, -1, width).astype(np.int64)
        for k, kind in (("low", np.int32), ("high", np.int32), ("total", np.int64))
    )
    return [Blocks(rows[p], place[p], low[p], high[p], total[p]) for p in range(parts)]


def _slabs(kept: DataFrame, dim: int, parts: int) -> DataFrame:
    """Stored slabs of the vectors ``v`` with their ids and labels."""
    limit = safe_limit(dim // parts, parts)
    most = max(4 * BLOCK, SLAB // dim)
    label = kept.schema["label"].dataType
    schema = T.StructType(
        [
            T.StructField("vec_ids", T.ArrayType(T.LongType())),
            T.StructField("labels", T.ArrayType(label)),
            T.StructField("wide", T.BooleanType()),
            *(
                T.StructField(c, T.BinaryType())
                for c in ("place", "numbers", "low", "high", "total")
            ),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {False: [], True: []}

        def close(wide: bool) -> pa.RecordBatch:
            rows = np.concatenate([r for r, _, _ in held[wide]])
            ids, labels = (
                pa.concat_arrays([h[k] for h in held[wide]]) for k in (1, 2)
            )
            held[wide] = []
            row = slab_row(rows, parts)
            ends = pa.array([0, len(rows)], pa.int32())
            cells = [pa.array([row.get(c)], pa.binary()) for c in schema.names[3:]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(ends, ids),
                    pa.ListArray.from_arrays(ends, labels),
                    pa.array([wide]),
                    *cells,
                ],
                schema.names,
            )

        for batch in batches:
            for a in range(0, batch.num_rows, most):
                some = batch.slice(a, most)
                values = some.column("v").flatten().to_numpy(zero_copy_only=False)
                big, small, large = whole_numbers(
                    values.astype(np.float64).reshape(some.num_rows, dim), limit
                )
                for wide, rows in ((False, small), (True, np.array(large, object))):
                    if not len(rows):
                        continue
                    mine = pa.array(big == wide)
                    keys = [some.column(c).filter(mine) for c in ("vec_id", "label")]
                    held[wide].append((rows, *keys))
                    if sum(len(h[0]) for h in held[wide]) >= most:
                        yield close(wide)
        for wide in held:
            if held[wide]:
                yield close(wide)

    return materialise(kept.mapInArrow(run, schema), "slabs")


def _read(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[tuple]:
    """Each slab of the batches: ids, labels, parts."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels = (batch.column(c)[i].values for c in ("vec_ids", "labels"))
            row = {
                c: batch.column(c)[i].as_py()
                for c in ("wide", "place", "numbers", "low", "high", "total")
            }
            yield ids, labels, slab_parts(row, len(ids), parts, width)


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number as (place, digit) in base 2**40; the last digit has the sign."""
    place = 0
    while abs(value) >= 1 << 40:
        value, digit = divmod(value, 1 << 40)
        yield place, digit
        place += 1
    yield place, value


def _round(slabs: DataFrame, books: list, parts: int, width: int) -> list:
    """The codebooks after one assignment of all rows."""
    limit = safe_limit(width, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [exact(b, limit) for b in books]
        total = np.zeros((parts, len(books[0]), width + 1), object)
        for _, _, found in _read(batches, parts, width):
            for p, blocks in enumerate(found):
                sums, counts = part_sums(blocks, entries[p], limit)
                total[p, :, :width] += sums
                total[p, :, width] += counts
        rows = [
            (p, e, i, place, digit)
            for (p, e, i), value in np.ndenumerate(total)
            if total[p, e, width]
            for place, digit in limbs(int(value))
        ]
        if rows:
            kinds = (pa.int32(),) * 4 + (pa.int64(),)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "i", "place", "digit"])

    keys = ("part", "entry", "i", "place")
    made = slabs.mapInArrow(run, "part int, entry int, i int, place int, digit long")
    total = np.zeros((parts, len(books[0]), width + 1), object)
    for r in made.groupBy(*keys).agg(F.sum("digit").alias("digit")).collect():
        total[r.part, r.entry, r.i] += r.digit << (40 * r.place)
    return [
        [
            [int(s) // int(total[p, e, width]) for s in total[p, e, :width]]
            if total[p, e, width]
            else list(old)
            for e, old in enumerate(book)
        ]
        for p, book in enumerate(books)
    ]


def _codes(slabs: DataFrame, books: list, parts: int, width: int) -> DataFrame:
    """vec_id, label, code and error of every row."""
    limit = safe_limit(width, parts)
    label = slabs.schema["labels"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("vec_id", T.LongType()),
            T.StructField("label", label),
            T.StructField("code", T.StringType()),
            T.StructField("error", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [exact(b, limit) for b in books]
        for ids, labels, found in _read(batches, parts, width):
            both = [part_codes(b, e, limit) for b, e in zip(found, entries, strict=True)]
            digits = np.stack([c for c, _ in both], axis=1).tobytes().hex()
            codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            errors = [min(int(v), MOST) for v in sum(e for _, e in both)]
            yield pa.RecordBatch.from_arrays(
                [ids, labels, pa.array(codes), pa.array(errors, pa.int64())], schema.names
            )

    return slabs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Encoded:
    """Codes (vec_id, label, code, error) and the codebooks: part, entry, component."""

    codes: DataFrame
    books: list[list[list[int]]]

    @property
    def digest(self) -> str:
        numbers = (str(v) for book in self.books for entry in book for v in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def _usable(v: Column) -> Column:
    """A vector without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.exists(v, bad)


def encode(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Encoded:
    """Codebooks fitted to all usable vectors, and the code of each."""
    if not 0 < entries <= 256:
        raise ValueError("a code digit is one byte: 1 to 256 entries")

    def own(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    rows = vectors.select(
        own(id_col).cast("long").alias("vec_id"),
        own(label_col).alias("label"),
        own(vector_col).alias("v"),
    ).where(_usable(F.col("v")))
    usual = (
        rows.groupBy(F.size("v").alias("dim"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("dim") > 0) & (F.col("dim") % parts == 0))
        .orderBy(F.desc("n"), F.desc("dim"))
        .first()
    )
    if usual is None:
        nothing = rows.limit(0).select(
            "vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")
        )
        return Encoded(nothing, [[] for _ in range(parts)])
    dim = usual.dim
    kept = rows.where(F.size("v") == dim)
    width = dim // parts
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    big, small, large = whole_numbers(
        np.array([r.v for r in first], np.float64), safe_limit(width, parts)
    )
    plain, rest = iter(small.tolist()), iter(large)
    start = [next(rest) if b else next(plain) for b in big]
    books = [[v[p * width : (p + 1) * width] for v in start] for p in range(parts)]
    slabs = _slabs(kept, dim, parts)
    for _ in range(rounds):
        books = _round(slabs, books, parts, width)
    return Encoded(materialise(_codes(slabs, books, parts, width), "codes"), books)


def with_label_errors(found: Encoded) -> DataFrame:
    """The codes with the error summed over rows of the same label (nulls together)."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)"))
    sums = materialise(
        found.codes.groupBy(F.col("label").alias("of")).agg(
            total.cast("long").alias("label_error")
        ),
        "label_errors",
    )
    if sums.count() <= SENT:
        sums = F.broadcast(sums)
    return found.codes.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(found.digest).alias("codebooks_sha256")
    )
