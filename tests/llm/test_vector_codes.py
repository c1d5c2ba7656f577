import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabcord.llm import queries, vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label string"


def plain(rows, parts=8, entries=16, rounds=6):
    """The codes, row by row, with Python integers."""
    kept = []
    for vec_id, v, label in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(Fraction(x) * 4096) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return {}, None
    width = len(kept[0][1]) // parts
    cut = [[r[1][p * width : (p + 1) * width] for r in kept] for p in range(parts)]
    books = [list(own[:entries]) for own in cut]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            found = [best(x, books[p])[1] for x in cut[p]]
            for j in set(found):
                mine = [x for x, f in zip(cut[p], found) if f == j]
                books[p] = list(books[p])
                books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    out, by_label = [], {}
    for i, (vec_id, _, label) in enumerate(kept):
        both = [best(cut[p][i], books[p]) for p in range(parts)]
        error = sum(b[0] for b in both)
        by_label[label] = by_label.get(label, 0) + error
        out.append((vec_id, "".join(f"{b[1]:02x}" for b in both), error, label))
    most = 2**63 - 1
    digest = hashlib.sha256(
        ",".join(str(v) for book in books for e in book for v in e).encode()
    ).hexdigest()
    rows = [(i, c, min(e, most), min(by_label[k], most)) for i, c, e, k in out]
    return sorted(rows, key=repr), digest


def codes(df, **options):
    found = vc.encode(df, **options)
    rows = vc.with_label_errors(found).collect()
    assert {r.codebooks_sha256 for r in rows} <= {found.digest}
    return sorted(
        ((r.vec_id, r.code, r.error, r.label_error) for r in rows), key=repr
    ), found.digest


def clusters(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim))
    return [
        (i, (centres[i % 7] + rng.normal(scale=0.2, size=dim)).tolist(), "abc"[i % 3])
        for i in range(n)
    ]


@pytest.mark.parametrize("dim", [8, 16, 40])
def test_codes_equal_plain_ones(frame, dim):
    rows = clusters(700, dim, dim)
    assert codes(frame(SCHEMA, *rows).repartition(3)) == plain(rows)


def test_odd_vectors(frame):
    bad = [
        (900, None, "a"),
        (901, [1.0] * 7 + [None], "a"),
        (902, [1.0] * 7 + [float("nan")], "a"),
        (903, [1.0] * 7 + [float("-inf")], None),
    ]
    good = [
        (None, [0.5] * 8, None),
        (None, [0.25] * 8, None),
        (7, [0.0] * 8, "x"),
        (7, [0.0] * 8, "x"),
        (7, [-1.5e-9] * 8, None),
        (1, [3.0, -2.0] * 4, "y"),
    ]
    df = frame(SCHEMA, *bad, *good, (904, [], "a"), (905, [1.0] * 5, "a"))
    df = df.withColumns({c: F.lit(f"own {c}") for c in ("v", "code", "error", "of", "wide")})
    assert codes(df) == plain(good)


def test_numbers_beyond_64_bits(frame):
    rows = clusters(80, 8, 1) + [
        (100 + i, [(-1) ** i * 10.0 ** (4 + 5 * i + j % 3) for j in range(8)], "big")
        for i in range(12)
    ]
    assert codes(frame(SCHEMA, *rows), entries=4) == plain(rows, entries=4)
    first = [(i - 200, v, k) for i, v, k in rows[-3:]] + rows
    assert codes(frame(SCHEMA, *first), rounds=3) == plain(first, rounds=3)


def test_few_and_no_vectors(spark, frame):
    rows = clusters(5, 16, 3)
    assert codes(frame(SCHEMA, *rows)) == plain(rows)
    assert codes(frame(SCHEMA))[0] == []
    assert codes(frame(SCHEMA, (1, None, "a")))[0] == []
    assert vc.encode(frame(SCHEMA)).codes.columns == ["vec_id", "label", "code", "error"]


def test_hot_vectors_and_ties(frame):
    rows = [(i, [0.0] * 8 if i % 3 else [float(i % 4)] * 8, None) for i in range(3000)]
    assert codes(frame(SCHEMA, *rows).repartition(5)) == plain(rows)


def test_shortlists_hold_every_nearest_entry():
    rows = np.array([r[1] for r in clusters(7000, 8, 5)])
    rows = np.floor(rows * 4096).astype(np.int64)
    place = vc.hilbert_order(rows)
    blocks = vc.Blocks.of(rows[place], place)
    entries = rows[:16]
    may = vc.shortlists(blocks, entries)
    distance = ((blocks.rows[:, None] - entries[None]) ** 2).sum(axis=2)
    nearest = distance == distance.min(axis=1)[:, None]
    assert not (nearest & ~may[np.arange(7000) // vc.BLOCK]).any()
    assert may.sum() < 0.6 * may.size
    centres = np.stack([rows[i::7].mean(axis=0).astype(np.int64) for i in range(7)])
    assert (vc.shortlists(blocks, centres).sum(axis=1) == 1).any()
    code, error = vc.part_codes(blocks, entries, vc.safe_limit(8, 8))
    assert (error == ((rows - entries[code]) ** 2).sum(axis=1)).all()


def test_the_curve_steps_to_a_neighbour():
    grid = np.stack(np.meshgrid(*[np.arange(16)] * 3), axis=-1).reshape(-1, 3)
    path = grid[vc.hilbert_order(grid, 4)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_limbs_add_up():
    for v in (0, 5, -5, 2**40, -(2**40), 2**200 + 17, -(10**60)):
        assert sum(d << (40 * p) for p, d in vc.limbs(v)) == v


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op13_vector_codes(spark, sf).collect()
    want, digest = plain([(i, [float(x) for x in v], k) for i, v, k in rows])
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want
    assert {r.codebooks_sha256 for r in got} == {digest}
