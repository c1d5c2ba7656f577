"""Random small tables with nulls, against plain-Python brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tabcord.operators import compare, coverage, integrity, uniqueness

DDL = "a string, b string, m bigint"


def table(rng, n):
    pick = lambda: rng.choice([None, "x", "y", "z", ""])
    return [(pick(), pick(), rng.choice([None, rng.randrange(-5, 20)])) for _ in range(n)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_integrity_in_both_directions(spark, seed):
    rng = random.Random(seed)
    left, right = table(rng, 40), table(rng, 12)
    l, r = (spark.createDataFrame(t, DDL).repartition(3) for t in (left, right))
    lk, rk = {x[:2] for x in left}, {x[:2] for x in right}
    measure = defaultdict(int)
    for a, b, m in left:
        measure[a, b] += m or 0
    got = integrity.unmatched_measure(l, r, ["a", "b"], "m").drop("pct")
    assert rows(got) == sorted(((*k, measure[k]) for k in lk - rk), key=repr)
    assert rows(integrity.orphaned_keys(l, r, ["a", "b"])) == sorted(rk - lk, key=repr)
    # keys found by the census are those a null-safe anti join finds
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("a", "b")]
    anti = l.alias("l").join(r.alias("r"), on, "left_anti").select("a", "b").distinct()
    assert rows(integrity.unmatched_keys(l, r, ["a", "b"])) == rows(anti)


@pytest.mark.parametrize("seed", range(3))
def test_parents_equal_distinct_counts(spark, seed):
    rng = random.Random(100 + seed)
    df = spark.createDataFrame(table(rng, 9), DDL)
    got = {(r["key_col"], r["column"]): r["n_bad_keys"] for r in
           uniqueness.parent_violations(df, ["a", "b"], ["b", "m"]).collect()}
    for key, column in (("a", "b"), ("a", "m"), ("b", "m")):
        per_key = df.groupBy(key).agg(F.count_distinct(column).alias("n"))
        assert got[key, column] == per_key.where("n > 1").count()


@pytest.mark.parametrize("seed", range(2))
def test_domain_duplicates_and_difference(spark, seed):
    rng = random.Random(200 + seed)
    left, right = table(rng, 25), table(rng, 6)
    l, r = (spark.createDataFrame(t, DDL) for t in (left, right))
    want = []
    for i, c in enumerate("ab"):
        known = {x[i] for x in right}
        want += [(c, v) for v in {x[i] for x in left} if v is not None and v not in known]
    assert rows(integrity.domain_violations(l, r, ["a", "b"])) == sorted(want, key=repr)
    counts = Counter(x[:2] for x in left)
    dups = sorted(((*k, n) for k, n in counts.items() if n > 1), key=repr)
    assert rows(uniqueness.duplicate_keys(l, ["a", "b"])) == dups
    extra, lacking = Counter(left) - Counter(right), Counter(right) - Counter(left)
    want = [("left", *k, n) for k, n in extra.items()] + [("right", *k, n) for k, n in lacking.items()]
    assert rows(compare.diff(l, r)) == sorted(want, key=repr)


def test_coverage_totals(spark):
    rng = random.Random(7)
    data = table(rng, 60)
    df = spark.createDataFrame(data, DDL).repartition(4)
    got = {r["column"]: r for r in coverage.unmapped_share(df, ["a", "b"], "m").collect()}
    for i, c in enumerate("ab"):
        blank = [x for x in data if not x[i]]
        assert got[c]["n_unmapped"] == len(blank)
        assert got[c]["unmapped_measure"] == sum(x[2] or 0 for x in blank)
        assert got[c]["total_measure"] == sum(x[2] or 0 for x in data)
    parts = coverage.unmapped_breakdown(df, ["a"], ["b"], "m").collect()
    assert sum(p["m"] for p in parts) == got["a"]["unmapped_measure"]
