"""Sums of doubles that are exact and the same under any partitioning."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tabcord.functions import exact


def nearest(values):
    """The exact sum of doubles as the nearest double."""
    return float(sum(map(Fraction, values), Fraction(0)))


def wild(rng, n):
    return [rng.uniform(-1, 1) * 10.0 ** rng.randint(-20, 20) for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_sums_are_exact_under_any_partitioning(spark, parts):
    rng = random.Random(7)
    groups = {g: wild(rng, 400) for g in range(6)}
    groups[6] = [0.1] * 1000
    groups[7] = [1e300, 1.0, -1e300, 2.0**-1000]
    groups[8] = [-v for v in groups[0]]
    rows = [(g, v) for g, values in groups.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, v double").repartition(parts)
    got = {r.g: r.v for r in exact.exact_sums(df, ["g"], ["v"]).collect()}
    assert got == {g: nearest(values) for g, values in groups.items()}
    assert got[6] == math.fsum(groups[6])


def test_money_needs_few_bins(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3).alias("g"), (F.rint(F.rand(1) * 10_000_000) / 100).alias("v")
    )
    sums = exact.ExactSums(df, {"v": F.col("v")})
    low, high = sums.bins["v"]
    assert high - low <= 4
    plan = df.groupBy("g").agg(*sums.parts())._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHash" not in plan
    want = {}
    for r in df.collect():
        want.setdefault(r.g, []).append(r.v)
    got = {r.g: r.v for r in exact.exact_sums(df, ["g"], ["v"]).collect()}
    assert got == {g: math.fsum(v) for g, v in want.items()}


def test_two_levels_equal_one(spark):
    rng = random.Random(3)
    rows = [(i % 4, i % 3, v) for i, v in enumerate(wild(rng, 300))]
    df = spark.createDataFrame(rows, "a int, b int, v double")
    sums = exact.ExactSums(df, {"v": F.col("v")})
    two = df.groupBy("a", "b").agg(*sums.parts()).groupBy("b").agg(*sums.again())
    got = {r.b: r.s for r in two.select("b", sums.result("v").alias("s")).collect()}
    assert got == {b: nearest([r[2] for r in rows if r[1] == b]) for b in range(3)}


def test_missing_and_infinite_values(frame):
    inf, nan = math.inf, math.nan
    df = frame(
        "g string, v double, w double",
        *[("a", None, None), ("a", nan, 1.5), ("b", inf, 0.0), ("b", 1.0, -0.0)],
        *[("c", -inf, 5e-324), ("c", inf, 5e-324), ("d", 0.25, -1.7e308)],
    )
    rows = exact.exact_sums(df, ["g"], ["v", "w"], "n").collect()
    got = {r.g: (r.v, r.w, r.n) for r in rows}
    assert got["a"] == (None, 1.5, 2) and got["b"] == (inf, 0.0, 2)
    assert math.isnan(got["c"][0]) and got["c"][1:] == (1e-323, 2)
    assert got["d"] == (0.25, -1.7e308, 1)
    assert exact.exact_sums(df.limit(0), ["g"], ["v"]).collect() == []
    assert exact.exact_sums(df.where("g = 'a'").select("g", "v"), [], ["v"]).first().v is None


def test_halves_round_to_even(frame):
    big = 2.0**53
    cases = [[big, 1.0], [big, 1.0, 2.0**-60], [big + 2, 1.0], [-big, -1.0], [big, 1.0, -(2.0**-60)]]
    df = frame("g int, v double", *[(i, v) for i, c in enumerate(cases) for v in c])
    got = {r.g: r.v for r in exact.exact_sums(df, ["g"], ["v"]).collect()}
    assert got == {i: nearest(c) for i, c in enumerate(cases)}
