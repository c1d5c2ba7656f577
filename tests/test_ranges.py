import random

import pytest
from pyspark.sql import functions as F

from tabcord.operators import ranges as rg


def band(frame, dicts, values, **kw):
    return dicts(rg.band_share(frame("v double", *[(v,) for v in values]), ["v"], **kw))


@pytest.mark.parametrize(
    "values, status",
    [
        ([0.05], "PASS"),
        ([5.0] * 100, "FAIL"),
        ([0.2, -0.2, 0.5], "WARNING"),
        ([0.2] * 9 + [0.3], "PASS"),  # exactly 10 percent outside
        ([0.6, 0.0], "WARNING"),  # exactly 50 percent outside the wide band
        ([0.1, None, float("nan")], "PASS"),
    ],
)
def test_band_status(frame, dicts, values, status):
    assert band(frame, dicts, values)[0]["status"] == status


def test_band_counts_and_wording(frame, dicts):
    got = band(frame, dicts, [0.02, 0.6, -0.55, None])[0]
    assert (got["n"], got["pct_inner"], got["pct_outer"]) == (3, 66.7, 66.7)
    assert got["detail"].startswith("66.7% outside [−0.5, +0.5] — likely")
    assert band(frame, dicts, [0.0])[0]["detail"] == "0.0% outside [−0.2, +0.2]"


def test_band_without_values_gives_no_row(frame, dicts):
    assert band(frame, dicts, [None, float("nan")]) == []


@pytest.mark.parametrize(
    "values, status",
    [
        ([0.8, 0.9, 1.0], "PASS"),
        ([0.2, 0.45, 1.25, 0.8, 1.3], "FAIL"),
        ([0.1, 0.2], "WARNING"),  # low mean
        ([0.9] * 9 + [1.1], "WARNING"),  # 10 percent above
        ([1.0] * 4 + [1.2], "WARNING"),  # 20 percent above is not more than 20
    ],
)
def test_exceed_status(frame, dicts, values, status):
    df = frame("a double, b double", *[(v, None) for v in values])
    got = dicts(rg.exceed_share(df, ["a", "b"]))
    assert [(g["column"], g["status"]) for g in got] == [("a", status)]


@pytest.mark.parametrize(
    "ddl, values, status, invalid",
    [
        ("int", [202501, 202501, None], "PASS", 0),
        ("int", [999999], "FAIL", 1),
        ("int", [202501, 202502], "FAIL", 0),
        ("string", ["202601", " 202601 "], "FAIL", 0),
        ("string", ["202604.0"], "FAIL", 1),
        ("string", ["-20212"], "FAIL", 1),
        ("string", ["20260"], "FAIL", 1),
        ("double", [202604.7], "PASS", 0),
        ("int", [None], "SKIP", 0),
    ],
)
def test_months(frame, dicts, ddl, values, status, invalid):
    got = dicts(rg.yyyymm_check(frame(f"m {ddl}", *[(v,) for v in values]), "m"))[0]
    assert (got["status"], got["n_invalid"]) == (status, invalid)


def test_a_date_is_no_month(frame, dicts):
    df = frame("m string", ("2026-04-01",)).selectExpr("cast(m as date) as m")
    got = dicts(rg.yyyymm_check(df, "m"))[0]
    assert (got["status"], got["n_invalid"], got["sample"]) == ("FAIL", 1, "2026-04-01")


def test_month_wording(frame, dicts):
    got = dicts(rg.yyyymm_check(frame("m int", (202604,), (202613,)), "m"))[0]
    assert got["detail"] == "1 value(s) not in valid YYYYMM format: [202613, 202604]"


def sequence(frame, rows, ddl="k string, p int", **kw):
    return rg.sequence_check(frame(ddl, *rows), "k", "p", **kw)


def test_sequence_cases(frame, dicts):
    full = [("ok", i) for i in range(1, 121)]
    gap = [("gap", i) for i in [1, *range(3, 124)]]
    short = [("short", i) for i in range(1, 61)]
    late = [("late", 5), ("late", 5)]
    got = {g["k"]: g for g in dicts(sequence(frame, full + gap + short + late))}
    assert set(got) == {"gap", "short", "late"}
    assert got["gap"]["reasons"] == "gaps at [2]"
    assert got["short"]["reasons"] == "max p = 60 (< 120 required)"
    assert got["late"]["reasons"] == "starts at 5 (expected 1); max p = 5 (< 120 required)"


def test_sequence_null_keys_fractions_and_missing_positions(frame, dicts):
    rows = [(None, 1.9), (None, 3.0), ("empty", None), ("empty", float("nan"))]
    got = dicts(sequence(frame, rows, "k string, p double", min_last=3))
    assert [(g["k"], g["first"], g["gaps"]) for g in got] == [(None, 1, "2")]


def test_sequence_huge_range_lists_a_few_gaps_only(frame, dicts):
    got = dicts(sequence(frame, [("a", 1), ("a", 2_000_000_000)], min_last=1))[0]
    assert got["n_gaps"] == 1_999_999_998 and got["gaps"] == "2, 3, 4, 5, 6"
    assert got["reasons"] == "gaps at [2, 3, 4, 5, 6]…"


def test_sequence_against_brute_force(spark, dicts):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(12)}", rng.randrange(1, 40)) for _ in range(150)]
    want = {}
    for k in {r[0] for r in rows}:
        held = sorted({p for q, p in rows if q == k})
        missing = [p for p in range(held[0], held[-1]) if p not in held]
        if held[0] != 1 or missing or held[-1] < 30:
            want[k] = (held[0], held[-1], len(missing), ", ".join(map(str, missing[:5])))
    df = spark.createDataFrame(rows, "k string, p int").repartition(3)
    got = dicts(rg.sequence_check(df, "k", "p", min_last=30))
    assert {g["k"]: (g["first"], g["last"], g["n_gaps"], g["gaps"]) for g in got} == want


@pytest.mark.parametrize(
    "values, status, n_bad, below",
    [
        (["1", " 2.5 ", "-3e-1", ".5", "2."], "PASS", 0, 100.0),
        (["1", "", "abc", "1d", "nan", None], "FAIL", 4, 100.0),
        (["1", "4"], "WARNING", 0, 50.0),
        (["inf", "1"], "WARNING", 0, 50.0),
        ([None], "PASS", 0, 100.0),
    ],
)
def test_numeric_share(frame, dicts, values, status, n_bad, below):
    got = dicts(rg.numeric_share(frame("v string", *[(v,) for v in values]), ["v"]))[0]
    assert (got["status"], got["n_non_numeric"], got["pct_below"]) == (status, n_bad, below)


def test_numeric_share_of_number_columns(frame, dicts):
    df = frame("a double, b boolean", (1.0, True), (float("nan"), None))
    got = dicts(rg.numeric_share(df, ["a", "b"]))
    assert [(g["n"], g["n_non_numeric"], g["status"]) for g in got] == [(2, 0, "PASS")] * 2


def test_rows_split_over_partitions_change_nothing(spark, dicts):
    df = spark.range(1000).select((F.col("id") % 7 / 10.0).alias("v"))
    a = dicts(rg.band_share(df.coalesce(1), ["v"]))
    assert a == dicts(rg.band_share(df.repartition(5), ["v"]))
