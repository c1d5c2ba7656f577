import pytest

from tabcord.operators import coverage as cv

DDL = "Key_M string, state string, lob string, premium double"


@pytest.fixture
def fact(frame):
    return frame(
        DDL,
        ("M1", "NSW", "A", 100.0),
        (None, "NSW", "A", 50.0),
        (None, "NSW", "B", 25.0),
        (" \t ", "VIC", "A", 25.0),
    )


def test_share(fact, dicts):
    got = dicts(cv.unmapped_share(fact, ["Key_M", "lob"], "premium"))
    assert [g["status"] for g in got] == ["WARNING", "PASS"]
    assert (got[0]["n_unmapped"], got[0]["unmapped_measure"]) == (3, 100.0)
    assert (got[0]["pct"], got[0]["total_measure"]) == (50.0, 200.0)


def test_original_rows_are_counted_through_the_aggregate(frame, dicts):
    df = frame("Key_M string, premium double, n_rows bigint", (None, 5.0, 7), ("a", 1.0, 2))
    got = dicts(cv.unmapped_share(df, ["Key_M"], "premium", "n_rows"))[0]
    assert (got["n_unmapped"], got["n_rows"]) == (1, 7)


def test_unmapped_rows_without_positive_measure_pass(frame, dicts):
    df = frame("Key_M string, premium double", (None, -5.0), ("a", 5.0))
    got = dicts(cv.unmapped_share(df, ["Key_M"], "premium"))[0]
    assert (got["status"], got["n_unmapped"], got["pct"]) == ("PASS", 1, 0.0)


def test_breakdown(fact, dicts):
    rows = cv.unmapped_breakdown(fact, ["Key_M", "lob"], ["state", "lob"], "premium")
    got = dicts(rows.orderBy(rows.premium.desc(), "state"))
    assert [(g["column"], g["state"], g["lob"], g["premium"], g["pct"]) for g in got] == [
        ("Key_M", "NSW", "A", 50.0, 25.0),
        ("Key_M", "NSW", "B", 25.0, 12.5),
        ("Key_M", "VIC", "A", 25.0, 12.5),
    ]


def test_breakdown_keeps_groups_whose_measure_is_null(frame, dicts):
    df = frame("Key_M string, state string, premium double", (None, "X", None), ("a", "X", None))
    assert dicts(cv.unmapped_breakdown(df, ["Key_M"], ["state"], "premium")) == [
        {"column": "Key_M", "state": "X", "premium": 0.0, "pct": None}
    ]
