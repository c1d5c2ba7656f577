"""Differences named down to the field, list position or map key."""

import pytest
from pyspark.sql import functions as F

from tabcord.operators.compare import nested_compare

SCHEMA = (
    "id int, s struct<a:int,b:string>, l array<struct<x:int,y:array<double>>>, m map<string,array<int>>"
)


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_paths_of_changes(frame):
    left = frame(
        SCHEMA,
        (1, (1, "u"), [(1, [0.1, None]), (2, [])], {"p": [1], "q": [2]}),
        (2, (1, "u"), [], {}),
        (3, None, None, None),
        (4, (4, None), [(1, None)], {"z": None}),
        (None, (0, "n"), [], {}),
    )
    right = frame(
        SCHEMA,
        (1, (1, "v"), [(1, [0.1 + 1e-13, 5.0])], {"q": [2, 3], "r": []}),
        (2, (1, "u"), [], {}),
        (3, (None, None), [], {}),
        (5, (9, "w"), None, None),
        (None, (0, "m"), [], {}),
    )
    got = nested_compare(left, right, ["id"])
    assert got.columns == ["id", "path", "left_value", "right_value", "change"]
    want = [
        (1, "s.b", "u", "v", "changed"),
        (1, "l[0].y[1]", None, "5.0", "changed"),
        (1, "l[1].x", "2", None, "left only"),
        (1, "l[1].y", "[]", None, "left only"),
        (1, "m{p}[0]", "1", None, "left only"),
        (1, "m{q}[1]", None, "3", "right only"),
        (1, "m{r}", None, "[]", "right only"),
        (3, "s", None, None, "left only"),
        (3, "s.a", None, None, "right only"),
        (3, "s.b", None, None, "right only"),
        (3, "l", None, "[]", "changed"),
        (3, "m", None, "{}", "changed"),
        (4, "s.a", "4", None, "left only"),
        (4, "s.b", None, None, "left only"),
        (4, "l[0].x", "1", None, "left only"),
        (4, "l[0].y", None, None, "left only"),
        (4, "m{z}", None, None, "left only"),
        (5, "s.a", None, "9", "right only"),
        (5, "s.b", None, "w", "right only"),
        (5, "l", None, None, "right only"),
        (5, "m", None, None, "right only"),
        (None, "s.b", "n", "m", "changed"),
    ]
    assert rows(got) == sorted(map(repr, want))
    assert nested_compare(left, left, ["id"]).collect() == []


def test_repeated_keys_are_paired_by_rank(frame):
    left = frame("k string, v int", ("a", 1), ("a", 2), ("a", 2))
    right = frame("v int, k string", (2, "a"), (1, "a"))
    got = nested_compare(left, right, ["k"]).collect()
    assert len(got) == 1 and got[0]["change"] in ("left only", "changed")
    assert nested_compare(left, left.repartition(3), ["k"]).collect() == []
    assert nested_compare(left.limit(0), left.limit(0), ["k"]).collect() == []
    with pytest.raises(ValueError, match="columns"):
        nested_compare(left, right.drop("v"), ["k"])


def test_findings_of_two_runs(spark):
    import fixtures

    from tabcord.plans import run
    from tabcord.sources.tables import TableSet

    base = fixtures.tables(spark)
    changed = dict(base)
    month = F.when(F.col("Segment") == "S1", 202402).otherwise(F.col("AsAt_Month"))
    changed["tbl_DetailedData"] = base["tbl_DetailedData"].withColumn("AsAt_Month", month)
    a, b = (run.run_checks(TableSet.classify(t), checks=["Check 7"]).findings for t in (base, changed))
    got = nested_compare(a, b, ["check", "table", "column"]).collect()
    assert {(r["table"], r["column"]) for r in got} == {("tbl_DetailedData", "AsAt_Month")}
    paths = {r["path"]: (r["left_value"], r["right_value"], r["change"]) for r in got}
    assert paths["metrics{n_distinct}"] == ("2.0", "3.0", "changed")
    assert paths["evidence[1]"] == ("202604", "202402", "changed")
    assert paths["evidence[2]"] == (None, "202604", "right only")
