import pytest
from pyspark.sql import functions as F

from tabcord.functions.columns import local_rows
from tabcord.plans import findings as fnd


def rows(spark, *statuses, section="check1", check="c", **extra):
    return fnd.stated(
        spark,
        [
            {"section": section, "check": check, "table": f"t{i}", "status": s, **extra}
            for i, s in enumerate(statuses)
        ],
    )


@pytest.mark.parametrize(
    "statuses, app, notebook",
    [
        (["PASS", "WARNING", "FAIL"], "FAIL", "FAIL"),
        (["PASS", "SKIP", "WARNING"], "WARNING", "WARNING"),
        (["PASS", "SKIP"], "PASS", "PASS"),
        (["SKIP", "SKIP"], "SKIP", "PASS"),
        (["SKIP", "odd"], "SKIP", "PASS"),
        ([], "SKIP", "PASS"),
    ],
)
def test_precedence(spark, statuses, app, notebook):
    df = local_rows(spark, [(s,) for s in statuses], "status string")
    assert df.agg(fnd.worst(F.col("status")).alias("s")).first()["s"] == app
    assert fnd.overall_status(df).first()["status"] == notebook


def test_tables_combine_their_checks(spark, dicts):
    df = fnd.stated(
        spark,
        [
            {"section": "checks2_5", "check": c, "table": t, "status": s}
            for t, c, s in [
                ("a", "forward_ri", "PASS"),
                ("a", "reverse_ri", "WARNING"),
                ("a", "row_uniqueness", "PASS"),
                ("b", "forward_ri", "SKIP"),
                ("b", "row_uniqueness", "SKIP"),
                ("b", "parent_columns", "PASS"),
            ]
        ],
    )
    got = {r["table"]: r["status"] for r in dicts(fnd.table_rollup(df))}
    assert got == {"a": "WARNING", "b": "PASS"}


def test_sections(spark, dicts):
    df = (
        rows(spark, "PASS", "PASS", "FAIL")
        .unionByName(rows(spark, "WARNING", "FAIL", "PASS", section="check7"))
        .unionByName(rows(spark, "SKIP", section="check6", detail="tbl_Key_Mapping not loaded"))
        .unionByName(rows(spark, "SKIP", section="check8", check=fnd.DEGRADED, warning="Check 8 degraded: x"))
    )
    got = {r["section"]: r for r in dicts(fnd.section_rollup(df))}
    assert len(got) == 5
    assert got["check1"]["summary"] == "3 table(s) checked: 1 FAIL, 2 PASS."
    assert got["check7"]["summary"] == "3 column check(s) performed: 1 FAIL, 1 WARNING, 1 PASS."
    assert (got["check6"]["status"], got["check6"]["summary"]) == ("SKIP", "tbl_Key_Mapping not loaded")
    assert (got["checks2_5"]["status"], got["checks2_5"]["summary"]) == ("SKIP", "0 table(s) checked.")
    assert (got["check8"]["status"], got["check8"]["warnings"]) == ("WARNING", ["Check 8 degraded: x"])
    assert got["check8"]["n_checks"] == 0


def test_run_rollup_and_warnings(spark):
    status = lambda s, n=0: fnd.run_rollup(
        local_rows(spark, [(x,) for x in s], "status string"), n
    ).first()["status"]
    assert status(["PASS", "SKIP"]) == "PASS"
    assert status(["PASS", "SKIP"], 1) == "WARNING"
    assert status(["SKIP"], 2) == "WARNING"
    assert status(["FAIL"], 1) == "FAIL"
