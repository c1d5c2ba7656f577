"""Whole runs: the golden table set, mutated copies, isolation and fatal errors."""

import json

import fixtures
import pytest
from pyspark.sql import functions as F

from tabcord.operators.compare import diff_summary
from tabcord.plans import checks, run
from tabcord.sources.tables import TableSet

CORE = ["section", "check", "table", "column", "status", "n_bad", "measure_bad", "pct", "detail"]


@pytest.fixture(scope="module")
def base(spark):
    return fixtures.tables(spark)


@pytest.fixture(scope="module")
def golden(base):
    return run.run_checks(TableSet.classify(base))


@pytest.fixture(scope="module")
def by_check(golden):
    return {(r["check"], r["table"], r["column"]): r.asDict() for r in golden.findings.collect()}


def test_registration_passes(by_check):
    assert {r["status"] for k, r in by_check.items() if k[0] == "key_registration"} == {"PASS"}


def test_forward_integrity(by_check):
    want = {
        "tbl_RateChange": ("FAIL", 2, 110000.0, 37.9),
        "tbl_RateChange_Pol": ("FAIL", 1, 60000.0, 20.7),
        "tbl_Trend": ("FAIL", 2, 110000.0, 37.9),
        "tbl_Patterns_Attr": ("PASS", 0, None, None),
        "tbl_Forecast_Adjustment": ("SKIP", None, None, None),
    }
    for t, w in want.items():
        r = by_check["forward_ri", t, None]
        pct = r["pct"] and round(r["pct"], 1)
        assert (r["status"], r["n_bad"], r["measure_bad"], pct) == w
    top = [json.loads(x) for x in by_check["forward_ri", "tbl_Trend", None]["evidence"]]
    assert [t["Key_Trend"] for t in top] == ["TR_A", "TR_MISS"]
    assert top[0]["Premium_%"] == 20.7 and top[1]["Premium_%"] == 17.2


def test_reverse_integrity(by_check):
    n = {t: by_check["reverse_ri", t, None]["n_bad"] for t in ("tbl_RateChange", "tbl_RateChange_Pol", "tbl_Trend")}
    assert n == {"tbl_RateChange": 2, "tbl_RateChange_Pol": 1, "tbl_Trend": 2}
    assert by_check["reverse_ri", "tbl_Trend", None]["status"] == "WARNING"


def test_uniqueness_and_parents(by_check):
    status = {t: r["status"] for (c, t, _), r in by_check.items() if c == "row_uniqueness"}
    assert status.pop("tbl_Forecast_Adjustment") == "SKIP" and set(status.values()) == {"PASS"}
    failing = {t for (c, t, _), r in by_check.items() if c == "parent_columns" and r["status"] == "FAIL"}
    assert failing == {"tbl_RateChange", "tbl_Trend"}
    assert json.loads(by_check["parent_columns", "tbl_Trend", None]["evidence"][0]) == {
        "key_col": "Key_Trend",
        "column": "Region",
    }
    r = by_check["mapping_uniqueness", "tbl_Key_Mapping", None]
    assert (r["status"], r["n_bad"], r["metrics"]["n_rows"]) == ("FAIL", 1, 2.0)
    assert json.loads(r["evidence"][0]) == {"Segment": "S2", "Region": "South", "LOB": "Motor"}


def test_value_ranges(by_check):
    rate = by_check["band_share", "tbl_RateChange", "RateChange"]
    assert (rate["status"], rate["metrics"]["pct_outside_05"]) == ("WARNING", 50.0)
    assert by_check["band_share", "tbl_RateChange_Pol", "RateChange"]["status"] == "FAIL"
    assert by_check["band_share", "tbl_Trend", "Trend_Value"]["pct"] == 25.0
    dev = [r for (c, _, _), r in by_check.items() if c == "exceed_share"]
    assert len(dev) == 4 and {(r["status"], r["pct"]) for r in dev} == {("FAIL", 40.0)}
    month = by_check["yyyymm", "tbl_DetailedData", "AsAt_Month"]
    assert (month["status"], month["n_bad"]) == ("FAIL", 1)
    seq = by_check["sequence", "tbl_Patterns_Large", "DevM"]
    assert (seq["status"], seq["n_bad"]) == ("FAIL", 3)
    reasons = {json.loads(e)["Key_Pattern_Large"]: json.loads(e)["reasons"] for e in seq["evidence"]}
    assert reasons["PL_B"] == "gaps at [2]; max DevM = 3 (< 120 required)"
    assert reasons["PL_C"] == "starts at 5 (expected 1); max DevM = 5 (< 120 required)"


def test_sections_and_metadata(golden):
    status = {r["section"]: r["status"] for r in golden.sections.collect()}
    assert status == {
        "check1": "PASS",
        "checks2_5": "FAIL",
        "check6": "FAIL",
        "check7": "FAIL",
        "check8": "SKIP",
    }
    m = golden.metadata.first()
    assert (m["status"], m["dataset_count"], m["warnings"], m["errors"]) == ("FAIL", 9, [], [])
    assert m["summary"] == "Overall: FAIL — 9 table(s) loaded." and m["runtime_ms"] >= 0


def test_aggregated_and_raw_facts_agree(spark, base, golden):
    raw, warnings = run.collect_findings(TableSet.classify(base))
    assert warnings == []
    core = lambda df: df.select(*CORE)
    assert diff_summary(core(raw), core(golden.findings)).first()["equal"]


def changed(name, tables):
    out = dict(tables)
    if name == "missing_tables":
        del out["tbl_Trend"]
    elif name == "bad_month":
        fact = out["tbl_DetailedData"]
        month = F.when(F.col("Segment") == "S1", 202513).when(F.col("Segment") == "S2", 202402)
        out["tbl_DetailedData"] = fact.withColumn("AsAt_Month", F.coalesce(month, "AsAt_Month"))
    elif name == "gap":
        p = out["tbl_Patterns_Attr"]
        out["tbl_Patterns_Attr"] = p.where("not (Key_Pattern_Attr = 'PA_A' and DevM = 2)")
    else:
        m = out["tbl_Key_Mapping"]
        out["tbl_Key_Mapping"] = m.unionByName(m.where("Segment = 'S1'"))
    return out


def check_of(tables, check):
    return {(r["table"], r["column"]): r.asDict() for r in check(TableSet.classify(tables)).collect()}


def test_scenarios(base):
    got = check_of(changed("missing_tables", base), checks.referential_integrity)
    assert ("tbl_Trend", None) not in got and ("tbl_RateChange", None) in got
    got = check_of(changed("bad_month", base), checks.value_ranges)
    assert got["tbl_DetailedData", "AsAt_Month"]["n_bad"] == 2
    got = check_of(changed("gap", base), checks.value_ranges)
    first = json.loads(got["tbl_Patterns_Attr", "DevM"]["evidence"][0])
    assert first["reasons"] == "gaps at [2, 3]; max DevM = 4 (< 120 required)"
    got = check_of(changed("mapping_duplicate", base), checks.mapping_uniqueness)
    assert got["tbl_Key_Mapping", None]["n_bad"] == 2


def small(frame, **more):
    fact = frame(
        "Key_Policy string, State string, Premium double, AsAt_Month int, Key_Modelling string",
        ("P1", "NSW", 100.0, 202501, "M1"),
        ("P2", "VIC", 200.0, 202501, "M2"),
    )
    mapping = frame("Key_Policy string, State string", ("P1", "NSW"), ("P2", "VIC"))
    rate = frame(
        "Key_Policy string, State string, RateChange double", ("P1", "NSW", 0.02), ("P2", "VIC", -0.01)
    )
    return {"tbl_DetailedData": fact, "tbl_Key_Mapping": mapping, "tbl_RateChange": rate, **more}


def test_clean_run_passes_and_writes(spark, frame, tmp_path):
    done = run.run_checks(TableSet.classify(small(frame)))
    assert {r["status"] for r in done.sections.collect()} == {"PASS"}
    assert done.metadata.first()["status"] == "PASS"
    done.write(str(tmp_path), "json")
    assert spark.read.json(f"{tmp_path}/findings").count() == done.findings.count()


def test_loader_notes_lift_the_run_to_warning(frame):
    done = run.guarded_run(
        frame("a int").sparkSession, lambda: (small(frame), ["x could not be opened"])
    )
    m = done.metadata.first()
    assert (m["status"], m["warnings"]) == ("WARNING", ["x could not be opened"])


def test_a_failing_check_is_isolated(frame):
    clash = frame("Key_Policy int, State string, RateChange double", (1, "NSW", 0.1))
    clash = clash.withColumn("Key_Policy", F.lit("2020-01-01").cast("date"))
    tables = TableSet.classify(small(frame, tbl_RateChange=clash))
    findings, warnings = run.collect_findings(tables)
    assert len(warnings) == 1 and warnings[0].startswith("Checks 2-3 degraded: key column")
    got = {r["check"]: r["status"] for r in findings.collect()}
    assert got["forward_ri"] == got["reverse_ri"] == "SKIP"
    assert got["band_share"] == "PASS" and got["key_coverage"] == "PASS"


def test_failures_inside_the_spark_job_are_isolated_too(frame):
    bad = frame("Key_Pattern_X string, DevM string", ("a", "one"))
    tables = TableSet.classify(small(frame, tbl_Patterns_Attr=bad))
    findings, warnings = run.collect_findings(tables)
    assert [w.split(" degraded")[0] for w in warnings] == ["Check 7"]
    assert "check7" in {r["section"] for r in findings.where("warning is not null").collect()}


@pytest.mark.parametrize(
    "load, error",
    [
        (lambda: ({}, []), "tbl_DetailedData not found — cannot run checks."),
        (lambda: 1 / 0, "Fatal setup error: division by zero"),
    ],
)
def test_fatal_setups_fail_the_run(spark, load, error):
    done = run.guarded_run(spark, load)
    m = done.metadata.first()
    assert (m["status"], m["errors"]) == ("FAIL", [error])
    assert done.sections.isEmpty() and done.findings.isEmpty()


def test_forecast_and_minimum_load_rules(frame):
    fact = frame(
        "Key_Modelling string, Region string, Key_Load string, Premium double",
        ("M1", "N", "L1", 10.0),
        (" ", "S", "L1", 30.0),
    )
    forecast = frame(
        "Key_Forecast string, Key_Modelling string, Region string, FPrem double",
        ("F1", "M1", "N", 1.0),
        ("F1", "M2", "N", 2.0),
        ("F1", "M3", "S", 4.0),
        ("F2", "M3", "N", 8.0),
    )
    load = frame(
        "Key_Load string, Region string, MinLoad_A string, MinLoad_B double",
        ("L1", "N", "1", 5.0),
        ("L1", "Q", "x", 1.0),
    )
    mapping = frame("Region string, Key_Modelling string, Other string", ("N", "M1", "o"))
    t = TableSet.classify(
        {
            "tbl_DetailedData": fact,
            "tbl_Key_Mapping": mapping,
            "tbl_Forecast": forecast,
            "tbl_Min_Large_Load": load,
        }
    )
    findings, warnings = run.collect_findings(t)
    assert warnings == []
    got = {(r["check"], r["table"], r["column"]): r.asDict() for r in findings.collect()}
    orphans = got["reverse_ri", "tbl_Forecast", None]
    assert (orphans["n_bad"], orphans["measure_bad"]) == (3, 14.0)
    assert json.loads(orphans["evidence"][0]) == {"Key_Modelling": "M3", "Region": "N", "FPrem": 8.0}
    assert got["reverse_ri", "tbl_Min_Large_Load", None]["measure_bad"] is None
    assert got["parent_columns", "tbl_Forecast", None]["n_bad"] == 1
    assert got["parent_columns", "tbl_Min_Large_Load", None]["n_bad"] == 1
    domain = got["domain_membership", "tbl_Min_Large_Load", "Region"]
    assert (domain["status"], domain["evidence"]) == ("FAIL", ["Q"])
    assert got["numeric_share", "tbl_Min_Large_Load", "MinLoad_A"]["status"] == "FAIL"
    assert got["numeric_share", "tbl_Min_Large_Load", "MinLoad_B"]["status"] == "WARNING"
    cover = got["key_coverage", None, "Key_Modelling"]
    assert cover["detail"] == "1 unmapped rows — 30 premium (75.0% of total)"
    assert [json.loads(e) for e in cover["evidence"]] == [
        {"Region": "S", "Premium": 30.0, "Premium_%": 75.0}
    ]


def test_details_hold_every_row_behind_the_findings(spark, frame):
    many = [(f"P{i:03}", "NSW", 1.0, 202500 + i % 14, None) for i in range(60)]
    fact = frame(
        "Key_Policy string, State string, Premium double, AsAt_Month int, Key_Modelling string", *many
    )
    tables = {**small(frame), "tbl_DetailedData": fact}
    ref = [(f"Q{i:03}", "NSW", 0.1) for i in range(50)] * 2
    tables["tbl_RateChange"] = frame("Key_Policy string, State string, RateChange double", *ref)
    done = run.run_checks(TableSet.classify(tables), evidence_rows=3)
    held = {r["check"]: r["n"] for r in done.details.groupBy("check").agg(F.count("*").alias("n")).collect()}
    bad = {r["check"]: r for r in done.findings.where("n_bad > 0").collect()}
    for check, n in {"forward_ri": 60, "reverse_ri": 50, "row_uniqueness": 50}.items():
        assert held[check] == bad[check]["n_bad"] == n
    assert (held["yyyymm"], bad["yyyymm"]["n_bad"]) == (14, 2)  # all months of the failing column
    assert len(bad["reverse_ri"]["evidence"]) == 3
    month = bad["yyyymm"]
    assert month["evidence"][:2] == ["202500", "202513"] and len(month["evidence"]) == 5
    assert month["detail"].startswith("2 value(s) not in valid YYYYMM format: [202500, 202513")


def test_records_combine_the_checks_of_a_table(golden):
    got = {r["check_id"]: r for r in golden.records.collect()}
    trend = got["checks2_5.tbl_Trend"]
    assert trend["label"] == "RI / Uniqueness / Parent columns — tbl_Trend"
    assert (trend["status"], trend["summary"]) == (
        "FAIL",
        "Forward RI: 2 unmatched combination(s); Reverse RI: 2 orphaned combination(s); "
        "Parent cols: 1 failing",
    )
    assert got["checks2_5.tbl_Patterns_Attr"]["summary"] == "All checks passed."
    assert got["check7.tbl_Trend.Trend_Value"]["label"] == "Value range — tbl_Trend / Trend_Value"
    assert "check1.tbl_RateChange" in got and "check6.tbl_Key_Mapping" in got
    times = {r["label"]: r["ms"] for r in golden.timings.collect()}
    assert set(times) == set(checks.CHECKS) and min(times.values()) >= 0


def test_numeric_keys_and_missing_measures_agree_in_both_modes(frame):
    fact = frame(
        "Key_A bigint, State string, Premium double",
        (1, "N", 75.0),
        (2, "S", 25.0),
        (2, "S", float("nan")),
        (3, "S", None),
    )
    ref = frame("Key_A bigint, State string", (1, "N"))
    tables = TableSet.classify({"tbl_DetailedData": fact, "tbl_X": ref})
    raw, plain = (run.run_checks(tables, aggregate=a).findings for a in (True, False))
    assert diff_summary(raw.select(*CORE), plain.select(*CORE)).first()["equal"]
    got = {r["check"]: r for r in raw.collect()}
    assert got["key_registration"]["status"] == "PASS"
    assert (got["forward_ri"]["measure_bad"], got["forward_ri"]["pct"]) == (25.0, 25.0)


def test_a_type_clash_leaves_out_its_table_only(frame):
    clash = frame("Key_Policy date, RateChange double")
    tables = small(frame, tbl_RateChange_Pol=clash)
    findings, warnings = run.collect_findings(TableSet.classify(tables))
    got = {r["table"]: r["status"] for r in findings.where("check = 'forward_ri'").collect()}
    assert got == {"tbl_RateChange": "PASS", "tbl_RateChange_Pol": "SKIP"}
    assert len(warnings) == 1 and warnings[0].startswith("Checks 2-3 degraded: key column")


def test_a_run_leaves_no_intermediates(spark, frame, tmp_path):
    run.run_checks(TableSet.classify(small(frame)), path=str(tmp_path / "run"))
    assert sorted(p.name for p in (tmp_path / "run").iterdir()) == ["details", "findings", "sections"]
    with pytest.raises(Exception):
        run.run_checks(TableSet.classify(small(frame)), path=str(tmp_path / "bad"), checks=["x"])
    assert not (tmp_path / "bad" / "scratch").exists()


def test_data_columns_may_be_named_like_result_columns(frame):
    ddl = "n_rows string, measure string, column string, key string, `a.b` string"
    names = ["n_rows", "measure", "column", "key", "a.b"]
    fact = frame(
        f"{ddl}, Key_Modelling string, Key_A string, Premium double",
        ("r", "m", "c", "k", "d", None, "A", 5.0),
        ("r", "m", "c", "k2", "d", "M", "A", 5.0),
    )
    ref = frame(f"{ddl}, Key_A string", *[("r", "m", "c", "z", "d", "A")] * 2)
    tables = {"tbl_DetailedData": fact, "tbl_Key_Mapping": ref, "tbl_Odd": ref}
    findings, warnings = run.collect_findings(TableSet.classify(tables))
    assert warnings == []
    got = {r["check"]: r.asDict() for r in findings.where("table = 'tbl_Odd'").collect()}
    assert [got[c]["n_bad"] for c in ("forward_ri", "reverse_ri", "row_uniqueness")] == [2, 1, 1]
    assert list(json.loads(got["forward_ri"]["evidence"][0]))[:5] == names
    assert json.loads(got["row_uniqueness"]["evidence"][0])["key"] == "z"
    assert json.loads(got["parent_columns"]["evidence"][0])["column"] == "key"
    cover = findings.where("check = 'key_coverage'").first()
    assert json.loads(cover["evidence"][0])["a.b"] == "d"


def test_details_name_months_and_the_values_behind_failing_parents(frame):
    months = [(f"P{i}", "NSW", 10.0, 202501 + i) for i in range(9)]
    rows = [*months, ("P1", "VIC", 1.0, 202501), ("P1", "VIC", 1.0, 202501), ("P2", None, 1.0, 202501)]
    tables = small(frame)
    tables["tbl_DetailedData"] = frame(
        "Key_Policy string, State string, Premium double, AsAt_Month int", *rows
    )
    for aggregate in (True, False):
        done = run.run_checks(
            TableSet.classify(tables), aggregate=aggregate, checks=["Check 5", "Check 7"]
        )
        held = done.details.collect()
        assert sorted(r["record"] for r in held if r["check"] == "yyyymm") == [
            str(202501 + i) for i in range(9)
        ]
        conflicts = [(json.loads(r["record"]), r["n_rows"], r["table"]) for r in held if r["check"] == "parent_columns"]
        assert {(c["key_value"], c["value"], n, c["is_majority"], c["n_remove"], t) for c, n, t in conflicts} == {
            ("P1", "NSW", 1, False, 1, "tbl_RateChange"),
            ("P1", "VIC", 2, True, 1, "tbl_RateChange"),
        }
