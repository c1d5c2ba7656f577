"""Runs that take over what is unchanged."""

import fixtures
import pytest
from pyspark.sql import functions as F

from tabcord.plans import checks, resume, run
from tabcord.sources.tables import TableSet

CORE = ["section", "check", "table", "column", "status", "n_bad", "measure_bad", "pct", "detail"]


@pytest.fixture(scope="module")
def base(spark):
    return fixtures.tables(spark)


def rows(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


@pytest.fixture
def calls(monkeypatch):
    """The labels of the checks that really run."""
    made = []
    for label, (section, names, function) in checks.CHECKS.items():

        def counted(tables, report, label=label, function=function):
            made.append(label)
            return function(tables, report)

        monkeypatch.setitem(checks.CHECKS, label, (section, names, counted))
    return made


def test_a_rerun_repeats_only_what_changed(spark, base, calls, tmp_path):
    path = str(tmp_path)
    once = resume.resumed_run(TableSet.classify(base), path)
    plain = run.run_checks(TableSet.classify(base))
    assert rows(once.findings, *CORE) == rows(plain.findings, *CORE)
    assert rows(once.details, "check", "table", "record") == rows(plain.details, "check", "table", "record")
    calls.clear()

    moved = {n: df.repartition(3) for n, df in base.items()}  # the same rows in another order
    again = resume.resumed_run(TableSet.classify(moved), path)
    assert calls == []
    assert rows(again.findings, *CORE) == rows(plain.findings, *CORE)
    assert rows(again.sections, "section", "status", "summary") == rows(plain.sections, "section", "status", "summary")
    assert rows(again.details, "check", "record") == rows(plain.details, "check", "record")
    assert {r["ms"] for r in again.timings.collect()} == {0}

    mapping = base["tbl_Key_Mapping"]
    changed = {**base, "tbl_Key_Mapping": mapping.unionByName(mapping.where("Segment = 'S1'"))}
    third = resume.resumed_run(TableSet.classify(changed), path)
    assert calls == ["Check 6"]
    assert rows(third.findings, *CORE) == rows(run.run_checks(TableSet.classify(changed)).findings, *CORE)
    calls.clear()

    trend = {**base, "tbl_Trend": base["tbl_Trend"].withColumn("Trend_Value", F.lit(0.9))}
    resume.resumed_run(TableSet.classify(trend), path)
    assert sorted(calls) == ["Check 4", "Check 7", "Checks 2-3"]


def test_marks_replace_reading_and_options_count(spark, base, calls, tmp_path):
    path, tables = str(tmp_path), TableSet.classify(base)
    marks = {n: "v1" for n in base}
    resume.resumed_run(tables, path, marks, checks=["Check 4", "Check 6"])
    calls.clear()
    spark.sparkContext.setJobGroup("marks", "")
    done = resume.resumed_run(tables, path, marks, checks=["Check 4", "Check 6"])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("marks"))
    spark.sparkContext.setJobGroup("other", "")
    assert calls == [] and done.findings.count() > 0
    assert jobs <= 16  # the two stored results and the rollups; no table is read
    resume.resumed_run(tables, path, {**marks, "tbl_Trend": "v2"}, checks=["Check 4", "Check 6"])
    assert calls == ["Check 4"]
    calls.clear()
    resume.resumed_run(tables, path, marks, evidence_rows=2, checks=["Check 6"])
    assert calls == ["Check 6"]


def test_a_degraded_check_runs_again(base, monkeypatch, tmp_path):
    path, tables = str(tmp_path), TableSet.classify(base)
    section, names, function = checks.CHECKS["Check 4"]

    def fails(tables, report):
        raise RuntimeError("no memory")

    monkeypatch.setitem(checks.CHECKS, "Check 4", (section, names, fails))
    first = resume.resumed_run(tables, path, checks=["Check 4", "Check 6"])
    assert first.metadata.first()["warnings"] == ["Check 4 degraded: no memory"]
    monkeypatch.setitem(checks.CHECKS, "Check 4", (section, names, function))
    second = resume.resumed_run(tables, path, checks=["Check 4", "Check 6"])
    assert second.metadata.first()["warnings"] == []
    times = {r["label"]: r["ms"] for r in second.timings.collect()}
    assert times["Check 4"] > 0 and times["Check 6"] == 0


def test_fingerprints_tell_rows_not_their_order(frame):
    a = frame("k string, v double", ("x", 1.0), ("y", None), ("y", None))
    b = frame("k string, v double", ("x", 1.0), ("y", None))
    found = resume.fingerprints({"a": a, "again": a.repartition(3), "b": b, "none": a.limit(0)})
    assert found["a"] == found["again"] and len(set(found.values())) == 3
    assert resume.fingerprints({}) == {}


def test_the_payload_nests_run_sections_checks_and_findings(spark, base, tmp_path):
    done = run.run_checks(TableSet.classify(base))
    place = f"{tmp_path}/payload"
    payload = done.payload()
    payload.write.json(place)
    whole = spark.read.schema(payload.schema).json(place).collect()
    assert len(whole) == 1
    doc = whole[0].asDict(recursive=True)
    assert set(doc) == {"status", "summary", "metadata", "sections", "warnings", "errors"}
    assert doc["status"] == "FAIL" and doc["metadata"]["dataset_count"] == len(base)
    assert [s["section"] for s in doc["sections"]] == ["check1", "checks2_5", "check6", "check7", "check8"]
    held = [f for s in doc["sections"] for c in s["checks"] for f in c["findings"]]
    assert len(held) == done.findings.count()
    trend = next(c for s in doc["sections"] for c in s["checks"] if c["check_id"] == "checks2_5.tbl_Trend")
    assert [f["check"] for f in trend["findings"]] == ["forward_ri", "parent_columns", "reverse_ri", "row_uniqueness"]
    assert trend["status"] == "FAIL" and trend["findings"][0]["n_bad"] == 2
    assert doc["sections"][4]["checks"] == []
