"""Scenarios in one plan against a run over each scenario's own tables."""

import fixtures
import pytest
from pyspark.sql import functions as F

from tabcord.plans import run
from tabcord.plans.scenarios import OUTCOME, Scenario, _Matrix, scenario_matrix
from tabcord.sources.tables import TableSet

CORE = ("section", "check", "table", "column", "status", "n_bad")


@pytest.fixture(scope="module")
def base(spark):
    tables = fixtures.tables(spark)
    fact = tables["tbl_DetailedData"]
    blank = F.when(F.col("Segment") != "S3", F.col("Segment"))
    tables["tbl_DetailedData"] = fact.withColumn("Key_Modelling", blank)
    tables["tbl_Forecast"] = spark.createDataFrame(
        [("F1", "S1", "North", 1.0), ("F1", "S9", "South", 2.0), ("F2", "S4", "West", 3.0)],
        "Key_Forecast string, Key_Modelling string, Region string, FPrem double",
    )
    tables["tbl_Min_Large_Load"] = spark.createDataFrame(
        [("RC_A", "North", "1", 5.0), ("RC_A", "Moon", "x", 1.0)],
        "Key_RateChange string, Region string, MinLoad_A string, MinLoad_B double",
    )
    return tables


def scenarios_of(tables):
    fact, pattern = tables["tbl_DetailedData"], tables["tbl_Patterns_Attr"]
    rate, mapping = tables["tbl_RateChange"], tables["tbl_Key_Mapping"]
    month = F.when(F.col("Segment") == "S1", 202513).when(F.col("Segment") == "S2", 202402)
    moved = fact.where("Segment IN ('S1', 'S2')")
    s3, load = fact.where("Segment = 'S3'"), tables["tbl_Min_Large_Load"]
    return [
        Scenario("baseline"),
        Scenario("absent", dropped=frozenset({"tbl_Trend", "tbl_Forecast"})),
        Scenario("no mapping", dropped=frozenset({"tbl_Key_Mapping"})),
        Scenario(
            "months",
            {"tbl_DetailedData": moved.withColumn("AsAt_Month", month)},
            {"tbl_DetailedData": moved},
        ),
        Scenario("gap", removed={"tbl_Patterns_Attr": pattern.where("DevM = 2").limit(1)}),
        Scenario("twice", {"tbl_Key_Mapping": mapping.where("Segment = 'S1'")}),
        Scenario(
            "rates",
            {"tbl_RateChange": rate.withColumn("RateChange", F.lit(9.0)).unionAll(rate)},
            {"tbl_Patterns_Prem": tables["tbl_Patterns_Prem"]},
        ),
        Scenario(
            "fact",
            {"tbl_DetailedData": s3.withColumn("Region", F.lit("Moon")).unionAll(s3)},
            {"tbl_Min_Large_Load": load.where("Region = 'North'"), "tbl_RateChange": rate.where("RateChange < 0")},
        ),
        Scenario("one month", removed={"tbl_DetailedData": fact.where("AsAt_Month = 202613")}),
        Scenario("no rows", removed={"tbl_DetailedData": fact, "tbl_RateChange": rate}),
    ]


def own_tables(tables, scenario):
    out = {n: df for n, df in tables.items() if n not in scenario.dropped}
    for name, rows in scenario.removed.items():
        out[name] = out[name].exceptAll(rows)
    for name, rows in scenario.added.items():
        out[name] = out[name].unionByName(rows)
    return out


def rows(df):
    return sorted(map(repr, (tuple(r[c] for c in CORE) for r in df.collect())))


def test_the_matrix_equals_separate_runs(base):
    scenarios = scenarios_of(base)
    found = scenario_matrix(TableSet.classify(base), scenarios)
    got = {}
    for r in found.collect():
        got.setdefault(r["scenario"], []).append(repr(tuple(r[c] for c in CORE)))
    assert set(got) == {s.name for s in scenarios}
    for s in scenarios:
        want = rows(run.run_checks(TableSet.classify(own_tables(base, s))).findings)
        assert sorted(got[s.name]) == want, s.name
    assert len({tuple(sorted(v)) for v in got.values()}) >= 7


def test_the_fact_is_read_once(spark, base, tmp_path):
    place = f"{tmp_path}/fact"
    base["tbl_DetailedData"].write.parquet(place)
    tables = {**base, "tbl_DetailedData": spark.read.parquet(place)}
    matrix = _Matrix(TableSet.classify(tables), scenarios_of(base))
    for check in matrix.checks():
        for part in check():
            assert place not in part._jdf.queryExecution().executedPlan().toString()


def test_odd_scenarios(base):
    tables = TableSet.classify(base)
    empty = scenario_matrix(tables, [])
    assert empty.collect() == [] and len(empty.columns) == len(OUTCOME.split(","))
    with pytest.raises(ValueError, match="one name"):
        scenario_matrix(tables, [Scenario("a"), Scenario("a")])
    with pytest.raises(ValueError, match="fact"):
        scenario_matrix(tables, [Scenario("a", dropped=frozenset({"tbl_DetailedData"}))])
