"""Types of CSV tables from all their cells."""

import datetime
from decimal import Decimal

import fixtures
import pytest
from pyspark.sql import functions as F

from tabcord.plans import run
from tabcord.sources import inference as inf
from tabcord.sources.tables import TableSet, csv_tables

CORE = ["section", "check", "table", "column", "status", "n_bad", "measure_bad", "pct", "detail"]


@pytest.mark.parametrize(
    "cells, plain, rich",
    [
        (["1", "-2", "+3", " 4 "], "bigint", "bigint"),
        (["1", None, "", "NA"], "bigint", "bigint"),
        (["1", "2.5"], "double", "decimal(2,1)"),
        (["1", "0.125", "-17.5"], "double", "decimal(5,3)"),
        (["007", "1"], "bigint", "bigint"),
        (["12345678901234567890", "1"], "double", "decimal(20,0)"),
        (["1e3", "2"], "double", "double"),
        (["inf", "2"], "double", "double"),
        (["9" * 30 + "." + "9" * 20], "double", "double"),
        (["true", "False"], "boolean", "boolean"),
        (["true", "1"], "string", "string"),
        (["1", "x"], "string", "string"),
        (["2024-02-29", "2023-01-01"], "string", "date"),
        (["2024-02-30"], "string", "string"),
        (["2024-02-29", "2023-01-01 10:20:30.5"], "string", "timestamp_ntz"),
        (["2023-01-01T10:20"], "string", "timestamp_ntz"),
        (["2024-02-29", "12"], "string", "string"),
        ([None, "", "null"], "double", "double"),
        (["1d"], "string", "string"),
    ],
)
def test_types_of_cells(frame, cells, plain, rich):
    raw = frame("c string", *[(c,) for c in cells])
    kinds = [
        inf.infer_schemas({"t": raw}, decimals=d, dates=d)["t"]["c"].dataType.simpleString()
        for d in (False, True)
    ]
    assert kinds == [plain, rich]
    for d in (False, True):
        schema = inf.infer_schemas({"t": raw}, decimals=d, dates=d)["t"]
        assert inf.typed(raw, schema).count() == len(cells)


def test_tables_are_examined_together(spark, frame):
    raws = {f"t{i}": frame("a string, `b c` string", (str(i), "x"), ("2", None)) for i in range(4)}
    spark.sparkContext.setJobGroup("infer", "")
    found = inf.infer_schemas(raws)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("infer")
    spark.sparkContext.setJobGroup("other", "")
    assert len(jobs) <= len(raws) + 1  # a partial aggregate of each, and one result
    assert {s.simpleString() for s in found.values()} == {"struct<a:bigint,b c:string>"}


def test_a_late_cell_decides(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.when(F.col("id") == 19_999, "n/q").otherwise(F.col("id").cast("string")).alias("a"),
        (F.col("id") / 8).alias("b"),
    )
    rows.repartition(5).write.option("header", True).csv(f"{tmp_path}/t.csv")
    df = inf.open_inferred(spark, {"t": f"{tmp_path}/t.csv"}, decimals=True)["t"]
    assert df.dtypes == [("a", "string"), ("b", "decimal(7,3)")]
    assert df.agg(F.sum("b")).first()[0] == sum(Decimal(i) / 8 for i in range(20_000))


def test_quotes_missing_values_and_odd_files(spark, tmp_path):
    text = 'a,b,c\n"x, ""y""",NA,2024-01-31\n"", 7 ,\n'
    (tmp_path / "t.csv").write_text(text)
    (tmp_path / "none.csv").write_text("a,b\n")
    paths = {n: f"{tmp_path}/{n}.csv" for n in ("t", "none")}
    found = inf.open_inferred(spark, paths, dates=True)
    assert [tuple(r) for r in found["t"].collect()] == [
        ('x, "y"', None, datetime.date(2024, 1, 31)),
        (None, 7, None),
    ]
    assert found["none"].dtypes == [("a", "double"), ("b", "double")]
    assert found["none"].count() == 0


def test_a_run_over_undeclared_tables_equals_one_over_declared_ones(spark, tmp_path):
    tables = fixtures.tables(spark)
    for name, df in tables.items():
        df.coalesce(1).write.option("header", True).csv(f"{tmp_path}/{name}.csv")
    found, notes = csv_tables(spark, str(tmp_path))
    assert set(found) == set(tables) and notes == []
    rows = lambda t: sorted(map(repr, run.run_checks(TableSet.classify(t)).findings.select(*CORE).collect()))
    assert rows(found) == rows(tables)
