"""Every registered query: its plan, and its result against the SQL in DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from workload.bindings import SCHEMAS, TABLES
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = list(QUERIES)
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables not present")

FORBIDDEN = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "Scan ExistingRDD",
)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.fixture
def uncached(spark):
    """Plans are looked at as they are, whatever an earlier test keeps in memory."""
    spark.catalog.clearCache()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(entry.oracle_sql()) >= set(NAMES) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    plan = plan_of(df)
    assert not [f for f in FORBIDDEN if f in plan]
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(entry.oracle_sql()[name])
    assert got == canonical([d[0] for d in res.description], res.fetchall())


@needs_data
def test_declared_schemas_match_the_files(spark):
    for name in TABLES:
        found = spark.read.parquet(f"{SF}/{name}.parquet").dtypes
        assert found == spark.read.schema(SCHEMAS[name]).parquet(f"{SF}/{name}.parquet").dtypes
        assert ", ".join(f"{c} {t}" for c, t in found) == SCHEMAS[name]


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["doc_id", "n_chars", "pct"]


def physical(spark, df):
    """The plan as planned, with broadcasts off as for tables beyond their limit."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan_of(df.select("*"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@needs_data
def test_forward_integrity_needs_one_grouping_and_shares_it(spark, uncached):
    df = entry.queries()["forward_ri_top10"](spark, SF)
    df.collect()
    final = plan_of(df).split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 1
    assert "TakeOrderedAndProject" in final


@needs_data
def test_scans_read_only_what_they_need(spark, uncached):
    plan = plan_of(entry.queries()["forward_ri_keys"](spark, SF))
    assert plan.count("ReadSchema: struct<doc_id:bigint>") == 2  # texts and lengths are pruned away


@needs_data
def test_large_sides_are_never_broadcast(spark, uncached):
    plan = physical(spark, entry.queries()["preaggregate"](spark, SF))
    assert plan.count("SortMergeJoin") >= 3
    assert plan.count("BroadcastHashJoin") <= 1  # the 25 nations


@needs_data
def test_top_rows_per_group_are_cut_before_the_shuffle(spark, uncached):
    plan = plan_of(entry.queries()["sequence_check"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan
