"""Sums kept beside a folder of files follow its changes without reading the rest."""

import os
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabcord.sources import kept
from tabcord.sources.tables import preaggregate
from workload import growing

SCHEMA = "k string, j int, m decimal(10,2)"


def write(spark, place, *rows, mode="overwrite"):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode(mode).parquet(place)


def rebuilt(spark, folder):
    rows = spark.read.parquet(folder)
    sums = preaggregate(rows, ["k", "j"], "m", "n_rows")
    return sorted((r.k, r.j, r.m, r.n_rows) for r in sums.collect())


def found(df):
    return sorted((r.k, r.j, r.m, r.n_rows) for r in df.collect())


D = Decimal


@pytest.fixture
def fact(spark, tmp_path):
    folder = f"{tmp_path}/a fact"
    write(spark, f"{folder}/day=1", ("a", 1, D("1.10")), ("a", 1, D("2.00")), ("b", 1, None))
    write(spark, f"{folder}/day=2", ("a", 1, D("5.00")), ("c", 2, D("7.25")))
    write(spark, f"{folder}/day=3", ("c", 2, D("0.75")), ("d", 3, D("9.00")))
    return folder


def kept_sums(spark, fact, tmp_path, **options):
    return kept.KeptAggregate(spark, fact, f"{tmp_path}/kept", ["k", "j"], "m", **options)


def test_refresh_equals_a_rebuild_and_reads_changed_files_only(spark, fact, tmp_path):
    sums = kept_sums(spark, fact, tmp_path)
    assert not sums.is_current()
    assert found(sums.refresh()) == rebuilt(spark, fact)
    assert len(sums.last_read) == 3 and sums.is_current()
    assert found(sums.refresh()) == rebuilt(spark, fact) and sums.last_read == []
    assert sums.generation() == 1

    write(spark, f"{fact}/day=4", ("a", 1, D("-3.00")), ("e", 5, D("1.00")))  # added
    write(spark, f"{fact}/day=2", ("c", 2, D("70.00")))  # changed
    kept.remove(spark, f"{fact}/day=3")  # removed
    assert not sums.is_current()
    assert found(sums.refresh()) == rebuilt(spark, fact)
    assert sorted(f.split("/")[-2] for f in sums.last_read) == ["day=2", "day=4"]
    assert {r[0] for r in found(sums.result())} == {"a", "b", "c", "e"}  # d went with its file

    # another process goes on from what is kept
    again = kept_sums(spark, fact, tmp_path)
    write(spark, f"{fact}/day=1", ("z", 9, D("4.00")), mode="append")
    assert found(again.refresh()) == rebuilt(spark, fact)
    assert len(again.last_read) == 1
    for day in (1, 2, 4):
        kept.remove(spark, f"{fact}/day={day}")
    assert found(again.refresh()) == []
    assert not os.path.exists(f"{tmp_path}/kept/parts/00000001")


def test_a_file_that_changes_while_it_is_read_is_read_again(spark, fact, tmp_path):
    turns = []

    def read(session, folder, files):
        turns.append(len(files))
        if len(turns) == 1:
            time.sleep(1.1)
            write(session, f"{fact}/day=2", ("x", 1, D("1.00")))
            files = [f for f in files if "day=2" not in f]
        return kept.parquet_files(session, folder, files)

    sums = kept_sums(spark, fact, tmp_path, read=read)
    assert found(sums.refresh()) == rebuilt(spark, fact) and len(turns) == 2

    def never(session, folder, files):
        write(session, f"{fact}/day={len(turns) + 9}", ("x", 1, D("1.00")))
        turns.append(0)
        return kept.parquet_files(session, folder, files)

    write(spark, f"{fact}/day=5", ("y", 1, D("1.00")))
    sums.read = never
    with pytest.raises(kept.FilesKeepChanging):
        sums.refresh()
    sums.read = kept.parquet_files
    assert sums.generation() == 1  # the failed refresh left no ledger
    assert found(sums.refresh()) == rebuilt(spark, fact)


def test_floating_measures_need_a_decimal(spark, tmp_path):
    folder = f"{tmp_path}/f"
    rows = spark.range(50).select(
        (F.col("id") % 3).cast("string").alias("k"),
        F.lit(1).alias("j"),
        F.when(F.col("id") != 4, F.col("id") / 10).otherwise(float("nan")).alias("m"),
    )
    rows.repartition(4).write.parquet(folder)
    with pytest.raises(ValueError, match="decimal"):
        kept_sums(spark, folder, tmp_path).refresh()
    sums = kept_sums(spark, folder, tmp_path, exact="decimal(20,2)")
    want = preaggregate(rows, ["k", "j"], "m", "n_rows", exact="decimal(20,2)")
    assert found(sums.refresh()) == found(want)


def test_a_folder_without_files(spark, tmp_path):
    sums = kept_sums(spark, f"{tmp_path}/nothing", tmp_path)
    assert sums.is_current()
    with pytest.raises(LookupError):
        sums.refresh()


def test_many_tasks_write_a_bucket_of_the_fact(spark, tmp_path):
    rows = spark.range(800).selectExpr(
        "id * 8 + IF(id < 40, 1, 0) AS l_orderkey",
        "'A' AS l_returnflag",
        "'F' AS l_linestatus",
        "DATE'1995-06-01' AS l_shipdate",
        "CAST(id AS DOUBLE) AS l_extendedprice",
    )
    rows.repartition(8).write.parquet(f"{tmp_path}/sf/lineitem.parquet")
    folder = f"{tmp_path}/fact"
    for factor in (1, 2):  # written again, a bucket has only its new rows
        growing._fact_folder(spark, f"{tmp_path}/sf", folder, factor, [0, 1])
        fact = spark.read.parquet(folder)
        got = fact.groupBy("bucket").agg(F.count("*"), F.sum("price")).collect()
        assert sorted(map(tuple, got)) == [
            (0, 760, 100 * factor * sum(range(40, 800))),
            (1, 40, 100 * factor * sum(range(40))),
        ]
        assert fact.where("bucket = 0").select(F.input_file_name()).distinct().count() > 1
