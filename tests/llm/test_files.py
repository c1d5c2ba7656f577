from pyspark.sql import functions as F

from tabcord.llm.token_files import file_order


def test_files_are_ordered_by_number(spark):
    n = 120_000
    name = F.format_string("part-%05d-5a0c-4c1f.c000.snappy.parquet", "id")
    files = spark.range(n).select("id", name.alias("file")).repartition(4)
    assert [r.id for r in files.orderBy(*file_order()).collect()] == list(range(n))


def test_pieces_of_a_part_follow_each_other(spark):
    names = [f"part-00007-x-c{i:03d}.snappy.parquet" for i in (0, 2, 999, 1000)]
    names.append("part-00011-x-c000.snappy.parquet")
    files = spark.createDataFrame([(f,) for f in reversed(names)], "file string")
    assert [r.file for r in files.orderBy(*file_order()).collect()] == names
