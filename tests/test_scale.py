"""Hot keys, lost broadcasts and other conditions of large data."""

import pytest
from pyspark.sql import functions as F

from tabcord.functions import durable
from tabcord.operators import compare, integrity, ranges, shaping, uniqueness


@pytest.fixture(scope="module")
def hot(spark):
    """A fact whose key 0 holds a third of all rows, in eight partitions."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)
    return spark.range(0, 60_000, 1, 8).select(
        key.cast("string").alias("k"), (F.col("id") % 7).alias("g"), F.lit(1.0).alias("m")
    )


def shuffled_records(spark, df):
    """Records each stage of the query wrote to a shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()
    quantiles = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def stages():
        found = store.stageList(none, False, False, quantiles, none)
        return {x.stageId(): x.shuffleWriteRecords() for x in map(found.apply, range(found.size()))}

    before = set(stages())
    df.collect()
    return [n for s, n in stages().items() if s not in before and n > 0]


def test_hot_keys_are_combined_before_the_shuffle(spark, hot):
    ref = hot.select("k").distinct().where("k <> '7'")
    census = integrity.key_census(hot, ref, ["k"], "m")
    assert max(shuffled_records(spark, census)) <= 8 * 50 + 50
    dups = uniqueness.duplicate_keys(hot, ["k"])
    assert max(shuffled_records(spark, dups)) <= 8 * 50
    parents = uniqueness.parent_violations(hot, ["k"], ["g"])
    assert max(shuffled_records(spark, parents)) <= 8 * 50  # a row per key value and task
    same = compare.diff(hot, hot)
    assert max(shuffled_records(spark, same)) <= 16 * 50 * 7


def test_a_long_sequence_of_one_key_sends_few_edges(spark):
    one = spark.range(0, 20_000, 1, 8).where("id % 100 <> 3").selectExpr("'x' as k", "id + 1 as p")
    got = ranges.sequence_check(one, "k", "p").collect()
    assert got[0]["n_gaps"] == 200 and got[0]["gaps"] == "4, 104, 204, 304, 404"
    written = sorted(shuffled_records(spark, ranges.sequence_check(one, "k", "p")))
    # only the marks themselves are many; the edges of the key are a handful per task
    assert [n for n in written[:-1] if n > 8 * 12] == []


def test_hot_key_results_are_whole(hot, dicts):
    ref = hot.sparkSession.range(1, 50).select(F.col("id").cast("string").alias("k"))
    got = dicts(integrity.unmatched_measure(hot, ref, ["k"], "m"))
    n = hot.where("k = '0'").count()
    assert [(r["k"], r["m"]) for r in got] == [("0", float(n))] and n > 20_000


@pytest.mark.parametrize("how", ["left", "outer"])
def test_split_join_of_a_hot_key_equals_the_plain_one(hot, how):
    names = hot.sparkSession.range(0, 60, 1, 3).select(
        F.col("id").cast("string").alias("k"), F.concat(F.lit("n"), "id").alias("name")
    )
    plain = shaping.natural_join(hot, names, how)
    split = shaping.natural_join(hot, names, how, split_hot_keys=True)
    assert compare.diff_summary(plain, split).first()["equal"]


def test_results_do_not_depend_on_broadcasts_or_adaptive_plans(spark, hot, dicts):
    ref = spark.range(0, 55).select(F.col("id").cast("string").alias("k"), F.lit(2).alias("w"))

    def results():
        joined = shaping.natural_join(hot, ref, "outer").groupBy("k").agg(F.count("m"), F.max("w"))
        rows = [
            dicts(integrity.integrity_summary(hot, ref, ["k"], "m")),
            dicts(ranges.sequence_check(hot, "k", "g", start=0, min_last=9)),
            dicts(joined),
        ]
        return [sorted(map(str, r)) for r in rows]

    want = results()
    for setting, value in (
        ("spark.sql.autoBroadcastJoinThreshold", "-1"),
        ("spark.sql.adaptive.enabled", "false"),
    ):
        old = spark.conf.get(setting)
        spark.conf.set(setting, value)
        try:
            assert results() == want
        finally:
            spark.conf.set(setting, old)


def test_intermediates_go_to_the_named_shared_folder(spark):
    folder = durable.work_dir(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir") + "/tabcord"
    assert durable.new_path(spark, "x") != durable.new_path(spark, "x")
