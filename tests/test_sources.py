import pytest
from pyspark.sql import types as T

from tabcord.functions.durable import materialise, new_path
from tabcord.functions.evidence import collect_top, top_records
from tabcord.rules import roles
from tabcord.sources import tables as src


TYPES = {
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
}


def schema(text):
    pairs = [column.split(" ") for column in text.split(", ")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


FACT = schema(
    "AsAt_Month int, Premium double, Segment string, Region string, AY int, Key_A string, "
    "Key_Forecast string, Key_Modelling string, Active boolean"
)


def test_join_and_context_columns():
    ref = schema("Region string, AY int, Key_A string, Key_Forecast string, Active boolean, X string")
    assert roles.join_key(ref, FACT) == ["Region", "Key_A"]
    assert roles.join_key(schema("AY string, Key_A string"), FACT) == ["AY", "Key_A"]
    assert roles.display_cols(schema("AY string, Key_A string"), FACT) == ["Key_A"]
    assert roles.context_cols(ref, FACT) == ["Region"]
    assert roles.join_key(schema("Premium double"), FACT) == []


@pytest.mark.parametrize(
    "table, ddl, key",
    [
        ("tbl_Forecast", "Key_Forecast string, Key_Modelling string, v double", ["Key_Forecast", "v"]),
        ("tbl_Trend", "Key_A string, Trend_Period string, Trend_Value double", ["Key_A", "Trend_Period"]),
        ("tbl_Patterns_Attr", "Key_A string, DevM int, v double", ["Key_A", "DevM"]),
        ("tbl_Other", "Key_A string, DevM int, UWY int, AY int", ["Key_A", "AY", "UWY"]),
        ("tbl_Other", "v double", []),
    ],
)
def test_uniqueness_keys(table, ddl, key):
    assert roles.uniqueness_key(table, schema(ddl), FACT) == key


def test_other_roles():
    ref = schema("Key_X string, Total_Premium string, prem_a double, Prem_b double")
    assert roles.forecast_measure(ref, ["Key_X"]) == "prem_a"
    assert roles.forecast_measure(ref, ["Key_X", "prem_a", "Prem_b"]) is None
    assert roles.forecast_context(schema("Key_X string, AY string, Region string, v int")) == ["Region"]
    mapping = schema("Key_A string, Premium string, Region string, Elsewhere string")
    assert roles.identifier_cols(mapping, FACT) == ["Region"]
    assert roles.identifier_cols(None, FACT) == []
    assert roles.pattern_key(schema("Key_A string, Key_Pattern_X string")) == "Key_Pattern_X"
    assert roles.first_matching(["a", "b"], ["z", "b", "a"]) == "b"
    with pytest.raises(KeyError):
        roles.first_matching(["a"], ["z"])


def test_preaggregation_keys_and_schema():
    others = [schema("Region string, AY int"), schema("Key_A string, Premium double")]
    keys = roles.preaggregation_keys(FACT, others)
    assert keys == ["AsAt_Month", "Region", "Key_A", "Key_Modelling"]
    out = roles.preaggregated_schema(FACT, ["AsAt_Month", "Region"])
    assert [(f.name, f.dataType.simpleString()) for f in out] == [
        ("AsAt_Month", "int"),
        ("Region", "string"),
        ("Premium", "double"),
    ]
    bare = roles.preaggregated_schema(schema("Region string"), ["Region"])
    assert bare["Premium"].dataType == T.DoubleType()
    with pytest.raises(ValueError, match="Unknown_Col"):
        roles.preaggregated_schema(FACT, ["Unknown_Col"])


def test_preaggregate(frame, dicts):
    df = frame("k string, Premium double, x int", ("a", 1.0, 1), ("a", 2.0, 2), (None, float("nan"), 3))
    got = {r["k"]: (r["Premium"], r["n_rows"]) for r in dicts(src.preaggregate(df, ["k"], rows_as="n_rows"))}
    assert got == {"a": (3.0, 2), None: (None, 1)}
    assert src.preaggregate(df.drop("Premium"), ["k"]).columns == ["k"]


def test_load_skips_missing_and_notes_broken_tables(spark, frame):
    folder = new_path(spark, "tables")
    frame("a int", (1,)).write.parquet(f"{folder}/tbl_Trend.parquet")
    frame("a string", ("x",)).write.text(f"{folder}/tbl_Forecast.parquet")
    found, notes = src.load_tables(spark, directory=folder)
    assert list(found) == ["tbl_Trend"]
    assert len(notes) == 1 and notes[0].startswith("tbl_Forecast could not be opened")
    frame("a int", (1,)).createOrReplaceTempView("tbl_Trend")
    found, notes = src.load_tables(spark, ["tbl_Trend", "tbl_None"])
    assert list(found) == ["tbl_Trend"] and notes == []
    spark.catalog.dropTempView("tbl_Trend")


def test_csv_tables_have_declared_types(spark, frame, dicts):
    folder = new_path(spark, "csv")
    frame("k string, v double", ("a", 1.5), (None, None)).write.option("header", True).csv(
        f"{folder}/tbl_Trend.csv"
    )
    got = src.load_csv_tables(spark, folder, {"tbl_Trend": "k string, v double", "tbl_X": "k int"})
    assert list(got) == ["tbl_Trend"]
    assert sorted(dicts(got["tbl_Trend"]), key=str) == [{"k": "a", "v": 1.5}, {"k": None, "v": None}]


def test_csv_tables_are_found_by_listing(spark, frame):
    folder = new_path(spark, "csv")
    for name in ("tbl_Trend", "tbl_Odd", "other"):
        frame("k string", ("a",)).write.option("header", True).csv(f"{folder}/{name}.csv")
    declared = {"tbl_Trend": "k string", "tbl_Absent": "k string", "other": "k string"}
    found, notes = src.csv_tables(spark, folder, declared)
    assert list(found) == ["tbl_Trend"] and found["tbl_Trend"].count() == 1
    assert notes == ["tbl_Odd.csv has no declared schema"]
    assert src.csv_tables(spark, folder + "/none", declared) == ({}, [])


def test_exact_sums_do_not_depend_on_the_order_of_rows(frame):
    rows = [("a", 1e16), ("a", 1.0), ("a", -1e16)]
    for order in (rows, rows[::-1], [rows[0], rows[2], rows[1]]):
        df = frame("k string, Premium double", *order).coalesce(1)
        got = src.preaggregate(df, ["k"], exact="decimal(20,2)").first()
        assert float(got["Premium"]) == 1.0


def test_materialise_replaces_and_survives(spark, frame, dicts):
    path = new_path(spark, "agg")
    materialise(frame("a int", (1,)), "agg", path)
    back = materialise(frame("b int", (2,), (3,)), "agg", path)
    assert back.columns == ["b"] and back.count() == 2
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_preaggregated_rows_get_a_free_name(frame):
    fact = frame("n_rows string, Premium double", ("a", 1.0), ("a", 2.0))
    t = src.TableSet.classify({"tbl_DetailedData": fact, "tbl_X": frame("n_rows string")})
    got = src.preaggregated(t)
    assert got.rows == "n_rows_" and got.fact.first().asDict() == {
        "n_rows": "a",
        "Premium": 3.0,
        "n_rows_": 2,
    }


def test_classify(frame):
    d = {n: frame("a int") for n in ("tbl_DetailedData", "tbl_Key_Mapping", "tbl_Trend")}
    t = src.TableSet.classify(d)
    assert list(t.refs) == ["tbl_Trend"] and t.names()[0] == "tbl_DetailedData"
    with pytest.raises(LookupError):
        src.TableSet.classify({"tbl_Trend": d["tbl_Trend"]})


def test_evidence_is_bounded_per_group(spark, dicts):
    df = spark.range(100).selectExpr("id % 3 as g", "id", "cast(id as string) as s")
    top = dicts(collect_top(df, ["g"], [df.id.desc()], df.s, 2).orderBy("g"))
    assert [t["evidence"] for t in top] == [["99", "96"], ["97", "94"], ["98", "95"]]


def test_top_records_keep_nulls(frame, dicts):
    df = frame("a string, v double", ("x", float("nan")), ("y", 2.0), ("z", 3.0))
    got = dicts(top_records(df, ["-a"], 2).orderBy("rank"))
    assert [g["record"] for g in got] == ['{"a":"z","v":3.0}', '{"a":"y","v":2.0}']
    assert dicts(top_records(df, ["a"], 1))[0]["record"] == '{"a":"x","v":null}'


def test_a_cluster_without_a_shared_folder_is_an_error(tmp_path):
    from types import SimpleNamespace

    from tabcord.functions import durable

    def session(**conf):
        get = lambda name, default=None: conf.get(name.replace(".", "_"), default)
        return SimpleNamespace(conf=SimpleNamespace(get=get))

    assert durable.work_dir(session(spark_master="local[4]")) == f"{durable.DEFAULT}/tabcord"
    named = session(spark_master="spark://host:1", spark_checkpoint_dir="hdfs:///work/")
    assert durable.work_dir(named) == "hdfs:///work/tabcord"
    with pytest.raises(durable.NoSharedFolder):
        durable.work_dir(session(spark_master="spark://host:1"))
