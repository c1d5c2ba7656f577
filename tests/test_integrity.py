import pytest

from tabcord.functions.columns import KeyTypeClash
from pyspark.sql import functions as F

from tabcord.operators import integrity
from tabcord.operators import integrity as ig

FACT = "k string, state string, premium double"
KEYS = ["k", "state"]


@pytest.fixture
def fact(frame):
    return frame(FACT, ("P1", "NSW", 100.0), ("P2", "VIC", 200.0))


def ref(frame, *rows):
    return frame("k string, state string", *rows)


def test_perfect_match_passes(frame, fact, dicts):
    got = dicts(ig.integrity_summary(fact, ref(frame, ("P1", "NSW"), ("P2", "VIC")), KEYS, "premium"))
    assert got[0]["status"] == "PASS"
    assert (got[0]["n_unmatched"], got[0]["n_orphaned"]) == (0, 0)
    assert got[0]["unmatched_measure"] is None and got[0]["unmatched_pct"] is None


def test_forward_gap_fails_with_measure(frame, fact, dicts):
    got = dicts(ig.unmatched_summary(fact, ref(frame, ("P1", "NSW")), KEYS, "premium"))[0]
    assert (got["status"], got["n_unmatched"], got["unmatched_measure"]) == ("FAIL", 1, 200.0)
    assert got["unmatched_pct"] == pytest.approx(200 / 300 * 100)


def test_reverse_orphan_warns(frame, fact, dicts):
    r = ref(frame, ("P1", "NSW"), ("P2", "VIC"), ("P3", "QLD"))
    assert dicts(ig.integrity_summary(fact, r, KEYS, "premium"))[0]["status"] == "WARNING"
    assert dicts(ig.orphaned_keys(fact, r, KEYS)) == [{"k": "P3", "state": "QLD"}]


def test_null_keys_match_null_keys(frame, dicts):
    fact = frame(FACT, (None, "NSW", 1.0), (None, None, 2.0))
    r = ref(frame, (None, "NSW"))
    assert dicts(ig.unmatched_keys(fact, r, KEYS)) == [{"k": None, "state": None}]
    assert dicts(ig.orphaned_keys(fact, r, KEYS)) == []


def test_top_rows_are_ordered_and_rounded(frame, dicts):
    rows = [(f"P{i}", "X", float(i)) for i in range(15)]
    fact = frame(FACT, *rows)
    got = dicts(ig.unmatched_top(fact, ref(frame, ("P14", "X")), KEYS, "premium"))
    assert [g["k"] for g in got] == [f"P{i}" for i in range(13, 3, -1)]
    assert got[0]["pct"] == round(13 / 105 * 100, 1)


def test_top_without_measure_lists_first_keys(frame, fact, dicts):
    got = dicts(ig.unmatched_top(fact, ref(frame, ("P9", "NSW")), KEYS, k=1))
    assert got == [{"k": "P1", "state": "NSW"}]


def test_zero_total_gives_null_percentage(frame, dicts):
    fact = frame(FACT, ("P1", "NSW", 5.0), ("P2", "VIC", -5.0))
    got = dicts(ig.unmatched_measure(fact, ref(frame, ("P1", "NSW")), KEYS, "premium"))
    assert got[0]["premium"] == -5.0 and got[0]["pct"] is None


def test_nan_measure_and_key_count_as_missing(frame, dicts):
    fact = frame("k double, premium double", (float("nan"), 1.0), (2.0, float("nan")))
    r = frame("k double", (None,))
    assert dicts(ig.unmatched_measure(fact, r, ["k"], "premium")) == [
        {"k": 2.0, "premium": 0.0, "pct": 0.0}
    ]


def test_orphaned_measure_sums_the_reference(frame, fact, dicts):
    r = frame("k string, state string, prem double", ("P3", "QLD", 7.0), ("P3", "QLD", 3.0))
    assert dicts(ig.orphaned_measure(fact, r, KEYS, "prem")) == [
        {"k": "P3", "state": "QLD", "prem": 10.0}
    ]


def test_type_clash_is_rejected(frame, fact):
    with pytest.raises(KeyTypeClash):
        ig.key_census(fact, frame("k int, state string", (1, "NSW")), KEYS)


def test_reserved_and_empty_keys_are_rejected(frame, fact):
    with pytest.raises(ValueError):
        ig.key_census(fact, fact, [])
    bad = frame("measure string", ("a",))
    with pytest.raises(ValueError):
        ig.key_census(bad, bad, ["measure"])


def test_many_references_give_the_single_censuses(frame, fact, dicts):
    a = frame("k string, w double", ("P1", 1.0), ("P9", 2.5))
    b = frame("state string, k string", ("VIC", "P2"), ("VIC", "P2"))
    many = ig.key_census_many(
        fact, {"a": a, "b": b}, {"a": ["k"], "b": ["state", "k"]}, "premium", ("a", "w")
    )
    as_set = lambda rows: {tuple(sorted(r.items(), key=str)) for r in rows}
    for name, one in {
        "a": ig.key_census(fact, a, ["k"], "premium", "w"),
        "b": ig.key_census(fact, b, ["state", "k"], "premium"),
    }.items():
        part = many.where(f"ref_table = '{name}'").select(*one.columns)
        assert as_set(dicts(part)) == as_set(dicts(one))


def test_domain_violations(frame, dicts):
    r = frame("a string, b string", ("x", "u"), ("y", None), ("z", "v"), ("z", "v"))
    fact = frame("a string, b string", ("x", "v"), ("y", "v"))
    got = dicts(ig.domain_violations(r, fact, ["a", "b"]).orderBy("column"))
    assert got == [{"column": "a", "value": "z"}, {"column": "b", "value": "u"}]


def test_domain_values_of_two_number_types_are_compared_as_numbers(spark, dicts):
    ref = spark.sql("SELECT 1L AS a, CAST(1.5 AS DECIMAL(10,2)) AS b UNION ALL SELECT 2L, 2.5")
    fact = spark.sql("SELECT 1.0D AS a, CAST(1.5 AS DECIMAL(12,3)) AS b")
    got = dicts(ig.domain_violations(ref, fact, ["a", "b"]).orderBy("column"))
    assert got == [{"column": "a", "value": "2.0"}, {"column": "b", "value": "2.500"}]


CATALOG = "table string, column string"


def test_registration(frame, dicts):
    rows = [("dd", "Key_A"), ("dd", "State"), ("map", "State"), ("r", "Key_A"), ("r", "Key_Forecast")]
    got = dicts(ig.key_registration(frame(CATALOG, *rows), ["dd", "map"]))
    assert got == [{"table": "r", "key_col": "Key_A", "missing_from": "map"}]
    assert dicts(ig.key_registration(frame(CATALOG, *rows), ["dd"])) == []
    got = ig.key_registration(frame(CATALOG, *rows[1:]), ["dd", "map"]).orderBy("missing_from")
    assert [g["missing_from"] for g in dicts(got)] == ["dd", "map"]


def _tree_tables(spark):
    rows = [(f"a{i % 5}", f"b{i % 3}", f"c{i % 7}" if i % 11 else None, i % 4, float(i)) for i in range(400)]
    fact = spark.createDataFrame(rows, "a string, b string, c string, d int, m double")
    refs = {
        "ab": fact.select("a", "b").where("a <> 'a1'").union(spark.createDataFrame([("z", "b0")], "a string, b string")),
        "a": fact.select("a").distinct(),
        "c": fact.select("c").where("c = 'c1' OR c IS NULL"),
        "ac": fact.select("c", "a", F.lit(2.5).alias("w")).where("a = 'a2'"),
        "a2": spark.createDataFrame([("a0",), ("q",)], "a string"),
    }
    keys = {"ab": ["a", "b"], "a": ["a"], "c": ["c"], "ac": ["c", "a"], "a2": ["a"]}
    return fact, refs, keys


def test_census_tree_equals_the_census_of_every_table(spark):
    fact, refs, keys = _tree_tables(spark)
    for measure, right in (("m", ("ac", "w")), (None, None)):
        many = integrity.key_census_many(fact, refs, keys, measure, right)
        tree = integrity.key_census_tree(fact, refs, keys, measure, right)
        names = many.columns
        assert sorted(tree.columns) == sorted(names)
        want = sorted(map(repr, (tuple(r) for r in many.collect())))
        assert sorted(map(repr, (tuple(r) for r in tree.select(*names).collect()))) == want


def test_raw_rows_are_grouped_once(spark, monkeypatch):
    fact, refs, keys = _tree_tables(spark)
    plans = []
    real = integrity.materialise

    def noted(df, name, path=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, path)

    monkeypatch.setattr(integrity, "materialise", noted)
    wide = fact.crossJoin(spark.range(3)).select("a", "b", "c", "d", "m")  # a raw fact
    tree = integrity.key_census_tree(wide, refs, keys, "m")
    plans.append(tree._jdf.queryExecution().executedPlan().toString())
    raw = [p for p in plans if "Range" in p]
    assert len(raw) == 1 and raw[0].count("Exchange hashpartitioning") == 1
    assert len(plans) == 4  # all columns, then the two sets that smaller ones build on, then the census


def test_a_grouping_is_made_from_the_smallest_finer_one():
    f = frozenset
    rows = {f("abcd"): 1000, f("abc"): 50, f("abd"): 40, f("ab"): 40}
    parents = integrity.grouping_parents([f("a"), f("bc"), f("d")], rows)
    assert parents == {f("a"): f("ab"), f("bc"): f("abc"), f("d"): f("abd")}
