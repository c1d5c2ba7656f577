import hashlib

import pytest

from tabcord.operators import determinants as det
from tabcord.operators import uniqueness as un


def test_duplicates_count_combinations_and_rows(frame, dicts):
    df = frame("a string, b int", ("x", 1), ("x", 1), ("x", 1), ("x", 2), (None, 3), (None, 3))
    got = dicts(un.duplicate_keys(df, ["a", "b"]).orderBy("b"))
    assert got == [{"a": "x", "b": 1, "n_rows": 3}, {"a": None, "b": 3, "n_rows": 2}]
    assert dicts(un.duplicate_summary(un.duplicate_keys(df, ["a", "b"]))) == [
        {"n_duplicates": 2, "n_rows": 5, "status": "FAIL"}
    ]


def test_unique_rows_pass(frame, dicts):
    df = frame("a string", ("x",), ("y",))
    assert dicts(un.duplicate_summary(un.duplicate_keys(df, ["a"])))[0]["status"] == "PASS"


def test_digest_covers_whole_values_and_does_not_run_together(frame, dicts):
    df = frame("a string, b string", ("ab", "c"), ("a", "bc"), ("a" * 9000, "x"), ("a" * 9000, "x"))
    got = dicts(un.duplicate_digests(df, ["a", "b"]))
    text = f"9000:{'a' * 9000}1:x"
    assert got == [{"key_digest": hashlib.sha256(text.encode()).hexdigest(), "n_rows": 2}]
    nulls = frame("a string, b string", (None, "x"), ("", "x"), (None, "x"))
    assert [g["n_rows"] for g in dicts(un.duplicate_digests(nulls, ["a", "b"]))] == [2]


def test_parents(frame, dicts):
    df = frame(
        "k string, same string, differs string, gaps string",
        ("P1", "a", "x", None),
        ("P1", "a", "y", "q"),
        ("P2", "b", "x", None),
        (None, "b", "x", "r"),
        (None, "c", "x", "r"),
    )
    got = {r["column"]: r["n_bad_keys"] for r in dicts(
        un.parent_violations(df, ["k"], ["same", "differs", "gaps", "absent"])
    )}
    assert got == {"same": 1, "differs": 1, "gaps": 0}
    assert un.find_parent_cols(df, "k", ["same", "gaps", "absent"]) == ["gaps"]


def test_parents_of_several_keys_and_nan(frame, dicts):
    nan = float("nan")
    df = frame("a string, b int, v double", ("x", 1, 1.0), ("x", 2, nan), ("y", 2, 5.0))
    got = {(r["key_col"], r["column"]): r["is_parent"] for r in dicts(
        un.parent_violations(df, ["a", "b"], ["v", "a"])
    )}
    assert got == {("a", "v"): True, ("b", "v"): True, ("b", "a"): False}


def test_no_candidates_gives_no_rows(frame, dicts):
    assert dicts(un.parent_violations(frame("k string", ("a",)), ["k"], ["x"])) == []


def test_an_empty_table_breaks_no_rule(frame, dicts):
    got = dicts(un.parent_violations(frame("k string, a string, b int"), ["k"], ["a", "b"]))
    assert sorted((r["column"], r["n_bad_keys"], r["is_parent"]) for r in got) == [
        ("a", 0, True),
        ("b", 0, True),
    ]


MAP = "seg string, reg string, lob string, key string"


@pytest.mark.parametrize(
    "rows, kept",
    [
        ([("a", "n", "m", "1"), ("a", "s", "m", "2"), ("b", "n", "m", "1"), ("b", "s", "p", "2")], ["reg"]),
        ([("a", "n", "m", "1"), ("a", "s", "m", "2"), ("b", "n", "m", "3"), ("b", "s", "m", "4")], ["seg", "reg"]),
        ([("a", "n", "m", "1"), ("a", "n", "m", "2")], ["seg", "reg", "lob"]),
        ([("a", "n", "m", "1"), ("b", "s", "p", "1")], ["lob"]),
    ],
)
def test_minimal_determinant(frame, dicts, rows, kept):
    cols, sub = un.minimal_determinant(frame(MAP, *rows), "key", ["seg", "reg", "lob", "absent"])
    assert cols == kept
    want = {tuple(dict(zip(("seg", "reg", "lob", "key"), r))[c] for c in [*kept, "key"]) for r in rows}
    got = [tuple(r.values()) for r in dicts(sub)]
    assert sub.columns == [*kept, "key"] and set(got) == want and len(got) == len(want)


def test_minimal_determinant_follows_the_greedy_order(spark, dicts):
    """Against the definition: drop in order, restart after every removal."""
    import itertools
    import random

    rng = random.Random(5)
    for _ in range(4):
        rows = [tuple(rng.choice("ab") for _ in range(3)) for _ in range(6)]
        rows = [(*r, str((r[0] == r[2]) + 0)) for r in rows]

        def determined(cols):
            seen = {}
            for r in rows:
                k = tuple(r[i] for i in cols)
                if seen.setdefault(k, r[3]) != r[3]:
                    return False
            return True

        want, again = [0, 1, 2], True
        while again:
            again = False
            for c in list(want):
                rest = [x for x in want if x != c]
                if rest and determined(rest):
                    want, again = rest, True
                    break
        names = ["seg", "reg", "lob"]
        cols, _ = un.minimal_determinant(spark.createDataFrame(rows, MAP), "key", names)
        assert cols == [names[i] for i in want]
    assert list(itertools.islice(names, 1)) == ["seg"]


def test_missing_target_gives_an_empty_frame(frame, dicts):
    cols, sub = un.minimal_determinant(frame(MAP, ("a", "n", "m", "1")), "nope", ["seg", "reg"])
    assert cols == ["seg", "reg"] and sub.columns == ["seg", "reg", "nope"] and dicts(sub) == []


CONFLICT = "k string, k2 int, a string, b int, n int"
CONFLICT_ROWS = [
    ("x", 1, "p", 1, 2),
    ("x", 1, "p", 1, 1),
    ("x", 1, "q", 1, 4),
    ("x", 2, None, 2, 9),
    ("y", 2, "p", 3, 1),
    (None, 3, "r", 4, 1),
    (None, 3, "s", 4, 1),
]


def plain_conflicts(rows, pairs, weighted):
    at = {"k": 0, "k2": 1, "a": 2, "b": 3}
    out = set()
    for key_col, column in pairs:
        held = {}
        for r in rows:
            if r[at[column]] is not None:
                counts = held.setdefault(r[at[key_col]], {})
                value = str(r[at[column]])
                counts[value] = counts.get(value, 0) + (r[4] if weighted else 1)
        for key, counts in held.items():
            if len(counts) > 1:
                first = min(counts, key=lambda v: (-counts[v], v))
                remove = sum(counts.values()) - counts[first]
                for v, n in counts.items():
                    name = None if key is None else str(key)
                    out.add((key_col, name, column, v, n, v == first, remove))
    return out


@pytest.mark.parametrize("weighted", [False, True])
def test_parent_conflicts_name_the_deviating_values(frame, dicts, weighted):
    pairs = [("k", "a"), ("k", "b"), ("k2", "a"), ("k", "k"), ("k", "absent"), ("b", "a")]
    df = frame(CONFLICT, *CONFLICT_ROWS)
    got = dicts(un.parent_conflicts(df, pairs, "n" if weighted else None))
    known = [p for p in pairs if p[0] != p[1] and p[1] != "absent"]
    assert {tuple(r.values()) for r in got} == plain_conflicts(CONFLICT_ROWS, known, weighted)
    bad = dicts(un.parent_violations(df, ["k", "k2", "b"], ["a", "b"]))
    failing = {(r["key_col"], r["column"]) for r in bad if not r["is_parent"]}
    assert {(r["key_col"], r["column"]) for r in got} == failing & set(known)


def test_fewest_rows_removed_make_a_parent(spark, dicts):
    import random

    rng = random.Random(11)
    rows = [(rng.choice("abc"), i % 4, rng.choice("pqr"), i, 1) for i in range(60)]
    df = spark.createDataFrame(rows, CONFLICT)
    got = dicts(un.parent_conflicts(df, [("k", "a")]))
    wrong = {(r["key_value"], r["value"]) for r in got if not r["is_majority"]}
    n_remove = {r["key_value"]: r["n_remove"] for r in got}
    kept = [r for r in rows if (r[0], r[2]) not in wrong]
    assert len(rows) - len(kept) == sum(n_remove.values())
    assert un.find_parent_cols(spark.createDataFrame(kept, CONFLICT), "k", ["a"]) == ["a"]


def test_conflicts_of_an_empty_table(frame, dicts):
    assert dicts(un.parent_conflicts(frame(CONFLICT), [("k", "a")])) == []
    assert dicts(un.parent_conflicts(frame(CONFLICT), [])) == []


def test_parents_are_found_without_sorting_rows(frame):
    df = frame(CONFLICT, *CONFLICT_ROWS)
    for got in (
        un.parent_violations(df, ["k", "k2"], ["a", "b"]),
        un.parent_conflicts(df, [("k", "a"), ("k2", "b")]),
    ):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def plain_determinants(rows, names, target):
    from itertools import combinations

    found = []
    for size in range(len(names) + 1):
        for chosen in combinations(range(len(names)), size):
            if any(set(f) <= set(chosen) for f in found):
                continue
            seen = {}
            for r in rows:
                if r[target] is not None:
                    seen.setdefault(tuple(r[i] for i in chosen), set()).add(r[target])
            if all(len(v) == 1 for v in seen.values()):
                found.append(chosen)
    return {tuple(names[i] for i in f) for f in found}


def test_all_determinants_equal_brute_force(spark):
    import random

    names = [f"c{i}" for i in range(5, -1, -1)]
    schema = ", ".join(f"{n} string" for n in names) + ", target string"
    rng = random.Random(2)
    seen = set()
    for k in range(5):
        rows = []
        for _ in range(40):
            r = [rng.choice([None, "1", "12", "2"]) for _ in names]
            value = (r[0], r[3]) if k < 2 else (r[1] == r[2], r[5]) if k < 4 else rng.choice("xy")
            rows.append((*r, None if k == 3 and r[4] == "2" else str(value)))
        want = plain_determinants(rows, names, 6)
        got = det.all_determinants(spark.createDataFrame(rows, schema), "target", names).collect()
        assert {tuple(r.columns) for r in got} == want
        assert all(r.n_columns == len(r.columns) for r in got)
        seen |= {len(w) for w in want}
    assert len(seen) > 1


def test_determinants_of_odd_tables(frame):
    df = frame("a string, b int, key string", ("x", 1, "k"), ("y", 1, "k"), ("y", 2, None))
    rows = lambda got: [tuple(r) for r in got.collect()]
    assert rows(det.all_determinants(df, "key", ["a", "b"])) == [([], 0)]
    assert rows(det.all_determinants(df, "absent", ["a"])) == []
    assert rows(det.all_determinants(df.limit(0), "key", ["a"])) == [([], 0)]
    two = frame("a string, b int, key string", ("x", 1, "k"), ("x", 1, "l"), ("y", 2, "m"))
    assert rows(det.all_determinants(two, "key", ["a", "b", "absent"])) == []
    assert rows(det.all_determinants(two, "a", ["key", "b"], most=1)) == [(["key"], 1), (["b"], 1)]
