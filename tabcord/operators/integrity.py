"""Referential integrity between a fact table and a reference table.

All operators rest on one *key census*: both sides are tagged, unioned and
grouped by the key.  The group-by treats nulls as equal, combines rows on the
map side (a hot key costs one row per task), needs a single shuffle, and
answers both directions at once, so no join is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean, col, common_type, percent, require_same_kind
from ..functions.durable import materialise

RESERVED = {"n_left", "n_right", "measure", "right_measure", "ref_table", "forward"}


def _census(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.groupBy(*[col(c) for c in by]).agg(
        F.sum("n_left").alias("n_left"),
        F.sum("n_right").alias("n_right"),
        total("measure"),
        total("right_measure"),
    )


def _tags(left: bool, measure: Column, right_measure: Column) -> list[Column]:
    return [
        F.lit(int(left)).cast("long").alias("n_left"),
        F.lit(int(not left)).cast("long").alias("n_right"),
        measure.alias("measure"),
        right_measure.alias("right_measure"),
    ]


def _check_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    if not keys:
        raise ValueError("a key census needs at least one key column")
    if RESERVED & set(keys):
        raise ValueError(f"key columns may not be named {sorted(RESERVED & set(keys))}")
    require_same_kind(left, right, keys)


def key_census(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    measure: str | None = None,
    right_measure: str | None = None,
) -> DataFrame:
    """Per key combination: rows on each side and the measure summed on each side."""
    _check_keys(left, right, keys)
    left_type = left.schema[measure].dataType if measure else "int"
    right_type = right.schema[right_measure].dataType if right_measure else "int"
    left_value = clean(left, measure) if measure else F.lit(0)
    right_value = clean(right, right_measure) if right_measure else F.lit(0)
    l = left.select(
        *[clean(left, k).alias(k) for k in keys],
        *_tags(True, left_value, F.lit(None).cast(right_type)),
    )
    r = right.select(
        *[clean(right, k).alias(k) for k in keys],
        *_tags(False, F.lit(None).cast(left_type), right_value),
    )
    return _census(l.unionByName(r), keys)


def key_census_many(
    left: DataFrame,
    refs: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    measure: str | None = None,
    right_measure: tuple[str, str] | None = None,
) -> DataFrame:
    """The census of one fact against many reference tables, in one pass over the fact.

    Each fact row is counted once per reference table, under that table's key;
    key columns of other tables are null.  One scan, one grouping and one
    shuffle serve all tables.  ``right_measure`` is (table, column).
    """
    for name, ref in refs.items():
        _check_keys(left, ref, keys[name])
    columns = list(dict.fromkeys(k for name in refs for k in keys[name]))
    owner, own = right_measure or (None, None)
    left_type = left.schema[measure].dataType if measure else "int"
    right_type = refs[owner].schema[own].dataType if owner else "int"

    types = {c: left.schema[c].dataType for c in columns}
    users = {c: [name for name in refs if c in keys[name]] for c in columns}
    each = F.explode(F.array(*[F.lit(name) for name in refs])).alias("ref_table")
    value = clean(left, measure) if measure else F.lit(0)
    rows = left.select(
        each, *[clean(left, c).alias(c) for c in columns], value.alias("__value")
    ).select(
        "ref_table",
        *[F.when(F.col("ref_table").isin(users[c]), col(c)).alias(c) for c in columns],
        *_tags(True, F.col("__value"), F.lit(None).cast(right_type)),
    )
    for name, ref in refs.items():
        right_value = clean(ref, own) if name == owner else F.lit(0)
        rows = rows.unionByName(
            ref.select(
                F.lit(name).alias("ref_table"),
                *[
                    (clean(ref, c) if c in keys[name] else F.lit(None)).cast(types[c]).alias(c)
                    for c in columns
                ],
                *_tags(False, F.lit(None).cast(left_type), right_value.cast(right_type)),
            )
        )
    return _census(rows, ["ref_table", *columns])


def grouping_parents(sets: Sequence[frozenset[str]], rows: Mapping[frozenset[str], int]):
    """For each set of columns the smallest known grouping that holds all of them."""
    return {
        s: min((p for p in rows if s <= p), key=lambda p: (rows[p], len(p), sorted(p)))
        for s in sets
    }


def fact_groupings(
    left: DataFrame, sets: Sequence[frozenset[str]], measure: str | None = None
) -> dict[frozenset[str], DataFrame]:
    """(columns, n_left, measure): the fact counted by each set of columns, finest first.

    Raw rows are grouped once, by all columns together.  Every other grouping
    is made from the smallest finer one that exists by then: a tree over the
    lattice of column sets, in which sizes are known because groupings that
    others build on are stored.
    """
    value = clean(left, measure) if measure else F.lit(0)
    whole = frozenset(c for s in sets for c in s)
    order = sorted(whole)
    first = (
        left.select(*[clean(left, c).alias(c) for c in order], value.alias("measure"))
        .groupBy(*[col(c) for c in order])
        .agg(F.count(F.lit(1)).alias("n_left"), F.sum("measure").alias("measure"))
    )
    made = {whole: materialise(first, "census")}
    rows = {whole: made[whole].count()}
    for s in sorted(set(sets) - {whole}, key=lambda x: (-len(x), sorted(x))):
        parent = grouping_parents([s], rows)[s]
        coarser = (
            made[parent]
            .groupBy(*[col(c) for c in sorted(s)])
            .agg(F.sum("n_left").alias("n_left"), F.sum("measure").alias("measure"))
        )
        if any(t < s for t in sets):
            made[s] = materialise(coarser, "census")
            rows[s] = made[s].count()
        else:
            made[s] = coarser
    return made


def key_census_tree(
    left: DataFrame,
    refs: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    measure: str | None = None,
    right_measure: tuple[str, str] | None = None,
) -> DataFrame:
    """The result of :func:`key_census_many` without multiplying the fact.

    That function counts every fact row once per reference table, which suits
    a fact that is aggregated already.  This one groups raw rows a single
    time and derives the census of each table from the smallest finer grouping
    (:func:`fact_groupings`); tables with equal keys share one.
    """
    for name, ref in refs.items():
        _check_keys(left, ref, keys[name])
    columns = list(dict.fromkeys(k for name in refs for k in keys[name]))
    owner, own = right_measure or (None, None)
    left_type = left.schema[measure].dataType if measure else "int"
    right_type = refs[owner].schema[own].dataType if owner else "int"
    total_type = left.select(F.sum(clean(left, measure) if measure else F.lit(0)).alias("m"))
    total_type = total_type.schema["m"].dataType
    types = {c: left.schema[c].dataType for c in columns}
    made = fact_groupings(left, [frozenset(keys[name]) for name in refs], measure)
    rows = None
    for name, ref in refs.items():
        right_value = clean(ref, own) if name == owner else F.lit(0)
        pad = lambda df, c: (
            (clean(df, c) if c in keys[name] else F.lit(None)).cast(types[c]).alias(c)
        )
        grouped = made[frozenset(keys[name])]
        facts = grouped.select(
            F.lit(name).alias("ref_table"),
            *[pad(grouped, c) for c in columns],
            F.col("n_left"),
            F.lit(0).cast("long").alias("n_right"),
            F.col("measure"),
            F.lit(None).cast(right_type).alias("right_measure"),
        )
        others = ref.select(
            F.lit(name).alias("ref_table"),
            *[pad(ref, c) for c in columns],
            *_tags(False, F.lit(None).cast(left_type).cast(total_type), right_value.cast(right_type)),
        )
        part = facts.unionByName(others)
        rows = part if rows is None else rows.unionByName(part)
    return _census(rows, ["ref_table", *columns])


def only_left() -> Column:
    return (F.col("n_left") > 0) & (F.col("n_right") == 0)


def only_right() -> Column:
    return (F.col("n_right") > 0) & (F.col("n_left") == 0)


def unmatched_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key combinations of ``left`` that ``right`` lacks."""
    return key_census(left, right, keys).where(only_left()).select(*[col(k) for k in keys])


def unmatched_measure(
    left: DataFrame, right: DataFrame, keys: Sequence[str], measure: str
) -> DataFrame:
    """Unmatched combinations with their measure and its share of the left total.

    The total is a scalar subquery over the same census, which reads the
    census's own shuffle output again rather than the inputs.
    """
    census = key_census(left, right, keys, measure)
    total = (
        census.where(F.col("n_left") + F.col("n_right") > 0)
        .agg(F.sum("measure").cast("double"))
        .scalar()
    )
    return census.where(only_left()).select(
        *[col(k) for k in keys],
        F.col("measure").alias(measure),
        F.bround(percent(F.col("measure"), total), 1).alias("pct"),
    )


def unmatched_top(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    measure: str | None = None,
    k: int = 10,
) -> DataFrame:
    """The ``k`` unmatched combinations with the largest measure (or the first ``k``)."""
    if measure is None:
        return unmatched_keys(left, right, keys).orderBy(*[col(c) for c in keys]).limit(k)
    rows = unmatched_measure(left, right, keys, measure)
    return rows.orderBy(col(measure).desc(), *[col(c) for c in keys]).limit(k)


def integrity_counts() -> list[Column]:
    """Aggregates over a census: both directions, the affected measure, the status."""
    n_unmatched = F.count_if(only_left())
    n_orphaned = F.count_if(only_right())
    unmatched = F.when(n_unmatched > 0, F.sum(F.when(only_left(), F.col("measure"))))
    total = F.sum("measure")
    return [
        n_unmatched.alias("n_unmatched"),
        unmatched.alias("unmatched_measure"),
        total.alias("total_measure"),
        percent(unmatched, total).alias("unmatched_pct"),
        n_orphaned.alias("n_orphaned"),
        F.when(n_orphaned > 0, F.sum(F.when(only_right(), F.col("right_measure")))).alias(
            "orphaned_measure"
        ),
        F.when(n_unmatched > 0, "FAIL")
        .when(n_orphaned > 0, "WARNING")
        .otherwise("PASS")
        .alias("status"),
    ]


def integrity_summary(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    measure: str | None = None,
    right_measure: str | None = None,
) -> DataFrame:
    """One row for both directions: FAIL on unmatched keys, else WARNING on orphans."""
    census = key_census(left, right, keys, measure, right_measure)
    return census.agg(*integrity_counts())


def unmatched_summary(
    left: DataFrame, right: DataFrame, keys: Sequence[str], measure: str
) -> DataFrame:
    """One row for the forward direction: count, measure, percentage, status."""
    return integrity_summary(left, right, keys, measure).select(
        "n_unmatched",
        "unmatched_measure",
        "unmatched_pct",
        F.when(F.col("n_unmatched") > 0, "FAIL").otherwise("PASS").alias("status"),
    )


def orphaned_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key combinations of the reference ``right`` that ``left`` never uses."""
    return key_census(left, right, keys).where(only_right()).select(*[col(k) for k in keys])


def orphaned_measure(
    left: DataFrame, right: DataFrame, keys: Sequence[str], measure: str
) -> DataFrame:
    """Orphaned reference combinations with the reference's own measure summed."""
    census = key_census(left, right, keys, right_measure=measure)
    return census.where(only_right()).select(
        *[col(k) for k in keys], F.col("right_measure").alias(measure)
    )


def domain_violations(ref: DataFrame, fact: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null values of ``ref`` columns that the same ``fact`` column never holds.

    All columns are checked in one pass over each table, as (column, value)
    rows; numbers of two types are compared as numbers of their common type.
    """
    require_same_kind(ref, fact, columns)
    kinds = {c: common_type(ref.schema[c].dataType, fact.schema[c].dataType) for c in columns}

    def values(df: DataFrame, in_fact: bool) -> DataFrame:
        cells = df.select(*[clean(df, c).cast(kinds[c]).cast("string").alias(c) for c in columns])
        long = cells.unpivot([], [col(c) for c in columns], "column", "value")
        return long.where(F.col("value").isNotNull()).withColumn("in_fact", F.lit(in_fact))

    return (
        values(ref, False)
        .unionByName(values(fact, True))
        .groupBy("column", "value")
        .agg(F.max("in_fact").alias("in_fact"))
        .where(~F.col("in_fact"))
        .select("column", "value")
    )


def key_registration(
    catalog: DataFrame,
    targets: Sequence[str],
    prefix: str = "Key_",
    exempt: Sequence[str] = ("Key_Forecast",),
) -> DataFrame:
    """Key columns of a (table, column) catalogue that a target table lacks.

    Returns (table, key_col, missing_from) for every non-target table.  The
    catalogue is plain data, so it may list any number of tables.
    """
    pairs = catalog.select("table", "column").distinct()
    wanted = pairs.where(
        ~F.col("table").isin(*targets)
        & F.col("column").startswith(prefix)
        & ~F.col("column").isin(*exempt)
    ).select(
        "table",
        F.col("column").alias("key_col"),
        F.explode(F.array(*[F.lit(t) for t in targets])).alias("missing_from"),
    )
    present = pairs.where(F.col("table").isin(*targets)).select(
        F.col("table").alias("missing_from"), F.col("column").alias("key_col")
    )
    return wanted.join(present, ["missing_from", "key_col"], "left_anti").select(
        "table", "key_col", "missing_from"
    )
