"""Row uniqueness and functional dependencies between columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean, col, local_rows, varies
from ..functions.durable import materialise


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur in more than one row, with their row count.

    Nulls are equal to each other.  The count is combined on the map side, so
    a key that holds a large part of the table costs one row per task.
    """
    if "n_rows" in keys:
        raise ValueError("a key column may not be named n_rows")
    return (
        df.select(*[clean(df, k).alias(k) for k in keys])
        .groupBy(*[col(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def key_digest(df: DataFrame, keys: Sequence[str]) -> Column:
    """SHA-256 of whole key values, each with its length so values cannot run together."""
    parts = [
        F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-"))
        for v in (clean(df, k).cast("string") for k in keys)
    ]
    return F.sha2(F.concat(*parts), 256)


def duplicate_digests(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Like :func:`duplicate_keys` for wide keys such as whole texts.

    Only a 64-character digest per row is grouped and shuffled, never the text.
    """
    return (
        df.select(key_digest(df, keys).alias("key_digest"))
        .groupBy("key_digest")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def duplicate_summary(duplicates: DataFrame) -> DataFrame:
    """One row: duplicated combinations, the rows they cover, the status."""
    n = F.count(F.lit(1))
    return duplicates.agg(
        n.alias("n_duplicates"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.when(n > 0, "FAIL").otherwise("PASS").alias("status"),
    )


def parent_violations(
    df: DataFrame, key_cols: Sequence[str], candidates: Sequence[str]
) -> DataFrame:
    """Per (key column, candidate): key values with more than one candidate value.

    A candidate is a *parent* of a key column when each key value has at most
    one distinct non-null candidate value.  Candidates that the table lacks are
    skipped.  All key columns share one grouping by (key column, value), which
    combines on the map side: at most one row per key value and task is
    shuffled.  A key value breaks the rule exactly when its smallest and
    largest candidate values differ (:func:`varies`).  A table without rows
    breaks no rule.
    """
    found = [c for c in candidates if c in df.columns]
    pairs = [(k, c) for k in key_cols for c in found if k != c]
    if not pairs:
        return local_rows(
            df.sparkSession,
            [],
            "key_col string, column string, n_bad_keys bigint, is_parent boolean",
        )
    used = list(dict.fromkeys([*key_cols, *found]))
    rows = df.select(*[clean(df, c).alias(c) for c in used])
    key_rows = F.array(
        *[F.struct(F.lit(k).alias("name"), col(k).cast("string").alias("value")) for k in key_cols]
    )
    per_key = (
        rows.select(
            F.explode(key_rows).alias("key"), *[col(c).alias(f"c{i}") for i, c in enumerate(found)]
        )
        .select("key.name", "key.value", *[f"c{i}" for i in range(len(found))])
        .groupBy("name", "value")
        .agg(*[varies(F.col(f"c{i}")).alias(f"bad{i}") for i in range(len(found))])
    )
    counts = per_key.groupBy("name").agg(
        *[F.count_if(F.col(f"bad{i}")).alias(f"n{i}") for i in range(len(found))]
    )
    counted = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"))
            for i, c in enumerate(found)
        ]
    )
    bad = counts.select(F.col("name").alias("key_col"), F.inline(counted))
    n = F.coalesce("n", F.lit(0))
    return (
        local_rows(df.sparkSession, pairs, "key_col string, column string")
        .join(bad, ["key_col", "column"], "left")
        .select("key_col", "column", n.alias("n_bad_keys"), (n == 0).alias("is_parent"))
    )


def parent_conflicts(
    df: DataFrame, pairs: Sequence[tuple[str, str]], rows: str | None = None
) -> DataFrame:
    """What breaks the rule of :func:`parent_violations`, value by value.

    ``pairs`` are (key column, candidate).  For each key value with several
    candidate values: every one of them, how many rows hold it, whether it is
    the majority (of equally frequent ones the smallest), and ``n_remove``, the
    fewest rows whose removal leaves one value.  ``rows`` names a row-count
    column of a pre-aggregated table.

    Rows are counted per (key value, candidate value) first, which combines on
    the map side, so a key that holds a large part of the table costs one row
    per candidate value and task; only the counts are grouped again by key.
    """
    pairs = [(k, c) for k, c in pairs if k != c and k in df.columns and c in df.columns]
    schema = "key_col string, key_value string, column string, value string"
    if not pairs:
        return local_rows(
            df.sparkSession, [], f"{schema}, n_rows long, is_majority boolean, n_remove long"
        )
    used = list(dict.fromkeys(c for pair in pairs for c in pair))
    short = {c: f"c{i}" for i, c in enumerate(used)}
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("key_col"),
                F.col(short[k]).cast("string").alias("key_value"),
                F.lit(c).alias("column"),
                F.col(short[c]).cast("string").alias("value"),
            )
            for k, c in pairs
        ]
    )
    weight = (col(rows) if rows else F.lit(1)).cast("long").alias("weight")
    held = (
        df.select(*[clean(df, c).alias(short[c]) for c in used], weight)
        .select(F.inline(cells), "weight")
        .where("value IS NOT NULL")
        .groupBy("key_col", "key_value", "column", "value")
        .agg(F.sum("weight").alias("n_rows"))
    )
    of = ("key_col", "key_value", "column")
    broken = (
        held.groupBy(*[F.col(c).alias(f"b_{c}") for c in of])
        .agg(
            F.count(F.lit(1)).alias("n_values"),
            (F.sum("n_rows") - F.max("n_rows")).alias("n_remove"),
        )
        .where("n_values > 1")
    )
    same = F.lit(True)
    for c in of:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    place = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("n_rows"), "value"))
    return held.join(broken, same).select(
        *of, "value", "n_rows", (place == 1).alias("is_majority"), "n_remove"
    )


def find_parent_cols(df: DataFrame, key_col: str, candidates: Sequence[str]) -> list[str]:
    """Candidates that are parents of ``key_col``, in the given order."""
    found = [c for c in candidates if c in df.columns]
    rows = parent_violations(df, [key_col], found).where("not is_parent").select("column")
    broken = {r["column"] for r in rows.collect()}  # at most one row per candidate
    return [c for c in found if c not in broken]


def undetermined_without(
    distinct_map: DataFrame, target: str, kept: Sequence[str], tested: Sequence[str]
) -> DataFrame:
    """For each tested column: does ``kept`` without it fail to determine ``target``?

    One job covers all tested columns, as grouping sets that each leave one out.
    """
    sets = [[c for c in kept if c != t] for t in tested]
    wide = distinct_map.groupingSets(
        [[col(c) for c in s] for s in sets], *[col(c) for c in kept]
    ).agg(
        F.grouping_id().alias("gid"),
        varies(col(target)).alias("ambiguous"),
    )
    # grouping_id has one bit per kept column, set where the column is left out
    bit = {2 ** (len(kept) - 1 - kept.index(t)): t for t in tested}
    name = F.create_map(*[x for g, t in bit.items() for x in (F.lit(g).cast("long"), F.lit(t))])
    return (
        wide.groupBy("gid")
        .agg(F.coalesce(F.bool_or("ambiguous"), F.lit(False)).alias("ambiguous"))
        .select(name[F.col("gid")].alias("column"), "ambiguous")
    )


def minimal_determinant(
    df: DataFrame, target: str, candidates: Sequence[str]
) -> tuple[list[str], DataFrame]:
    """Smallest set of columns that still determines ``target``, and its sub-map.

    Columns are dropped greedily in the given order, never below one.  A column
    that is needed once stays needed in every smaller set, so each round tests
    only the columns behind the last one dropped; a round is one job over the
    distinct map.  A missing target yields an empty frame.
    """
    kept = [c for c in candidates if c in df.columns]
    if target not in df.columns:
        fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
        extra = f"`{target}` string"
        schema = f"{fields}, {extra}" if fields else extra
        return kept, local_rows(df.sparkSession, [], schema)

    used = [*kept, target]
    distinct_map = materialise(
        df.select(*[clean(df, c).alias(c) for c in used]).distinct(), "determinant"
    )
    open_cols = list(kept)
    while open_cols and len(kept) > 1:
        rows = undetermined_without(distinct_map, target, kept, open_cols).collect()
        needed = {r["column"] for r in rows if r["ambiguous"]}  # one row per tested column
        droppable = [c for c in open_cols if c not in needed]
        if not droppable:
            break
        dropped = droppable[0]
        kept.remove(dropped)
        open_cols = [c for c in open_cols[open_cols.index(dropped) + 1 :] if c not in needed]
    return kept, distinct_map.select(*[col(c) for c in [*kept, target]]).distinct()
