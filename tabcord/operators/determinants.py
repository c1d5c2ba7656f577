"""All minimal sets of columns that determine another column.

The sets are searched level by level, from none to many columns.  Of a set that
does not determine the target only the stripped partition is kept: the distinct
rows in classes that still hold several target values.  A larger set can be
wrong in no other row, so each level reads what the level before left over, and
a set starts from the smallest such remainder among its subsets.  Sets above a
found one are never tried.  All sets of a level are one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean, local_rows, varies
from ..functions.durable import materialise


def _class_key(columns: Sequence[str], chosen: Sequence[int]) -> Column:
    """A digest of a row's values in the chosen columns, each with its length."""
    parts = [
        F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-"))
        for v in (F.col(columns[i]).cast("string") for i in chosen)
    ]
    return F.sha2(F.concat(F.lit(",".join(map(str, chosen))), F.lit("|"), *parts), 256)


def _stripped(rows: DataFrame, sets: dict[int, tuple[int, ...]], columns, parents) -> DataFrame:
    """Per set the rows of its parent's remainder that lie in a class of several target values."""
    children: dict[int, list[int]] = {}
    for child, parent in parents.items():
        children.setdefault(parent, []).append(child)
    tried = F.lit(None).cast("array<int>")
    for parent, own in children.items():
        listed = F.array(*[F.lit(c) for c in own])
        tried = F.when(F.col("of") == parent, listed).otherwise(tried)
    key = F.lit(None).cast("string")
    for child, chosen in sets.items():
        key = F.when(F.col("next") == child, _class_key(columns, chosen)).otherwise(key)
    classed = (
        rows.withColumn("next", F.explode(tried)).withColumn("key", key).drop("of")
    )
    wrong = (
        classed.groupBy("key").agg(varies(F.col("target")).alias("several")).where("several")
    )
    return classed.join(wrong.select("key"), "key", "left_semi").select(
        F.col("next").alias("of"), "target", *columns
    )


def all_determinants(
    df: DataFrame, target: str, candidates: Sequence[str], most: int | None = None
) -> DataFrame:
    """(columns, n_columns): every minimal set of candidates that determines the target.

    A set determines the target if no combination of its values, nulls included,
    goes with two different non-null target values.  ``most`` bounds the size of
    the sets; the number of sets grows as two to the number of candidates, so
    those are few.  A constant target is determined by the empty set; a missing
    one by none.
    """
    spark = df.sparkSession
    schema = "columns array<string>, n_columns int"
    names = [c for c in dict.fromkeys(candidates) if c in df.columns and c != target]
    if target not in df.columns:
        return local_rows(spark, [], schema)
    columns = [f"c{i}" for i in range(len(names))]
    rows = materialise(
        df.select(
            F.lit(0).alias("of"),
            clean(df, target).alias("target"),
            *[clean(df, n).alias(c) for n, c in zip(names, columns, strict=True)],
        ).distinct(),
        "determinants",
    )
    found: list[tuple[int, ...]] = []
    if not rows.agg(varies(F.col("target")).alias("several")).first()["several"]:
        found.append(())
    left = {(): (0, 1)}  # set -> number in the stored remainder, rows there
    for size in range(1, min(most or len(names), len(names)) + 1):
        if found == [()]:
            break
        sets, parents, number = {}, {}, {}
        for chosen in combinations(range(len(names)), size):
            if any(set(f) <= set(chosen) for f in found):
                continue
            below = [left[s] for s in combinations(chosen, size - 1) if s in left]
            if below:
                number[chosen] = len(sets)
                parents[len(sets)] = min(below, key=lambda x: x[1])[0]
                sets[len(sets)] = chosen
        if not sets:
            break
        rows = materialise(_stripped(rows, sets, columns, parents), "determinants")
        counts = {r["of"]: r["n"] for r in rows.groupBy("of").agg(F.count(F.lit(1)).alias("n")).collect()}
        found += [chosen for chosen, n in number.items() if n not in counts]
        left = {chosen: (n, counts[n]) for chosen, n in number.items() if n in counts}
    result = [([names[i] for i in f], len(f)) for f in found]
    return local_rows(spark, result, schema)
