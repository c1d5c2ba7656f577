"""Compare two tables row by row, as bags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col


def canonical_value(value: Column, kind: T.DataType, float_digits: int = 10) -> Column:
    """Floats rounded and NaN as null at every depth; maps as entries in key order."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.bround(F.when(~F.isnan(value), value).cast("double"), float_digits)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: canonical_value(x, kind.elementType, float_digits))
    if isinstance(kind, T.StructType):
        parts = sorted(kind.fields, key=lambda f: f.name)
        cells = [canonical_value(value[f.name], f.dataType, float_digits).alias(f.name) for f in parts]
        return F.when(value.isNotNull(), F.struct(*cells))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(
            canonical_value(e["key"], kind.keyType, float_digits).alias("key"),
            canonical_value(e["value"], kind.valueType, float_digits).alias("value"),
        )
        return F.array_sort(F.transform(F.map_entries(value), entry))
    return value


def canonical(df: DataFrame, float_digits: int = 10) -> DataFrame:
    """Columns in name order, every value in its canonical form."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return df.select(
        *[canonical_value(col(f.name), f.dataType, float_digits).alias(f.name) for f in fields]
    )


def diff(left: DataFrame, right: DataFrame, float_digits: int = 10) -> DataFrame:
    """Rows that one table holds more often than the other: side, columns, n.

    Both tables are counted in one group-by with opposite signs, so copies of
    a row are combined before the shuffle and no join is needed.
    """
    a, b = canonical(left, float_digits), canonical(right, float_digits)
    if a.columns != b.columns:
        raise ValueError(f"different columns: {a.columns} and {b.columns}")
    sign = F.lit(1).cast("long")
    both = a.withColumn("__n", sign).unionByName(b.withColumn("__n", -sign))
    return (
        both.groupBy(*[col(c) for c in a.columns])
        .agg(F.sum("__n").alias("__n"))
        .where(F.col("__n") != 0)
        .select(
            F.when(F.col("__n") > 0, "left").otherwise("right").alias("side"),
            *[col(c) for c in a.columns],
            F.abs("__n").alias("n"),
        )
    )


def diff_summary(left: DataFrame, right: DataFrame, float_digits: int = 10) -> DataFrame:
    """One row: surplus rows on each side and whether the tables are equal."""
    rows = diff(left, right, float_digits)
    surplus = lambda side: F.coalesce(
        F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0)
    )
    return rows.agg(
        surplus("left").alias("n_left_only"),
        surplus("right").alias("n_right_only"),
        (F.count(F.lit(1)) == 0).alias("equal"),
    )


def leaves(value: Column, kind: T.DataType, path: Column) -> Column:
    """(path, value) of every scalar below a canonical value, as an array.

    Paths read ``name.field``, ``name[0]`` and ``name{key}``; a null is a leaf,
    and so is an empty list or map, whose value is ``[]`` or ``{}``.
    """
    entry = lambda v: F.array(F.struct(path.alias("path"), v.cast("string").alias("value")))
    null = F.lit(None).cast("string")
    if isinstance(kind, T.StructType):
        parts = sorted(kind.fields, key=lambda f: f.name)
        below = [leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in parts]
        return F.when(value.isNull(), entry(null)).otherwise(F.concat(*below) if below else entry(null))
    if isinstance(kind, T.ArrayType):
        each = F.transform(
            value,
            lambda x, i: leaves(
                x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            ),
        )
        return (
            F.when(value.isNull(), entry(null))
            .when(F.size(value) == 0, entry(F.lit("[]")))
            .otherwise(F.flatten(each))
        )
    if isinstance(kind, T.MapType):
        # the canonical form of a map is its entries in key order
        each = F.transform(
            value,
            lambda e: leaves(
                e["value"],
                kind.valueType,
                F.concat(path, F.lit("{"), F.coalesce(e["key"].cast("string"), F.lit("")), F.lit("}")),
            ),
        )
        return (
            F.when(value.isNull(), entry(null))
            .when(F.size(value) == 0, entry(F.lit("{}")))
            .otherwise(F.flatten(each))
        )
    return entry(value)


def nested_compare(
    left: DataFrame, right: DataFrame, keys: Sequence[str], float_digits: int = 10
) -> DataFrame:
    """Where two tables differ, down to the field, list position or map key.

    Rows are paired by ``keys`` (null equals null); of several rows with one
    key equal ones are paired first, the others by the rank of their digests.  Returns the keys, ``path``,
    ``left_value`` and ``right_value`` as text and ``change``: "changed",
    "left only" or "right only" (the path, or the whole row, is on one side).
    Columns may be nested to any depth.

    Rows travel as digests first; only rows that differ are taken apart.
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"different columns: {left.columns} and {right.columns}")
    kinds = {f.name: f.dataType for f in left.schema.fields}
    others = {f.name: f.dataType for f in right.schema.fields}
    values = sorted(c for c in kinds if c not in keys)
    short = {k: f"k{i}" for i, k in enumerate(keys)}

    def rows(df: DataFrame, types: dict[str, T.DataType], side: str) -> DataFrame:
        cells = [canonical_value(col(c), types[c], float_digits).alias(c) for c in values]
        found = df.select(
            *[canonical_value(col(k), types[k], float_digits).alias(n) for k, n in short.items()],
            (F.struct(*cells) if cells else F.struct(F.lit(0))).alias("row"),
        )
        whole = F.to_json("row", {"ignoreNullFields": "false"})
        found = found.withColumn("mark", F.sha2(whole, 256))
        copy = Window.partitionBy(*short.values(), "mark").orderBy("mark")
        found = found.withColumn("copy", F.row_number().over(copy))
        return found.select(*[F.col(c).alias(f"{side}_{c}") for c in found.columns])

    def ranked(df: DataFrame, side: str) -> DataFrame:
        order = Window.partitionBy(*[f"{side}_{n}" for n in short.values()]).orderBy(
            f"{side}_mark", f"{side}_copy"
        )
        return df.withColumn(f"{side}_rank", F.row_number().over(order))

    a, b = rows(left, kinds, "a"), rows(right, others, "b")
    same = F.lit(True)
    for n in short.values():
        same = same & F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}"))
    equal = same & (F.col("a_mark") == F.col("b_mark")) & (F.col("a_copy") == F.col("b_copy"))
    loose_a = ranked(a.join(b.drop("b_row"), equal, "left_anti"), "a")
    loose_b = ranked(b.join(a.drop("a_row"), equal, "left_anti"), "b")
    pairs = loose_a.join(loose_b, same & (F.col("a_rank") == F.col("b_rank")), "full")

    def tree(side: str, types: dict[str, T.DataType]) -> Column:
        row = F.col(f"{side}_row")
        parts = [leaves(row[c], types[c], F.lit(c)) for c in values]
        whole = F.map_from_entries(F.concat(*parts)) if parts else F.create_map()
        empty = F.create_map().cast("map<string,string>")
        return F.when(row.isNotNull(), whole.cast("map<string,string>")).otherwise(empty)

    trees = pairs.select(
        *[
            F.when(F.col("a_copy").isNotNull(), F.col(f"a_{n}")).otherwise(F.col(f"b_{n}")).alias(n)
            for n in short.values()
        ],
        tree("a", kinds).alias("a"),
        tree("b", others).alias("b"),
    )
    paths = trees.withColumn(
        "path", F.explode(F.array_union(F.map_keys("a"), F.map_keys("b")))
    ).withColumns(
        {
            "in_a": F.map_contains_key("a", F.col("path")),
            "in_b": F.map_contains_key("b", F.col("path")),
            "left_value": F.try_element_at("a", F.col("path")),
            "right_value": F.try_element_at("b", F.col("path")),
        }
    )
    differ = ~F.col("left_value").eqNullSafe(F.col("right_value")) | (
        F.col("in_a") != F.col("in_b")
    )
    return paths.where(differ).select(
        *[F.col(n).alias(k) for k, n in short.items()],
        "path",
        "left_value",
        "right_value",
        F.when(~F.col("in_b"), "left only").when(~F.col("in_a"), "right only").otherwise("changed").alias("change"),
    )
