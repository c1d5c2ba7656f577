"""Column expressions shared by all operators: null rules, parsing, percentages.

Inputs follow one rule: a floating NaN means "missing".  Operators pass every
key and value column through :func:`clean` first, so grouping, counting and
comparing never see a NaN (Spark would order it above every number).
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Fixed value: the texts a cell may hold and still be read as a number.
NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
# Fixed value: the characters that count as whitespace around a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)


class KeyTypeClash(TypeError):
    """A key column has types on the two sides that cannot be compared."""


def col(name: str) -> Column:
    """Reference a column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null (a no-op for non-floating types)."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col(name)), col(name)).alias(name)
    return col(name)


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers and booleans count as numeric, everything else is categorical."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_blank(column: Column) -> Column:
    """Null, empty, or only whitespace of any kind."""
    return column.isNull() | (F.btrim(column.cast("string"), F.lit(WHITESPACE)) == "")


def as_number(column: Column) -> Column:
    """Double value of a cell, null when the text is not a number.

    The pattern guard keeps out texts the JVM would accept (``1d``, ``NaN``).
    """
    text = column.cast("string")
    return F.when(text.rlike(NUMERIC_TEXT), F.trim(text).try_cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; null when the whole is zero or null."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def mean(column: Column) -> Column:
    """Aggregate: the mean as a double; exact sums stay exact up to the division."""
    return F.try_divide(F.sum(column).cast("double"), F.count(column).cast("double"))


def varies(column: Column) -> Column:
    """Aggregate: whether a group has more than one value, null aside.

    Smallest and largest hash are compared instead of the values: fixed-width
    buffers keep the grouping a hash aggregate, where texts would have the rows
    sorted.  Two hashes make 128 bits, so unequal values do not look equal.
    """
    marks = [F.when(column.isNotNull(), F.xxhash64(F.lit(seed), column)) for seed in (1, 2)]
    differ = [F.min(m) != F.max(m) for m in marks]
    return F.coalesce(differ[0] | differ[1], F.lit(False))


def share(condition: Column, count: Column) -> Column:
    """Percentage of counted rows that meet a condition."""
    return percent(F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)), count)


def require_same_kind(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    """Reject key columns whose types differ in kind instead of casting them silently."""
    for name in keys:
        a, b = left.schema[name].dataType, right.schema[name].dataType
        both_numbers = isinstance(a, T.NumericType) and isinstance(b, T.NumericType)
        unknown = isinstance(a, T.NullType) or isinstance(b, T.NullType)
        if type(a) is not type(b) and not both_numbers and not unknown:
            raise KeyTypeClash(
                f"key column {name!r} is {a.simpleString()} on one side "
                f"and {b.simpleString()} on the other"
            )


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which values of two column types are compared."""
    if a == b or not (isinstance(a, T.NumericType) and isinstance(b, T.NumericType)):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, T.FractionalType) and isinstance(b, T.FractionalType):
        if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
            return T.DecimalType(38, max(a.scale, b.scale))
        return T.DoubleType()
    for x in (a, b):
        if isinstance(x, T.DecimalType):
            return T.DecimalType(38, x.scale)
        if isinstance(x, T.FractionalType):
            return T.DoubleType()
    return T.LongType()


def aggregate_to_long(df: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """Evaluate one struct of aggregates per column in a single pass, one row each.

    ``rows`` are structs with equal field names, such as
    ``struct(lit('a') as column, count('a') as n)``.  The input is scanned once
    however many columns are examined.
    """
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A few driver-known rows as a local relation, whose size the optimizer knows.

    Only for facts read from schemas (names of tables and columns).
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema.fieldNames()
    cell = lambda v: list(v.items()) if isinstance(v, dict) else v  # noqa: E731  (maps as entries)
    columns = [[cell(r[i]) for r in rows] for i in range(len(names))]
    arrow = to_arrow_schema(schema)
    data = [pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(data, schema=arrow), schema)
