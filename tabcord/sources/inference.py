"""Column types of text tables, found from every cell in one pass.

The types form a lattice: a whole number is also a decimal and a double, a date
is also a timestamp, and everything is a string.  Each cell gives the set of
types it parses as, as a bit mask; the masks of a column are merged with a
bitwise AND, which combines on the map side, in any order and over any number of
files.  The narrowest type left is the column's; beside the mask only the
longest integer part and fraction are kept, for the precision of a decimal.
No cell is sampled, so a table opened with the result never holds a cell that
does not fit its column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NUMERIC_TEXT, aggregate_to_long, col

# Cell texts that stand for a missing value.
MISSING = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

BOOLEAN, LONG, DECIMAL, DOUBLE, DATE, TIMESTAMP = (1 << i for i in range(6))
EVERY = (1 << 6) - 1

WHOLE = r"^\s*[+-]?\d+\s*$"
PLAIN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"
DAY = r"^\d{4}-\d{2}-\d{2}$"
MOMENT = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"


def given(cell: Column, missing: Sequence[str] = MISSING) -> Column:
    """A cell's text, null where it stands for a missing value."""
    return F.when(~cell.isin(*missing), cell)


def cell_types(text: Column) -> Column:
    """The set of types a text parses as, as a mask; 0 leaves only the string."""
    number = F.trim(text)
    return (
        F.when(
            text.rlike(WHOLE),
            F.when(number.try_cast("bigint").isNotNull(), LONG | DECIMAL | DOUBLE).otherwise(
                DECIMAL | DOUBLE
            ),
        )
        .when(text.rlike(PLAIN), DECIMAL | DOUBLE)
        .when(text.rlike(NUMERIC_TEXT), DOUBLE)
        .when(F.lower(text).isin("true", "false"), BOOLEAN)
        .when(text.rlike(DAY) & text.try_cast("date").isNotNull(), DATE | TIMESTAMP)
        .when(text.rlike(MOMENT) & text.try_cast("timestamp_ntz").isNotNull(), TIMESTAMP)
        .otherwise(0)
    )


def column_profile(raw: DataFrame, missing: Sequence[str] = MISSING) -> DataFrame:
    """One row per column: mask of types, given cells, longest integer part and fraction."""

    def row(name: str) -> Column:
        text = given(col(name), missing)
        plain = F.when(text.rlike(PLAIN), F.ltrim(F.trim(text), F.lit("+-")))
        whole = F.ltrim(F.substring_index(plain, ".", 1), F.lit("0"))
        fraction = F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise("")
        return F.struct(
            F.lit(name).alias("column"),
            F.coalesce(F.bit_and(F.when(text.isNotNull(), cell_types(text))), F.lit(EVERY)).alias(
                "types"
            ),
            F.count(text).alias("n"),
            F.coalesce(F.max(F.length(whole)), F.lit(0)).alias("digits"),
            F.coalesce(F.max(F.length(fraction)), F.lit(0)).alias("scale"),
        )

    return aggregate_to_long(raw, [row(c) for c in raw.columns])


def narrowest(
    types: int, n: int, digits: int, scale: int, decimals: bool = False, dates: bool = False
) -> T.DataType:
    """The narrowest type of a mask; a column without a given cell is a double."""
    if n == 0:
        return T.DoubleType()
    if types & BOOLEAN:
        return T.BooleanType()
    if types & LONG:
        return T.LongType()
    if types & DECIMAL and decimals and max(digits, 1) + scale <= 38:
        return T.DecimalType(max(digits, 1) + scale, scale)
    if types & DOUBLE:
        return T.DoubleType()
    if dates and types & DATE:
        return T.DateType()
    if dates and types & TIMESTAMP:
        return T.TimestampNTZType()
    return T.StringType()


def infer_schemas(
    raws: Mapping[str, DataFrame],
    missing: Sequence[str] = MISSING,
    decimals: bool = False,
    dates: bool = False,
) -> dict[str, T.StructType]:
    """Schemas of text tables; one job examines all of them.

    ``decimals`` gives numbers with a fraction the decimal that holds them all
    exactly, ``dates`` recognises ISO dates and moments; without them such
    columns are doubles and strings.
    """
    profiles = [
        column_profile(raw, missing).select(F.lit(name).alias("table"), "*")
        for name, raw in raws.items()
        if raw.columns
    ]
    if not profiles:
        return {name: T.StructType() for name in raws}
    found = reduce(DataFrame.unionAll, profiles).collect()  # one row per column
    kinds = {
        (r["table"], r["column"]): narrowest(
            r["types"], r["n"], r["digits"], r["scale"], decimals, dates
        )
        for r in found
    }
    return {
        name: T.StructType([T.StructField(c, kinds[name, c]) for c in raw.columns])
        for name, raw in raws.items()
    }


def typed(raw: DataFrame, schema: T.StructType, missing: Sequence[str] = MISSING) -> DataFrame:
    """A text table with the types of a schema; a cell that does not fit is an error."""

    def cell(f: T.StructField) -> Column:
        text = given(col(f.name), missing)
        if isinstance(f.dataType, T.StringType):
            return text.alias(f.name)
        return F.trim(text).cast(f.dataType).alias(f.name)

    return raw.select(*[cell(f) for f in schema.fields])


def open_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV file or folder with a header, every column as text; nothing is read but the header.

    ``multi_line`` allows line ends inside quotes; such a file is read by one task.
    """
    return (
        spark.read.option("header", True)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )


def open_inferred(
    spark: SparkSession,
    paths: Mapping[str, str],
    missing: Sequence[str] = MISSING,
    decimals: bool = False,
    dates: bool = False,
    multi_line: bool = False,
) -> dict[str, DataFrame]:
    """Open CSV tables by name with the types their cells have."""
    raws = {name: open_text(spark, path, multi_line) for name, path in paths.items()}
    schemas = infer_schemas(raws, missing, decimals, dates)
    return {name: typed(raw, schemas[name], missing) for name, raw in raws.items()}
