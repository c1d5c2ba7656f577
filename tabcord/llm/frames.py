"""Small shared pieces: text columns, bounded samples and stored steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabcord.functions.durable import materialise  # noqa: F401  (used by the operators)


def text_of(name: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def by_batch(
    df: DataFrame,
    step: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None],
    schema: str | T.StructType,
) -> DataFrame:
    """Apply a function from Arrow batch to Arrow batch in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = step(batch) if batch.num_rows else None
            if out is None:
                continue
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def whole_row(df: DataFrame, **named: Column) -> DataFrame:
    """The row as one struct ``row`` beside named working columns, so that names cannot clash."""
    return df.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in named.items()))


def with_row(df: DataFrame, columns: str) -> T.StructType:
    """The schema of a struct ``row`` of the frame's columns and further columns."""
    return T.StructType([T.StructField("row", df.schema), *T.StructType.fromDDL(columns).fields])


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
