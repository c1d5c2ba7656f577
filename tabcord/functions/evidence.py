"""Bounded evidence: a few rows of a possibly huge result, kept as JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import clean, col


def json_record(columns: Sequence[Column]) -> Column:
    """One JSON object of the given columns, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def row_json(df: DataFrame, columns: Sequence[str]) -> Column:
    """One JSON object per row; NaN and null both appear as ``null``."""
    return json_record([clean(df, c).alias(c) for c in columns])


def top_records(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows as (rank, record) pairs, the record in JSON.

    ``order`` lists column names, with a leading ``-`` for descending.  Only the
    ``limit`` rows that survive the distributed top-k are ranked.
    """
    sort = [col(o[1:]).desc() if o.startswith("-") else col(o).asc() for o in order]
    head = df.orderBy(*sort).limit(limit)
    rank = F.row_number().over(Window.orderBy(*sort)).cast("int")
    return head.select(rank.alias("rank"), row_json(df, df.columns).alias("record"))


def collect_top(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], record: Column, limit: int
) -> DataFrame:
    """At most ``limit`` records per group as one array column ``evidence``.

    The rank filter becomes a map-side group limit, so a group of any size
    sends at most ``limit`` rows per task through the shuffle; records are
    built from the rows that are left.
    """
    groups = [col(c) for c in by]
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    kept = df.withColumn("_rank", rank).where(F.col("_rank") <= limit)
    kept = kept.select(*groups, "_rank", record.alias("_record"))
    ranked = F.sort_array(F.collect_list(F.struct("_rank", "_record")))
    return kept.groupBy(*groups).agg(
        F.transform(ranked, lambda x: x["_record"]).alias("evidence")
    )
