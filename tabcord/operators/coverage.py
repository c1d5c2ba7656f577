"""Measure that is not assigned to a mapping value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import aggregate_to_long, clean, col, is_blank, percent


def unmapped_share(
    df: DataFrame, columns: Sequence[str], measure: str, rows: str | None = None
) -> DataFrame:
    """Per column: rows and measure where the column is null or blank.

    All columns are examined in one pass.  ``rows`` names a row-count column of
    a pre-aggregated table, so that ``n_rows`` counts original rows.  WARNING
    only when the unmapped measure is above zero.
    """
    value = clean(df, measure)
    total = F.coalesce(F.sum(value), F.lit(0))

    def row(name: str) -> Column:
        blank = is_blank(clean(df, name))
        unmapped = F.coalesce(F.sum(F.when(blank, value)), F.lit(0))
        n_rows = F.sum(F.when(blank, col(rows) if rows else F.lit(1)))
        return F.struct(
            F.lit(name).alias("column"),
            F.count_if(blank).alias("n_unmapped"),
            F.coalesce(n_rows, F.lit(0)).cast("long").alias("n_rows"),
            unmapped.alias("unmapped_measure"),
            F.bround(F.coalesce(percent(unmapped, total), F.lit(0.0)), 1).alias("pct"),
            total.alias("total_measure"),
            F.when(unmapped > 0, "WARNING").otherwise("PASS").alias("status"),
        )

    return aggregate_to_long(df, [row(c) for c in columns])


def unmapped_breakdown(
    df: DataFrame, columns: Sequence[str], ids: Sequence[str], measure: str
) -> DataFrame:
    """Per column: unmapped measure of each identifier combination, and its share.

    The share is relative to mapped plus unmapped measure.  One grouping of the
    table serves all columns; the total re-reads that grouping's shuffle output.
    """
    value = clean(df, measure)
    numbers = range(len(columns))
    blank = [is_blank(clean(df, c)) for c in columns]
    groups = (
        df.select(
            *[clean(df, c).alias(c) for c in ids],
            value.alias("_all"),
            *[F.when(blank[i], value).alias(f"_m{i}") for i in numbers],
            *[F.when(blank[i], 1).alias(f"_n{i}") for i in numbers],
        )
        .groupBy(*[col(c) for c in ids])
        .agg(
            F.sum("_all").alias("_all"),
            *[F.sum(f"_m{i}").alias(f"_m{i}") for i in numbers],
            *[F.count(f"_n{i}").alias(f"_n{i}") for i in numbers],
        )
    )
    # always true; both readers then use the same columns and share one shuffle
    sums = ["_all", *[f"_m{i}" for i in numbers]]
    counts = F.greatest(F.lit(0), *[F.col(f"_n{i}") for i in numbers])
    groups = groups.where((counts >= 0) | F.greatest(*sums).isNull())
    total = groups.agg(F.sum("_all").cast("double")).scalar()
    each = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"_m{i}").alias("_unmapped"),
                F.col(f"_n{i}").alias("_blank"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return (
        groups.select(*[col(c) for c in ids], F.inline(each))
        .where("_blank > 0")
        .select(
            "column",
            *[col(c) for c in ids],
            F.coalesce("_unmapped", F.lit(0)).alias(measure),
            F.bround(percent(F.coalesce("_unmapped", F.lit(0)), total), 1).alias("pct"),
        )
    )
