"""Value ranges, formats and sequence completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import aggregate_to_long, as_number, clean, is_numeric, mean, share

# Wording of the result sentences.
BAND_DETAIL = "%.1f%% outside [−{0}, +{0}]"
BAND_SCALE_HINT = " — likely entered as percentages not decimals"
EXCEED_FAIL_DETAIL = "%.1f%% of values > {ceiling} (threshold: >{fail}%%)"
EXCEED_DETAIL = "Mean = %.4f; %.1f%% of values > {ceiling}"
MONTH_INVALID_DETAIL = "%d value(s) not in valid YYYYMM format: [%s]"
MONTH_MANY_DETAIL = "Multiple {column} values found: [%s]"
MONTH_ONE_DETAIL = "Single valid value: %s"
NUMERIC_FAIL_DETAIL = "%d non-numeric value(s) found"
NUMERIC_LOW_DETAIL = "Only %.1f%% of values < {ceiling} (expected ≥{floor}%%)"
NUMERIC_DETAIL = "%.1f%% of values < {ceiling}"
STARTS_REASON = "starts at %d (expected {start})"
GAPS_REASON = "gaps at [%s]%s"
SHORT_REASON = "max {pos} = %d (< {min_last} required)"


def band_status(pct_inner: Column, pct_outer: Column, warn_pct: float, fail_pct: float) -> Column:
    """FAIL by the share outside the outer band, else WARNING by that outside the inner one."""
    return (
        F.when(pct_outer > fail_pct, "FAIL").when(pct_inner > warn_pct, "WARNING").otherwise("PASS")
    )


def exceed_status(
    average: Column,
    pct_above: Column,
    mean_lo: float,
    mean_hi: float,
    warn_pct: float,
    fail_pct: float,
) -> Column:
    """FAIL by the share above the ceiling, else WARNING by a smaller share or an odd mean."""
    suspicious = (average < mean_lo) | (average > mean_hi) | (pct_above > warn_pct)
    return F.when(pct_above > fail_pct, "FAIL").when(suspicious, "WARNING").otherwise("PASS")


def months_status(n_distinct: Column, n_invalid: Column) -> Column:
    """SKIP without a value, FAIL on an invalid or a second one."""
    return (
        F.when(n_distinct == 0, "SKIP")
        .when((n_invalid > 0) | (n_distinct > 1), "FAIL")
        .otherwise("PASS")
    )


def numeric_status(n_non_numeric: Column, pct_below: Column, min_pct: float) -> Column:
    """FAIL on a cell that is no number, else WARNING by the share below the ceiling."""
    return (
        F.when(n_non_numeric > 0, "FAIL").when(pct_below < min_pct, "WARNING").otherwise("PASS")
    )


def sequence_broken(
    first: Column, last: Column, n_held: Column, start: int, min_last: int
) -> Column:
    """Whether held positions do not run from the start, without a gap, far enough."""
    return (first != start) | (last - first + 1 > n_held) | (last < min_last)


def band_share(
    df: DataFrame,
    columns: Sequence[str],
    inner: float = 0.2,
    outer: float = 0.5,
    warn_pct: float = 10,
    fail_pct: float = 50,
) -> DataFrame:
    """Share of values outside two symmetric bands around zero, one row per column.

    FAIL when more than ``fail_pct`` percent lie outside the outer band, else
    WARNING when more than ``warn_pct`` percent lie outside the inner one.
    Band edges count as inside; a column without values yields no row.
    """

    def row(name: str) -> Column:
        v = clean(df, name)
        n = F.count(v)
        return F.struct(
            F.lit(name).alias("column"),
            n.alias("n"),
            share(F.abs(v) > inner, n).alias("pct_inner"),
            share(F.abs(v) > outer, n).alias("pct_outer"),
        )

    rows = aggregate_to_long(df, [row(c) for c in columns]).where("n > 0")
    too_wide = F.col("pct_outer") > fail_pct
    return rows.select(
        "column",
        "n",
        F.bround("pct_inner", 1).alias("pct_inner"),
        F.bround("pct_outer", 1).alias("pct_outer"),
        band_status(F.col("pct_inner"), F.col("pct_outer"), warn_pct, fail_pct).alias("status"),
        F.when(
            too_wide,
            F.format_string(
                BAND_DETAIL.format(outer) + BAND_SCALE_HINT, F.bround("pct_outer", 1)
            ),
        )
        .otherwise(F.format_string(BAND_DETAIL.format(inner), F.bround("pct_inner", 1)))
        .alias("detail"),
    )


def exceed_share(
    df: DataFrame,
    columns: Sequence[str],
    ceiling: float = 1,
    mean_lo: float = 0.7,
    mean_hi: float = 1.0,
    warn_pct: float = 5,
    fail_pct: float = 20,
) -> DataFrame:
    """Mean and share of values above a ceiling, one row per column with values."""

    def row(name: str) -> Column:
        v = clean(df, name)
        n = F.count(v)
        return F.struct(
            F.lit(name).alias("column"),
            n.alias("n"),
            mean(v).alias("mean"),
            share(v > ceiling, n).alias("pct_above"),
        )

    rows = aggregate_to_long(df, [row(c) for c in columns]).where("n > 0")
    failed = F.col("pct_above") > fail_pct
    status = exceed_status(
        F.col("mean"), F.col("pct_above"), mean_lo, mean_hi, warn_pct, fail_pct
    )
    words = {"ceiling": f"{ceiling:g}", "fail": f"{fail_pct:g}"}
    return rows.select(
        "column",
        "n",
        F.bround("mean", 4).alias("mean"),
        F.bround("pct_above", 1).alias("pct_above"),
        status.alias("status"),
        F.when(failed, F.format_string(EXCEED_FAIL_DETAIL.format(**words), F.bround("pct_above", 1)))
        .otherwise(
            F.format_string(
                EXCEED_DETAIL.format(**words), F.bround("mean", 4), F.bround("pct_above", 1)
            )
        )
        .alias("detail"),
    )


def is_yyyymm(value: Column) -> Column:
    """Six digits whose last two are a month; fractions are cut, spaces ignored."""
    text = value.try_cast("long").cast("string")
    month = F.substring(text, 5, 2).try_cast("int")
    return F.coalesce(text.rlike(r"^\d{6}$") & month.between(1, 12), F.lit(False))


def month_values(df: DataFrame, column: str) -> DataFrame:
    """(value, valid): the distinct values of a month column."""
    value = clean(df, column)
    if not is_numeric(df.schema[column].dataType):
        value = value.cast("string")
    return (
        df.select(value.alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.lit(1).alias("one"))
        .select("value", is_yyyymm(F.col("value")).alias("valid"))
    )


def yyyymm_check(df: DataFrame, column: str, shown: int = 5) -> DataFrame:
    """One row: distinct and invalid months, a few of them, the status.

    FAIL on any invalid value and on more than one distinct value; SKIP when
    the column holds no value at all.  ``values`` and ``sample`` list the first
    ``shown`` values, the invalid ones before the others; all of them are in
    :func:`month_values`.
    """
    return months_summary(month_values(df, column), column, shown)


def months_summary(values: DataFrame, column: str, shown: int = 5) -> DataFrame:
    """The row of :func:`yyyymm_check` from the distinct values."""
    text = F.col("value").cast("string")
    first = (
        values.orderBy("valid", "value")
        .limit(shown)
        .agg(F.sort_array(F.collect_list(F.struct("valid", "value", text.alias("text")))).alias("r"))
        .select(F.transform("r", lambda r: r["text"]))
        .scalar()
    )
    n, bad = F.col("n_distinct"), F.col("n_invalid")
    return (
        values.agg(
            F.count(F.lit(1)).alias("n_distinct"), F.count_if(~F.col("valid")).alias("n_invalid")
        )
        .withColumn("values", first)
        .withColumn("sample", F.array_join("values", ", "))
        .select(
            "n_distinct",
            "n_invalid",
            months_status(n, bad).alias("status"),
            "values",
            "sample",
            F.when(n == 0, "No values.")
            .when(bad > 0, F.format_string(MONTH_INVALID_DETAIL, bad, F.col("sample")))
            .when(n > 1, F.format_string(MONTH_MANY_DETAIL.format(column=column), F.col("sample")))
            .otherwise(F.format_string(MONTH_ONE_DETAIL, F.col("sample")))
            .alias("detail"),
        )
    )


def sequence_check(
    df: DataFrame, key: str, pos: str, start: int = 1, min_last: int = 120, shown: int = 5
) -> DataFrame:
    """Keys whose whole-number positions do not run from ``start`` to ``min_last``.

    Returns key, first, last, n_gaps, gaps (the first few missing positions) and
    the reasons.  A position marks itself and announces its successor; grouping
    the marks by (key, position) shows where runs begin and where holes begin.
    Only the first few run edges of each key are ever brought together, so
    neither a hot key nor a huge range builds a large group.
    """
    p = clean(df, pos).cast("long")
    cells = df.select(clean(df, key).alias("key"), p.alias("pos")).where(F.col("pos").isNotNull())
    marks = (
        cells.select(
            "key",
            F.explode(
                F.array(
                    F.struct(F.col("pos").alias("pos"), F.lit(True).alias("held")),
                    F.struct((F.col("pos") + 1).alias("pos"), F.lit(False).alias("held")),
                )
            ).alias("m"),
        )
        .groupBy("key", F.col("m.pos").alias("pos"))
        .agg(
            F.bool_or("m.held").alias("held"),
            F.bool_or(~F.col("m.held")).alias("follows"),
        )
    )
    # where a run of held positions begins, and the hole behind it; few rows per key
    edges = marks.where(F.col("held") != F.col("follows")).select("key", "held", "pos")
    exact = F.col("pos").cast("decimal(38,0)")
    spans = (
        edges.groupBy("key")
        .agg(
            F.min(F.when(F.col("held"), F.col("pos"))).alias("first"),
            (F.max(F.when(~F.col("held"), F.col("pos"))) - 1).alias("last"),
            F.sum(F.when(F.col("held"), -exact).otherwise(exact)).cast("long").alias("n_held"),
        )
        .withColumn("n_gaps", F.col("last") - F.col("first") + 1 - F.col("n_held"))
        .where((F.col("first") != start) | (F.col("n_gaps") > 0) | (F.col("last") < min_last))
    )
    # the i-th hole lies between the i-th hole start and the (i+1)-th run start
    in_order = Window.partitionBy("key", "held").orderBy("pos")
    nth_edge = lambda held, n: F.max(
        F.when((F.col("held") == F.lit(held)) & (F.col("nth") == n), F.col("pos"))
    )
    nth_hole = lambda n: F.when(
        F.col(f"run{n}").isNotNull(),
        F.sequence(
            F.col(f"hole{n}"),
            F.least(F.col(f"run{n}") - 1, F.col(f"hole{n}") + (shown - 1)),
        ),
    )
    holes = range(1, shown + 1)
    listing = (
        edges.select("key", "held", "pos", F.row_number().over(in_order).alias("nth"))
        .where(F.col("nth") <= shown + 1)
        .groupBy(F.col("key").alias("gap_key"))
        .agg(
            *[nth_edge(False, n).alias(f"hole{n}") for n in holes],
            *[nth_edge(True, n + 1).alias(f"run{n}") for n in holes],
        )
        .where("run1 is not null")
        .select(
            "gap_key",
            F.slice(
                F.flatten(F.array_compact(F.array(*[nth_hole(n) for n in holes]))), 1, shown
            ).alias("missing"),
        )
    )
    listed = F.coalesce(F.array_join("missing", ", "), F.lit(""))
    reasons = F.concat_ws(
        "; ",
        F.when(
            F.col("first") != start, F.format_string(STARTS_REASON.format(start=start), "first")
        ),
        F.when(
            F.col("n_gaps") > 0,
            F.format_string(
                GAPS_REASON, listed, F.when(F.col("n_gaps") > shown, "…").otherwise("")
            ),
        ),
        F.when(
            F.col("last") < min_last,
            F.format_string(SHORT_REASON.format(pos=pos, min_last=min_last), "last"),
        ),
    )
    return spans.join(listing, F.col("key").eqNullSafe(F.col("gap_key")), "left").select(
        F.col("key").alias(key),
        "first",
        "last",
        "n_gaps",
        listed.alias("gaps"),
        reasons.alias("reasons"),
    )


def numeric_share(
    df: DataFrame, columns: Sequence[str], ceiling: float = 3, min_pct: float = 95
) -> DataFrame:
    """Cells that are not numbers, and the share below a ceiling, one row per column.

    FAIL on any non-numeric value, else WARNING when fewer than ``min_pct``
    percent lie below the ceiling (a column without values counts as 100).
    """

    def row(name: str) -> Column:
        v = clean(df, name)
        number = v.cast("double") if is_numeric(df.schema[name].dataType) else as_number(v)
        n_numeric = F.count(number)
        return F.struct(
            F.lit(name).alias("column"),
            F.count(F.lit(1)).alias("n"),
            (F.count(v) - n_numeric).alias("n_non_numeric"),
            F.coalesce(share(number < ceiling, n_numeric), F.lit(100.0)).alias("pct_below"),
        )

    rows = aggregate_to_long(df, [row(c) for c in columns])
    bad, below = F.col("n_non_numeric"), F.col("pct_below")
    rounded = F.bround(below, 1)
    words = {"ceiling": f"{ceiling:g}", "floor": f"{min_pct:g}"}
    return rows.select(
        "column",
        "n",
        "n_non_numeric",
        rounded.alias("pct_below"),
        numeric_status(bad, below, min_pct).alias("status"),
        F.when(bad > 0, F.format_string(NUMERIC_FAIL_DETAIL, bad))
        .when(below < min_pct, F.format_string(NUMERIC_LOW_DETAIL.format(**words), rounded))
        .otherwise(F.format_string(NUMERIC_DETAIL.format(**words), rounded))
        .alias("detail"),
    )
