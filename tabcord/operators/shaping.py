"""Natural join, placeholder rows, period strings, display projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean, col, require_same_kind

# Key texts that mark a row as a placeholder.
PLACEHOLDERS = ("Dummy", "dummy", "Not in use", "not in use", "Not in Use")
PLACEHOLDER_KEY = "Not in Use"
HOWS = ("inner", "left", "right", "outer")


def natural_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "left",
    keys: Sequence[str] | None = None,
    suffix: str = "",
    split_hot_keys: bool | None = None,
) -> DataFrame:
    """Join on the shared (or given) columns; null keys match null keys.

    Without shared columns the left table comes back unchanged.  Other columns
    that both tables have get ``suffix`` on the right side; an empty suffix
    with such a clash is an error.  ``how="cross"`` is not offered.

    Spark broadcasts a side only after checking its size, and adaptive
    execution splits a hot key of an inner join on both sides but of an outer
    join only on the preserved side, never of a full one.  With
    ``split_hot_keys`` an outer join is expressed as the inner join plus the
    rows without a partner, whose own lookup side is reduced to distinct keys:
    then every part can be split.  Right and full joins do so unless told not
    to; a left join keeps its preserved side as it is and needs it only where
    the right side has the hot key.
    """
    if split_hot_keys is None:
        split_hot_keys = how in ("right", "outer")
    if how not in HOWS:
        raise ValueError(f"how must be one of {HOWS}, not {how!r}")
    keys = list(keys) if keys else [c for c in right.columns if c in left.columns]
    if not keys:
        return left
    require_same_kind(left, right, keys)

    renamed = {c: c + suffix if c in left.columns else c for c in right.columns if c not in keys}
    names = [*left.columns, *renamed.values()]
    if len(set(names)) != len(names):
        raise ValueError(f"the suffix {suffix!r} leaves duplicate column names in {names}")

    r_key = {k: f"__r{i}" for i, k in enumerate(keys)}
    r = right.select(
        *[clean(right, k).alias(r_key[k]) for k in keys],
        *[col(c).alias(n) for c, n in renamed.items()],
        F.lit(True).alias("__right"),
    )
    l = left.select(*[clean(left, c).alias(c) if c in keys else col(c) for c in left.columns])
    on = [col(k).eqNullSafe(col(r_key[k])) for k in keys]

    def shaped(df: DataFrame) -> DataFrame:
        def key(k: str) -> Column:
            if how in ("inner", "left"):
                return col(k)
            return F.when(col("__right"), col(r_key[k])).otherwise(col(k)).alias(k)

        return df.select(
            *[key(c) if c in keys else col(c) for c in left.columns],
            *[col(n) for n in renamed.values()],
        )

    if not split_hot_keys or how == "inner":
        return shaped(l.join(r, on, how))

    parts = [shaped(l.join(r, on, "inner"))]
    if how in ("left", "outer"):
        seen = r.select(*r_key.values()).distinct()
        parts.append(l.join(seen, on, "left_anti"))
    if how in ("right", "outer"):
        seen = l.select(*[col(k) for k in keys]).distinct()
        lonely = r.join(seen, on, "left_anti").drop("__right")
        parts.append(lonely.withColumnsRenamed({v: k for k, v in r_key.items()}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*[col(n) for n in names])


def key_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "Key" in c]


def is_placeholder(df: DataFrame, keys: Sequence[str] | None = None) -> Column:
    """True for rows with a placeholder text in any key column (null keys are real)."""
    flag = F.lit(False)
    for k in key_columns(df) if keys is None else keys:
        flag = flag | F.coalesce(col(k).cast("string").isin(*PLACEHOLDERS), F.lit(False))
    return flag


def without_placeholders(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    return df.where(~is_placeholder(df, keys))


def dataset_is_in_use(df: DataFrame, keys: Sequence[str] | None = None) -> bool:
    """Whether any row is not a placeholder; stops at the first such row."""
    return not without_placeholders(df, keys).isEmpty()


def placeholder_report(
    tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Per table: all rows, placeholder rows, and whether the table is in use."""
    parts = []
    for name, df in tables.items():
        flag = is_placeholder(df, (keys or {}).get(name))
        parts.append(
            df.agg(
                F.count(F.lit(1)).alias("n_rows"), F.count_if(flag).alias("n_placeholder")
            ).select(
                F.lit(name).alias("table"),
                "n_rows",
                "n_placeholder",
                (F.col("n_rows") > F.col("n_placeholder")).alias("in_use"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def not_in_use_row(df: DataFrame) -> DataFrame:
    """One placeholder row with the columns and types of ``df``; other than text keys are null."""

    def cell(f: T.StructField) -> Column:
        if "Key_" in f.name and isinstance(f.dataType, T.StringType):
            return F.lit(PLACEHOLDER_KEY)
        if f.name == "Comments":
            return F.lit("")
        return F.lit(None).cast(f.dataType)

    return df.sparkSession.range(1).select(*[cell(f).alias(f.name) for f in df.schema.fields])


def fill_empty_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every empty table replaced by its placeholder row, the others unchanged."""
    # one job finds the tables that hold a row
    heads = [df.limit(1).select(F.lit(n).alias("name")) for n, df in tables.items()]
    held = {r["name"] for r in reduce(DataFrame.unionAll, heads).collect()} if heads else set()
    return {n: df if n in held else not_in_use_row(df) for n, df in tables.items()}


def _ends(text: Column) -> Column:
    """First and last year of a range; null unless both are years from 1 to 9999."""
    ends = F.transform(F.split(F.trim(text), "-"), lambda t: F.trim(t).try_cast("int"))
    year = F.forall(ends, lambda y: F.coalesce(y.between(1, 9999), F.lit(False)))
    return F.when((F.size(ends) <= 2) & year, ends)


def year_range(text: Column) -> Column:
    """``"2018-2022"`` or ``"2018"`` as an ascending array of years.

    A reversed range and a text that is no range have none.
    """
    ends = _ends(text)
    first, last = F.element_at(ends, 1), F.element_at(ends, -1)
    return F.when(first <= last, F.sequence(first, last)).otherwise(
        F.array().cast("array<int>")
    )


def _problem(text: Column) -> Column:
    ends = _ends(text)
    return F.when(ends.isNull(), "malformed").when(
        F.element_at(ends, 1) > F.element_at(ends, -1), "reversed"
    )


def expand_periods(df: DataFrame, column: str) -> DataFrame:
    """Add ``include_years``, ``exclude_years`` and ``problem`` of strings like ``a-b ex c-d``.

    The excluded years stay in the included ones, as two separate lists.
    ``problem`` is null, or says that a part is missing, malformed or reversed;
    such a part has no years.
    """
    parts = F.split(col(column), "ex")
    excluded = F.when(F.size(parts) > 1, year_range(F.get(parts, 1)))
    other = F.when(F.size(parts) > 1, _problem(F.get(parts, 1)))
    problem = F.when(col(column).isNull(), "missing").otherwise(
        F.coalesce(_problem(F.get(parts, 0)), other)
    )
    return df.withColumns(
        {
            "include_years": year_range(F.get(parts, 0)),
            "exclude_years": F.coalesce(excluded, F.array().cast("array<int>")),
            "problem": problem,
        }
    )


def period_years(df: DataFrame, column: str) -> DataFrame:
    """One row per included year, with ``year``, whether it is ``excluded``, and ``problem``.

    A period without years keeps one row, whose year is null.
    """
    lists = expand_periods(df, column)
    return lists.select(
        *[col(c) for c in df.columns],
        F.explode_outer("include_years").alias("year"),
        "exclude_years",
        "problem",
    ).select(
        *[col(c) for c in df.columns],
        "year",
        F.coalesce(F.array_contains("exclude_years", F.col("year")), F.lit(False)).alias("excluded"),
        "problem",
    )


def period_intervals(df: DataFrame, column: str) -> DataFrame:
    """One row per unbroken run of years of a period: ``first_year`` and ``last_year``.

    The excluded years are cut out of the included ones, which leaves at most
    two runs.  A period without years left has no row.
    """
    parts = F.split(col(column), "ex")
    ends = _ends(F.get(parts, 0))
    cut = F.when(F.size(parts) > 1, _ends(F.get(parts, 1)))
    first, last = F.element_at(ends, 1), F.element_at(ends, -1)
    low, high = F.element_at(cut, 1), F.element_at(cut, -1)
    run = lambda a, b: F.struct(a.alias("first_year"), b.alias("last_year"))
    runs = F.when(
        low <= high, F.array(run(first, F.least(last, low - 1)), run(F.greatest(first, high + 1), last))
    ).otherwise(F.array(run(first, last)))
    return df.select(
        *[col(c) for c in df.columns],
        F.inline(F.filter(runs, lambda r: r["first_year"] <= r["last_year"])),
    )


#: Years that share a bucket of the interval join.
PERIOD_BUCKET = 16


def period_join(
    rows: DataFrame,
    year_col: str,
    periods: DataFrame,
    period_col: str,
    on: Sequence[str] = (),
) -> DataFrame:
    """Rows with every period that includes their year and does not exclude it.

    ``on`` names columns that must be equal too (null equals null).  Periods
    stay intervals: both sides get the bucket of years they fall into, a period
    one row per bucket it meets, so the join is one of equal keys and buckets
    with a comparison inside, whatever the length of a period.  The columns of
    ``periods`` other than ``on`` follow those of ``rows``; a name that both
    have is an error.  Rows without a year meet no period.
    """
    extra = [c for c in periods.columns if c not in on]
    if clash := sorted(set(extra) & set(rows.columns)):
        raise ValueError(f"columns of both tables: {clash}")
    require_same_kind(rows, periods, on)
    runs = period_intervals(periods, period_col)
    bucket = lambda year: F.floor(year / PERIOD_BUCKET)
    right = runs.select(
        *[clean(periods, c).alias(f"__k{i}") for i, c in enumerate(on)],
        *[col(c).alias(f"__v{i}") for i, c in enumerate(extra)],
        F.col("first_year").alias("__first"),
        F.col("last_year").alias("__last"),
        F.explode(F.sequence(bucket(F.col("first_year")), bucket(F.col("last_year")))).alias("__b"),
    )
    year = col(year_col).cast("long")
    same = bucket(year) == F.col("__b")
    for i, c in enumerate(on):
        same = same & clean(rows, c).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(right, same & year.between(F.col("__first"), F.col("__last"))).select(
        *[col(c) for c in rows.columns],
        *[F.col(f"__v{i}").alias(c) for i, c in enumerate(extra)],
    )


def period_suffix(text: Column) -> Column:
    """A period string made fit for a column name."""
    return F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("-"), F.lit("_"))


def display_columns(df: DataFrame, display: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Only the display columns and extras that exist; everything if none does."""
    keep = [c for c in df.columns if c in display or c in extra]
    return df.select(*[col(c) for c in keep]) if keep else df
