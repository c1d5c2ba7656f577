"""Column roles, read from schemas only: no function here touches any data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

from ..functions.columns import is_numeric
from . import rulepack as rp


@dataclass(frozen=True)
class Roles:
    """What the columns of a reference table are for, seen from the fact.

    ``join`` are the columns by which a fact row finds its reference row: those
    of both tables that hold no numbers in the reference, the exempt key aside.
    The other roles are parts of it, in its order.
    """

    join: tuple[str, ...]

    @classmethod
    def of(cls, ref: T.StructType, fact: T.StructType) -> Roles:
        shared = {*fact.fieldNames()} - {rp.EXEMPT_KEY}
        return cls(tuple(f.name for f in ref.fields if f.name in shared and not is_numeric(f.dataType)))

    @property
    def keys(self) -> tuple[str, ...]:
        """Columns that hold keys by their name."""
        return tuple(c for c in self.join if c.startswith(rp.KEY_PREFIX))

    @property
    def shown(self) -> tuple[str, ...]:
        """Columns that a report shows: all but years and development months."""
        return tuple(c for c in self.join if c not in rp.STRUCTURAL)

    @property
    def context(self) -> tuple[str, ...]:
        """Shown columns that are no keys: they must be parents of the keys."""
        return tuple(c for c in self.shown if c not in self.keys)


def categorical(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not is_numeric(f.dataType)]


def join_key(ref: T.StructType, fact: T.StructType) -> list[str]:
    return list(Roles.of(ref, fact).join)


def key_cols(names: Iterable[str]) -> list[str]:
    return [c for c in names if c.startswith(rp.KEY_PREFIX)]


def display_cols(ref: T.StructType, fact: T.StructType) -> list[str]:
    return list(Roles.of(ref, fact).shown)


def context_cols(ref: T.StructType, fact: T.StructType) -> list[str]:
    return list(Roles.of(ref, fact).context)


def uniqueness_key(table: str, ref: T.StructType, fact: T.StructType) -> list[str]:
    """Columns whose combination may occur once only in a reference table."""
    names = ref.fieldNames()
    payload = {rp.FORECAST: "Key_Modelling", rp.TREND: rp.TREND_VALUE}
    if table in payload:
        return [c for c in names if c != payload[table]]
    extra = [*rp.YEARS, rp.DEVELOPMENT] if table in rp.PATTERN_TABLES else list(rp.YEARS)
    base = join_key(ref, fact)
    return base + [c for c in extra if c in names and c not in base]


def forecast_context(ref: T.StructType) -> list[str]:
    return [
        c
        for c in categorical(ref)
        if not c.startswith(rp.KEY_PREFIX) and c not in rp.STRUCTURAL
    ]


def forecast_measure(ref: T.StructType, key: Sequence[str]) -> str | None:
    """First numeric column outside the key that has "prem" in its name."""
    hits = (
        f.name
        for f in ref.fields
        if f.name not in key and "prem" in f.name.lower() and is_numeric(f.dataType)
    )
    return next(hits, None)


def identifier_cols(mapping: T.StructType | None, fact: T.StructType) -> list[str]:
    """Mapping columns, other than keys, by which fact rows can be described."""
    if mapping is None:
        return []
    names = mapping.fieldNames()
    skip = {*key_cols(names), rp.MEASURE}
    return [c for c in names if c in fact.fieldNames() and c not in skip]


def pattern_key(ref: T.StructType) -> str | None:
    return next((c for c in key_cols(ref.fieldNames()) if "Pattern" in c), None)


def with_prefix(schema: T.StructType, prefix: str) -> list[str]:
    return [c for c in schema.fieldNames() if c.startswith(prefix)]


def first_matching(names: Sequence[str], candidates: Sequence[str]) -> str:
    """First candidate among the column names."""
    for c in candidates:
        if c in names:
            return c
    raise KeyError(f"none of {list(candidates)} is a column")


def preaggregation_keys(
    fact: T.StructType,
    others: Iterable[T.StructType],
    always_keep: Sequence[str] = (rp.MODELLING_PREFIX,),
) -> list[str]:
    """Fact columns worth keeping when the fact table is pre-aggregated.

    Categorical columns that some loaded table also has, always the month
    column, never the measure.  ``always_keep`` lists prefixes of columns that
    later checks need although no other table has them.
    """
    known = {c for s in others for c in s.fieldNames()}
    keys = []
    for f in fact.fields:
        if f.name == rp.MEASURE:
            continue
        wanted = f.name in known or f.name.startswith(tuple(always_keep))
        if f.name == rp.MONTH or (wanted and not is_numeric(f.dataType)):
            keys.append(f.name)
    return keys


def preaggregated_schema(
    fact: T.StructType, keys: Sequence[str], measure: str = rp.MEASURE
) -> T.StructType:
    """Schema of the pre-aggregated fact table: keys in order, then the measure."""
    missing = [k for k in keys if k not in fact.fieldNames()]
    if missing:
        raise ValueError(f"grouping columns {missing} are not in the fact table")
    value = fact[measure].dataType if measure in fact.fieldNames() else T.DoubleType()
    return T.StructType([fact[k] for k in keys] + [T.StructField(measure, value)])
