"""Find, read, pre-aggregate and write the tables of a run."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean, col
from ..functions.durable import materialise
from ..functions.exact import exact_sums
from ..rules import roles
from ..rules import rulepack as rp
from .inference import open_inferred

log = logging.getLogger(__name__)


class MissingFact(LookupError):
    """There is no fact table, so nothing can be checked."""


@dataclass(frozen=True)
class TableSet:
    """The tables of a run by role; everything but fact and mapping is a reference.

    ``rows`` names the row-count column of a pre-aggregated fact, and
    ``fact_columns`` the columns the fact had before it was aggregated.
    """

    fact: DataFrame
    mapping: DataFrame | None = None
    refs: dict[str, DataFrame] = field(default_factory=dict)
    notes: tuple[str, ...] = ()
    rows: str | None = None
    fact_columns: tuple[str, ...] | None = None

    @classmethod
    def classify(cls, tables: Mapping[str, DataFrame], notes: Iterable[str] = ()) -> TableSet:
        if rp.FACT not in tables:
            raise MissingFact(f"{rp.FACT} not found — cannot run checks.")
        refs = {n: df for n, df in tables.items() if n not in (rp.FACT, rp.MAPPING)}
        return cls(tables[rp.FACT], tables.get(rp.MAPPING), refs, tuple(notes))

    def registered(self) -> list[str]:
        """Columns of the fact as it was loaded."""
        return list(self.fact_columns or self.fact.columns)

    def names(self) -> list[str]:
        return [rp.FACT, *([rp.MAPPING] if self.mapping is not None else []), *self.refs]


def _missing(error: Exception) -> bool:
    return isinstance(error, AnalysisException) and error.getCondition() in (
        "PATH_NOT_FOUND",
        "TABLE_OR_VIEW_NOT_FOUND",
    )


def load_tables(
    spark: SparkSession,
    names: Sequence[str] = rp.KNOWN_TABLES,
    directory: str | None = None,
    schemas: Mapping[str, T.StructType | str] | None = None,
) -> tuple[dict[str, DataFrame], list[str]]:
    """Open every named table that exists, as Parquet in a folder or from the catalogue.

    A missing table is skipped; one that cannot be opened is skipped with a
    note.  Nothing is read yet; with declared schemas not even file footers.
    """
    found, notes = {}, []
    for name in names:
        reader = spark.read
        if schemas and name in schemas:
            reader = reader.schema(schemas[name])
        try:
            if directory:
                found[name] = reader.parquet(f"{directory}/{name}.parquet")
            else:
                found[name] = spark.table(name)
        except Exception as e:  # one unreadable table must not stop the others
            if not _missing(e):
                reason = str(e).splitlines()[0]
                log.warning("cannot open %s: %s", name, reason)
                notes.append(f"{name} could not be opened: {reason}")
    return found, notes


def load_csv_tables(
    spark: SparkSession, directory: str, schemas: Mapping[str, T.StructType | str]
) -> dict[str, DataFrame]:
    """Open the CSV files ``<name>.csv`` that exist, with declared types."""
    found = {}
    for name, schema in schemas.items():
        try:
            reader = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
            found[name] = reader.csv(f"{directory}/{name}.csv")
        except AnalysisException as e:
            if not _missing(e):
                raise
    return found


def csv_tables(
    spark: SparkSession,
    directory: str,
    schemas: Mapping[str, T.StructType | str] | None = None,
    prefix: str = "tbl_",
    infer: bool | None = None,
) -> tuple[dict[str, DataFrame], list[str]]:
    """Find the CSV tables of a folder and open them, with a note for each without a schema.

    The folder is listed by Spark, so it may lie in any store; a table is a
    file or a folder named ``<prefix>*.csv``.  With ``infer`` (the default
    without any ``schemas``) a table without a declared schema gets the types
    that all its cells have; else it is reported, not guessed.
    """
    infer = schemas is None if infer is None else infer
    schemas = schemas or {}
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
        name = F.regexp_extract("path", rf"/({prefix}[^/]*)\.csv(/[^/]*)?$", 1)
        names = [r[0] for r in files.select(name).where(name != "").distinct().collect()]
    except AnalysisException as e:
        if not _missing(e):
            raise
        names = []
    known = {n: schemas[n] for n in sorted(names) if n in schemas}
    others = [n for n in sorted(names) if n not in schemas]
    found = load_csv_tables(spark, directory, known)
    if infer:
        return found | open_inferred(spark, {n: f"{directory}/{n}.csv" for n in others}), []
    notes = [f"{n}.csv has no declared schema" for n in others]
    for note in notes:
        log.warning(note)
    return found, notes


def preaggregate(
    fact: DataFrame,
    keys: Sequence[str],
    measure: str = rp.MEASURE,
    rows_as: str | None = None,
    exact: str | None = None,
) -> DataFrame:
    """Sum the measure per key combination, optionally with the number of rows.

    A floating measure is summed in the order in which rows arrive; ``exact``
    names a decimal type to sum it in, so that the result never depends on it,
    or is "double": the exact sum of the doubles themselves, correctly rounded.
    """
    if exact == "double" and measure in fact.columns:
        rows = fact.select(
            *[clean(fact, k).alias(k) for k in keys], clean(fact, measure).alias(measure)
        )
        return exact_sums(rows, keys, [measure], rows_as)
    value = col(measure).cast(exact) if exact else col(measure)
    aggs = [F.sum(value).alias(measure)] if measure in fact.columns else []
    if rows_as:
        aggs.append(F.count(F.lit(1)).alias(rows_as))
    rows = fact.select(
        *[clean(fact, k).alias(k) for k in keys],
        *([clean(fact, measure).alias(measure)] if measure in fact.columns else []),
    )
    groups = rows.groupBy(*[col(k) for k in keys])
    return groups.agg(*aggs) if aggs else rows.distinct()


def preaggregated(
    tables: TableSet, path: str | None = None, exact: str | None = None, store: bool = True
) -> TableSet:
    """Replace the fact table by its stored aggregate, rebuilt on every call.

    The full fact table is read once; every later check reads the aggregate.
    With ``store=False`` the aggregate is only planned, to know its columns.
    """
    others = [df.schema for df in tables.refs.values()]
    if tables.mapping is not None:
        others.append(tables.mapping.schema)
    keys = roles.preaggregation_keys(tables.fact.schema, others)
    rows = "n_rows"
    while rows in tables.fact.columns:
        rows += "_"
    sums = preaggregate(tables.fact, keys, rows_as=rows, exact=exact)
    small = materialise(sums, rp.FACT, path) if store else sums
    return replace(tables, fact=small, rows=rows, fact_columns=tuple(tables.fact.columns))
