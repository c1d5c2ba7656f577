"""Runs that repeat only the checks whose tables changed or that could not run.

The result of a check is kept in a folder named after everything it depends on:
the content of the tables it reads, the columns of all others, and the options
of the run.  A later run looks for that folder; what it finds it takes over, the
rest it runs.  A check that was degraded leaves no folder, so it runs again, and
a run that ends halfway keeps the checks that were done.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean
from ..functions.durable import exists, remove
from ..rules import rulepack as rp
from ..sources.tables import TableSet
from .checks import CHECKS, tables_read
from .findings import FINDING
from .report import Report
from .run import Outcome, Prepared, Run, outcomes, rolled_up, store_findings

#: Raised when the meaning of a check changes, so that kept results are not taken over.
VERSION = 1


def content_mark(df: DataFrame) -> list[Column]:
    """Aggregates that tell the rows of a table, in any order and partitioning: 128 bits and a count."""
    cells = [clean(df, c) for c in df.columns]
    marks = [
        F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")).cast("string")
        for seed in (1, 2)
    ]
    return [F.concat_ws(":", F.count(F.lit(1)).cast("string"), *marks).alias("mark")]


def fingerprints(tables: Mapping[str, DataFrame]) -> dict[str, str]:
    """A fingerprint of the rows of each table, in one job that reads each once."""
    if not tables:
        return {}
    parts = [
        df.agg(*content_mark(df)).select(F.lit(name).alias("table"), "mark")
        for name, df in tables.items()
    ]
    return {r["table"]: r["mark"] for r in reduce(DataFrame.unionAll, parts).collect()}


def check_key(label: str, tables: TableSet, marks: Mapping[str, str], options: Mapping) -> str:
    """A digest of everything that a check's result depends on."""
    frames = {rp.FACT: tables.fact, rp.MAPPING: tables.mapping, **tables.refs}
    schemas = {n: df.dtypes for n, df in sorted(frames.items()) if df is not None}
    reads = {t: marks[t] for t in sorted(tables_read(label, tables))}
    whole = json.dumps([VERSION, label, schemas, reads, dict(options)], sort_keys=True)
    return hashlib.sha256(whole.encode()).hexdigest()[:32]


def resumed_run(
    tables: TableSet,
    path: str,
    marks: Mapping[str, str] | None = None,
    aggregate: bool = True,
    evidence_rows: int = rp.EVIDENCE_ROWS,
    exact: str | None = None,
    store_references: bool = True,
    checks: Sequence[str] = tuple(CHECKS),
) -> Run:
    """A run that takes over, below ``path``, the results of checks whose tables are unchanged.

    ``marks`` may give fingerprints of tables (a version, a list of files);
    those missing are computed from the rows.  The options are those of
    :func:`run_checks`.  Times of checks that were taken over are 0.
    """
    spark, started = tables.fact.sparkSession, datetime.now(UTC)
    frames = {rp.FACT: tables.fact, rp.MAPPING: tables.mapping, **tables.refs}
    read = set().union(*(tables_read(label, tables) for label in checks))
    known = dict(marks or {})
    known |= fingerprints({t: frames[t] for t in sorted(read) if t not in known})
    options = {"aggregate": aggregate, "evidence_rows": evidence_rows, "exact": exact}
    place = {
        label: f"{path}/checks/{label.replace(' ', '_')}/{check_key(label, tables, known, options)}"
        for label in checks
    }
    todo = [label for label in checks if not exists(spark, f"{place[label]}/findings/_SUCCESS")]
    reports = {label: Report(spark, place[label], evidence_rows) for label in checks}
    work = Report(spark, path, evidence_rows)
    for label in todo:
        remove(spark, place[label])  # what an interrupted run left
    try:
        ready = Prepared(tables, work, aggregate, exact, store_references, todo)
        try:
            done = {o.label: o for o in outcomes(todo, reports.__getitem__, ready, spark)}
        finally:
            ready.finish()
        for label, outcome in done.items():
            if not outcome.degraded:
                store_findings(spark, outcome.rows, f"{place[label]}/findings")
        for label in set(checks) - set(todo):
            stored = spark.read.schema(FINDING).parquet(f"{place[label]}/findings")
            done[label] = Outcome(label, [tuple(r) for r in stored.collect()], [], 0)
        done = [done[label] for label in checks]
        findings = store_findings(spark, [r for o in done for r in o.rows], f"{path}/findings")
        details = [reports[label].stored_details() for label in checks]
        return rolled_up(
            ready.planned,
            work,
            started,
            findings,
            [w for o in done for w in o.warnings],
            [(o.label, o.ms) for o in done],
            reduce(DataFrame.unionByName, details),
        )
    finally:
        work.clear()
        for report in reports.values():
            report.clear()
