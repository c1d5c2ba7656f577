"""Run all checks over a set of tables and roll the findings up."""

from __future__ import annotations

import logging
import time
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, fields, replace
from datetime import UTC, datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import local_rows
from ..functions.durable import materialise
from ..sources.tables import MissingFact, TableSet, preaggregated
from ..rules import rulepack as rp
from .checks import CHECKS, FAILED, tables_read
from .findings import (
    DEGRADED,
    FINDING,
    SEVERITY,
    check_records,
    nested,
    section_rollup,
    stated,
)
from .report import Report

log = logging.getLogger(__name__)

METADATA = (
    "status string, summary string, started_at_utc string, completed_at_utc string, "
    "runtime_ms bigint, dataset_count int, dataset_names array<string>, "
    "warnings array<string>, errors array<string>"
)


@dataclass(frozen=True)
class Run:
    """Everything a run found: findings, sections, records per check, full rows, times.

    ``details`` holds every row behind the findings (unmatched and orphaned
    keys, duplicates, invalid values, failing sequences, unmapped groups);
    findings show a few of them as evidence.  ``records`` has one row per check
    as reported, table checks combined per table.  ``timings`` has the
    milliseconds of each check.
    """

    findings: DataFrame
    sections: DataFrame
    metadata: DataFrame
    details: DataFrame
    records: DataFrame
    timings: DataFrame

    def write(self, path: str, fmt: str = "parquet") -> None:
        """Write the tables below ``path`` as Parquet or JSON."""
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").format(fmt).save(f"{path}/{f.name}")

    def payload(self) -> DataFrame:
        """The run as one nested row: run, its sections, their checks, their findings."""
        return nested(self.findings, self.sections, self.records, self.metadata)


TIMING = "label string, ms bigint"


def _degraded(spark: SparkSession, label: str, warning: str, tables: TableSet) -> DataFrame:
    """Safe SKIP findings in place of a check that could not run."""
    section, names, _ = CHECKS[label]
    base = {"section": section, "status": "SKIP", "detail": FAILED, "warning": warning}
    rows = [{**base, "check": c, "table": t} for c in names for t in sorted(tables.refs)]
    if section == "check6":
        rows = [{**base, "check": "mapping_uniqueness", "table": rp.MAPPING}]
    return stated(spark, rows or [{**base, "check": DEGRADED}])


def collect_findings(
    tables: TableSet, path: str | None = None, report: Report | None = None
) -> tuple[DataFrame, list[str]]:
    """The findings of all checks, and the warnings of those that could not run."""
    report = report or Report(tables.fact.sparkSession, path or "")
    findings, warnings, _ = timed_findings(tables, report)
    return findings, warnings


@dataclass(frozen=True)
class Outcome:
    """What one check found: rows of :data:`FINDING`, warnings, time, and whether it could run."""

    label: str
    rows: list[tuple]
    warnings: list[str]
    ms: int
    degraded: bool = False


def run_check(label: str, tables: TableSet, report: Report) -> Outcome:
    """Run a check; if it fails its findings are safe SKIPs and the error a warning.

    A check is lazy until its findings are gathered, so the guard encloses
    that.  Findings are bounded by the schemas and the evidence they show.
    """
    spark, started = tables.fact.sparkSession, time.perf_counter()
    place = FINDING.fieldNames().index("warning")
    failed = False
    try:
        rows = [tuple(r) for r in CHECKS[label][2](tables, report).collect()]
        warnings = sorted({r[place] for r in rows if r[place] is not None})
    except Exception as e:
        log.warning("%s failed: %s", label, e)
        text = f"{label} degraded: {str(e).splitlines()[0] if str(e) else repr(e)}"
        rows = [tuple(r) for r in _degraded(spark, label, text, tables).collect()]
        warnings, failed = [text], True
    ms = int((time.perf_counter() - started) * 1000)
    log.info("%s: %d ms", label, ms)
    return Outcome(label, rows, warnings, ms, failed or bool(warnings))


def outcomes(
    labels: Sequence[str],
    report: Callable[[str], Report],
    ready: Callable[[str], TableSet],
    spark: SparkSession,
) -> list[Outcome]:
    """Run checks together, so that small stages of one fill the executors another leaves idle.

    ``ready`` gives the tables of a check once they are prepared.
    """
    if not labels:
        return []
    job = lambda label: run_check(label, ready(label), report(label))
    with ThreadPoolExecutor(len(labels)) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(job), label) for label in labels]
        return [j.result() for j in jobs]


def store_findings(spark: SparkSession, rows: list[tuple], path: str) -> DataFrame:
    return materialise(local_rows(spark, rows, FINDING).coalesce(1), "findings", path)


def timed_findings(
    tables: TableSet,
    report: Report,
    labels: Sequence[str] = tuple(CHECKS),
    ready: Callable[[str], TableSet] | None = None,
) -> tuple[DataFrame, list[str], list[tuple[str, int]]]:
    """Findings of checks, stored together, their warnings and their times.

    Each check runs on its own; a failing one becomes a warning, the rest go on.
    """
    spark = tables.fact.sparkSession
    done = outcomes(labels, lambda label: report, ready or (lambda label: tables), spark)
    rows = [r for d in done for r in d.rows]
    return (
        store_findings(spark, rows, f"{report.folder}/findings"),
        [w for d in done for w in d.warnings],
        [(d.label, d.ms) for d in done],
    )


class Prepared:
    """The tables as the checks read them, each computed once and stored while checks run.

    The fact is stored summed over the columns that a check needs.  A reference
    or the mapping is stored if several of the chosen checks read it, since it
    may be derived; ``store=False`` spares that for plain files.  Tables that
    no chosen check reads are left alone.
    """

    def __init__(
        self,
        tables: TableSet,
        report: Report,
        aggregate: bool,
        exact: str | None,
        store: bool,
        labels: Sequence[str],
    ):
        spark = tables.fact.sparkSession
        scratch = f"{report.folder}/scratch/tables"
        self.reads = {label: tables_read(label, tables) for label in labels}
        readers = Counter(t for read in self.reads.values() for t in read)
        self.planned = preaggregated(tables, exact=exact, store=False) if aggregate else tables
        self.pool = ThreadPoolExecutor(8)
        self.jobs: dict[str, Future] = {}
        submit = lambda f, *a: self.pool.submit(inheritable_thread_target(spark)(f), *a)
        if aggregate and rp.FACT in readers:
            self.jobs[rp.FACT] = submit(
                materialise, self.planned.fact, rp.FACT, f"{scratch}/{rp.FACT}"
            )
        for name, df in {**tables.refs, rp.MAPPING: tables.mapping}.items():
            if store and df is not None and readers[name] > 1:
                self.jobs[name] = submit(materialise, df, name, f"{scratch}/{name}")

    def __call__(self, label: str) -> TableSet:
        """The tables of a check, as soon as those it reads are stored."""
        done = {t: self.jobs[t].result() for t in self.reads[label] if t in self.jobs}
        return replace(
            self.planned,
            fact=done.get(rp.FACT, self.planned.fact),
            mapping=done.get(rp.MAPPING, self.planned.mapping),
            refs={name: done.get(name, df) for name, df in self.planned.refs.items()},
        )

    def finish(self) -> None:
        """Wait for every table; an error of one is raised."""
        self.pool.shutdown()
        for job in self.jobs.values():
            job.result()


def run_checks(
    tables: TableSet,
    aggregate: bool = True,
    path: str | None = None,
    started: datetime | None = None,
    evidence_rows: int = rp.EVIDENCE_ROWS,
    exact: str | None = None,
    store_references: bool = True,
    checks: Sequence[str] = tuple(CHECKS),
) -> Run:
    """All checks (or those named), each table read once, and only tables they need.

    Findings and details stay below ``path``; intermediates are removed at the
    end and on failure.  ``evidence_rows`` limits what a finding shows, never
    the details.  ``exact`` names a decimal type in which the measure is
    summed, so that results do not depend on the order of rows.
    """
    spark, started = tables.fact.sparkSession, started or datetime.now(UTC)
    report = Report(spark, path or "", evidence_rows)
    try:
        ready = Prepared(tables, report, aggregate, exact, store_references, checks)
        return _checked(ready, report, started, checks)
    finally:
        report.clear()


def _checked(ready: Prepared, report: Report, started: datetime, checks: Sequence[str]) -> Run:
    tables = ready.planned
    try:
        findings, warnings, times = timed_findings(tables, report, checks, ready)
    finally:
        ready.finish()
    return rolled_up(tables, report, started, findings, warnings, times, report.details())


def rolled_up(
    tables: TableSet,
    report: Report,
    started: datetime,
    findings: DataFrame,
    warnings: list[str],
    times: list[tuple[str, int]],
    details: DataFrame,
) -> Run:
    """The run that findings make."""
    spark = tables.fact.sparkSession
    warnings = [*tables.notes, *warnings]
    sections = materialise(section_rollup(findings), "", f"{report.folder}/sections")
    found = [r["status"] for r in sections.select("status").collect()]  # one per section
    status = max(found, key=SEVERITY.index, default="SKIP")
    status = "WARNING" if warnings and status in ("SKIP", "PASS") else status
    n = len(tables.names())
    row = _metadata_row(
        status, f"Overall: {status} — {n} table(s) loaded.", started, tables.names(), warnings, []
    )
    return Run(
        findings,
        sections,
        local_rows(spark, [row], METADATA),
        details,
        check_records(findings),
        local_rows(spark, times, TIMING),
    )


def _metadata_row(status, summary, started, names, warnings, errors) -> tuple:
    done = datetime.now(UTC)
    ms = int((done - started).total_seconds() * 1000)
    return (
        status,
        summary,
        started.isoformat(),
        done.isoformat(),
        ms,
        len(names),
        list(names),
        list(warnings),
        list(errors),
    )


def guarded_run(
    spark: SparkSession,
    load: Callable[[], tuple[Mapping[str, DataFrame], list[str]]],
    aggregate: bool = True,
    path: str | None = None,
    evidence_rows: int = rp.EVIDENCE_ROWS,
    exact: str | None = None,
    store_references: bool = True,
    checks: Sequence[str] = tuple(CHECKS),
) -> Run:
    """Load and run; a failure before the checks yields a FAIL run without sections.

    The options are those of :func:`run_checks`.
    """
    started = datetime.now(UTC)
    names: list[str] = []
    report = Report(spark, path or "", evidence_rows)
    try:
        try:
            found, notes = load()
            names = list(found)
            tables = TableSet.classify(found, notes)
            ready = Prepared(tables, report, aggregate, exact, store_references, checks)
            ready.finish()
        except Exception as e:
            log.error("set-up failed: %s", e)
            if isinstance(e, MissingFact):
                text = summary = str(e)
            else:
                text = f"Fatal setup error: {e}"
                summary = "Fatal setup error before checks could run."
            row = _metadata_row("FAIL", summary, started, names, [], [text])
            empty = local_rows(spark, [], FINDING)
            return Run(
                empty,
                section_rollup(empty).where(F.lit(False)),
                local_rows(spark, [row], METADATA),
                report.details(),
                check_records(empty),
                local_rows(spark, [], TIMING),
            )
        return _checked(ready, report, started, checks)
    finally:
        report.clear()
