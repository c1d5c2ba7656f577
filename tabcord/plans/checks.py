"""The consistency checks: operators bound to the rule pack, as findings.

Each function returns one findings DataFrame that covers all tables, so the
work is shared between the reference tables of a run.  The rows behind the
findings go to the report in full; a finding itself shows a few of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.columns import KeyTypeClash, col, local_rows, percent, require_same_kind
from ..functions.columns import clean
from ..functions.evidence import collect_top, json_record, row_json
from ..operators import coverage, integrity, ranges, uniqueness
from ..sources.tables import TableSet
from ..rules import roles
from ..rules import rulepack as rp
from .findings import FINDING, as_findings, metrics, stated
from .report import Report

# Wording of the results.
NO_JOIN_KEY = "No common non-numeric columns with DetailedData"
NO_UNIQUE_KEY = "No join key columns identified"
NO_MAPPING = "tbl_Key_Mapping not loaded"
NO_MAPPING_COLS = "No non-Key_* columns in tbl_Key_Mapping"
ALL_PASSED = "All checks passed."
FAILED = "Check failed"


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _spark(tables: TableSet):
    return tables.fact.sparkSession


def _static(tables: TableSet, rows: list[dict]) -> list[DataFrame]:
    return [stated(_spark(tables), rows)] if rows else []


def _nothing(tables: TableSet) -> DataFrame:
    return local_rows(_spark(tables), [], FINDING)


def _named(tables: TableSet, keys: dict[str, list[str]]) -> DataFrame:
    """(table, key_cols) rows, one per examined table."""
    return local_rows(
        _spark(tables), list(keys.items()), "table string, key_cols array<string>"
    )


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _numbered(columns: list[str]) -> dict[str, str]:
    """Neutral names for data columns, so that none can clash with a result column."""
    return {c: f"key{i}" for i, c in enumerate(dict.fromkeys(columns))}


def _renamed(df: DataFrame, short: dict[str, str], *others: str | None) -> DataFrame:
    return df.select(
        *[col(c).alias(n) for c, n in short.items() if c in df.columns],
        *[col(c) for c in others if c],
    )


def _json(**fields: str) -> str:
    """A record of a few names as Spark writes it."""
    return json.dumps(fields, ensure_ascii=False, separators=(",", ":"))


def share_of(part, whole) -> float | None:
    """``part`` in percent of ``whole``; none without either, or of nothing."""
    if part is None or whole is None or not float(whole):
        return None
    return float(part) / float(whole) * 100.0


def local_total(tables: TableSet, measure: str):
    """The measure of the whole fact: one number."""
    return tables.fact.agg(F.sum(clean(tables.fact, measure)).alias("total")).first()["total"]


def _pass_fail(n_bad: Column) -> Column:
    return F.when(n_bad > 0, "FAIL").otherwise("PASS")


def key_registration(tables: TableSet, report: Report | None = None) -> DataFrame:
    """Check 1: every key column of a reference is a fact and a mapping column.

    The fact counts with the columns it was loaded with, aggregated or not.
    """
    targets = {rp.FACT: tables.registered()}
    if tables.mapping is not None:
        targets[rp.MAPPING] = tables.mapping.columns
    rows = []
    for table, ref in tables.refs.items():
        keys = roles.key_cols(ref.columns)
        missing = sorted(
            (key, target)
            for key in keys
            for target, columns in targets.items()
            if key != rp.EXEMPT_KEY and key not in columns
        )
        found = f"{len(missing)} missing key column registration(s)"
        rows.append(
            {
                "section": "check1",
                "check": "key_registration",
                "table": table,
                "key_cols": keys,
                "status": "FAIL" if missing else "PASS",
                "n_bad": len(missing),
                "detail": found if missing else "All Key_* columns registered.",
                "evidence": [_json(key_col=k, missing_from=t) for k, t in missing] or None,
            }
        )
    return stated(_spark(tables), rows)


def referential_integrity(tables: TableSet, report: Report | None = None) -> DataFrame:
    """Checks 2 and 3: fact keys without a reference row, reference keys without facts.

    A table whose key columns have another kind of type than the fact's is
    left out with a warning; the others are checked.
    """
    fact, report = tables.fact, report or Report(_spark(tables))
    measure = rp.MEASURE if rp.MEASURE in fact.columns else None
    keys = {t: roles.join_key(df.schema, fact.schema) for t, df in tables.refs.items()}
    without = [
        {"section": "checks2_5", "check": c, "table": t, "status": "SKIP", "detail": NO_JOIN_KEY}
        for t, k in keys.items()
        if not k
        for c in ("forward_ri", "reverse_ri")
    ]
    clashing = {}
    for t, k in keys.items():
        try:
            require_same_kind(fact, tables.refs[t], k)
        except KeyTypeClash as e:
            clashing[t] = f"Checks 2-3 degraded: {e}"
    without += [
        {
            "section": "checks2_5",
            "check": c,
            "table": t,
            "status": "SKIP",
            "detail": FAILED,
            "warning": text,
        }
        for t, text in clashing.items()
        for c in ("forward_ri", "reverse_ri")
    ]
    keys = {t: k for t, k in keys.items() if k and t not in clashing}
    parts = _static(tables, without)
    if not keys:
        return union(parts) if parts else _nothing(tables)

    ref_measure = (
        roles.forecast_measure(tables.refs[rp.FORECAST].schema, keys[rp.FORECAST])
        if rp.FORECAST in keys
        else None
    )
    total = fact.agg(F.sum(clean(fact, measure))).scalar() if measure else F.lit(None)
    short = _numbered([k for key in keys.values() for k in key])
    own = {rp.FORECAST: ref_measure}
    # raw rows are grouped once; an aggregated fact is small enough to count per table
    count = integrity.key_census_many if tables.rows else integrity.key_census_tree
    census = count(
        _renamed(fact, short, measure),
        {t: _renamed(tables.refs[t], short, own.get(t)) for t in keys},
        {t: [short[k] for k in key] for t, key in keys.items()},
        measure,
        (rp.FORECAST, ref_measure) if ref_measure else None,
    )
    record = F.lit(None).cast("string")
    for table, key in keys.items():
        forward = [col(short[k]).alias(k) for k in key]
        reverse = list(forward)
        if measure:
            pct = F.bround(percent(F.col("measure"), total), 1)
            forward += [F.col("measure").alias(rp.MEASURE), pct.alias(f"{rp.MEASURE}_%")]
        if table == rp.FORECAST and ref_measure:
            reverse.append(F.col("right_measure").alias(ref_measure))
        shown = F.when(integrity.only_left(), json_record(forward)).otherwise(json_record(reverse))
        record = F.when(F.col("ref_table") == table, shown).otherwise(record)
    # stored once: every summary below reads these keys only, not the census again
    loose = report.stash(
        census.where(integrity.only_left() | integrity.only_right()).select(
            "ref_table",
            "n_left",
            "n_right",
            "measure",
            "right_measure",
            *short.values(),
        ),
        "loose_keys",
    )
    one_way = loose.withColumn("forward", integrity.only_left())
    has_value = F.lit(bool(measure)) & F.col("forward")
    has_value = has_value | (
        ~F.col("forward") & (F.col("ref_table") == (rp.FORECAST if ref_measure else ""))
    )
    value = F.when(F.col("forward"), F.col("measure")).otherwise(F.col("right_measure"))
    report.keep(
        one_way,
        F.when(F.col("forward"), "forward_ri").otherwise("reverse_ri"),
        table="ref_table",
        record=record,
        n_rows=F.col("n_left") + F.col("n_right"),
        measure=F.when(has_value, value),
        pct=F.when(F.col("forward"), percent(F.col("measure"), total)) if measure else F.lit(None),
    )
    counts = loose.groupBy(F.col("ref_table").alias("table")).agg(
        F.count_if(integrity.only_left()).alias("n_unmatched"),
        F.sum(F.when(integrity.only_left(), F.col("measure"))).alias("unmatched_measure"),
        F.count_if(integrity.only_right()).alias("n_orphaned"),
        F.sum(F.when(integrity.only_right(), F.col("right_measure"))).alias("orphaned_measure"),
    )
    order = [F.col("measure").desc(), F.col("right_measure").desc(), *short.values()]
    evidence = collect_top(
        one_way,
        ["ref_table", "forward"],
        order,
        record,
        max(report.evidence_rows, report.top_rows),
    ).withColumnRenamed("ref_table", "table")
    # at most one row per reference table, and two with evidence
    figures = {r["table"]: r for r in counts.collect()}
    shown = {(r["table"], r["forward"]): r["evidence"] for r in evidence.collect()}
    whole = local_total(tables, measure) if measure and figures else None
    rows = []
    for table, key in keys.items():
        of = figures.get(table)
        n_fwd, n_rev = (of["n_unmatched"], of["n_orphaned"]) if of else (0, 0)
        lost = of["unmatched_measure"] if of and measure else None
        own = of["orphaned_measure"] if of and table == rp.FORECAST and ref_measure else None
        base = {"section": "checks2_5", "table": table, "key_cols": list(key)}
        rows.append(
            {
                **base,
                "check": "forward_ri",
                "status": "FAIL" if n_fwd else "PASS",
                "n_bad": n_fwd,
                "measure_bad": None if lost is None else float(lost),
                "pct": share_of(lost, whole),
                "detail": f"Forward RI: {n_fwd} unmatched combination(s)" if n_fwd else ALL_PASSED,
                "evidence": (shown.get((table, True)) or [])[: report.top_rows] or None,
            }
        )
        rows.append(
            {
                **base,
                "check": "reverse_ri",
                "status": "WARNING" if n_rev else "PASS",
                "n_bad": n_rev,
                "measure_bad": None if own is None else float(own),
                "detail": f"Reverse RI: {n_rev} orphaned combination(s)" if n_rev else ALL_PASSED,
                "evidence": (shown.get((table, False)) or [])[: report.evidence_rows] or None,
            }
        )
    return union([*parts, stated(_spark(tables), rows)])


def _duplicates(
    tables: TableSet,
    report: Report,
    check: str,
    frames: dict[str, DataFrame],
    keys: dict[str, list[str]],
) -> dict[str, Row | None]:
    """Per table: number of duplicated combinations, rows covered, evidence."""
    parts = []
    for table, key in keys.items():
        short = _numbered(key)
        d = uniqueness.duplicate_keys(_renamed(frames[table], short), list(short.values()))
        record = json_record([col(n).alias(c) for c, n in short.items()])
        parts.append(d.select(F.lit(table).alias("table"), "n_rows", record.alias("record")))
    dups = report.keep(union(parts), check, table="table", record="record", n_rows="n_rows")
    counts = dups.groupBy("table").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("n_rows")
    )
    order = [F.col("n_rows").desc(), F.col("record").asc()]
    top = collect_top(dups, ["table"], order, F.col("record"), report.evidence_rows)
    # at most one row per table
    figures = {r["table"]: r for r in counts.join(top, "table").collect()}
    return {t: figures.get(t) for t in keys}


UNIQUENESS = "Uniqueness: %d duplicate combination(s)"


def _repeated(
    section: str, check: str, table: str, key: list[str], found: Row | None, told: str, passed: str
) -> dict:
    """The finding of one table's repeated keys."""
    n = found["n"] if found else 0
    return {
        "section": section,
        "check": check,
        "table": table,
        "key_cols": list(key),
        "status": "FAIL" if n else "PASS",
        "n_bad": n,
        "metrics": {"n_rows": float(found["n_rows"]) if found else 0.0},
        "detail": told % n if n else passed,
        "evidence": found["evidence"] if found else None,
    }


def row_uniqueness(tables: TableSet, report: Report | None = None) -> DataFrame:
    """Check 4: the uniqueness key occurs once per reference table."""
    report = report or Report(_spark(tables))
    fact = tables.fact.schema
    keys = {t: roles.uniqueness_key(t, df.schema, fact) for t, df in tables.refs.items()}
    parts = _static(
        tables,
        [
            {
                "section": "checks2_5",
                "check": "row_uniqueness",
                "table": t,
                "status": "SKIP",
                "detail": NO_UNIQUE_KEY,
            }
            for t, k in keys.items()
            if not k
        ],
    )
    keys = {t: k for t, k in keys.items() if k}
    if keys:
        found = _duplicates(tables, report, "row_uniqueness", tables.refs, keys)
        rows = [
            _repeated("checks2_5", "row_uniqueness", t, keys[t], r, UNIQUENESS, ALL_PASSED)
            for t, r in found.items()
        ]
        parts.append(stated(_spark(tables), rows))
    return union(parts) if parts else _nothing(tables)


def parent_columns(tables: TableSet, report: Report | None = None) -> DataFrame:
    """Check 5: context columns are parents of the key columns; known values only."""
    fact, spark = tables.fact, _spark(tables)
    report = report or Report(spark)
    wanted: list[tuple[str, str, str, str]] = []  # table, table examined, key column, column
    domain: list[str] = []
    for table, ref in tables.refs.items():
        if table == rp.FORECAST:
            context = roles.forecast_context(ref.schema)
            if rp.EXEMPT_KEY in ref.columns:
                wanted += [(table, table, rp.EXEMPT_KEY, c) for c in context]
            continue
        keys = roles.key_cols(roles.join_key(ref.schema, fact.schema))
        context = roles.context_cols(ref.schema, fact.schema)
        wanted += [(table, rp.FACT, k, c) for k in keys for c in context]
        if table == rp.MIN_LOAD and keys:
            domain = context

    if not tables.refs:
        return _nothing(tables)
    failing: dict[str, list[tuple[str, str]]] = {t: [] for t in tables.refs}
    for source, df in ((rp.FACT, fact), (rp.FORECAST, tables.refs.get(rp.FORECAST))):
        pairs = [w for w in wanted if w[1] == source]
        if not pairs:
            continue
        found = uniqueness.parent_violations(
            df, list(dict.fromkeys(p[2] for p in pairs)), list(dict.fromkeys(p[3] for p in pairs))
        )
        # at most one row per pair of columns
        bad = {(r["key_col"], r["column"]) for r in found.where("not is_parent").collect()}
        named = [p for p in pairs if (p[2], p[3]) in bad]
        for table, _, key, column in named:
            failing[table].append((key, column))
        if named:
            _keep_conflicts(report, named, df, tables.rows if source == rp.FACT else None)
    rows = [
        {
            "section": "checks2_5",
            "check": "parent_columns",
            "table": table,
            "status": "FAIL" if bad else "PASS",
            "n_bad": len(bad),
            "detail": f"Parent cols: {len(bad)} failing" if bad else ALL_PASSED,
            "evidence": sorted(_json(key_col=k, column=c) for k, c in bad) or None,
        }
        for table, bad in failing.items()
    ]
    parts = [stated(spark, rows)]
    if domain:
        bad_values = report.keep(
            integrity.domain_violations(tables.refs[rp.MIN_LOAD], fact, domain),
            "domain_membership",
            table=F.lit(rp.MIN_LOAD),
            column="column",
            record="value",
        )
        counts = bad_values.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
        value = F.col("record")
        top = collect_top(bad_values, ["column"], [value.asc()], value, report.evidence_rows)
        cols = local_rows(spark, [(c,) for c in domain], "column string")
        rows = cols.join(counts, "column", "left").join(top, "column", "left")
        parts.append(
            as_findings(
                rows,
                "checks2_5",
                "domain_membership",
                table=F.lit(rp.MIN_LOAD),
                column="column",
                status=_pass_fail(_zero("n")),
                n_bad=_zero("n"),
                evidence="evidence",
            )
        )
    return union(parts)


def _keep_conflicts(
    report: Report,
    named: list[tuple[str, str, str, str]],
    df: DataFrame,
    weight: str | None,
) -> None:
    """Keep the values behind failing pairs, once for every table that asks for the pair."""
    pairs = list(dict.fromkeys((p[2], p[3]) for p in named))
    held = uniqueness.parent_conflicts(df, pairs, weight)
    wanted = local_rows(
        report.spark,
        [(p[0], p[2], p[3]) for p in named],
        "table string, key_col string, column string",
    )
    told = json_record([F.col(c) for c in ("key_col", "key_value", "column", "value", "is_majority", "n_remove")])
    report.keep(
        held.join(F.broadcast(wanted), ["key_col", "column"]),
        "parent_columns",
        table="table",
        column="column",
        record=told,
        n_rows="n_rows",
    )


def mapping_uniqueness(tables: TableSet, report: Report | None = None) -> DataFrame:
    """Check 6: the columns other than keys occur once in the mapping table."""
    report = report or Report(_spark(tables))
    reason = None
    if tables.mapping is None:
        reason = NO_MAPPING
    else:
        key = [c for c in tables.mapping.columns if not c.startswith(rp.KEY_PREFIX)]
        reason = None if key else NO_MAPPING_COLS
    if reason:
        row = {
            "section": "check6",
            "check": "mapping_uniqueness",
            "table": rp.MAPPING,
            "status": "SKIP",
            "detail": reason,
        }
        return stated(_spark(tables), [row])
    found = _duplicates(
        tables, report, "mapping_uniqueness", {rp.MAPPING: tables.mapping}, {rp.MAPPING: key}
    )
    row = _repeated(
        "check6",
        "mapping_uniqueness",
        rp.MAPPING,
        key,
        found[rp.MAPPING],
        "%d duplicate non-Key_* combination(s).",
        "No duplicate combinations.",
    )
    return stated(_spark(tables), [row])


def value_ranges(tables: TableSet, report: Report | None = None) -> DataFrame:
    """Check 7: rates, trends, development, month, sequences, minimum loads."""
    refs, parts = tables.refs, []
    report = report or Report(_spark(tables))

    for table, name in [*[(t, rp.RATE) for t in rp.RATE_TABLES], (rp.TREND, rp.TREND_VALUE)]:
        if table in refs and name in refs[table].columns:
            parts.append(
                as_findings(
                    ranges.band_share(refs[table], [name], **rp.RATE_BANDS),
                    "check7",
                    "band_share",
                    table=F.lit(table),
                    column="column",
                    status="status",
                    pct="pct_inner",
                    metrics=metrics(
                        n=F.col("n"),
                        pct_outside_02=F.col("pct_inner"),
                        pct_outside_05=F.col("pct_outer"),
                    ),
                    detail="detail",
                )
            )
    for table in rp.PATTERN_TABLES:
        columns = roles.with_prefix(refs[table].schema, rp.DEVELOPMENT_PREFIX) if table in refs else []
        if columns:
            parts.append(
                as_findings(
                    ranges.exceed_share(refs[table], columns, **rp.DEVELOPMENT_LIMITS),
                    "check7",
                    "exceed_share",
                    table=F.lit(table),
                    column="column",
                    status="status",
                    pct="pct_above",
                    metrics=metrics(
                        n=F.col("n"), mean=F.col("mean"), pct_above_1=F.col("pct_above")
                    ),
                    detail="detail",
                )
            )
    if rp.MONTH in tables.fact.columns:
        months = report.stash(ranges.month_values(tables.fact, rp.MONTH), "months")
        # every month of a failing column: an invalid one, or one of several
        several = months.select(F.count(F.lit(1)) > 1).scalar()
        report.keep(
            months.where(~F.col("valid") | several),
            "yyyymm",
            table=F.lit(rp.FACT),
            column=F.lit(rp.MONTH),
            record=F.col("value").cast("string"),
        )
        parts.append(
            as_findings(
                ranges.months_summary(months, rp.MONTH),
                "check7",
                "yyyymm",
                table=F.lit(rp.FACT),
                column=F.lit(rp.MONTH),
                status="status",
                n_bad="n_invalid",
                metrics=metrics(n_distinct=F.col("n_distinct")),
                detail="detail",
                evidence="values",
            )
        )
    for table in rp.PATTERN_TABLES:
        if table in refs and rp.DEVELOPMENT in refs[table].columns:
            key = roles.pattern_key(refs[table].schema)
            if key:
                parts.append(_sequence_finding(table, refs[table], key, report))
    if rp.MIN_LOAD in refs:
        columns = roles.with_prefix(refs[rp.MIN_LOAD].schema, rp.MIN_LOAD_PREFIX)
        if columns:
            parts.append(
                as_findings(
                    ranges.numeric_share(refs[rp.MIN_LOAD], columns, **rp.MIN_LOAD_LIMITS),
                    "check7",
                    "numeric_share",
                    table=F.lit(rp.MIN_LOAD),
                    column="column",
                    status="status",
                    n_bad="n_non_numeric",
                    pct="pct_below",
                    metrics=metrics(n=F.col("n")),
                    detail="detail",
                )
            )
    return union(parts) if parts else _nothing(tables)


def _sequence_finding(table: str, ref: DataFrame, key: str, report: Report) -> DataFrame:
    failing = ranges.sequence_check(ref, key, rp.DEVELOPMENT, **rp.SEQUENCE_LIMITS)
    record = row_json(failing, [key, "first", "last", "reasons"])
    stored = report.keep(
        failing,
        "sequence",
        table=F.lit(table),
        column=F.lit(rp.DEVELOPMENT),
        record=record,
        n_rows="n_gaps",
    )
    top = (
        stored.select("record")
        .orderBy("record")
        .limit(report.evidence_rows)
        .agg(F.sort_array(F.collect_list("record")).alias("evidence"))
    )
    n = F.col("n")
    return as_findings(
        stored.agg(F.count(F.lit(1)).alias("n")).withColumn("evidence", top.scalar()),
        "check7",
        "sequence",
        table=F.lit(table),
        column=F.lit(rp.DEVELOPMENT),
        key_cols=F.array(F.lit(key)),
        status=_pass_fail(n),
        n_bad=n,
        detail=F.when(
            n > 0, F.format_string("%d pattern key(s) with DevM sequence issues", n)
        ).otherwise("All DevM sequences valid (1 to ≥120)"),
        evidence="evidence",
    )


def key_coverage(tables: TableSet, report: Report | None = None) -> DataFrame:
    """Check 8: measure on rows whose modelling key is null or blank."""
    fact, report = tables.fact, report or Report(_spark(tables))
    columns = sorted(roles.with_prefix(fact.schema, rp.MODELLING_PREFIX))
    if rp.MEASURE not in fact.columns or not columns:
        return _nothing(tables)
    ids = roles.identifier_cols(
        tables.mapping.schema if tables.mapping is not None else None, fact.schema
    )
    rows = coverage.unmapped_share(fact, columns, rp.MEASURE, tables.rows)
    if ids:
        short = _numbered(ids)
        groups = coverage.unmapped_breakdown(
            _renamed(fact, short, rp.MEASURE, *columns), columns, list(short.values()), rp.MEASURE
        )
        record = json_record(
            [
                *[col(n).alias(c) for c, n in short.items()],
                col(rp.MEASURE),
                F.col("pct").alias(f"{rp.MEASURE}_%"),
            ]
        )
        stored = report.keep(
            groups, "key_coverage", column="column", record=record, measure=rp.MEASURE, pct="pct"
        )
        order = [F.col("measure").desc(), F.col("record").asc()]
        top = collect_top(stored, ["column"], order, F.col("record"), report.evidence_rows)
        rows = rows.join(top, "column", "left")
    else:
        rows = rows.withColumn("evidence", F.lit(None).cast("array<string>"))
    return as_findings(
        rows,
        "check8",
        "key_coverage",
        column="column",
        status="status",
        n_bad="n_unmapped",
        measure_bad="unmapped_measure",
        pct="pct",
        metrics=metrics(n_rows=F.col("n_rows"), total_measure=F.col("total_measure")),
        detail=F.when(
            F.col("unmapped_measure") > 0,
            F.format_string(
                "%,d unmapped rows — %,.0f premium (%.1f%% of total)",
                F.col("n_unmapped"),
                F.bround(F.col("unmapped_measure").cast("double"), 0),
                F.col("pct"),
            ),
        ).otherwise("No unmapped rows."),
        evidence="evidence",
    )


def tables_read(label: str, tables: TableSet) -> set[str]:
    """The tables whose rows a check reads; of all others it knows the columns only."""
    refs = tables.refs
    named = {
        "Check 1": set(),
        "Checks 2-3": {rp.FACT, *refs},
        "Check 4": set(refs),
        "Check 5": {rp.FACT, rp.FORECAST, rp.MIN_LOAD},
        "Check 6": {rp.MAPPING},
        "Check 7": {rp.FACT, *rp.RATE_TABLES, rp.TREND, *rp.PATTERN_TABLES, rp.MIN_LOAD},
        "Check 8": {rp.FACT},
    }[label]
    return named & set(tables.names())


# check label -> (section, check names it reports per reference table when degraded, function)
CHECKS: dict[str, tuple[str, tuple[str, ...], Callable[[TableSet, Report], DataFrame]]] = {
    "Check 1": ("check1", ("key_registration",), key_registration),
    "Checks 2-3": ("checks2_5", ("forward_ri", "reverse_ri"), referential_integrity),
    "Check 4": ("checks2_5", ("row_uniqueness",), row_uniqueness),
    "Check 5": ("checks2_5", ("parent_columns",), parent_columns),
    "Check 6": ("check6", (), mapping_uniqueness),
    "Check 7": ("check7", (), value_ranges),
    "Check 8": ("check8", (), key_coverage),
}
