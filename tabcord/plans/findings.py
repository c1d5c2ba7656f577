"""The findings table and its rollups to table, section and run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, local_rows
from ..rules import rulepack as rp

FINDING = T.StructType(
    [
        T.StructField("section", T.StringType()),
        T.StructField("check", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("key_cols", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("n_bad", T.LongType()),
        T.StructField("measure_bad", T.DoubleType()),
        T.StructField("pct", T.DoubleType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("detail", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("warning", T.StringType()),
    ]
)

DEGRADED = "degraded"  # stands in for a check without findings that could not run

# Fixed value: precedence of statuses, the highest wins.
SEVERITY = ("SKIP", "PASS", "WARNING", "FAIL")


def as_findings(df: DataFrame, section: str, check: str, **values: Column | str) -> DataFrame:
    """Shape any operator result into findings; unnamed fields are null."""
    values = {"section": F.lit(section), "check": F.lit(check), **values}
    cells = []
    for f in FINDING.fields:
        v = values.get(f.name, F.lit(None))
        cells.append((col(v) if isinstance(v, str) else v).cast(f.dataType).alias(f.name))
    return df.select(*cells)


def stated(spark: SparkSession, rows: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Findings known from the schemas alone, one per table at most."""
    names = FINDING.fieldNames()
    return local_rows(spark, [tuple(r.get(n) for n in names) for r in rows], FINDING)


def metrics(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("double"))]
    return F.create_map(*pairs)


def severity(status: Column) -> Column:
    """Rank of a status; an unknown text counts as SKIP."""
    rank = F.lit(0)
    for i, name in enumerate(SEVERITY):
        rank = F.when(status == name, i).otherwise(rank)
    return rank


def worst(status: Column, skip_as_pass: bool = False) -> Column:
    """Aggregate: the most severe status, SKIP over nothing."""
    rank = F.coalesce(F.max(severity(status)), F.lit(0))
    if skip_as_pass:
        rank = F.greatest(rank, F.lit(SEVERITY.index("PASS")))
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), rank + 1)


def rollup(findings: DataFrame, by: Sequence[str], skip_as_pass: bool = False) -> DataFrame:
    """Worst status and number of findings of each status, per group."""
    status = F.col("status")
    return findings.groupBy(*[col(b) for b in by]).agg(
        worst(status, skip_as_pass).alias("status"),
        F.count(F.lit(1)).alias("n_checks"),
        *[F.count_if(status == s).alias(f"n_{s.lower()}") for s in reversed(SEVERITY)],
    )


def table_rollup(findings: DataFrame) -> DataFrame:
    """One row per check as reported: table checks are combined per table."""
    per_table = F.col("section") == "checks2_5"
    return findings.where(F.col("check") != DEGRADED).select(
        "section",
        F.when(~per_table, F.col("check")).alias("check"),
        "table",
        F.when(~per_table, F.col("column")).alias("column"),
        "status",
    ).groupBy("section", "check", "table", "column").agg(worst(F.col("status")).alias("status"))


# Labels of the records by section or check.
RECORD_LABELS = {
    "check1": "Key column registration",
    "checks2_5": "RI / Uniqueness / Parent columns",
    "check6": "Non-Key_* uniqueness",
    "check7": "Value range",
    "check8": "Key_Modelling coverage",
}
ALL_PASSED = "All checks passed."


def check_records(findings: DataFrame) -> DataFrame:
    """One row per check as reported: id, label, table, column, status and summary.

    The checks of a reference table are combined; their summary joins the
    sentences of those that found something.
    """
    per_table = F.col("section") == "checks2_5"
    place = F.array_position(
        F.array(*map(F.lit, ("forward_ri", "reverse_ri", "row_uniqueness", "parent_columns"))),
        F.col("check"),
    )
    told = (F.col("n_bad") > 0) & (place > 0) & F.col("detail").isNotNull()
    sentence = F.when(~per_table | told, F.struct(place.alias("place"), "detail"))
    target = F.concat_ws(" / ", "table", F.when(~per_table, F.col("column")))
    spot = record_id(per_table)
    label = F.create_map(*[F.lit(x) for pair in RECORD_LABELS.items() for x in pair])
    rows = findings.where(F.col("check") != DEGRADED).select(
        "section",
        F.when(~per_table, F.col("check")).alias("check"),
        F.concat_ws(" — ", label[F.col("section")], target).alias("label"),
        spot.alias("check_id"),
        "table",
        F.when(~per_table, F.col("column")).alias("column"),
        "status",
        sentence.alias("sentence"),
    )
    # a handful of sentences per record
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list("sentence")), lambda s: s["detail"]), "; "
    )
    return rows.groupBy("section", "check", "check_id", "label", "table", "column").agg(
        worst(F.col("status")).alias("status"),
        F.when(joined == "", F.lit(ALL_PASSED)).otherwise(joined).alias("summary"),
    )


def record_id(per_table: Column) -> Column:
    """The id under which a finding is reported: table checks share one per table."""
    return F.concat_ws(".", "section", "table", F.when(~per_table, F.col("column")))


def nested(
    findings: DataFrame, sections: DataFrame, records: DataFrame, metadata: DataFrame
) -> DataFrame:
    """One row: status, summary, metadata and warnings of a run, sections with checks with findings.

    All of it is bounded by the schemas and the evidence shown; full details
    are a table of their own.
    """
    per_table = F.col("section") == "checks2_5"
    shown = [c for c in FINDING.fieldNames() if c not in ("section", "table")]
    own = findings.where(F.col("check") != DEGRADED).groupBy(
        record_id(per_table).alias("of"),
        F.when(~per_table, F.col("check")).alias("of_check"),
    )
    # a map has no order, so findings are sorted by what comes before it
    order = F.struct("check", "column", F.struct(*shown).alias("finding"))
    held = own.agg(F.collect_list(order).alias("findings")).withColumn(
        "findings",
        F.transform(
            F.array_sort(
                "findings",
                lambda a, b: F.when(a["check"] < b["check"], -1)
                .when(a["check"] > b["check"], 1)
                .when(a["column"] < b["column"], -1)
                .when(a["column"] > b["column"], 1)
                .otherwise(0),
            ),
            lambda f: f["finding"],
        ),
    )
    same = (F.col("check_id") == F.col("of")) & F.col("check").eqNullSafe(F.col("of_check"))
    checks = records.join(held, same, "left").select(
        "section",
        F.struct("check_id", "label", "table", "column", "status", "summary", "findings").alias("c"),
    )
    per_section = checks.groupBy(F.col("section").alias("of_section")).agg(
        F.collect_list("c").alias("checks")
    )
    by_id = lambda a, b: F.when(a["check_id"] < b["check_id"], -1).when(
        a["check_id"] > b["check_id"], 1
    ).otherwise(0)
    whole = (
        sections.join(per_section, F.col("section") == F.col("of_section"), "left")
        .select(
            F.struct(
                "position",
                "section",
                "label",
                "status",
                "summary",
                F.array_sort(F.coalesce("checks", F.array()), by_id).alias("checks"),
                "warnings",
            ).alias("s")
        )
        .agg(
            F.array_sort(
                F.collect_list("s"), lambda a, b: (a["position"] - b["position"]).cast("int")
            ).alias("sections")
        )
    )
    named = ("started_at_utc", "completed_at_utc", "runtime_ms", "dataset_count", "dataset_names")
    return metadata.select(
        "status",
        "summary",
        F.struct(*named).alias("metadata"),
        whole.scalar().alias("sections"),
        "warnings",
        "errors",
    )


def summary_text(unit: Column) -> Column:
    """``N unit: a FAIL, b WARNING, c PASS.`` over the counts of a rollup."""
    counts = F.concat_ws(
        ", ",
        *[
            F.when(col(f"n_{s.lower()}") > 0, F.format_string(f"%d {s}", col(f"n_{s.lower()}")))
            for s in ("FAIL", "WARNING", "PASS")
        ],
    )
    head = F.format_string("%d %s", F.col("n_checks"), unit)
    return F.when(counts == "", F.concat(head, F.lit("."))).otherwise(
        F.concat(head, F.lit(": "), counts, F.lit("."))
    )


def section_rollup(findings: DataFrame) -> DataFrame:
    """Status and summary per section; a section without checks is SKIP.

    A warning on a section (a check that could not run) lifts SKIP to WARNING.
    """
    spark = findings.sparkSession
    sections = local_rows(
        spark,
        [(i, s, label, unit) for i, (s, (label, unit)) in enumerate(rp.SECTIONS.items())],
        "position int, section string, label string, unit string",
    )
    checks = rollup(table_rollup(findings), ["section"])
    warned = findings.groupBy("section").agg(
        F.array_sort(F.collect_set("warning")).alias("warnings"),
        F.max(F.when(F.col("section") == "check6", F.col("detail"))).alias("only_detail"),
    )
    counts = ["n_checks", *[f"n_{s.lower()}" for s in SEVERITY]]
    joined = (
        sections.join(checks, "section", "left")
        .join(warned, "section", "left")
        .fillna(0, counts)
    )
    status = F.coalesce(F.col("status"), F.lit("SKIP"))
    has_warning = F.size(F.coalesce("warnings", F.array())) > 0
    return joined.select(
        "position",
        "section",
        "label",
        F.when(has_warning & (status == "SKIP"), "WARNING").otherwise(status).alias("status"),
        F.coalesce("only_detail", summary_text(F.col("unit"))).alias("summary"),
        *counts,
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
    )


def run_rollup(sections: DataFrame, run_warnings: int = 0) -> DataFrame:
    """Worst section status; any run warning lifts PASS and SKIP to WARNING."""
    out = sections.agg(worst(F.col("status")).alias("status"))
    if run_warnings:
        status = F.col("status")
        out = out.select(
            F.when(status.isin("PASS", "SKIP"), "WARNING").otherwise(status).alias("status")
        )
    return out


def overall_status(findings: DataFrame) -> DataFrame:
    """Worst status over single findings, where SKIP counts as PASS."""
    return findings.agg(worst(F.col("status"), skip_as_pass=True).alias("status"))
