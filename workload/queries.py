"""One registered query per operator, each over whole tables.

Every function takes (spark, sf_dir) and returns a DataFrame whose columns
match the SQL of the same name in :mod:`workload.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabcord.functions.columns import local_rows
from tabcord.functions.durable import materialise, new_path
from tabcord.functions.evidence import top_records
from tabcord.operators import aggregate, compare, coverage, integrity, ranges, shaping, uniqueness
from tabcord.plans import findings as fnd
from tabcord.plans import run
from tabcord.rules import roles
from tabcord.sources import tables as src

from .bindings import (
    SCHEMAS,
    TABLES,
    cents,
    labelled,
    money,
    order_facts,
    order_sales,
    read,
    rule_tables,
    sales,
    yyyymm,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def as_double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def units(name: str) -> Column:
    """Cents as an amount."""
    return F.col(name) / F.lit(100.0)


# --- sources -----------------------------------------------------------------


@query
def load_tables(spark, sf):
    """Open all known tables, skip the missing one, count rows."""
    found, _ = src.load_tables(spark, [*TABLES, "returns"], sf, SCHEMAS)
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        for n, df in found.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out


NOTED = "source string, seg string, bal decimal(18,2)"


@query
def csv_tables(spark, sf):
    """Three tables written as CSV and found by listing; one has no declared types."""
    folder = new_path(spark, "csv")
    for name in ("customer", "supplier", "nation"):
        rows = read(spark, sf, name)
        rows.write.option("header", True).csv(f"{folder}/tbl_{name}.csv")
    declared = {f"tbl_{n}": SCHEMAS[n] for n in ("customer", "supplier", "orders")}
    found, notes = src.csv_tables(spark, folder, declared)
    customer = found["tbl_customer"].select(
        F.lit("tbl_customer").alias("source"),
        F.col("c_mktsegment").alias("seg"),
        money("c_acctbal").alias("bal"),
    )
    supplier = found["tbl_supplier"].select(
        F.lit("tbl_supplier"), F.lit(None).cast("string"), money("s_acctbal")
    )
    noted = local_rows(spark, [(n, None, None) for n in notes], NOTED)
    rows = customer.unionAll(supplier).unionAll(noted)
    return rows.groupBy("source", "seg").agg(
        F.count("bal").alias("n_rows"), F.sum("bal").cast("double").alias("balance")
    )


@query
def preaggregate(spark, sf):
    """Group the fact by the agreed keys, sum the measure."""
    keys = ["seg", "nat", "brand", "ptype"]
    return src.preaggregate(sales(spark, sf), keys, "price").withColumn("price", units("price"))


@query
def preaggregate_exact(spark, sf):
    """A floating measure summed as a decimal, so that the order of rows cannot matter."""
    items = read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    keys = ["l_returnflag", "l_linestatus"]
    rows = src.preaggregate(items, keys, "l_extendedprice", "n_rows", exact="decimal(20,2)")
    return as_double(rows, "l_extendedprice")


@query
def preaggregate_stored(spark, sf):
    """The stored aggregate, read back and summed again."""
    keys = ["seg", "reg", "prio", "month"]
    stored = materialise(src.preaggregate(order_sales(spark, sf), keys, "price"), "fact")
    return stored.groupBy("seg", "reg").agg(
        F.sum("price").cast("double").alias("price"), F.count(F.lit(1)).alias("n_groups")
    )


# --- integrity ---------------------------------------------------------------

@query
def forward_ri_keys(spark, sf):
    """Documents without a label."""
    return integrity.unmatched_keys(*labelled(spark, sf), ["doc_id"])


@query
def forward_ri(spark, sf):
    """Documents without a label, with their length."""
    rows = integrity.unmatched_measure(*labelled(spark, sf), ["doc_id"], "n_chars")
    return as_double(rows, "n_chars")


@query
def forward_ri_top10(spark, sf):
    rows = integrity.unmatched_top(*labelled(spark, sf), ["doc_id"], "n_chars")
    return as_double(rows, "n_chars")


@query
def forward_ri_summary(spark, sf):
    rows = integrity.unmatched_summary(*labelled(spark, sf), ["doc_id"], "n_chars")
    return as_double(rows, "unmatched_measure")


@query
def reverse_ri(spark, sf):
    """Orders without any line item."""
    items = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"))
    return integrity.orphaned_keys(items, orders, ["orderkey"])


@query
def reverse_ri_measure(spark, sf):
    """Customers without any event, with their balance."""
    events = read(spark, sf, "events").select(F.col("user_id").alias("custkey"))
    customers = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"), money("c_acctbal").alias("balance")
    )
    return as_double(
        integrity.orphaned_measure(events, customers, ["custkey"], "balance"), "balance"
    )


@query
def ri_status(spark, sf):
    """Both directions for three reference tables, one row each; line items are read once."""
    items = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_suppkey").alias("suppkey"),
        cents("l_extendedprice").alias("price"),
    )
    refs = {
        "orders": read(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey")),
        "suppliers": read(spark, sf, "supplier").select(F.col("s_suppkey").alias("suppkey")),
    }
    keys = {"orders": ["orderkey"], "suppliers": ["suppkey"]}
    census = integrity.key_census_many(items, refs, keys, "price")
    two = census.groupBy(F.col("ref_table").alias("table_name")).agg(
        *integrity.integrity_counts()
    )
    one = integrity.integrity_summary(*labelled(spark, sf), ["doc_id"], "n_chars")
    names = ["table_name", "n_unmatched", "unmatched_measure", "n_orphaned", "status"]
    both = two.withColumn("unmatched_measure", units("unmatched_measure")).select(*names)
    one = as_double(one.withColumn("table_name", F.lit("labels")), "unmatched_measure")
    return both.unionAll(one.select(*names))


@query
def domain_membership(spark, sf):
    """Nations and balance classes of customers that no supplier has, across number types."""
    size = F.floor(F.col("bal") / 50).alias("balance_class")
    ref = read(spark, sf, "customer").selectExpr("c_nationkey as nation", "c_acctbal as bal")
    fact = read(spark, sf, "supplier").selectExpr(
        "cast(s_nationkey as double) as nation", "s_acctbal as bal"
    )
    rows = integrity.domain_violations(
        ref.select("nation", size),
        fact.select("nation", size.cast("decimal(12,1)").alias("balance_class")),
        ["nation", "balance_class"],
    )
    return rows.select(F.col("column").alias("column_name"), "value")


@query
def key_registration(spark, sf):
    """Event types each (user, nation) table uses that the two target users never register."""
    catalog = read(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("table"),
        F.concat_ws("_", F.lit("Key"), "event_type", F.get_json_object("props", "$.k")).alias(
            "column"
        ),
    )
    return integrity.key_registration(catalog, ["0", "1"], "Key_", ["Key_error_1"]).select(
        F.col("table").alias("table_name"), "key_col", "missing_from"
    )


@query
def natural_join(spark, sf):
    """Orders with customer data on a shared key that is null on some rows of both sides."""
    orders = read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_custkey")).alias("custkey"),
        F.col("o_orderstatus").alias("status"),
    )
    customers = (
        read(spark, sf, "customer")
        .groupBy(F.when(F.col("c_acctbal") <= 9000, F.col("c_custkey")).alias("custkey"))
        .agg(
            F.sum(money("c_acctbal")).cast("double").alias("balance"),
            F.max("c_mktsegment").alias("status"),
        )
    )
    return shaping.natural_join(orders, customers, "left", ["custkey"], "_cust")


@query
def natural_join_outer(spark, sf):
    """Events per user against customers, keeping both sides, safe under hot keys."""
    events = (
        read(spark, sf, "events")
        .groupBy(F.col("user_id").alias("custkey"))
        .agg(F.count(F.lit(1)).alias("n_events"))
    )
    customers = read(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    return shaping.natural_join(events, customers, "outer")


@query
def dataset_compare(spark, sf):
    """Line items against a copy with another tax on returned rows."""
    a, b = _compared(spark, sf)
    return compare.diff(a, b)


@query
def dataset_compare_summary(spark, sf):
    return compare.diff_summary(*_compared(spark, sf))


def _compared(spark, sf):
    a = read(spark, sf, "lineitem")
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    return a, a.withColumn("l_tax", F.when(returned, 0.5).otherwise(F.col("l_tax")))


# --- uniqueness and dependencies -----------------------------------------------


@query
def row_uniqueness(spark, sf):
    items = read(spark, sf, "lineitem")
    return uniqueness.duplicate_keys(items, ["l_orderkey", "l_linenumber"])


@query
def row_uniqueness_variants(spark, sf):
    """Uniqueness keys of each kind of reference table, and what they find."""
    tables = rule_tables(spark, sf)
    fact = tables["tbl_DetailedData"].schema
    parts = []
    for name in ("tbl_RateChange", "tbl_Trend", "tbl_Patterns_Attr", "tbl_Forecast"):
        key = roles.uniqueness_key(name, tables[name].schema, fact)
        found = uniqueness.duplicate_summary(uniqueness.duplicate_keys(tables[name], key))
        parts.append(
            found.select(
                F.lit(name).alias("table_name"),
                F.lit(", ".join(key)).alias("key_cols"),
                "n_duplicates",
                "n_rows",
                "status",
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query
def mapping_uniqueness(spark, sf):
    """Columns other than keys must be unique: brand and type of parts."""
    mapping = read(spark, sf, "part").select(
        "p_brand", "p_type", F.col("p_partkey").alias("Key_Part")
    )
    columns = [c for c in mapping.columns if c not in roles.key_cols(mapping.columns)]
    return uniqueness.duplicate_keys(mapping, columns)


@query
def text_uniqueness(spark, sf):
    """Whole document texts that occur more than once, by digest."""
    return uniqueness.duplicate_digests(read(spark, sf, "documents"), ["text"])


@query
def parent_columns(spark, sf):
    """Which dimensions are functions of brand, nation and priority."""
    rows = uniqueness.parent_violations(
        sales(spark, sf), ["brand", "nat", "prio"], ["ptype", "reg", "seg", "absent"]
    )
    return rows.select("key_col", F.col("column").alias("column_name"), "n_bad_keys", "is_parent")


@query
def forecast_parents(spark, sf):
    """The same rule inside a reference table, with its own key."""
    ref = rule_tables(spark, sf)["tbl_Forecast"]
    rows = uniqueness.parent_violations(
        ref, ["Key_Forecast"], roles.forecast_context(ref.schema)
    )
    return rows.select("key_col", F.col("column").alias("column_name"), "n_bad_keys", "is_parent")


@query
def min_determinant(spark, sf):
    """Smallest lookup of the region from segment, nation and priority."""
    _, submap = uniqueness.minimal_determinant(
        order_facts(spark, sf), "reg", ["seg", "nat", "prio"]
    )
    return submap


# --- ranges, formats, sequences --------------------------------------------------


@query
def band_share(spark, sf):
    items = read(spark, sf, "lineitem").select((F.col("l_discount") - 0.05).alias("rate"))
    rows = ranges.band_share(items, ["rate"], inner=0.025, outer=0.045)
    return rows.withColumnRenamed("column", "column_name")


@query
def trend_share(spark, sf):
    """Two trend columns in one pass, the second on a percentage scale."""
    t = read(spark, sf, "supplier").select(
        (F.col("s_acctbal") / F.lit(20000.0)).alias("Trend_Value"),
        (F.col("s_acctbal") / F.lit(100.0)).alias("Trend_Percent"),
    )
    rows = ranges.band_share(t, ["Trend_Value", "Trend_Percent"])
    return rows.withColumnRenamed("column", "column_name")


@query
def develop_share(spark, sf):
    """Share of each line item in its order total."""
    items, orders = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    pct = items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        (F.col("l_extendedprice") / F.col("o_totalprice")).alias("DevPct_Line"),
        (F.col("l_discount") * 10).alias("DevPct_Discount"),
    )
    rows = ranges.exceed_share(pct, ["DevPct_Line", "DevPct_Discount"])
    return rows.withColumnRenamed("column", "column_name")


@query
def yyyymm_check(spark, sf):
    """Order months; urgent December orders carry an impossible month."""
    bad = (F.col("o_orderpriority") == "1-URGENT") & (F.month("o_orderdate") == 12)
    month = yyyymm("o_orderdate")
    rows = read(spark, sf, "orders").select(F.when(bad, month + 1).otherwise(month).alias("month"))
    names = ["n_distinct", "n_invalid", "status", "sample", "detail"]
    return ranges.yyyymm_check(rows, "month").select(*names)


@query
def sequence_check(spark, sf):
    """Line numbers per order must run from 1 to 7."""
    items = read(spark, sf, "lineitem")
    rows = ranges.sequence_check(items, "l_orderkey", "l_linenumber", min_last=7)
    return rows.select(
        "l_orderkey",
        F.col("first").alias("first_pos"),
        F.col("last").alias("last_pos"),
        "n_gaps",
        "gaps",
        "reasons",
    )


@query
def numeric_share(spark, sf):
    """Numbers inside JSON, and part names, which are no numbers."""
    cells = read(spark, sf, "events").select(
        F.get_json_object("props", "$.k").alias("k"),
        F.col("value").cast("string").alias("value"),
        F.col("event_type").alias("kind"),
    )
    rows = ranges.numeric_share(cells, ["k", "value", "kind"], ceiling=95)
    return rows.withColumnRenamed("column", "column_name")


# --- coverage --------------------------------------------------------------------


def _covered(spark, sf):
    return order_sales(spark, sf).select(
        "seg",
        "reg",
        F.when(F.col("prio") != "4-NOT SPECIFIED", F.col("prio")).alias("Key_Prio"),
        F.when(F.col("reg") == "ASIA", "\t ").otherwise(F.col("reg")).alias("Key_Region"),
        "price",
        "n_rows",
    )


@query
def coverage_share(spark, sf):
    rows = coverage.unmapped_share(
        _covered(spark, sf), ["Key_Prio", "Key_Region"], "price", "n_rows"
    )
    out = as_double(rows, "unmapped_measure", "total_measure")
    return out.withColumnRenamed("column", "column_name")


@query
def coverage_breakdown(spark, sf):
    """Both unmapped keys by segment and region, against the whole measure."""
    rows = coverage.unmapped_breakdown(
        _covered(spark, sf), ["Key_Prio", "Key_Region"], ["seg", "reg"], "price"
    )
    return as_double(rows, "price").withColumnRenamed("column", "column_name")


# --- aggregation -----------------------------------------------------------------


def _ratio_items(spark, sf):
    return read(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("Segment"),
        F.col("l_orderkey"),
        F.col("l_discount").alias("ULR_Attr"),
        cents("l_extendedprice").alias("Ult_Premium"),
    )


@query
def weighted_ratio(spark, sf):
    """Mean discount weighted by price, recalculated per return flag."""
    items = _ratio_items(spark, sf).drop("l_orderkey")
    plan = aggregate.plan_aggregation(items.schema, ["Segment"])
    out = aggregate.mixed_aggregate(items, plan)
    return out.select(
        "Segment",
        F.round("ULR_Attr", 9).alias("ULR_Attr"),
        units("Ult_Premium").alias("Ult_Premium"),
    )


@query
def mixed_aggregate(spark, sf):
    """Sums, means, a kept value and derived ratios in one group-by."""
    items = read(spark, sf, "lineitem")
    order = F.col("l_orderkey") * 8 + F.col("l_linenumber")  # equal numbers keep equal values
    price, quantity = cents("l_extendedprice"), cents("l_quantity")
    t = items.select(
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("Segment"),
        F.col("l_linestatus").alias("Status"),
        F.col("l_linenumber").cast("long").alias("DevM"),
        order.alias("pos"),
        price.alias("Ult_Premium"),
        price.alias("Incd_OL_Attr"),
        quantity.alias("Ult_OL_Attr_IncdCL"),
        (quantity * 0).alias("Ult_OL_Large_IncdCL"),
        quantity.alias("Incd_OL_Large"),
        F.col("l_tax").alias("OLFactor_Premium"),
        F.col("l_tax").alias("OLFactor_PY_Premium"),
        F.col("l_discount").alias("DevPct_Attr"),
    )
    plan = aggregate.plan_aggregation(t.schema, ["Segment", "Status"])
    out = aggregate.mixed_aggregate(t, plan, order_col="pos")
    ratios = [c for c in out.columns if c.startswith(("OLFactor", "DevPct"))]
    return out.select(
        "Segment",
        "Status",
        "DevM",
        *[units(c).alias(c) for c in plan.sums],
        *[F.round(c, 6).alias(c) for c in ratios],
    )


# --- shaping -----------------------------------------------------------------------


@query
def in_use(spark, sf):
    """Placeholder report over two tables, one of them all placeholders."""
    customer = read(spark, sf, "customer")
    named = F.when(F.col("c_mktsegment") == "BUILDING", "Not in use").otherwise(
        F.col("c_mktsegment")
    )
    return shaping.placeholder_report(
        {
            "customer": customer.select(named.alias("Key_Segment")),
            "nation": read(spark, sf, "nation").select(F.lit("Dummy").alias("Key_Nation")),
            "orders": read(spark, sf, "orders").select("o_orderkey"),
        }
    ).withColumnRenamed("table", "table_name")


@query
def placeholder_fill(spark, sf):
    """An empty table gets its placeholder row, a used one stays."""
    part = read(spark, sf, "part").select(F.col("p_brand").alias("Key_Brand"), "p_size")
    note = F.lit("kept").alias("Comments")
    filled = shaping.fill_empty_tables(
        {
            "used": part.select("*", note),
            "empty": part.where("p_size < 0").select("*", note),
        }
    )
    parts = [
        df.groupBy("Key_Brand", "Comments")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("p_size").alias("n_sizes"))
        .select(F.lit(n).alias("table_name"), "Key_Brand", "Comments", "n_rows", "n_sizes")
        for n, df in filled.items()
    ]
    return parts[0].unionAll(parts[1])


def _periods(spark, sf):
    """Per customer the span of order years, without the years of the urgent orders."""
    year = F.year("o_orderdate")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", year)
    spans = (
        read(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(
            F.min(year).alias("a"),
            F.max(year).alias("b"),
            F.min(urgent).alias("c"),
            F.max(urgent).alias("d"),
        )
    )
    base = F.concat_ws("-", "a", "b")
    excluded = F.when(F.col("c") == F.col("d"), F.col("c").cast("string")).otherwise(
        F.concat_ws("-", "c", "d")
    )
    text = F.when(F.col("c").isNull(), base).otherwise(F.concat(base, F.lit(" ex "), excluded))
    return spans.select("o_custkey", text.alias("period"))


@query
def period_expand(spark, sf):
    """Every customer's averaging period as years, with the excluded ones marked."""
    return shaping.period_years(_periods(spark, sf), "period")


@query
def period_suffix(spark, sf):
    rows = _periods(spark, sf).select(shaping.period_suffix(F.col("period")).alias("suffix"))
    return rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("n_customers"))


@query
def display_projection(spark, sf):
    """Duplicated reference rows, cut down to the columns that are shown."""
    tables = rule_tables(spark, sf)
    ref, fact = tables["tbl_Patterns_Attr"], tables["tbl_DetailedData"]
    rate = tables["tbl_RateChange_Pol"]
    d = uniqueness.duplicate_keys(rate, ["Key_RateChange", "RateChange"])
    assert roles.display_cols(ref.schema, fact.schema) == ["Key_Pattern_Attr"]
    return shaping.display_columns(d, roles.display_cols(rate.schema, fact.schema), ["n_rows"])


@query
def evidence_records(spark, sf):
    """The ten brand and type combinations with most duplicates, as JSON records."""
    part = read(spark, sf, "part")
    d = uniqueness.duplicate_keys(part, ["p_brand", "p_type"])
    return top_records(d, ["-n_rows", "p_brand", "p_type"], 10)


# --- findings of a whole run ---------------------------------------------------------


def run_findings(spark: SparkSession, sf: str, *checks: str) -> run.Run:
    """A run over the rule-pack tables, of all checks or those named."""
    tables = src.TableSet.classify(rule_tables(spark, sf))
    return run.run_checks(tables, checks=checks) if checks else run.run_checks(tables)


TABLE_CHECKS = ("Checks 2-3", "Check 4", "Check 5")


@query
def consistency_run(spark, sf):
    """All eight checks over the rule-pack tables: one row per finding."""
    return run_findings(spark, sf).findings.select(
        "section",
        F.col("check").alias("check_name"),
        F.col("table").alias("table_name"),
        F.col("column").alias("column_name"),
        F.array_join("key_cols", ", ").alias("key_cols"),
        "status",
        "n_bad",
        units("measure_bad").alias("measure_bad"),
        F.bround("pct", 1).alias("pct"),
    )


KEY_FIELDS = {
    "key_rate": "Key_RateChange",
    "product": "ProductType",
    "key_trend": "Key_Trend",
    "key_pattern": "Key_Pattern_Attr",
    "key_modelling": "Key_Modelling",
    "region": "Region",
}


def _loose(spark, sf, check: str):
    """All rows behind the integrity findings of one direction, their keys as columns."""
    rows = run_findings(spark, sf, "Checks 2-3").details.where(F.col("check") == check)
    fields = [F.get_json_object("record", f"$.{f}").alias(n) for n, f in KEY_FIELDS.items()]
    measure = units("measure").alias("measure")
    return rows.select(F.col("table").alias("table_name"), *fields, measure)


@query
def run_unmatched(spark, sf):
    """Every fact key that a reference table lacks, with its premium."""
    return _loose(spark, sf, "forward_ri")


@query
def run_orphans(spark, sf):
    """Every reference key that no fact has."""
    return _loose(spark, sf, "reverse_ri")


@query
def run_breakdown(spark, sf):
    """Unmapped premium of both modelling keys by every identifier combination."""
    rows = run_findings(spark, sf, "Check 8").details
    ids = {"segment": "Segment", "region": "Region", "nation": "Nation"}
    return rows.select(
        F.col("column").alias("column_name"),
        *[F.get_json_object("record", f"$.{f}").alias(n) for n, f in ids.items()],
        units("measure").alias("measure"),
        "pct",
    )


@query
def table_records(spark, sf):
    """One record per reference table: its checks together, and what they found."""
    rows = run_findings(spark, sf, *TABLE_CHECKS).records
    return rows.select("check_id", "label", F.col("table").alias("table_name"), "status", "summary")


@query
def table_rollup(spark, sf):
    """Worst status per table over integrity, uniqueness and parent checks."""
    found = run_findings(spark, sf, *TABLE_CHECKS).findings
    rows = fnd.table_rollup(found).where("section = 'checks2_5'")
    return rows.select(F.col("table").alias("table_name"), "status")


@query
def section_rollup(spark, sf):
    """Status and summary sentence per section."""
    return run_findings(spark, sf).sections.select("section", "status", "n_checks", "summary")


@query
def run_rollup(spark, sf):
    """Status of the run, and the older rule without SKIP."""
    found = run_findings(spark, sf)
    app = fnd.run_rollup(found.sections).select(F.lit("sections").alias("rule"), "status")
    return app.unionAll(
        fnd.overall_status(found.findings).select(F.lit("findings").alias("rule"), "status")
    )


@query
def findings_payload(spark, sf):
    """The run written as JSON and read back."""
    found, path = run_findings(spark, sf), new_path(spark, "payload")
    found.write(path, "json")
    back = spark.read.schema(fnd.FINDING).json(f"{path}/findings")
    return fnd.rollup(back, ["section", "check"]).select(
        "section", F.col("check").alias("check_name"), "status", "n_checks"
    )


@query
def degraded_run(spark, sf):
    """A check that cannot run becomes a warning; the other checks still report."""
    tables = rule_tables(spark, sf)
    fact = order_sales(spark, sf).select(
        F.col("nat").alias("Key_Trend"), F.col("price").alias("Premium")
    )
    clash = tables["tbl_Trend"].withColumn("Key_Trend", F.lit("2020-01-01").cast("date"))
    chosen = {"tbl_DetailedData": fact, "tbl_Trend": clash}
    found = run.run_checks(src.TableSet.classify(chosen))
    return found.sections.select("section", "status", F.size("warnings").alias("n_warnings"))


from . import growing  # noqa: E402,F401  (registers its queries)
