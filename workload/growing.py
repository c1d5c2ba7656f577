"""Queries on tables that come untyped, change, or are compared: one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabcord.functions import exact
from tabcord.functions.columns import aggregate_to_long, col
from tabcord.functions.durable import materialise, new_path, remove
from tabcord.operators import compare, determinants, integrity, shaping, uniqueness
from tabcord.plans import resume
from tabcord.plans.scenarios import Scenario
from tabcord.plans.scenarios import scenario_matrix as matrix
from tabcord.sources import inference, kept
from tabcord.sources.tables import TableSet

from .bindings import cents, order_facts, read, rule_tables, sales
from .queries import _periods, query, run_findings, units

#: Tables whose types are found from their cells.
UNTYPED = ("customer", "part", "orders")


def digest(df: DataFrame, name: str):
    """A whole number over all values of a column, whatever its type."""
    kind, c = df.schema[name].dataType, col(name)
    if isinstance(kind, T.StringType):
        value = F.length(c)
    elif isinstance(kind, T.TimestampNTZType):
        value = F.unix_timestamp(c.cast("timestamp"))
    else:
        value = F.rint(c * 100)
    return F.coalesce(F.sum(value.cast("decimal(20,0)")), F.lit(0)).cast("bigint")


@query
def csv_inferred(spark, sf):
    """Three tables written as CSV and opened without declared types: types, counts, digests."""
    folder = new_path(spark, "untyped")
    for name in UNTYPED:
        rows = read(spark, sf, name).write.option("header", True).option("escape", '"')
        rows.csv(f"{folder}/tbl_{name}.csv")
    paths = {n: f"{folder}/tbl_{n}.csv" for n in UNTYPED}
    found = inference.open_inferred(spark, paths, decimals=True, dates=True)
    out = None
    for name, df in found.items():
        profile = aggregate_to_long(
            df,
            [
                F.struct(
                    F.lit(name).alias("table_name"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("type"),
                    F.count(col(f.name)).alias("n_values"),
                    digest(df, f.name).alias("digest"),
                )
                for f in df.schema.fields
            ],
        )
        out = profile if out is None else out.unionAll(profile)
    return out


def _fact_folder(spark, sf, folder: str, factor: int, buckets: list[int]) -> None:
    """Line items of some buckets as files of a fact folder.

    Every task writes the rows it reads: none holds or sorts those of a bucket.
    """
    bucket = F.pmod("l_orderkey", F.lit(8)).cast("int")
    rows = read(spark, sf, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        F.year("l_shipdate").alias("ship_year"),
        (cents("l_extendedprice") * factor).alias("price"),
        bucket.alias("bucket"),
    )
    for b in buckets:
        own = rows.where(F.col("bucket") == b).drop("bucket")
        own.write.mode("overwrite").parquet(f"{folder}/bucket={b}")


@query
def preaggregate_delta(spark, sf):
    """Kept sums after files were added, changed and removed; only those files are read again."""
    folder = new_path(spark, "fact")
    sums = kept.KeptAggregate(
        spark,
        folder,
        new_path(spark, "kept"),
        ["l_returnflag", "l_linestatus", "ship_year"],
        "price",
    )
    _fact_folder(spark, sf, folder, 1, [0, 1, 2, 3, 4, 5])
    sums.refresh()
    remove(spark, f"{folder}/bucket=1")
    _fact_folder(spark, sf, folder, 2, [2])
    _fact_folder(spark, sf, folder, 1, [6, 7])
    return sums.refresh().withColumn("price", units("price"))


@query
def preaggregate_binned(spark, sf):
    """Discounted prices as doubles, summed exactly whatever the order of rows."""
    items = read(spark, sf, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
    )
    return exact.exact_sums(items, ["l_returnflag", "l_linestatus"], ["net"], "n_rows")


@query
def ri_census_tree(spark, sf):
    """Raw sales against four reference tables whose keys overlap; sales are grouped once."""
    fact = sales(spark, sf).select("brand", "ptype", "nat", "seg", "price")
    part, customer = read(spark, sf, "part"), order_facts(spark, sf)
    refs = {
        "products": part.where("p_size > 3").select(
            F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype")
        ),
        "brands": part.select(F.concat("p_brand", F.when(F.col("p_size") > 45, "x").otherwise("")).alias("brand")),
        "buyers": customer.where("bal >= 0").select("nat", "seg"),
        "markets": customer.select(
            "nat", "seg", F.concat(F.lit("Brand#"), F.length("reg").cast("string"), F.lit("1")).alias("brand")
        ),
    }
    keys = {
        "products": ["brand", "ptype"],
        "brands": ["brand"],
        "buyers": ["nat", "seg"],
        "markets": ["nat", "seg", "brand"],
    }
    census = integrity.key_census_tree(fact, refs, keys, "price")
    rows = census.groupBy(F.col("ref_table").alias("table_name")).agg(
        *integrity.integrity_counts()
    )
    return rows.select(
        "table_name",
        "n_unmatched",
        units("unmatched_measure").alias("unmatched_measure"),
        "n_orphaned",
        "status",
    )


@query
def parent_conflicts(spark, sf):
    """The values behind brands with several product types and nations with several segments."""
    rows = uniqueness.parent_conflicts(
        sales(spark, sf), [("brand", "ptype"), ("nat", "seg"), ("nat", "reg")]
    )
    return rows.withColumnRenamed("column", "column_name")


@query
def all_determinants(spark, sf):
    """Every minimal set of order columns that determines the region of the buyer."""
    rows = order_facts(spark, sf)
    found = determinants.all_determinants(rows, "reg", ["seg", "nat", "prio", "month", "bal"])
    return found.select(F.array_join("columns", ", ").alias("column_names"), "n_columns")


@query
def scenario_matrix(spark, sf):
    """All checks under five scenarios, in one plan."""
    tables = rule_tables(spark, sf)
    fact = materialise(tables["tbl_DetailedData"], "fact")
    building = fact.where("Segment = 'BUILDING'")
    pattern, mapping = tables["tbl_Patterns_Attr"], tables["tbl_Key_Mapping"]
    scenarios = [
        Scenario("baseline"),
        Scenario("absent", dropped=frozenset({"tbl_Trend", "tbl_Forecast"})),
        Scenario(
            "months",
            {"tbl_DetailedData": building.withColumn("AsAt_Month", F.lit(202513))},
            {"tbl_DetailedData": building},
        ),
        Scenario("gap", removed={"tbl_Patterns_Attr": pattern.where("DevM > 1 AND DevM < 12")}),
        Scenario("copies", {"tbl_Key_Mapping": mapping.where("Segment = 'MACHINERY'")}),
    ]
    rows = matrix(TableSet.classify({**tables, "tbl_DetailedData": fact}), scenarios)
    return rows.select(
        "scenario",
        "section",
        F.col("check").alias("check_name"),
        F.col("table").alias("table_name"),
        F.col("column").alias("column_name"),
        "status",
        "n_bad",
    )


UNIQUE_CHECKS = ("Check 4", "Check 6")


@query
def resumed_run(spark, sf):
    """A run after the mapping changed: what it found, and which checks it had to repeat."""
    tables, path = rule_tables(spark, sf), new_path(spark, "resumed")
    resume.resumed_run(TableSet.classify(tables), path, checks=UNIQUE_CHECKS)
    mapping = tables["tbl_Key_Mapping"]
    tables["tbl_Key_Mapping"] = mapping.unionByName(mapping.where("Segment = 'MACHINERY'"))
    found = resume.resumed_run(TableSet.classify(tables), path, checks=UNIQUE_CHECKS)
    repeated = {r["label"] for r in found.timings.collect() if r["ms"]}  # two rows
    section = F.when(F.col("section") == "check6", "Check 6").otherwise("Check 4")
    return found.findings.select(
        "section",
        F.col("check").alias("check_name"),
        F.col("table").alias("table_name"),
        "status",
        "n_bad",
        section.isin(*repeated).alias("repeated"),
    )


@query
def nested_payload(spark, sf):
    """The uniqueness checks as one JSON document, read back and taken apart again."""
    found = run_findings(spark, sf, *UNIQUE_CHECKS).payload()
    place = new_path(spark, "payload")
    found.select(F.to_json(F.struct("*")).alias("value")).write.text(place)
    whole = spark.read.schema(found.schema).json(place)
    sections = whole.select("status", F.explode("sections").alias("s"))
    checks = sections.select("status", "s", F.explode("s.checks").alias("c"))
    return checks.select("status", "s", "c", F.explode("c.findings").alias("f")).select(
        F.col("status").alias("run_status"),
        F.col("s.section").alias("section"),
        F.col("s.status").alias("section_status"),
        F.col("c.check_id").alias("check_id"),
        F.col("c.status").alias("status"),
        F.col("f.check").alias("check_name"),
        F.col("f.n_bad").alias("n_bad"),
    )


def _profiles(spark, sf, kept_orders, balance):
    """Customers with a struct, a map and a list of structs about their orders."""
    orders = read(spark, sf, "orders").where(kept_orders)
    by = lambda c, name: orders.groupBy("o_custkey", c.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    prio = by(F.col("o_orderpriority"), "p").groupBy("o_custkey").agg(
        F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("prio")
    )
    years = by(F.year("o_orderdate"), "y").groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct("y", "n"))).alias("years")
    )
    return (
        read(spark, sf, "customer")
        .select(
            F.col("c_custkey").alias("custkey"),
            F.struct(F.col("c_mktsegment").alias("seg"), balance.alias("bal")).alias("who"),
        )
        .join(prio, F.col("custkey") == F.col("o_custkey"), "left")
        .drop("o_custkey")
        .join(years, F.col("custkey") == F.col("o_custkey"), "left")
        .drop("o_custkey")
    )


@query
def nested_compare(spark, sf):
    """Customer profiles with and without urgent orders, and with another balance in one nation."""
    bal = F.col("c_acctbal")
    left = _profiles(spark, sf, F.lit(True), bal)
    moved = F.when(F.col("c_nationkey") == 3, bal + 1).otherwise(bal)
    right = _profiles(spark, sf, F.col("o_orderpriority") != "1-URGENT", moved)
    return compare.nested_compare(left, right, ["custkey"]).select(
        "custkey",
        "path",
        # numbers as written by either engine are compared by value
        *[F.coalesce(F.col(c).try_cast("double").cast("decimal(18,2)").cast("string"), c).alias(c)
          for c in ("left_value", "right_value")],
        "change",
    )


@query
def period_join(spark, sf):
    """Orders within the averaging period of their customer: number and value."""
    orders = read(spark, sf, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("order_year"), cents("o_totalprice").alias("price")
    )
    inside = shaping.period_join(
        orders, "order_year", _periods(spark, sf), "period", ["o_custkey"]
    )
    return inside.groupBy("o_custkey", "period").agg(
        F.count(F.lit(1)).alias("n_orders"), (F.sum("price") / F.lit(100.0)).alias("price")
    )
